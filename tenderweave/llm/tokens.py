"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds equal-length sequences: column ids is a fixed-size list of unsigned integers (16 bits
where the vocabulary allows it), column mask a fixed-size list of booleans (false: padding of the
file's last sequence). Offsets of a sequence follow from its number alone, so a mapped file gives
any sequence and its mask without copying or decoding. The schema's metadata says the length, the
tokens of the file and its documents: 12 bytes each, doc_id and number of ids.

Documents are range-partitioned and sorted by doc_id; a task writes one file through pyarrow's file
system of the target (local, HDFS, object stores) under a name of its own and returns a manifest
row. Only files of the manifest count, so what lost or repeated tasks leave is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

LENGTH = 2048
CACHE_PARTS = 800_000
PARTS = 1024
PART_BYTES = 64 << 20
FILE_BYTES = 32 << 20
TEXT_BYTES = 4 << 20

#: What a byte of a text is: ASCII white space, part of a Latin letter that normal form C leaves alone once it is lower case
#: (ASCII or Latin-1), a digit, an ASCII sign but for ' and <, or anything else. A byte of 0x80 to 0xBF behind other than 0xC3
#: is in a word that has something else anyway. Runs of letters, runs of signs and single digits tokenise apart.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kind(c: int) -> int:
    if c in b" \t\n\r\x0b\x0c":
        return _SPACE
    if chr(c).isascii():
        return _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN if chr(c).isprintable() and c not in b"'<" else _OTHER
    return _LETTER if c == 0xC3 or 0x80 <= c <= 0xBF and c not in b"\x97\xb7" else _OTHER


_KINDS = bytes(map(_kind, range(256)))
#: Lower case of ASCII letters and of the second byte of Latin-1 letters; what it makes of other characters is not used.
_SMALL = bytes(c + 32 if chr(c).isascii() and chr(c).isupper() or 0x80 <= c <= 0x9E and c != 0x97 else c for c in range(256))


def joins_no_words(tokenizer) -> bool:
    """Whether its rules are the ones by which words can be tokenised one by one: lower case, normal form
    C, white space alike and never inside a token."""
    rules = json.loads(tokenizer.to_str())
    before, split = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    kinds = sorted(n.get("type", "") for n in before.get("normalizers", []))
    spaces = [n for n in before.get("normalizers", []) if n.get("type") == "Replace"]
    parts = split.get("pretokenizers", [])
    return (
        kinds == ["Lowercase", "NFC", "Replace"]
        and [(n["pattern"], n["content"]) for n in spaces] == [({"Regex": "\\s+"}, " ")]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert") is True
        and not parts[1].get("add_prefix_space")
        and not any(" " in t["content"] or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in rules.get("added_tokens", []))
    )


class WordEncoder:
    """Ids of texts, as bytes. Where the tokenizer never joins anything across white space, a text's ids are those of its
    parts one after the other: runs of letters or signs, digits, and whole words that hold anything else. The different parts
    of the texts of a call are looked up once each, and the unknown ones tokenised together. Forgets all at CACHE_PARTS, or
    16 times as many ids. A tokenizer of other rules gets whole texts."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.by_word = joins_no_words(self.tokenizer)
        self._forget()
        if self.by_word:  # parts of letters, signs and digits are normal and split already
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _forget(self) -> None:
        self.parts: dict[bytes, int] = {}  # the number of each part; its ids are sizes[number] of ids from starts[number]
        self.ids, self.starts, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        every = [t.encode("utf-8") if t else b"" for t in texts]
        text = b"\n".join(every)
        begins, data = _parts(text)
        if not len(begins):
            return [b""] * len(texts)
        coded = data.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.sizes[number]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[number] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        starts = np.cumsum([0, *(len(t) + 1 for t in every)])  # of the texts
        bounds = np.concatenate([[0], ends])[np.searchsorted(begins, starts)] * np.dtype(self.dtype).itemsize
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        if len(self.parts) > CACHE_PARTS or len(self.ids) > 16 * CACHE_PARTS:
            self._forget()
        numbers = np.fromiter(map(self.parts.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = [parts[k] for k in missing.tolist()]
            self._learn(new)
            numbers[missing] = [*map(self.parts.__getitem__, new)]
        return numbers

    def _learn(self, new: list[bytes]) -> None:
        whole = [_OTHER in p.translate(_KINDS) for p in new]
        others, plain = [*compress(new, whole)], [p for p, w in zip(new, whole) if not w]
        found = [self._plain(plain[k : k + 4096]) for k in range(0, len(plain), 4096)]
        found += [self._whole(others[k : k + 1024]) for k in range(0, len(others), 1024)]
        sizes = np.concatenate([s for _, s in found])
        first = len(self.parts)
        self.parts.update(zip(plain + others, range(first, first + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *(i for i, _ in found)])

    def _plain(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each part is one word to the tokenizer, so one text of them all gives the ids of each: a word's last id says so."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(parts).decode("utf-8")], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):  # never seen: a part that is several words, or none
            return self._whole(parts)
        return ids, np.diff(ends, prepend=0)

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]
        return np.array([*chain.from_iterable(found)], self.dtype), np.array([*map(len, found)], np.int64)


def _parts(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Where the parts of a text begin, and the parts: lower case, or as they are where they hold anything else."""
    kinds, small = (np.frombuffer(text.translate(t), np.uint8) for t in (_KINDS, _SMALL))
    begins = np.flatnonzero(np.concatenate([[len(text) > 0], (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)]))
    kind = kinds[begins]
    if (kind == _OTHER).any():
        word = np.cumsum(kind == _SPACE)
        whole = np.zeros(len(begins) + 1, bool)
        whole[word[kind == _OTHER]] = True
        inside = whole[word] & (kind != _SPACE)
        first = inside & ~np.concatenate([[False], inside[:-1]])
        kind[first] = _OTHER
        kept = first | ~inside
        begins, kind = begins[kept], kind[kept]
        as_is = np.repeat(kind == _OTHER, np.diff(begins, append=len(text)))
        small = np.where(as_is, np.frombuffer(text, np.uint8), small)
    real = kind != _SPACE
    offsets = np.concatenate([[0], np.cumsum(np.diff(begins, append=len(text))[real])]).astype(np.int32)
    data = pa.py_buffer(small[kinds != _SPACE])
    return begins[real], pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, dtype: str) -> WordEncoder:
    """One per worker process: later tasks find its words known."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def file_schema(length: int, dtype: pa.DataType, metadata: dict | None = None) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(dtype, length)), pa.field("mask", pa.list_(pa.bool_(), length))], metadata)


#: What a file says of its documents: id, whether that is null, number of ids.
INDEX = [("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")]


def file_bytes(doc_ids: list[int | None], parts: list[bytes], length: int, dtype: str, rows: int = 512) -> bytes:
    """An Arrow stream of these documents' ids, in batches of rows sequences."""
    flat = np.frombuffer(b"".join(parts), dtype)
    n = -(-len(flat) // length)
    ids = np.zeros(n * length, dtype)
    ids[: len(flat)] = flat
    mask = np.arange(n * length) < len(flat)
    index = np.zeros(len(parts), INDEX)
    index["doc_id"], index["null"] = [0 if d is None else d for d in doc_ids], [d is None for d in doc_ids]
    index["n"] = [len(p) // flat.itemsize for p in parts]
    schema = file_schema(length, pa.from_numpy_dtype(np.dtype(dtype)), {"length": str(length), "tokens": str(len(flat)), b"documents": index.tobytes()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for a in range(0, n, rows):
            cut = slice(a * length, min(n, a + rows) * length)
            out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids[cut]), length), pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), length)], schema=schema))
    return sink.getvalue().to_pybytes()


def open_file(content: bytes | pa.Buffer) -> tuple[np.ndarray, pa.Table, np.ndarray]:
    """(all ids without padding, the table of sequences, the index of documents)."""
    with pa.ipc.open_stream(content) as reader:
        table = reader.read_all()
    index = np.frombuffer(table.schema.metadata[b"documents"], INDEX)
    flat = [b.column(0).values.to_numpy(zero_copy_only=True) for b in table.to_batches()]
    every = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
    mask = [b.column(1).values.to_numpy(zero_copy_only=False) for b in table.to_batches()]
    return every[np.concatenate(mask)] if mask else every, table, index


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have TEXT_BYTES together, or one more text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    first = 0
    while first < len(batch):
        after = int(np.searchsorted(size, (size[first - 1] if first else 0) + TEXT_BYTES)) + 1
        yield batch.slice(first, after - first)
        first = after


def _writer(folder: str, path: str, end_id: int, length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        words, end = encoder(path, dtype), np.array([end_id], dtype).tobytes()
        files, base = fs.FileSystem.from_uri(folder)
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/ids-{uuid.uuid4().hex}.arrow"
            with files.open_output_stream(name) as f:
                f.write(file_bytes(ids, parts, length, dtype))
            item = np.dtype(dtype).itemsize
            nonlocal nth
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([part]), pa.array([nth]), pa.array([size // item], pa.int64()), pa.array([len(ids)], pa.int64())], ["file", "part", "nth", "n_tokens", "n_docs"])

        for batch in batches:
            for some in _slices(batch):
                for doc_id, encoded in zip(some.column("doc_id").to_pylist(), words.encode(some.column("text").to_pylist())):
                    ids.append(doc_id)
                    parts.append(encoded + end)
                    size += len(parts[-1])
                    if size >= FILE_BYTES:
                        yield flush()
                        ids, parts, size = [], [], 0
        if ids:
            yield flush()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes the files in ascending order of doc_id; returns their manifest (file, start, n_tokens, n_docs).

    start is the number of ids in all files before. Null and empty texts are the end id alone; very
    long texts run over as many sequences as they need; rows that repeat a doc_id follow each other,
    ordered by text. Rows without doc_id come first, in the order of their texts. No documents: no files.
    """
    from pyarrow import fs
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() < 1 << 16 and end_id < 1 << 16 else "<u4"
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    manifest = stored(ordered.mapInArrow(_writer(folder, tokenizer, end_id, length, dtype), "file string, part long, nth long, n_tokens long, n_docs long"), "manifest")
    # A row for each file, summed up within runs of PARTS partitions, and over these: no task gets a row for every file.
    manifest = manifest.withColumn("run", F.expr(f"part div {PARTS}"))
    upto = lambda *by: Window.partitionBy(*by) if by else Window
    runs = manifest.groupBy("run").agg(F.sum("n_tokens").alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(upto().orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(upto("run").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inside", inside).join(runs, "run").select("file", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "n_docs")


def _partitions(docs: DataFrame) -> int:
    """As many as shuffles have, or more if the plan's statistics say that these would hold over PART_BYTES each."""
    spark = docs.sparkSession
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if known >= 1 << 60 else max(least, known // PART_BYTES + 1)  # over that, the size is not known


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content")):
                ids, _, index = open_file(content.as_buffer())
                ends = np.cumsum(index["n"].astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = ends - index["n"]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(index)), pa.array(index["doc_id"], mask=index["null"].astype(bool)), pa.array(begins), pa.array(index["n"].astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(manifest.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Writes the token files of docs and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    return read_ids(spark, folder, write_ids(docs, folder, tokenizer, end_id, length))
