"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of WINDOW item words (an item of fewer words is one pattern of its length).
A table of shifts over hashed blocks of two words tells how far a search position can move on
without missing a pattern; where the shift is 0, the bucket of the block's hash selects patterns,
and comparing the words themselves confirms an occurrence. The search runs in lanes: stretches of
many documents step at once, each at its own position.

Items are dealt into blocks of at most BLOCK_BYTES of text. Spark tasks build the tables of a block and
write them as a file into the shared folder; the driver only learns the files' names. A task reads
one block at a time: with a single block once, with several for each HELD_BYTES of documents, whose
hit words and items add up. So what a task holds is bounded however many items there are.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
HELD_BYTES = 64 << 20
LANE = 256
TABLE_BITS = (12, 24)  # least and most; between them some four slots for each block of words

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Text:
    """Lower-cased texts end to end, and the bounds of their words."""

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8").lower() for t in texts]
        self.raw = bytes(8) + b"\0".join(raw) + bytes(9)
        self.data = np.frombuffer(self.raw, np.uint8)
        inside = _WORD[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        stop = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))) + 8
        self.bounds = np.concatenate(([0], np.searchsorted(self.start, stop)))  # words before each text
        self.load = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        s, e = self.start[at], self.end[at]
        n = e - s
        head = self.load[s] & _MASK[np.minimum(n, 8)]
        tail = np.where(n > 8, self.load[e - 8], np.uint64(0))
        x = head * _A ^ tail * _B ^ n.astype(np.uint64) * _C
        return x ^ (x >> np.uint64(31))

    def blocks(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of the block of width words (1 or 2) that ends at each word."""
        x = self.hashes(at)
        if width == 2:
            x = x * _B + self.hashes(at - 1) * _C
        return x ^ (x >> np.uint64(29))

    def words(self, first: int, count: int) -> bytes:
        s, e = self.start[first : first + count].tolist(), self.end[first : first + count].tolist()
        return b" ".join([self.raw[a:b] for a, b in zip(s, e)])


class _Search:
    """Shift table and buckets for the patterns of one length; arrays and bytes, quick to write and read."""

    def __init__(self, length: int, patterns: dict[bytes, list[int]]):
        self.length, self.width = length, min(2, length)
        every = list(patterns)
        text = _Text([p.decode("utf-8") for p in every])
        most, first = length - self.width + 1, text.bounds[:-1]
        blocks = [text.blocks(first + j, self.width) for j in range(self.width - 1, length)]
        least, greatest = TABLE_BITS
        self.bits = min(greatest, max(least, (4 * sum(map(len, blocks))).bit_length()))
        self.shift = np.full(1 << self.bits, most, np.uint8)
        for k, h in enumerate(blocks):
            np.minimum.at(self.shift, self.slot(h), most - 1 - k)
        order = np.argsort(blocks[-1], kind="stable")
        self.suffixes, starts = np.unique(blocks[-1][order], return_index=True)
        self.starts = np.append(starts, len(order))  # of each suffix's bucket in the patterns
        own = [every[k] for k in order.tolist()]
        self.patterns, self.ends = b"".join(own), np.cumsum([0, *map(len, own)])
        items = [patterns[p] for p in own]
        self.items, self.item_ends = np.array([i for of in items for i in of], np.int64), np.cumsum([0, *map(len, items)])

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def confirmed(self, k: int, words: bytes) -> list[int]:
        """The items of the pattern in bucket k that these words are."""
        for p in range(int(self.starts[k]), int(self.starts[k + 1])):
            if self.patterns[self.ends[p] : self.ends[p + 1]] == words:
                return self.items[self.item_ends[p] : self.item_ends[p + 1]].tolist()
        return []

    def found(self, text: _Text) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        low, high = text.bounds[:-1], text.bounds[1:]
        lanes = np.maximum(-(-(high - low - self.length + 1) // LANE), 0)
        of = np.repeat(np.arange(len(low)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = low[of] + nth * LANE + self.length - 1
        last = np.minimum(at + LANE, high[of])  # lanes share no window: one ends before the other's first
        while len(at):
            h = text.blocks(at, self.width)
            move = self.shift[self.slot(h)]
            stop = np.flatnonzero(move == 0)
            if len(stop):
                k = np.minimum(np.searchsorted(self.suffixes, h[stop]), len(self.suffixes) - 1)
                same = self.suffixes[k] == h[stop]
                for i, bucket in zip(stop[same].tolist(), k[same].tolist()):
                    first = int(at[i]) - self.length + 1
                    if items := self.confirmed(bucket, text.words(first, self.length)):
                        yield first, items
                move = np.maximum(move, 1)
            at = at + move
            going = at < last
            at, last = at[going], last[going]


def _searches(ids: list[int], texts: list[str | None]) -> list[_Search]:
    text = _Text(texts)
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for i, item in enumerate(ids):
        a, b = int(text.bounds[i]), int(text.bounds[i + 1])
        n = min(WINDOW, b - a)
        for first in range(a, b - n + 1) if n else ():
            of = by_length.setdefault(n, {}).setdefault(text.words(first, n), [])
            if not of or of[-1] != item:
                of.append(item)
    return [_Search(n, p) for n, p in sorted(by_length.items())]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _builder(folder: str):
    """Writes the tables of a block of items as a file under a name of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        pdf = pdf.sort_values(["item_id", "text"], na_position="last")
        files, base = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.items"
        with files.open_output_stream(f"{base}/{name}") as f:
            f.write(pickle.dumps(_searches(pdf["item_id"].tolist(), pdf["text"].tolist()), 5))
        return pd.DataFrame({"name": [name]})

    return run


def _blocks(items: DataFrame, block_bytes: int) -> tuple[str, list[str]]:
    """The folder of the blocks' tables, and the files' names: only files of finished tasks are among them."""
    from pyarrow import fs

    folder = fresh_path(items.sparkSession, "items")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return folder, sorted(r[0] for r in stored(numbered.groupBy("block").applyInPandas(_builder(folder), "name string"), "blocks").collect())


class _Blocks:
    """The tables of one block after the other; a single one is read once."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.at, self.held = folder, names, None, []

    def __iter__(self) -> Iterator[list[_Search]]:
        from pyarrow import fs

        for name in self.names:
            if name != self.at:
                self.at, self.held = None, []  # let go before the next is read
                files, base = fs.FileSystem.from_uri(self.folder)
                with files.open_input_stream(f"{base}/{name}") as f:
                    self.at, self.held = name, pickle.loads(f.read())
            yield self.held


def _held(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.Table]:
    """Batches put together up to HELD_BYTES where blocks are many, so that each is read less often."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if not several or sum(b.nbytes for b in some) >= HELD_BYTES:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def _hits(texts: list[str | None], blocks: _Blocks) -> tuple[list[int], list[int], list[set[int]]]:
    """Of each text: its words, the words hit, and the items found."""
    chunks = list(_chunks(texts))
    n_words, hits, which = [0] * len(texts), [b""] * len(texts), [set() for _ in texts]
    for searches in blocks:
        for a, b in chunks:
            text = _Text(texts[a:b])
            change = np.zeros(len(text.start) + 1, np.int32)
            for s in searches:
                for first, of in s.found(text):
                    change[first] += 1
                    change[first + s.length] -= 1
                    which[a + int(np.searchsorted(text.bounds, first, side="right")) - 1].update(of)
            hit = np.cumsum(change)[:-1] > 0
            for k in range(a, b):
                own = hit[text.bounds[k - a] : text.bounds[k - a + 1]]
                if hits[k]:
                    own = own | np.unpackbits(np.frombuffer(hits[k], np.uint8), count=len(own)).astype(bool)
                n_words[k] = len(own)
                if own.any():
                    hits[k] = np.packbits(own).tobytes()
    return n_words, [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in hits], which


def _report(folder: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder, names)
        for table in _held(batches, len(names) > 1):
            n_words, hits, which = _hits(table.column("text").to_pylist(), blocks)
            found = [",".join(sorted(map(str, x))) for x in which]
            columns = [
                table.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(list(map(len, which)), pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in found], pa.string()), pa.array([x > 0 for x in hits], pa.bool_()),
            ]
            yield from pa.table(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).to_batches()

    return run


def _filter(folder: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder, names)
        for table in _held(batches, len(names) > 1):
            _, hits, _ = _hits(table.column("text").to_pylist(), blocks)
            yield from table.filter(pa.array([x == 0 for x in hits], pa.bool_())).to_batches()

    return run


def contamination(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs has doc_id and text, items has item_id and text; other columns don't matter. Null texts and
    null item ids have no words and no patterns. Items of one text each count; rows that repeat an
    item_id are one item. Texts and items of any length are searched whole. Without items no document is
    contaminated. Repeated and null doc_ids give a row each.
    """
    kind = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    folder, names = _blocks(items, block_bytes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report(folder, names or [_empty(folder)]), kind)


def decontaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the items occurs; else as contamination()."""
    folder, names = _blocks(items, block_bytes)
    return docs.mapInArrow(_filter(folder, names), docs.schema)


def _empty(folder: str) -> str:
    """A block without items: words are counted all the same."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    with files.open_output_stream(f"{base}/none.items") as f:
        f.write(pickle.dumps([], 5))
    return "none.items"
