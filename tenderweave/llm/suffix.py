"""Suffix-array de-duplication with a distributed difference-cover sample.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. The
order of all suffixes is needed only as far as their first WIDTH bytes, which gives this form of
the difference-cover algorithm:

1. Sample: the positions whose residue modulo PERIOD is in COVER. {0, 1, 4, 14, 16} is a perfect
   difference set modulo 21: for any two residues a, b there is a shift d < 21 with a + d and b + d
   both in it. Two equal 50-byte strings therefore hold sampled positions at the same shift, and
   equal tuples of REACH = 50 - 20 = 30 bytes there.
2. Sort sampled tuples and name them: each tuple is a triple of names of its 10-byte thirds,
   combined once more into the name of the 30 bytes (the recursion: with a bounded prefix it is two
   levels deep). Names are sorted in buckets; a name found in one document only is settled and is
   discarded, with every suffix whose sampled tuples are all settled.
3. Merge the remaining suffixes: each goes to the bucket of the least 16-byte string in its first 50
   bytes, so equal prefixes meet; neighbouring suffixes of a bucket travel as one stretch of bytes.
   A bucket sorts its suffixes and compares adjacent prefixes byte for byte (names are hashes; they
   only spare work, they never decide).

Documents are dealt into blocks by doc_id. Inside a block equal stretches are sent once, with the
least doc_id, so a passage that a third of all rows share costs a bucket one stretch per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, text_bytes

WIDTH = 50
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
REACH = WIDTH - PERIOD + 1
LEAST = 16
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 2 << 20
PIECE = 1 << 18

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as integers; data has 8 bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


class _Block:
    """The texts of a block in the order of their ids, laid end to end."""

    def __init__(self, ids, texts):
        raw = [b"" if x is None else x.encode("utf-8") for x in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))  # rows of one id have places of their own
        raw = [raw[i] for i in self.order]
        self.ids = np.asarray(ids, dtype=np.int64)[self.order]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.size = int(sizes.sum())
        self.data = np.frombuffer(b"".join(raw) + bytes(WIDTH + 16), np.uint8)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions with a whole tuple in their document, and the documents' places."""
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.ends - self.starts)
        if not self.size:
            return np.zeros(0, np.int64), doc[:0]
        wanted = np.zeros(PERIOD, bool)
        wanted[list(COVER)] = True
        found = []
        for a in range(0, self.size, PIECE):
            at = np.arange(a, min(self.size, a + PIECE), dtype=np.int64)
            some = doc[a : a + PIECE]
            found.append(at[wanted[(at - self.starts[some]) % PERIOD] & (at + REACH <= self.ends[some])])
        at = np.concatenate(found)
        return at, doc[at]

    def names(self, at: np.ndarray) -> np.ndarray:
        """Names of the tuples at these positions: of three 10-byte names each."""
        w = _words(self.data)
        third = lambda p: _mix((w[p] * _A) ^ ((w[p + 2] >> np.uint64(48)) * _C) ^ (w[p] >> np.uint64(31)))
        return _mix(third(at) * _A + third(at + 10) * _B + third(at + 20) * _C)


def _planes(x: np.ndarray) -> bytes:
    """Sorted 32-bit integers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _bucket_names(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 more bits of the name in the lower half."""
    return ((names >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))


def _cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.append(first[1:], len(sorted_keys))


def _sampler(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf["doc_id"].to_numpy(), pdf["text"].tolist())
        at, doc = block.samples()
        keys = _bucket_names(block.names(at), buckets)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], block.ids[doc[order]]
        first, last = _cuts(keys)
        out = []
        if len(keys):
            several = ids[first] != ids[last - 1]  # ids ascend within a key: positions do
            keys = keys[first]
            low, high = _cuts(keys >> np.uint64(32))
            for a, b in zip(low, high):
                out.append((int(keys[a] >> np.uint64(32)), int(pdf["block"].iloc[0]), _planes(keys[a:b].astype(np.uint32)), np.packbits(several[a:b]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "block", "names", "several"])

    return run


def _unsettled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the names of each block that are found in more than one document."""
    parts = [_unplaned(x) for x in pdf["names"]]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)).astype(bool) for s, p in zip(pdf["several"], parts)]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[p[s] for p, s in zip(parts, several)]]))
    out = []
    for block, bucket, p in zip(pdf["block"], pdf["bucket"], parts):
        if len(twice):
            place = np.minimum(np.searchsorted(twice, p), len(twice) - 1)
            if len(found := p[twice[place] == p]):
                out.append((int(block), int(bucket), _planes(found)))
    return pd.DataFrame(out, columns=["block", "bucket", "names"])


def _least(data: np.ndarray, size: int) -> np.ndarray:
    """For each position: the least name of a LEAST-byte string inside the WIDTH bytes from there. In pieces, so that the
    working memory is a small part of the result's."""
    w, out = _words(data), np.empty(size, np.uint64)
    for a in range(0, size, PIECE):
        b = min(size, a + PIECE)
        x = _mix((w[a : b + WIDTH] * _A) ^ (w[a + 8 : b + WIDTH + 8] * _C))
        span = WIDTH - LEAST + 1
        step = 1
        while step * 2 <= span:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        if rest := span - step:
            x = np.minimum(x[:-rest], x[rest:])
        out[a:b] = x[: b - a]
    return out


def _runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of maximal runs of consecutive positions that agree in all of same."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1] + 1))
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))


def _merger(buckets: int, name_buckets: int):
    """Of a block: stretches of remaining suffixes by bucket, and what is settled inside the block."""

    def run(docs: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "bucket", "block", "ids", "places", "at", "sizes", "data"]
        if not len(docs) or not len(names):
            return pd.DataFrame([], columns=columns)
        number = int(docs["block"].iloc[0])
        block = _Block(docs["doc_id"].to_numpy(), docs["text"].tolist())
        del docs
        wanted = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | _unplaned(x).astype(np.uint64) for b, x in zip(names["bucket"], names["names"])]))
        at, doc = block.samples()
        keys = _bucket_names(block.names(at), name_buckets)
        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[place] == keys
        at, doc = at[hit], doc[hit]
        del keys, place, wanted
        low = np.maximum(at - (WIDTH - REACH), block.starts[doc])
        high = np.minimum(at, block.ends[doc] - WIDTH)
        fits = high >= low
        change = np.zeros(block.size + 1, np.int32)
        np.add.at(change, low[fits], 1)
        np.add.at(change, high[fits] + 1, -1)
        at = np.flatnonzero(np.cumsum(change, dtype=np.int32)[:-1] > 0)
        del change, low, high, fits, hit
        if not len(at):
            return pd.DataFrame([], columns=columns)
        doc = (np.searchsorted(block.ends, at, side="right")).astype(np.int32)
        least = _least(block.data, block.size)[at]
        first, last = _runs(at, least, doc)
        start, count, doc, bucket = at[first], last - first, doc[first], least[first] % np.uint64(buckets)
        raw, known, keep, local = block.data.tobytes(), {}, [], []
        for i, (s, n) in enumerate(zip(start.tolist(), (count + WIDTH - 1).tolist())):
            j = known.setdefault(raw[s : s + n], i)
            if j == i or block.ids[doc[j]] == block.ids[doc[i]]:
                keep.append(i)
            else:
                local.append(i)
        out = []
        inside = start - block.starts[doc]
        if local:
            i = np.array(local)
            out.append((1, number % buckets, number, block.ids[doc[i]].tobytes(), doc[i].astype("<u4").tobytes(), inside[i].astype("<u4").tobytes(), count[i].astype("<u4").tobytes(), b""))
        keep = np.array(keep)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        for a, b in zip(*_cuts(bucket[keep])):
            i = keep[a:b]
            out.append((0, int(bucket[i[0]]), number, block.ids[doc[i]].tobytes(), doc[i].astype("<u4").tobytes(), inside[i].astype("<u4").tobytes(), count[i].astype("<u4").tobytes(), b"".join([raw[s : s + n] for s, n in zip(start[i].tolist(), (count[i] + WIDTH - 1).tolist())])))
        return pd.DataFrame(out, columns=columns)

    return run


def _ranks(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the prefixes at these places in which equal ones are adjacent, and where a new one begins."""
    offsets = (0, 8, 16, 24, 32, 40, WIDTH - 8)
    name = np.zeros(len(at), np.uint64)
    for k, o in enumerate(offsets):
        name = _mix(name * _B + w[at + o] + np.uint64(k))
    order = np.argsort(name)
    name = name[order]
    same = np.ones(len(at) - 1, bool)
    sorted_at = at[order]
    for o in offsets:
        x = w[sorted_at + o]
        same &= x[1:] == x[:-1]
    if (name[1:][~same] == name[:-1][~same]).any():  # two prefixes of one name: sort by the bytes themselves
        order = np.lexsort([w[at + o].byteswap() for o in reversed(offsets)])
        sorted_at, same = at[order], np.ones(len(at) - 1, bool)
        for o in offsets:
            x = w[sorted_at + o]
            same &= x[1:] == x[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same)))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: sort the suffixes, compare adjacent prefixes, give the stretches that go."""
    out = []
    settled = pdf["kind"] == 1
    for r in pdf[settled].itertuples():
        out.append((r.block, r.places, r.at, r.sizes))
    pdf = pdf[~settled]
    if len(pdf):
        data = np.frombuffer(b"".join(pdf["data"]) + bytes(16), np.uint8)
        ids = np.frombuffer(b"".join(pdf["ids"]), "<i8")
        places = np.frombuffer(b"".join(pdf["places"]), "<u4")
        inside = np.frombuffer(b"".join(pdf["at"]), "<u4").astype(np.int64)
        count = np.frombuffer(b"".join(pdf["sizes"]), "<u4").astype(np.int64)
        block = np.repeat(pdf["block"].to_numpy(), [len(x) // 8 for x in pdf["ids"]])
        size = count + WIDTH - 1
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(ids), dtype=np.int32), count)
        step = np.arange(len(piece), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
        at = begin[piece] + step
        order, first = _ranks(_words(data), at)
        least = np.minimum.reduceat(ids[piece[order]], first)
        gone = np.zeros(len(at), bool)
        gone[order] = ids[piece[order]] > np.repeat(least, np.diff(np.append(first, len(at))))
        del order
        i = np.flatnonzero(gone)
        a, b = _runs(i, piece[i])
        if len(a):
            p, o = piece[i[a]], inside[piece[i[a]]] + step[i[a]]
            n = b - a
            by = np.argsort(block[p], kind="stable")
            for x, y in zip(*_cuts(block[p[by]])):
                k = by[x:y]
                out.append((int(block[p[k[0]]]), places[p[k]].tobytes(), o[k].astype("<u4").tobytes(), n[k].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["block", "places", "at", "sizes"])


def _kept(ids: list[int], texts: list[str | None], gone: dict[str, list[bytes]]) -> list[tuple[int, int, int, int, bytes]]:
    """Of each row of a block: its place in ids, bytes, removed bytes, removed runs, and the bytes that stay."""
    places = np.frombuffer(b"".join(gone["places"]), "<u4")
    at = np.frombuffer(b"".join(gone["at"]), "<u4").astype(np.int64)
    count = np.frombuffer(b"".join(gone["sizes"]), "<u4").astype(np.int64)
    order = np.lexsort((at, places))
    places, at, end = places[order], at[order], (at + count + WIDTH - 1)[order]
    block = _Block(ids, texts)
    out = []
    for place, i in enumerate(block.order):
        raw = b"" if texts[i] is None else texts[i].encode("utf-8")
        a, b = np.searchsorted(places, place), np.searchsorted(places, place, side="right")
        removed, spans, kept, seen = 0, 0, [], 0
        if b > a:
            ends = np.minimum(np.maximum.accumulate(end[a:b]), len(raw))
            new = np.concatenate(([True], at[a + 1 : b] > ends[:-1]))
            begin = at[a:b][new]
            stop = ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
            spans, removed = len(begin), int((stop - begin).sum())
            for x, y in zip(begin.tolist(), stop.tolist()):
                kept.append(raw[seen:x])
                seen = y
        kept.append(raw[seen:])
        out.append((i, len(raw), removed, spans, b"".join(kept)))
    return out


def _digest(docs: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    ids = docs["doc_id"].tolist()
    out = [(ids[i], n, removed, spans, hashlib.sha256(rest).hexdigest()) for i, n, removed, spans, rest in _kept(ids, docs["text"].tolist(), gone)]
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(columns: list[str]):
    """Through Arrow, so that all other columns stay what they are."""

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        ids, texts = docs.column("doc_id").cast(pa.int64()).to_pylist(), docs.column("text").to_pylist()
        left = [True] * len(texts)
        for i, n, removed, _, rest in _kept(ids, texts, {c: gone.column(c).to_pylist() for c in ("places", "at", "sizes")}) if ids else ():
            if removed:
                texts[i], left[i] = rest.decode("utf-8", "ignore"), removed < n
        new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
        return pa.table({c: pa.array(new[c], docs.schema.field(c).type) if c in new else docs.column(c) for c in columns}).filter(pa.array(left, pa.bool_()))

    return run


def _removals(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """docs with a column for their block, its name, and the stretches that go by block."""
    total = text_bytes(docs)
    blocks = max(64, total // BLOCK_BYTES + 1)
    buckets = max(256, total // BUCKET_BYTES + 1)
    block = free_name(docs, "part")
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).cast("int"))
    lean = dealt.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(block).alias("block"))
    names = lean.groupBy("block").applyInPandas(_sampler(buckets), "bucket int, block int, names binary, several binary")
    names = stored(names.groupBy("bucket").applyInPandas(_unsettled, "block int, bucket int, names binary"), "names")
    merged = lean.groupBy("block").cogroup(names.groupBy("block")).applyInPandas(_merger(buckets, buckets), "kind int, bucket int, block int, ids binary, places binary, at binary, sizes binary, data binary")
    return dealt, block, stored(merged.groupBy("bucket").applyInPandas(_compare, "block int, places binary, at binary, sizes binary"), "gone")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    docs has doc_id and text; other columns don't matter. A null text counts as empty: nothing of it
    goes. Texts under 50 bytes lose nothing; those of any length are judged whole. Rows that repeat a
    doc_id give a row each; they never remove from one another, as no id is smaller. No id is smaller
    or greater than a null one either, so rows without doc_id lose nothing and take nothing. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt, block, gone = _removals(docs.where("doc_id is not null"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    raw = F.coalesce("text", F.lit("")).cast("binary")
    without = docs.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    return dealt.groupBy(block).cogroup(gone.groupBy("block")).applyInPandas(_digest, kind).union(without)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without the bytes that suffix_dedup() removes.

    Of a character of which a part went, the rest goes too; n_chars, where there is one, follows the
    text. A document that loses everything goes; one that had no bytes stays. Rows without doc_id stay
    as they are.
    """
    dealt, block, gone = _removals(docs.where("doc_id is not null"))
    return dealt.groupBy(block).cogroup(gone.groupBy("block")).applyInArrow(_strip(docs.columns), docs.schema).union(docs.where("doc_id is null"))
