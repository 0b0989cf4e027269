"""Exact links between texts whose shingle sets have a Jaccard similarity of NUM / DEN or more.

Candidates come from a prefix filter, which loses no pair: order the shingles of all texts by the
number of texts that have them, and by hash. Two sets of n shingles with that similarity share one
among their first n - ceil(n * NUM / DEN) + 1 in that order. A shingle of one text only links nothing,
so most texts have nothing but such shingles in front and leave at once. Of the others the shingles
that several texts have stay, by which each candidate is then confirmed or refuted.

Few texts of a prefix shingle: all pairs are candidates. Many (over CROWD): first each with some
leaders and its neighbours in size; then, as links only count for components, those that the confirmed
links left apart, with other leaders in turn and at the last turn in all pairs. So a large group of copies has links in proportion to its size, and
still no pair that could join two groups goes untried. Candidates found by other means may come first:
once confirmed they are links, and pairs that these connect already are passed over from the start.

Between the steps entries travel as binary columns of many shingles to a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes
from .graph import components

NUM, DEN = 4, 5
CROWD = 32
LEADERS = 3
TURNS = 3
PART_BYTES = 12 << 20
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _dealt(part: np.ndarray, doc: np.ndarray, size: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
    """Entries as one row for each part; neighbours of one document share its id and size."""
    order = np.argsort(part, kind="stable")
    part, doc, size = part[order], doc[order], size[order]
    new = np.concatenate(([True], part[1:] != part[:-1]))
    first = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(part))
    runs = np.diff(np.append(first, len(part))).astype(np.int32)
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    cut = lambda x, lo, hi: [x[i:j].tobytes() for i, j in zip(lo.tolist(), hi.tolist())]
    out = {"part": part[starts].astype(np.int32), "docs": cut(doc[first], a, b), "sizes": cut(size[first], a, b), "runs": cut(runs, a, b)}
    return out | {k: cut(v[order], starts, ends) for k, v in columns.items()}


def _read(pdf: pd.DataFrame, **kinds) -> list[np.ndarray]:
    """Document, size and the other columns of all entries."""
    whole = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
    runs = whole("runs", np.int32)
    return [np.repeat(whole("docs", np.int64), runs), np.repeat(whole("sizes", np.int32), runs), *(whole(c, k) for c, k in kinds.items())]


_ENTRIES = "part int, docs binary, sizes binary, runs binary, hashes binary"


def _batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in rows.items()], list(rows))


def _spread(parts: int, hashes: Callable[[bytes], np.ndarray]):
    """Each shingle of each text once, dealt by its hash. A text without words has one of its own."""
    none = np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            h, n = np.concatenate(sets), np.array([len(s) for s in sets], np.int32)
            part = (h % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            return _batch(_dealt(part, np.repeat(np.array(ids, np.int64), n), np.repeat(n, n), {"hashes": h}))

        ids, sets, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                h = np.unique(hashes(text.as_py().encode("utf-8") if text.is_valid else b""))
                ids.append(doc)
                sets.append(h if len(h) else none)
                held += len(sets[-1])
                if held >= CHUNK:
                    yield out()
                    ids, sets, held = [], [], 0
        if ids:
            yield out()

    return run


def _common(parts: int):
    """Of one part of the shingles those that several texts have, with their number, dealt by document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, size, h = _read(pdf, hashes=np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(starts, len(h)))
        freq = np.repeat(n, n).astype(np.uint32)
        more = freq > 1
        order, h, freq = order[more], h[more], freq[more]
        if not len(h):
            return pd.DataFrame({c.split()[0]: [] for c in _ENTRIES.split(", ")} | {"freq": []})
        doc, size = doc[order], size[order]
        by = np.argsort(doc, kind="stable")
        doc, size, h, freq = doc[by], size[by], h[by], freq[by]
        part = (_mixed(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        return pd.DataFrame(_dealt(part, doc, size, {"hashes": h, "freq": freq}))

    return run


def _active(pdf: pd.DataFrame) -> pd.DataFrame:
    """Texts with common shingles in their prefix: their size, the common shingles in order, how many of
    these are in the prefix, and a digest where all are common."""
    doc, size, h, freq = _read(pdf, hashes=np.uint64, freq=np.uint32)
    order = np.lexsort((h, freq, doc))
    doc, size, h = doc[order], size[order], h[order]
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.append(starts[1:], len(doc))
    n, m = size[starts].astype(np.int64), ends - starts
    take = (n - (n * NUM + DEN - 1) // DEN + 1) - (n - m)
    rows = []
    for k in np.flatnonzero(take > 0).tolist():
        raw = h[starts[k] : ends[k]].tobytes()
        rows.append((int(doc[starts[k]]), int(n[k]), int(take[k]), raw, hashlib.blake2b(raw, digest_size=16).digest() if m[k] == n[k] else None))
    return pd.DataFrame(rows, columns=["doc", "n", "take", "shingles", "digest"])


def _prefixes(parts: int):
    """The prefix shingles dealt by hash; with the component of the text, where there is a column of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            take = batch.column("take").to_numpy().astype(np.int64)
            h = np.concatenate([np.frombuffer(x[: 8 * t], np.uint64) for x, t in zip(batch.column("shingles").to_pylist(), take.tolist())])
            common = np.array([len(x) // 8 for x in batch.column("shingles").to_pylist()])
            left = (np.repeat(common + np.cumsum(take) - take, take) - np.arange(len(h))).astype(np.int32)
            column = lambda c, kind: np.repeat(batch.column(c).to_numpy().astype(kind), take)
            yield _batch(_dealt((h % np.uint64(parts)).astype(np.int64), column("doc", np.int64), column("n", np.int32), {"hashes": h, "root": column("root", np.int64), "left": left}))

    return run


def _fits(n: np.ndarray, left: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m, with left and other shingles from this one on, can be similar enough if it
    is the first they share; that one of a similar pair always says yes."""
    return np.minimum(left, other).astype(np.int64) * (NUM + DEN) >= (n.astype(np.int64) + m) * NUM


def _candidates(turn: int, crowd: int):
    """Pairs of texts with a prefix shingle in common, once for each part. A pair of a text with itself
    says that the text is in a crowd. Pairs of one component are passed over. After turn 0 only crowds: first
    with other leaders at each turn, at the last turn all pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, size, h, root, left = _read(pdf, hashes=np.uint64, root=np.int64, left=np.int32)
        order = np.lexsort((doc, size, h))
        doc, size, h, root, left = doc[order], size[order], h[order], root[order], left[order]
        fits = lambda i, j: _fits(size[i], left[i], size[j], left[j])
        chosen = lambda at: at[np.argsort(_mixed(doc[at].view(np.uint64) ^ np.uint64(turn * 0x5851F42D)), kind="stable")[: LEADERS << turn]]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.append(starts, len(h)))
        few = np.repeat(n <= crowd, n)
        pairs = [np.zeros((0, 2), np.int64)]

        def add(i, j):
            pairs.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], axis=1))
            if sum(map(len, pairs)) > 1 << 21:
                pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]

        if not turn:
            for k in range(1, int(min(crowd, n.max()))):
                i = np.flatnonzero((h[:-k] == h[k:]) & (few[:-k] | (k < 3)))
                i = i[(root[i] != root[i + k]) & fits(i, i + k)]
                add(i, i + k)
        for a, g in zip(starts[n > crowd].tolist(), n[n > crowd].tolist()):
            at = np.arange(a, a + g)
            if turn:
                names, which, many = np.unique(root[at], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                main = which == np.argmax(many)
                rest, lead = at[~main], at[main] if turn == TURNS else chosen(at[main])
                for k, i in enumerate(rest.tolist()):
                    j = np.concatenate((lead, rest[k + 1 :] if turn == TURNS else rest[k + 1 : k + 3]))
                    j = j[(root[j] != root[i]) & fits(i, j)]
                    add(np.full(len(j), i), j)
            else:
                add(at, at)
                for i in chosen(at).tolist():
                    j = at[(root[at] != root[i]) & fits(i, at)]
                    add(np.full(len(j), i), j)
        found = np.unique(np.concatenate(pairs), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
        both = np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column("sa"), batch.column("sb"))], np.int64)
        near = pa.array(both * DEN >= (sizes - both) * NUM)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])


def similar(docs: DataFrame, hashes: Callable[[bytes], np.ndarray], crowd: int = CROWD, seeds: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of doc_ids whose texts have a similarity of NUM / DEN or more, with the components
    that all such links have. hashes gives a text's shingles.

    docs has doc_id and text, each doc_id once. Texts without words are equal to each other. seeds (a, b) are
    candidates found by other means; they are confirmed like all others, and whatever they lack is found.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    parts = max(1, text_bytes(docs) // PART_BYTES)
    shingles = docs.mapInArrow(_spread(parts, hashes), _ENTRIES)
    common = shingles.groupBy("part").applyInPandas(_common(parts), f"{_ENTRIES}, freq binary")
    active = stored(common.groupBy("part").applyInPandas(_active, "doc long, n int, take int, shingles binary, digest binary"), "active")
    least = active.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("many")).where("many > 1")
    copies = stored(active.select("doc", "digest").join(least, "digest").where("doc <> least").select(F.col("doc").alias("a"), F.col("least").alias("b")), "copies")
    firsts = active.drop("digest").join(copies.select(F.col("a").alias("doc")), "doc", "left_anti")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x: firsts.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
        whole = pairs.where("a <> b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
        return stored(whole.mapInArrow(_confirmed, "a long, b long"), "confirmed")

    def rooted(texts: DataFrame, links: DataFrame) -> DataFrame:
        return texts.join(components(links), F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc"))

    def candidates(texts: DataFrame, turn: int) -> DataFrame:
        dealt = texts.select("doc", "n", "take", "shingles", "root").mapInArrow(_prefixes(parts), f"{_ENTRIES}, root binary, left binary")
        return stored(dealt.groupBy("part").applyInPandas(_candidates(turn, crowd), "a long, b long").distinct(), "pairs")

    seeded = confirmed(seeds.distinct()) if seeds is not None else None
    pairs = candidates(firsts.withColumn("root", F.col("doc")) if seeded is None else rooted(firsts, seeded), 0)
    links = confirmed(pairs) if seeded is None else confirmed(pairs).union(seeded)
    crowded = pairs.where("a = b").select(F.col("a").alias("doc"))
    for turn in range(1, 1 if crowded.isEmpty() else TURNS + 1):
        links = links.union(confirmed(candidates(rooted(firsts.join(crowded, "doc", "left_semi"), links), turn)))
    return links.union(copies)
