"""SimHash fingerprints and their near-duplicate links, by a self-join of binary tries.

The join walks pairs of trie nodes together: from a pair it goes to the pairs of their children,
adds the bit in which the children differ to the pair's errors, and drops the pair once the errors
exceed the budget of Hamming distance. To spread one join over many tasks, a fingerprint enters
several tries, each with other blocks of its bits in front: cut into budget + k blocks, two
fingerprints within the budget agree in k whole blocks, so one of the tries has them under the same
node at that depth. k follows from the number of fingerprints, so that nodes stay small. A task
gets such nodes; a node of many fingerprints is cut into slots, and each pair of slots is a share of
its own. Between different texts no link is lost: where thousands of fingerprints lie close
together, node pairs whose fingerprints are known to be connected already are passed over, and a
share returns a spanning forest of its links, which has the same components.

A fingerprint may have several words of 64 bits. Then each word is joined under the budget, and a
link needs a total distance within `total` as well: more bits tell a similarity of 0.8 from 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .graph import components
from .jaccard import similar

BITS = 64
SEED = 42
SLOT = 4096
FRONTIER = 1 << 18
DEAL = 1 << 15


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of size words (all words, where there are fewer), repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


_PLACE = np.arange(8, dtype=np.int16) * 256
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


_TURN = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def fingerprint(raw: bytes, size: int, words: int = 1) -> list[int]:
    """The words of the fingerprint, as signed longs; the first is that of the hashes themselves."""
    h = shingle_hashes(raw, size)
    out = []
    for k in range(words):
        if not len(h):
            out.append(0)
            continue
        x = h
        if k:
            x = (h ^ (h >> np.uint64(32))) * _TURN[k]
            x ^= x >> np.uint64(29)
        counts = np.bincount((x.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BIT
        out.append(int(np.packbits((counts * 2 > len(x)).ravel(), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, size: int, words: int = 1) -> DataFrame:
    """(doc_id, w0, w1, ...). A null text has no bit set."""
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t.as_py().encode("utf-8") if t.is_valid else b"", size, words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(words)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


class _Join:
    """Trie join of sorted values; the arrays hold node pairs as ranges of them."""

    def __init__(self, values: np.ndarray, budget: int, words: np.ndarray | None = None, total: int | None = None):
        self.v, self.budget, self.words, self.total = values, budget, words, total
        self.label = np.arange(len(values))

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            odd = x != y
            if not odd.any():
                return
            a, b = a[odd], b[odd]
            low, high = np.minimum(x[odd], y[odd]), np.maximum(x[odd], y[odd])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label[:] = label[label]

    def split(self, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        """Where the values with this bit set begin."""
        wanted = ((self.v[low] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            less = open_ & (self.v[np.minimum(mid, len(self.v) - 1)] < wanted)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def close(self, pairs: np.ndarray) -> np.ndarray:
        """Without the pairs all of whose values are connected."""
        n = len(self.label)
        last = np.append(np.flatnonzero(self.label[1:] != self.label[:-1]), n - 1)
        reach = last[np.searchsorted(last, np.arange(n))]  # the last place of the run of one label
        a, b, c, d = pairs[:4]
        done = (reach[a] >= b - 1) & (reach[c] >= d - 1) & (self.label[a] == self.label[c])
        return pairs[:, ~done]

    def leaves(self, pairs: np.ndarray) -> None:
        a, b, c, d = pairs[:4]
        wide = d - c
        n = (b - a) * wide
        i = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        x, y = a[i] + k // wide[i], c[i] + k % wide[i]
        near = (x != y) & (np.bitwise_count(self.v[x] ^ self.v[y]) <= self.budget)
        x, y = x[near], y[near]
        if self.total is not None and len(x):
            near = np.bitwise_count(self.words[x] ^ self.words[y]).sum(axis=1) <= self.total
            x, y = x[near], y[near]
        self.union(x, y)

    def flat(self, pairs: np.ndarray) -> None:
        """Pairs of nodes of one value each, as several classes may have one and the same word."""
        for a, b, c, d, _ in pairs.T.tolist():
            for i in range(a, b):
                for k in range(c, d, FRONTIER):
                    self.leaves(np.array([[i], [i + 1], [k], [min(d, k + FRONTIER)], [0]]))

    def run(self, pairs: np.ndarray, bit: int) -> None:
        """pairs: rows of first and past-the-last place on either side, and errors so far."""
        todo = [(pairs, bit)]
        while todo:
            pairs, bit = todo.pop()
            pairs = self.close(pairs)
            small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 16
            if small.any():
                self.leaves(pairs[:, small])
                pairs = pairs[:, ~small]
            if not pairs.shape[1]:
                continue
            if bit < 0:
                self.flat(pairs)
                continue
            a, b, c, d, err = pairs
            m, n = self.split(a, b, bit), self.split(c, d, bit)
            own = (a == c) & (b == d)
            children = np.concatenate(
                [np.stack([a, m, c, n, err]), np.stack([m, b, n, d, err]), np.stack([a, m, n, d, err + 1]), np.stack([m, b, c, n, err + 1])[:, ~own]],
                axis=1,
            )
            keep = (children[1] > children[0]) & (children[3] > children[2]) & (children[4] <= self.budget)
            children = children[:, keep]
            for k in range(0, children.shape[1], FRONTIER):
                todo.append((children[:, k : k + FRONTIER], bit - 1))


class Tries:
    """Which blocks of which word stand in front in which trie (turn)."""

    def __init__(self, budget: int, count: int, words: int = 1):
        self.budget = budget
        wanted = max(1, count).bit_length() - 8
        self.together = next((k for k in (1, 2, 3) if k * (BITS // (budget + k)) >= wanted), 3)
        self.blocks = budget + self.together
        self.width = BITS // self.blocks
        self.depth = self.width * self.together
        self.turns = [(w, c) for w in range(words) for c in combinations(range(self.blocks), self.together)]

    def values(self, words: np.ndarray, turn: int) -> np.ndarray:
        """The word of the turn with its bits in the trie's order."""
        w, chosen = self.turns[turn]
        x = words[:, w]
        spans = [(b * self.width, self.width) for b in (*chosen, *(b for b in range(self.blocks) if b not in chosen))]
        if rest := BITS - self.blocks * self.width:
            spans.append((self.blocks * self.width, rest))
        out = np.zeros(len(x), np.uint64)
        for start, n in spans:
            out = (out << np.uint64(n)) | ((x >> np.uint64(BITS - start - n)) & np.uint64((1 << n) - 1))
        return out


def _packed(columns: list[np.ndarray], bounds: np.ndarray) -> list[pa.Array]:
    """Each column's bytes cut at bounds, as binary values."""
    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        width = c.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        out.append(pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype("<i4").tobytes()), pa.py_buffer(c.tobytes())]))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _TURN[1]
    return x ^ (x >> np.uint64(29))


def _dealer(tries: Tries, count: int, per_turn: int):
    """Entries of the classes by share: a share has nodes of one trie, dealt by a hash of their front bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), DEAL):
                part = batch.slice(first, DEAL)
                words = np.stack([part.column(f"w{k}").to_numpy().view(np.uint64) for k in range(count)], axis=1)
                least = part.column("least").to_numpy()
                for turn in range(len(tries.turns)):
                    front = tries.values(words, turn) >> np.uint64(BITS - tries.depth)
                    share = (_mixed(front) % np.uint64(per_turn)).astype(np.int64)
                    order = np.argsort(share, kind="stable")
                    share = share[order]
                    bounds = np.append(np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1]))), len(share))
                    keys = share[bounds[:-1]] + turn * per_turn
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(bounds).astype(np.int32)), *_packed([least[order], words[order]], bounds)], ["share", "n", "least", "words"])

    return run


def _splitter(count: int):
    """Rows of crowded shares again for every pair of slots that their entries are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["slots"] is None:
                    out.append((r["share"], 0, 0, 0, r["least"], r["words"]))
                    continue
                least, words = np.frombuffer(r["least"], np.int64), np.frombuffer(r["words"], np.uint64).reshape(-1, count)
                slot = _mixed(words[:, 0]) % np.uint64(r["slots"])
                for s in np.unique(slot).tolist():
                    own = least[slot == s].tobytes(), words[slot == s].tobytes()
                    out += [(r["share"], min(s, o), max(s, o), s, *own) for o in range(r["slots"])]
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["share", "a", "b", "slot", "least", "words"])

    return run


def _shares(tries: Tries, count: int, per_turn: int, total: int | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, left, right = int(pdf["share"].iloc[0]) // per_turn, int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        least = np.frombuffer(b"".join(pdf["least"]), np.int64)
        words = np.frombuffer(b"".join(pdf["words"]), np.uint64).reshape(-1, count)
        slot = np.repeat(pdf["slot"].to_numpy(), [len(x) // 8 for x in pdf["least"]])
        v = tries.values(words, turn)
        order = np.lexsort((least, v, slot))
        v, least, slot = v[order], least[order], slot[order]
        join = _Join(v, tries.budget, words[order], total)
        front = v >> np.uint64(BITS - tries.depth)
        cut = len(v) if left == right else int(np.searchsorted(slot, right))
        low = np.flatnonzero(np.concatenate(([True], front[1:cut] != front[: cut - 1]))) if cut else np.zeros(0, np.int64)
        high = np.append(low[1:], cut)[: len(low)]
        if left == right:
            pairs = np.stack([low, high, low, high, np.zeros(len(low), np.int64)])
        else:
            first = cut + np.searchsorted(front[cut:], front[low])
            last = cut + np.searchsorted(front[cut:], front[low], side="right")
            pairs = np.stack([low, high, first, last, np.zeros(len(low), np.int64)])[:, last > first]
        join.run(pairs, BITS - tries.depth - 1)
        root = least.copy()  # the least id of each component: other shares then name the same edges
        np.minimum.at(root, join.label, least)
        root = root[join.label]
        far = root < least
        return pd.DataFrame({"a": least[far], "b": root[far]})

    return run


def links(classes: DataFrame, budget: int, words: int = 1, total: int | None = None, slot_size: int = SLOT) -> DataFrame:
    """Edges (a, b) between the least ids of classes (least, w0, ...) of which a word differs in at most
    budget bits, and all words together in at most total: a forest for each share of the join, with the
    components of all links."""
    count = classes.count()
    tries = Tries(budget, count, words)
    per_turn = max(1, count // slot_size)
    dealt = classes.mapInArrow(_dealer(tries, words, per_turn), "share long, n int, least binary, words binary")
    crowded = dealt.groupBy("share").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * slot_size).select("share", F.ceil(F.col("n") / slot_size).cast("int").alias("slots"))
    crowded = stored(crowded, "crowded")
    if crowded.isEmpty():
        entries = dealt.select("share", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("slot"), "least", "words")
    else:
        entries = dealt.join(crowded, "share", "left").select("share", "slots", "least", "words").mapInArrow(_splitter(words), "share long, a int, b int, slot int, least binary, words binary")
    return entries.groupBy("share", "a", "b").applyInPandas(_shares(tries, words, per_turn, total), "a long, b long")


def _components(docs: DataFrame, size: int, budget: int, words: int, total: int | None) -> DataFrame:
    """(doc_id, w0, ..., component_id), a row for each of docs."""
    names = [f"w{k}" for k in range(words)]
    prints = stored(fingerprints(docs, size, words), "fingerprints")
    classes = prints.groupBy(*names).agg(F.min("doc_id").alias("least")).where("least is not null")
    roots = components(links(classes, budget, words, total))
    of = classes.join(roots, classes["least"] == roots["node"], "left").select(*names, F.coalesce("root", "least").alias("component_id"))
    return prints.join(of, names, "left")


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    docs has doc_id and text; other columns don't matter. A text without words, or null, has the
    fingerprint zero and links like any other. Texts of any length are read whole. Repeated doc_ids give a
    row each. A row without doc_id links nothing; its component is that of the rows with its very
    fingerprint, null if none of them has a doc_id. No documents: no rows.
    """
    return _components(docs, size, budget, 1, None).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows by doc_id, and its name: doc_id itself where that is
    never null and never repeats; else the rows are stored in the order of doc_id and text, nulls last."""
    key = free_name(docs, "row")
    doc_id = F.col("doc_id").cast("long")
    if docs.groupBy(doc_id.alias("doc_id")).count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, doc_id), key
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [doc_id.asc_nulls_last(), F.col("text").asc_nulls_first()]
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ordered.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _candidates(docs: DataFrame, size: int, budget: int) -> DataFrame:
    """(a, b) of doc_ids whose fingerprints are equal, or are in one component of the tries' links."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(prints.groupBy("w0").agg(F.min("doc_id").alias("least")), "classes")
    equal = prints.join(classes, "w0").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    return stored(links(classes, budget).select("a", "b").union(equal), "candidates")


def without_near_copies(docs: DataFrame, size: int = 5, budget: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, of the documents with the least doc_id of their groups.

    Two documents link if their sets of shingles of size words have a Jaccard similarity of 0.8 or more,
    exactly; groups are the components of all links. Candidates come from the join of tries over the
    fingerprints, within budget bits, and each is confirmed by its shingles. The tries can't find all pairs
    of 0.8 (two such texts differ in more bits than tries can allow), so a prefix filter over the shingles
    adds the pairs that the confirmed ones leave apart. Each row is a document of its own: rows
    that repeat a doc_id, or have none, link by their texts alone; of a group's rows of one doc_id
    the one with the least text stays, and rows without doc_id come after all others. A null text is one
    without words; such texts are copies of each other. Texts of any length are read whole. No documents:
    no rows.
    """
    docs, key = _keyed(docs)
    texts = docs.select(F.col(key).alias("doc_id"), "text")
    roots = components(similar(texts, partial(shingle_hashes, size=size), seeds=_candidates(texts, size, budget)))
    later = stored(roots.where("node <> root").select(F.col("node").alias(key)), "later")
    return docs.join(later, key, "left_anti").drop(key)
