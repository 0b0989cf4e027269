"""Periodic runs of words, found through Lyndon roots.

A run of period q starts a Lyndon root somewhere in its first q words: for one of the two orders of the
alphabet, the longest Lyndon word that starts there has length q. So all runs follow from the two Lyndon
arrays, and these come directly out of the grouping phase of Baier's suffix sorter (`grouped`), run once
for each order. Roots of one group at distance q are equal words; a chain of them is extended to both
sides by comparing the word stream with itself q places on (`_extent`).

Only stretches that can hold a wanted run are grouped (`stretches`): of a run of at least four periods and
six words, each three consecutive words occur three times or more inside the run, so words outside such
threes cut the text. What is left holds every wanted run whole, with its neighbours' words decided.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
PERIODS = 4
FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def stretches(w: np.ndarray, times: int = 3) -> list[tuple[int, int]]:
    """Bounds of the maximal stretches in which every three consecutive words occur `times` times inside the stretch."""
    n = len(w) - 2
    if n < times:
        return []
    size = int(w.max()) + 1
    pair = w[:-1].astype(np.int64) * size + w[1:]
    if size >= 1 << 20:  # a number of three words must fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
        three = np.unique(pair[:-1] * size + w[2:], return_inverse=True)[1]
    else:
        three = pair[:-1] * size + w[2:]
    at = np.arange(n)
    part = np.zeros(n, np.int64)
    while True:
        order = np.lexsort((three, part)) if part.any() else np.argsort(three, kind="stable")
        t, p = three[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] != p[:-1]))))
        count = np.diff(np.append(first, len(t)))
        stay = np.zeros(len(t), bool)
        stay[order] = np.repeat(count >= times, count)
        if stay.all():
            break
        at, three, part = at[stay], three[stay], part[stay]
        if not len(at):
            return []
        part = np.cumsum(np.concatenate(([False], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]))))
    first = _firsts(part)
    last = np.append(first[1:], len(at)) - 1
    return [(a, b) for a, b in zip(at[first].tolist(), (at[last] + 3).tolist()) if b - a >= LEAST]


def grouped(w: list[int]) -> tuple[list[int], list[int]]:
    """(length of the longest Lyndon word at each place, its group): the first phase of Baier's sorter.

    w holds ranks. Groups are taken from the greatest down. A taken group's places leave the list of live
    ones; each of them then points to the nearest live place on its left, which lies in a lesser group. Of
    every lesser group, the places that k of them point to go, for k from the greatest down, into a new group
    just above it, as the word they begin now has k words of the taken group behind it. The length of a
    group's word when it is taken is the entry of its places in the Lyndon array. Places in a group ascend.
    """
    n = len(w)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right.append(0)  # of place -1, which no group holds
    left.append(n - 1)  # of place n
    by = [[] for _ in range(max(w, default=-1) + 1)]
    for i, x in enumerate(w):
        by[x].append(i)
    members = [m for m in by if m]
    word = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    length, final = [0] * n, [0] * n
    g = len(members) - 1
    while g >= 0:
        size = word[g]
        counts: dict[int, list[int]] = {}
        last, k = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue
            length[i] = size
            final[i] = g
            a, b = left[i], right[i]
            left[b] = a
            right[a] = b
            if a == last:
                k += 1
            else:
                if k and last >= 0:
                    counts.setdefault(k, []).append(last)
                last, k = a, 1
        if k and last >= 0:
            counts.setdefault(k, []).append(last)
        members[g] = ()
        for k in sorted(counts, reverse=True):
            new: dict[int, int] = {}
            for i in counts[k]:
                old = group[i]
                to = new.get(old)
                if to is None:
                    to = new[old] = len(members)
                    members.append([])
                    word.append(word[old] + k * size)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = to
                    if up < len(below):
                        below[up] = to
                members[to].append(i)
                group[i] = to
        g = below[g]
    return length, final


def _equal(w: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from a and from b on (step 1) or before them (step -1) are equal, up to most."""
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        if step > 0:
            x, y = w[a + done : a + done + size], w[b + done : b + done + size]
        else:
            x, y = w[a - done - size : a - done][::-1], w[b - done - size : b - done][::-1]
        if len(other := np.flatnonzero(x != y)):
            return done + int(other[0])
        done += size
        size *= 4
    return done


def _extent(w: np.ndarray, first: int, last: int, p: int) -> tuple[int, int]:
    """The stretch of period p around the roots that start at first, first + p, ..., last."""
    back = _equal(w, first, first + p, first, -1)
    end = last + p
    return first - back, end + _equal(w, last, end, len(w) - end, 1)


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of w, by start, then period."""
    found = set()
    for lo, hi in stretches(w):
        part = w[lo:hi]
        ranks = np.unique(part, return_inverse=True)[1]
        for r in (ranks, ranks.max() - ranks):
            length, group = (np.array(x) for x in grouped(r.tolist()))
            i = np.arange(len(part))
            after = i + length
            fits = after < len(part)
            same = np.zeros(len(part), bool)
            same[fits] = group[after[fits]] == group[i[fits]]
            before = np.zeros(len(part), bool)
            before[after[same]] = True
            for a in np.flatnonzero(same & ~before).tolist():
                p = int(length[a])
                z = a
                while same[z]:
                    z += p
                if z - a >= (PERIODS - 2) * p:  # the root at each end of such a run may be cut off
                    s, e = _extent(part, a, z, p)
                    if e - s >= max(LEAST, PERIODS * p):
                        found.add((lo + s, e - s, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten (by crc32 of its id) with a repeated tail, so that runs of any period occur."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _document(doc_id: int | None, text: str | None, tails: bool) -> tuple:
    words = [] if text is None else text.encode("utf-8").split()  # of bytes: splits at \x20 and \x09-\x0D alone
    if tails:
        words = repeated_tail(words, doc_id)
    names = {x: k for k, x in enumerate(dict.fromkeys(words))}
    runs = runs_of(np.fromiter(map(names.__getitem__, words), np.int64, len(words))) if len(words) >= LEAST else []
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    if runs:
        stays = np.ones(len(words), bool)
        for s, n, p in runs:
            stays[s + p : s + n] = False
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()), runs, b" ".join(words).decode("utf-8")


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """Per document: doc_id, n_runs, start, length, period and exponent_milli of its longest run, runs_sha256, collapsed_sha256.

    A run is a maximal stretch of words with smallest period q and at least max(6, 4 q) words. Of several
    longest ones the first start counts, then the smaller period; a document without runs has nulls there.
    runs_sha256 is of the lines `start,length,period`; collapsed_sha256 of the words that no run repeats,
    joined by one space. `tails` repeats the tail of one document in ten first (repeated_tail).

    docs has doc_id and text; other columns don't matter. A null or empty text has no words and no runs.
    Texts of any length are read whole, each in one task, in time that grows with n log n. Rows with equal
    doc_ids give a row each; a null doc_id stays null and its text is never changed by `tails`. An empty
    table gives no rows. One pass, no shuffle: a lost executor costs the partitions it was reading.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [_document(i, texts[k].as_py(), tails)[0] for k, i in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, FOUND)


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with all their columns and, as `runs`, the (start, length, period) of each run, and, as `collapsed`,
    the words that no run repeats, joined by one space; columns of these names are replaced. Null texts have none."""
    docs = docs.drop("runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            got = [_document(None, x.as_py(), False) for x in texts]
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in g[1]] for g in got], kind)
            texts = pa.array([g[2] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, runs, texts], [*batch.schema.names, "runs", "collapsed"])

    schema = docs.selectExpr("*", "cast(null AS array<struct<start: long, length: long, period: long>>) AS runs", "cast(null AS string) AS collapsed").schema
    return docs.mapInArrow(run, schema)
