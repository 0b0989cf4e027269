"""Exact search for the largest inner products, by ball trees and branch and bound.

Rows are dealt into shards, each with a ball tree over its different vectors; the stated queries are dealt into
blocks. A ball with centre c and radius r holds no product with q above q.c + |q| r.

1. Dive: each query goes down every shard's tree to the leaf of the larger bound. The k-th best of all that
   is found there is a score that its result can't fall below.
2. Search: with that score known to every shard, a tree is searched by branch and bound: balls whose bound
   lies below the current k-th score go, the leaves left are taken in the order of their bounds, and each
   leaf raises the k-th score for those behind it. A shard sends only what reaches the shared score.

A (shard, block) pair is one group of bounded size, so memory stays the same however many rows and queries
there are. All scores are sums of whole numbers; the bounds are doubles, rounded up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import EXACT, finite, packed, shard, small, unpacked, whole

SHARD_ROWS = 16384
BLOCK_QUERIES = 16384
LEAF = 64
ROWS_AT_ONCE = 1024
NO_ID = 2**63 - 1
LEAST = -(2**63)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def ball_tree(ids: np.ndarray, x: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """A balanced tree over the different rows of x. Of rows with equal vectors the k + 1 smallest ids are kept:
    no query's k best (of which its own id is none) can hold another of them."""
    points, place = np.unique(x, axis=0, return_inverse=True)
    place = place.ravel()
    by = np.lexsort((ids, place))
    place, ids = place[by], ids[by]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    nth = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    names = np.full((len(points), k + 1), NO_ID, np.int64)
    names[place[nth <= k], nth[nth <= k]] = ids[nth <= k]
    y = points.astype(np.float64)
    depth = max(0, int(np.ceil(np.log2(max(1, len(y)) / LEAF))))
    order = np.arange(len(y))
    edges = np.array([0, len(y)])
    levels = []
    for level in range(depth + 1):
        centre = np.empty((len(edges) - 1, y.shape[1]))
        radius = np.empty(len(edges) - 1)
        middle = []
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            idx = order[lo:hi]
            inside = y[idx]
            centre[b] = inside.mean(0)
            far = ((inside - centre[b]) ** 2).sum(1)
            radius[b] = np.sqrt(far.max())
            if level < depth:  # towards the farthest point, and from there to the one farthest from it
                one = inside[far.argmax()]
                other = inside[((inside - one) ** 2).sum(1).argmax()]
                along = inside @ (other - one)
                half = len(idx) // 2
                order[lo:hi] = idx[np.argpartition(along, half)] if half else idx
                middle.append(lo + half)
        levels.append((centre, radius))
        if level < depth:
            edges = np.sort(np.concatenate((edges, middle)))
    return {
        "points": small(points[order]), "ids": names[order], "edges": small(edges),
        "centre": np.concatenate([c for c, _ in levels]), "radius": np.concatenate([r for _, r in levels]), "depth": np.array(depth),
    }


class _Best:
    """The k best (score, id) of each query so far, by score, then smaller id, and the score to reach."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.k = own, k
        self.score = np.full((len(own), k), LEAST, np.int64)
        self.ids = np.full((len(own), k), NO_ID, np.int64)
        self.some = np.zeros((len(own), k), bool)
        self.floor = floor.copy()

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of one vector each: ids has its ids, padded with NO_ID behind the first."""
        rows, k = np.unique(q), self.k
        q, score = np.repeat(q, ids.shape[1]), np.repeat(score, ids.shape[1])
        first = np.zeros(ids.shape, bool)
        first[:, 0] = True
        ids, first = ids.ravel(), first.ravel()
        good = ((ids != NO_ID) | first) & (ids != self.own[q])
        old = self.some[rows]
        q = np.concatenate((q[good], np.repeat(rows, k)[old.ravel()]))
        score = np.concatenate((score[good], self.score[rows][old]))
        ids = np.concatenate((ids[good], self.ids[rows][old]))
        by = np.lexsort((ids, ~score, q))  # ~x descends and never overflows
        q, score, ids = q[by], score[by], ids[by]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        stay = nth < k
        q, nth = q[stay], nth[stay]
        self.some[rows] = False
        self.score[q, nth], self.ids[q, nth], self.some[q, nth] = score[stay], ids[stay], True
        full = rows[self.some[rows, k - 1]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, k - 1])


class _Search:
    def __init__(self, tree: dict[str, np.ndarray], q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.t, self.q, self.k = tree, q, k
        self.best = _Best(own, floor, k)
        self.f = q.astype(np.float64)
        self.norm = np.sqrt((self.f**2).sum(1)) * (1 + 1e-12)
        #: What rounding may take from a bound.
        self.slack = 1 + 1e-12 * self.norm * float(np.sqrt((tree["points"].astype(np.float64) ** 2).sum(1)).max(initial=0)) * self.f.shape[1]

    def bounds(self, level: int, rows: slice | np.ndarray) -> np.ndarray:
        balls = slice((1 << level) - 1, (2 << level) - 1)
        return self.f[rows] @ self.t["centre"][balls].T + self.norm[rows, None] * self.t["radius"][balls] + self.slack[rows, None]

    def leaf(self, b: int, rows: np.ndarray) -> None:
        lo, hi = self.t["edges"][b], self.t["edges"][b + 1]
        score = _product(self.q[rows], self.t["points"][lo:hi])
        reach = self.best.floor[rows]
        if score.shape[1] > self.k + 1:  # k + 1 vectors hold k ids that are not the query's own
            reach = np.maximum(reach, np.partition(score, -self.k - 1, axis=1)[:, -self.k - 1])
        i, j = np.nonzero(score >= reach[:, None])
        if len(i):
            self.best.add(rows[i], score[i, j], self.t["ids"][lo + j])

    def each_leaf(self, rows: np.ndarray, leaves: np.ndarray) -> None:
        by = np.argsort(leaves, kind="stable")
        rows, leaves = rows[by], leaves[by]
        first = np.flatnonzero(np.concatenate(([True], leaves[1:] != leaves[:-1]))) if len(leaves) else ()
        for a, z in zip(first, np.append(first[1:], len(leaves)) if len(leaves) else ()):
            self.leaf(int(leaves[a]), rows[a:z])

    def dive(self) -> None:
        at, rows = np.zeros(len(self.q), np.int64), np.arange(len(self.q))
        for level in range(1, int(self.t["depth"]) + 1):
            bound = self.bounds(level, slice(None))
            at = 2 * at + (bound[rows, 2 * at + 1] > bound[rows, 2 * at])
        self.each_leaf(rows, at)

    def search(self) -> None:
        depth = int(self.t["depth"])
        for start in range(0, len(self.q), ROWS_AT_ONCE):
            rows = np.arange(start, min(start + ROWS_AT_ONCE, len(self.q)))
            floor = self.best.floor[rows, None].astype(np.float64)
            live = np.ones((len(rows), 1), bool)
            for level in range(depth + 1):
                if level:
                    live = np.repeat(live, 2, axis=1)
                bound = self.bounds(level, rows)
                live &= bound >= floor
            bound[~live] = -np.inf
            by = np.argsort(-bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, by, axis=1)
            done, step = 0, 1
            while done < by.shape[1]:
                part = bound[:, done : done + step]
                i, j = np.nonzero((part >= self.best.floor[rows, None]) & (part > -np.inf))
                if not len(i):
                    break  # bounds descend: nothing behind can reach its query's score
                self.each_leaf(rows[i], by[i, done + j])
                done, step = done + step, step * 2


def _grown(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("i").fill_null(NO_ID).to_numpy().astype(np.int64)
        tree = ball_tree(ids, whole(table.column("v")), k)
        return pa.table([table.column("w").slice(0, 1), table.column("s").slice(0, 1), pa.array([packed(**tree)], pa.binary())], ["w", "s", "tree"])

    return run


def _block(table: pa.Table) -> pa.Table:
    x = whole(table.column("v"))
    ids = table.column("i").to_numpy().astype(np.int64)
    by = np.lexsort((*x.T[::-1], ids))  # so that a second run numbers them alike
    one = lambda v: pa.array([v], pa.binary())
    return pa.table([table.column("w").slice(0, 1), table.column("b").slice(0, 1), one(packed(ids=ids[by], x=small(x[by])))], ["w", "b", "queries"])


def _searcher(k: int, dive: bool):
    names, kinds = ["w", "b", "at", "query_id", "vec_id", "score"], [pa.int32()] * 3 + [pa.int64()] * 3

    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(trees) or not len(blocks):
            return pa.table([pa.array([], t) for t in kinds], names)
        got = unpacked(blocks.column("queries")[0].as_py())
        floor = np.full(len(got["ids"]), LEAST, np.int64)
        if not dive and (known := blocks.column("at")[0].as_py()):
            floor[known] = blocks.column("floor")[0].as_py()
        s = _Search(unpacked(trees.column("tree")[0].as_py()), got["x"], got["ids"], floor, k)
        s.dive() if dive else s.search()
        q, n = np.nonzero(s.best.some & (s.best.score >= floor[:, None]))
        ids = s.best.ids[q, n]
        where = [pa.array(np.full(len(q), blocks.column(c)[0].as_py()), pa.int32()) for c in ("w", "b")]
        return pa.table([*where, pa.array(q, pa.int32()), pa.array(got["ids"][q]), pa.array(ids, mask=ids == NO_ID), pa.array(s.best.score[q, n])], names)

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partial sorts leave k of a task before the shuffle."""
    best = Window.partitionBy("w", "b", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def largest_products(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of queries its k largest inner products with the vectors of rows: query_id, rank, vec_id, score.

    Components are taken as floor(256 * x), scores are exact, ties go to the smaller key (a null key last). A
    query never meets rows of its own key; with fewer rows than k it gets all. Rows and queries whose vector
    is null, empty, or holds null or non-finite components take no part, nor do queries without key. Vectors
    of different lengths have no product and never meet. A key that repeats among queries gets a list for
    each of its rows; among rows each counts by itself. Scaled components beyond 2**28 count as that. Empty
    tables give no rows; other columns don't matter, whatever their names. Keys are whole numbers.
    """
    lean = lambda df: df.where(finite(df, vector)).select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"), F.size(vector).alias("w"))
    rows, queries = lean(rows), lean(queries).where("i is not null")
    shards, blocks = rows.count() // SHARD_ROWS + 1, queries.count() // BLOCK_QUERIES + 1
    dealt = rows.withColumn("s", shard(F.lit(shards), "i", "v")).groupBy("w", "s")
    trees = stored(dealt.applyInArrow(_grown(k), "w int, s int, tree binary"), "trees")
    dealt = queries.withColumn("b", shard(F.lit(blocks), "i", "v")).groupBy("w", "b")
    lists = stored(dealt.applyInArrow(_block, "w int, b int, queries binary"), "queries")
    every = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("w", "s", "b")
    spread = lambda df: df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("w", "s", "b")
    kind = "w int, b int, at int, query_id long, vec_id long, score long"
    found = every.cogroup(spread(lists)).applyInArrow(_searcher(k, True), kind)
    least = _first(found, k).where(F.col("rank") == k).groupBy("w", "b").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("f"))
    least = stored(least.select("w", "b", F.col("f.at").alias("at"), F.col("f.score").alias("floor")), "floors")
    known = lists.join(least, ["w", "b"], "left")
    found = every.cogroup(spread(known)).applyInArrow(_searcher(k, False), kind)
    return _first(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
