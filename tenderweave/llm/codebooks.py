"""Compression of vectors by codebooks of their parts, learnt with metric trees.

Rows are dealt into shards. Inside a shard each part position has a metric tree over its different values,
built middle-out by the anchors hierarchy: as many anchors as the root of the number of points, each new one
at the point farthest from its anchor and taking over what is nearer to it, where lists sorted by distance
and the triangle inequality spare most comparisons; anchors are merged upwards, closest pairs first, and
their own points are divided the same way downwards. A ball knows its rows' count and sum.

Assigning a part goes down its tree level by level. A ball inherits its parent's list of candidate entries
and strikes those that no point in it can be nearest to; when one is left, the ball is that entry's as a
whole and gives its cached count and sum. Only points of leaves that stay open are compared one by one, in
whole numbers. Entries struck are farther for every point of the ball, so ties always reach the comparison.

Shards with their trees are a stored table; a round reads it, sums what its tasks found, and hands the new
entries (parts x entries, the only thing that comes to the driver) to the next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .vectors import EXACT, finite, packed, shard, small, unpacked, whole

SHARD_ROWS = 8192
LEAF = 32
CHUNK = 2048
MOST = 2**63 - 1
SALT = 32


def cuts(width: int, parts: int) -> list[int]:
    return [width * p // parts for p in range(parts + 1)]


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def _anchors(x: np.ndarray, idx: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(centre, places, radius) of about the root of len(idx) anchors over the points x[idx]."""
    want = int(np.ceil(np.sqrt(len(idx))))
    far = _far(x[idx], x[idx[0]])
    by = np.argsort(-far, kind="stable")
    pivots, radii = np.empty((want, x.shape[1])), np.zeros(want)
    pivots[0], radii[0] = x[idx[0]], far[by[0]]
    own = [(idx[by], far[by])]
    while len(own) < want:
        n = len(own)
        j = int(radii[:n].argmax())
        if radii[j] <= 0:
            break
        new = x[own[j][0][0]]
        half = _far(pivots[:n], new) / 2
        taken, dist = [], []
        for k in np.flatnonzero(half < radii[:n]).tolist():
            places, d = own[k]
            reach = int(np.searchsorted(-d, -half[k]))  # beyond, the old anchor is nearer for certain
            near = _far(x[places[:reach]], new)
            goes = near < d[:reach]
            if goes.any():
                taken.append(places[:reach][goes])
                dist.append(near[goes])
                stay = np.concatenate((np.flatnonzero(~goes), np.arange(reach, len(places))))
                own[k] = places[stay], d[stay]
                radii[k] = own[k][1][0] if len(stay) else 0
        places, d = np.concatenate(taken), np.concatenate(dist)
        by = np.argsort(-d, kind="stable")
        pivots[n], radii[n] = new, d[by[0]]
        own.append((places[by], d[by]))
    return [(pivots[k], places, float(radii[k])) for k, (places, _) in enumerate(own) if len(places)]


def _merged(balls: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[int, int]]:
    """Pairs to merge, in order; the k-th merge makes number len(balls) + k."""
    n = len(balls)
    centre, radius = np.array([b[0] for b in balls]), np.array([b[2] for b in balls])
    size = np.array([len(b[1]) for b in balls], float)
    number = list(range(n))
    cost = (_far(centre[:, None], centre[None]) + radius[:, None] + radius[None]) / 2
    cost[np.tril_indices(n)] = np.inf
    out = []
    for k in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        out.append((number[i], number[j]))
        joint = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        radius[i] = max(_far(joint, centre[i]) + radius[i], _far(joint, centre[j]) + radius[j])
        centre[i], size[i], number[i] = joint, size[i] + size[j], n + k
        cost[j, :] = cost[:, j] = np.inf
        live = np.isfinite(cost[i]) | np.isfinite(cost[:, i])
        new = (_far(centre, joint) + radius + radius[i]) / 2
        above = live & (np.arange(n) > i)
        cost[i, above] = new[above]
        under = live & (np.arange(n) < i)
        cost[under, i] = new[under]
    return out


def metric_tree(points: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The tree over different points (whole numbers), each standing for so many rows.

    order: places of the points so that each ball is a slice lo:hi of them; kids: two balls, or -1 for a leaf.
    """
    x = points.astype(np.float64)
    kids: list[tuple[int, int]] = [(-1, -1)]
    leaf: dict[int, np.ndarray] = {}
    work = [(0, np.arange(len(x)))]
    while work:
        ball, idx = work.pop()
        if len(idx) <= LEAF or len(balls := _anchors(x, idx)) < 2:
            leaf[ball] = idx
            continue
        number = list(range(len(kids), len(kids) + len(balls)))
        kids += [(-1, -1)] * len(balls)
        work += [(b, places) for b, (_, places, _) in zip(number, balls)]
        pairs = _merged(balls)
        for k, (a, b) in enumerate(pairs):
            if k < len(pairs) - 1:
                number.append(len(kids))
                kids.append((number[a], number[b]))
            else:
                kids[ball] = (number[a], number[b])
    lo, hi = np.zeros(len(kids), np.int64), np.zeros(len(kids), np.int64)
    order, stack, done = [], [(0, False)], 0
    while stack:
        ball, left = stack.pop()
        if left:
            hi[ball] = done
            continue
        lo[ball] = done
        stack.append((ball, True))
        if ball in leaf:
            order.append(leaf[ball])
            done += len(leaf[ball])
        else:
            stack += [(k, False) for k in kids[ball][::-1]]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    count = np.concatenate(([0], np.cumsum(weights[order])))
    total = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(points[order] * weights[order, None], axis=0)))
    count, total = count[hi] - count[lo], total[hi] - total[lo]
    centre = total / np.maximum(count, 1)[:, None]
    sorted_x = x[order]
    radius = np.array([np.sqrt(((sorted_x[a:b] - c) ** 2).sum(1).max(initial=0)) for a, b, c in zip(lo, hi, centre)])
    return {"order": order, "kids": small(np.array(kids)), "lo": small(lo), "hi": small(hi), "count": count, "sum": total, "centre": centre, "radius": radius}


def _nearest(points: np.ndarray, entries: np.ndarray, candidates: np.ndarray | None = None) -> np.ndarray:
    """For each point its nearest entry, ties to the lower one; candidates: a row of flags for each point."""
    out = np.zeros(len(points), np.int64)
    exact = 4.0 * points.shape[1] * float(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))) ** 2 < EXACT
    for a in range(0, len(points), CHUNK):
        p = points[a : a + CHUNK]
        if exact:  # whole numbers as doubles
            e = entries.astype(np.float64)
            d = (e**2).sum(1) - 2 * (p.astype(np.float64) @ e.T)
        else:
            d = ((p.astype(np.int64)[:, None] - entries) ** 2).sum(2)
        if candidates is not None:
            d[~candidates[a : a + CHUNK]] = d.max(initial=0) + 1
        out[a : a + CHUNK] = d.argmin(1)
    return out


def assigned(tree: dict[str, np.ndarray], points: np.ndarray, weights: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, rows of each entry, sums of each entry's rows); points in the tree's order."""
    k = len(entries)
    owner = np.zeros(len(points), np.int64)
    count, total = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64)
    e = entries.astype(np.float64)
    slack = 1e-9 * (1 + float(np.abs(points).max(initial=0)) + float(np.abs(e).max(initial=0)))
    at, listed = np.zeros(1, np.int64), np.ones((1, k), bool)
    open_places, open_lists = [], []
    while len(at):
        d = np.where(listed, _far(tree["centre"][at][:, None], e[None]), np.inf)
        listed = d <= d.min(1, keepdims=True) + 2 * tree["radius"][at][:, None] + slack
        alone = listed.sum(1) == 1
        mine = listed.argmax(1)
        np.add.at(count, mine[alone], tree["count"][at[alone]])
        np.add.at(total, mine[alone], tree["sum"][at[alone]])
        for ball, entry in zip(at[alone].tolist(), mine[alone].tolist()):
            owner[tree["lo"][ball] : tree["hi"][ball]] = entry
        at, listed = at[~alone], listed[~alone]
        leaf = tree["kids"][at, 0] < 0
        for ball, flags in zip(at[leaf].tolist(), listed[leaf]):
            places = np.arange(tree["lo"][ball], tree["hi"][ball])
            open_places.append(places)
            open_lists.append(np.broadcast_to(flags, (len(places), k)))
        at, listed = tree["kids"][at[~leaf]].astype(np.int64).ravel(), np.repeat(listed[~leaf], 2, axis=0)
    if open_places:
        i = np.concatenate(open_places)
        owner[i] = _nearest(points[i], entries, np.concatenate(open_lists))
        np.add.at(count, owner[i], weights[i])
        np.add.at(total, owner[i], points[i].astype(np.int64) * weights[i, None])
    return owner, count, total


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not x.shape[1]:
        return x[:1], np.zeros(len(x), np.int64), np.full(min(1, len(x)), len(x))
    points, place, count = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    return points, place.ravel(), count


def _builder(parts: int, names: list[str]):
    """Of a shard: one row with its rows' ids and labels and the trees of all parts."""

    def run(table: pa.Table) -> pa.Table:
        x = whole(table.column("v"))
        edge = cuts(x.shape[1], parts)
        arrays = {}
        for p in range(parts):
            points, place, weight = _distinct(x[:, edge[p] : edge[p + 1]])
            tree = metric_tree(points, weight)
            order = tree.pop("order")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            arrays |= {f"{p}.{k}": v for k, v in tree.items()}
            arrays |= {f"{p}.points": small(points[order]), f"{p}.weight": small(weight[order]), f"{p}.place": small(back[place])}
        cells = [pa.array([table.column(c).combine_chunks().to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("i", "l")]
        return pa.table([*cells, pa.array([packed(**arrays)], pa.binary())], names)

    return run


def _parts(data: bytes, parts: int):
    arrays = unpacked(data)
    for p in range(parts):
        yield p, {k.partition(".")[2]: v for k, v in arrays.items() if k.startswith(f"{p}.")}


def _summer(books: list[np.ndarray]):
    """Of each shard: what its parts add to each entry, as (part, entry, place, sum); place -1 has the count."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for p, t in _parts(data.as_py(), len(books)):
                    _, count, total = assigned(t, t["points"], t["weight"], books[p])
                    used = np.flatnonzero(count)
                    table = np.column_stack((count, total))[used]
                    e, at = np.meshgrid(used, np.arange(table.shape[1]) - 1, indexing="ij")
                    out.append((np.full(table.size, p), e.ravel(), at.ravel(), table.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["part", "entry", "at", "n"])

    return run


def _coder(books: list[np.ndarray], names: list[str]):
    """Of each shard: a row for each of its rows, with code and error."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                codes, exact, near = [], 0, 0.0
                for p, t in _parts(batch.column(2)[k].as_py(), len(books)):
                    owner, _, _ = assigned(t, t["points"], t["weight"], books[p])
                    d = ((t["points"].astype(np.int64) - books[p][owner]) ** 2).sum(1)[t["place"]]
                    codes.append(owner[t["place"]].astype(np.uint8))
                    exact, near = exact + d, near + d.astype(np.float64)
                top = np.where(near < MOST - 2048, exact, MOST)
                text = [row.tobytes().hex() for row in np.ascontiguousarray(np.array(codes).T)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(text, pa.string()), pa.array(top, pa.int64())], names)

    return run


def _seeds(kept: DataFrame, entries: int) -> tuple[int, list]:
    """The length of vectors, which the first row by id decides, and the first rows' vectors of that length."""
    by = [F.col("i").asc_nulls_last(), F.col("v")]
    first = kept.select("v").orderBy(*by).limit(1).collect()
    if not first:
        return 0, []
    width = len(first[0][0])
    return width, [r[0] for r in kept.where(F.size("v") == width).select("v").orderBy(*by).limit(entries).collect()]


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks). Rows: key, label, code (two hex digits a part), error (squared distance to the entries, long).

    Vectors are cut into `parts` consecutive parts (of equal length, or differing by one) of whole numbers
    floor(256 * x). A part's codebook starts as that part of the `entries` smallest keys' vectors and is moved
    to the floor of its parts' means `rounds` times; an entry without parts stays. Ties go to the lower entry.

    Rows whose vector is null, empty, or holds null or non-finite components are left out, as are vectors of
    another length than the one with the smallest key. Null keys come last in the order, equal keys by their
    vectors; each row is coded by itself, with any label. With fewer rows than `entries`, codebooks are as
    short. Scaled components beyond 2**28 count as that; an error beyond 64 bits counts as the largest. An empty
    table gives no rows and no codebooks. Other columns don't matter, whatever their names.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hex digits: 1 to 256 entries, and 1 part at least")
    kept = df.where(finite(df, vector)).select(F.col(key).alias("i"), F.col(label).alias("l"), F.col(vector).alias("v"))
    width, seeds = _seeds(kept, entries)
    kinds = f"`{key}` {kept.schema['i'].dataType.simpleString()}, `{label}` {kept.schema['l'].dataType.simpleString()}, code string, error long"
    if not seeds:
        return df.sparkSession.createDataFrame([], kinds), []
    edge = cuts(width, parts)
    start = whole(pa.array(seeds, pa.list_(pa.float64())))
    books = [start[:, edge[p] : edge[p + 1]] for p in range(parts)]
    kept = kept.where(F.size("v") == width)
    shards = kept.count() // SHARD_ROWS + 1
    dealt = kept.withColumn("s", shard(F.lit(shards), "i", "v"))
    held = ", ".join(f"{c} array<{kept.schema[c].dataType.simpleString()}>" for c in ("i", "l")) + ", data binary"
    trees = stored(dealt.groupBy("s").applyInArrow(_builder(parts, ["i", "l", "data"]), held), "trees")
    for _ in range(rounds):
        found = trees.select("data").mapInArrow(_summer(books), "part long, entry long, at long, n long")
        moved = [b.copy() for b in books]
        rows = {(r[0], r[1], r[2]): int(r[3]) for r in found.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect()}
        for (p, e, at), n in rows.items():
            if at >= 0:
                moved[p][e, at] = n // rows[p, e, -1]
        books = moved
    return trees.mapInArrow(_coder(books, [key, label, "code", "error"]), kinds), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compression(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """compressed() with the digest of the codebooks and, per row, the errors of all rows of its label (nulls together).

    The sums by label come back by a join on label and a salt, so that a label of a third of all rows is spread.
    A sum beyond 64 bits counts as the largest of them.
    """
    rows, books = compressed(df, key, vector, label)
    rows = stored(rows, "codes")
    name = free_name(rows, "salt")
    sums = rows.groupBy(F.struct(F.col(label).isNull().alias("no"), F.col(label).alias("l")).alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    kind = rows.schema[label].dataType
    blank = {"string": F.lit("")}.get(kind.simpleString(), F.lit(0)).cast(kind)
    sums = sums.select(F.col("of.no").alias("no"), F.coalesce("of.l", blank).alias("l"), "label_error").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    left = rows.withColumns({name: F.pmod(F.xxhash64(key, "code"), F.lit(SALT)).cast("int")})
    on = (F.col(label).isNull() == sums["no"]) & (F.coalesce(F.col(label), blank) == sums["l"]) & (left[name] == sums["salt"])
    return left.join(sums, on).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
