import random

import numpy as np
import pytest

from tenderweave.llm import topk
from tenderweave.llm.topk import LEAST, _Search, ball_tree, largest_products


def brute(queries, rows, k=5):
    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v)

    cut = lambda v: [int(np.clip(np.floor(256.0 * x), -(2**28), 2**28)) for x in v]
    rows = [(i, cut(v)) for i, v in rows if ok(v)]
    out = []
    for q, v in queries:
        if q is None or not ok(v):
            continue
        v = cut(v)
        found = sorted((-sum(a * b for a, b in zip(v, x)), i is None, i or 0, i) for i, x in rows if i != q and len(x) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,spread,copies", [(1, 3, 0), (2, 300, 400), (3, 1 << 28, 50)])
def test_one_tree(seed, spread, copies):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (1500, 8))
    x[:copies] = x[0]
    x[600:700] = x[600:700] // 4 + np.array([spread // 2] * 8)  # a cluster
    ids = rng.permutation(1500)
    tree = ball_tree(ids, x, 5)
    at = np.concatenate((np.arange(0, 1500, 50), [1, 2]))
    floor = np.full(len(at), LEAST)
    want = [sorted(((-int(s), int(i)) for s, i in zip((x.astype(object) @ q.astype(object)), ids) if i != own))[:5] for q, own in zip(x[at], ids[at])]
    for known in (False, True):
        if known:  # the score shared by other shards
            floor = np.array([-w[-1][0] for w in want])
        s = _Search(tree, x[at], ids[at], floor, 5)
        s.search()
        assert [[(-int(a), int(b)) for a, b in zip(*r)] for r in zip(s.best.score, s.best.ids)] == want
    s = _Search(tree, x[at], ids[at], np.full(len(at), LEAST), 5)
    s.dive()
    assert all(a <= -w[-1][0] for a, w in zip(s.best.floor, want))


def test_search_skips_leaves(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 500, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 5, (8000, 16))).astype(np.int64)
    s = _Search(ball_tree(np.arange(8000), x, 5), x[::400], np.arange(0, 8000, 400), np.full(20, LEAST), 5)
    seen = []
    leaf = s.leaf
    monkeypatch.setattr(s, "leaf", lambda b, rows: (seen.append(len(rows)), leaf(b, rows)))
    s.search()
    assert sum(seen) < 20 * 40  # of 125 or more leaves


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    rng = random.Random(3)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, same if i % 3 == 0 else [rng.choice([-1.0, 0.5, 0.25, 0.0]) for _ in range(4)]) for i in range(1, 640)]
    rows += [(700, [1.0, 2.0]), (750, [0.5, 0.5]), (701, [-3.0, 1.0]), (800, [None] * 4), (850, [float("nan"), 1.0, 1.0, 1.0]), (900, None), (950, []), (None, [1.0] * 4), (50, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, s int, b int, score string")
    got = sorted(map(tuple, largest_products(df.where("vec_id % 50 = 0"), df).collect()), key=str)
    assert got == brute([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows)
    few = spark.createDataFrame([(1, [1e30, 1.0]), (50, [2.0, -1e30]), (100, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, largest_products(few.where("vec_id > 1"), few).collect()), key=str) == brute([(50, [2.0, -1e30]), (100, [0.0, 1.0])], [(1, [1e30, 1.0]), (50, [2.0, -1e30]), (100, [0.0, 1.0])])
    assert largest_products(few.limit(0), few).collect() == [] and largest_products(few, few.limit(0)).collect() == []
