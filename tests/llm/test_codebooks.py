import hashlib
import random

import numpy as np
import pytest

from tenderweave.llm import codebooks
from tenderweave.llm.codebooks import assigned, compressed, compression, metric_tree


def brute(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, embedding, label), by the definition, in Python's whole numbers."""
    ok = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    ok.sort(key=lambda r: r[0])
    w = len(ok[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v, book):
        return min(range(len(book)), key=lambda e: (d2(v, book[e]), e))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in ok:
                own.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by = [], {}
    for i, v, y in ok:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d2(cut(v, p), books[p][c]) for p, c in enumerate(code))
        out.append((i, "".join(f"{c:02x}" for c in code), error, y))
        by[y] = by.get(y, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by[y], sha) for i, c, e, y in out)


@pytest.mark.parametrize("seed,n,spread", [(1, 400, 40), (2, 3000, 400), (3, 500, 3), (4, 1, 9), (5, 40, 1 << 27)])
def test_balls_assign_as_all_pairs_do(seed, n, spread):
    rng = np.random.default_rng(seed)
    x = np.unique(np.concatenate([rng.integers(-spread, spread, (n, 4)), rng.integers(-3, 3, (n // 4, 4)) + spread]), axis=0)
    weight = rng.integers(1, 5, len(x))
    tree = metric_tree(x, weight)
    order = tree.pop("order")
    assert sorted(order.tolist()) == list(range(len(x)))
    x, weight = x[order], weight[order]
    leaves = tree["kids"][:, 0] < 0
    assert sorted(np.concatenate([np.arange(a, b) for a, b in zip(tree["lo"][leaves], tree["hi"][leaves])]).tolist()) == list(range(len(x)))
    for b in range(len(leaves)):
        inside = x[tree["lo"][b] : tree["hi"][b]]
        assert np.sqrt(((inside - tree["centre"][b]) ** 2).sum(1)).max() <= tree["radius"][b] + 1e-9 * spread
        assert tree["count"][b] == weight[tree["lo"][b] : tree["hi"][b]].sum()
    entries = np.concatenate([x[rng.integers(0, len(x), 20)], rng.integers(-spread, spread, (20, 4)), x[:2], x[:2]])
    owner, count, total = assigned(tree, x, weight, entries)
    d = ((x[:, None].astype(object) - entries) ** 2).sum(2)
    want = np.array([min(range(len(entries)), key=lambda e: (row[e], e)) for row in d])
    assert (owner == want).all()
    assert (count == np.bincount(want, weight, len(entries))).all()
    assert all((total[e] == (x[want == e] * weight[want == e, None]).sum(0)).all() for e in range(len(entries)))


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "SHARD_ROWS", 60)
    rng = random.Random(5)
    same = [rng.gauss(0, 0.3) for _ in range(32)]
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)] if i % 3 else same, rng.choice([None, 1, 2])) for i in range(5, 300)]
    rows += [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 2), (4, [1.0] * 31 + [float("inf")], 2), (301, [], 1), (302, [2.0e5] * 32, 9)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, error int, l string")
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(map(tuple, compression(df).collect())) == brute(single)


def test_edges(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert compression(spark.createDataFrame([], kind)).collect() == []
    assert compression(spark.createDataFrame([(1, None, "a")], kind)).collect() == []
    rows = [(1, [0.1 * k for k in range(19)], "a"), (1, [0.1 * k for k in range(19)], None), (None, [1.0] * 19, ""), (7, [1.0] * 18, "a"), (8, [1e30] * 19, None)]
    out, books = compressed(spark.createDataFrame(rows, kind))
    got = {(r.vec_id, r.label): r for r in out.collect()}
    assert len(got) == 4 and got[1, "a"].code == got[1, None].code and all(r.error == 0 for r in got.values())
    assert [b.shape for b in books] == [(4, 1)] * 5 + [(4, 2)] + [(4, 1)] * 4 + [(4, 2)] + [(4, 1)] * 4 + [(4, 2)]
    tiny, _ = compressed(spark.createDataFrame([(1, [0.5], "a"), (2, [0.25], "b")], kind))
    assert [r.error for r in tiny.collect()] == [0, 0]
    with pytest.raises(ValueError):
        compressed(spark.createDataFrame(rows, kind), entries=300)
