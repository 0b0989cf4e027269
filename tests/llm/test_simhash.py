import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tenderweave.llm import simhash
from tenderweave.llm.graph import components
from tenderweave.llm.simhash import links, near_duplicates, without_near_copies


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, budget=4):
    ids = list(range(len(prints)))
    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= budget:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(prints))]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["An", "ber", "chö", "d"]) + rng.choice(["x", "yy", "z,"])
    docs = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([1, 3, 4, 5, 60, 300]))]
        for _ in range(8):
            near = list(words)
            for _ in range(rng.randrange(0, 3)):
                near[rng.randrange(len(near))] = word()
            docs.append((len(docs) * 7 % 101, rng.choice([" ", "\n", " \t"]).join(near)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, docs[0][1]), (503, docs[0][1]), (504, " a b"), (505, "a b c d e")]
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in docs], "doc_id long, text string, w0 int, least int")
    prints = [(d, brute_print(t)) for d, t in docs]
    expected = sorted((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints)))
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == expected
    assert near_duplicates(df.limit(0)).collect() == []


def test_links_of_crowded_nodes(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12)
    fps = set()
    for b in base.tolist():
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    rows = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "w0 long, least long")
    expected = brute_components(list(enumerate(fps)))
    for slot in (10, 4096):
        root = {r.node: r.root for r in components(links(classes, 4, slot_size=slot)).collect()}
        assert [root.get(i, i) for i in range(len(fps))] == expected


def test_small_frontier(spark, monkeypatch):
    v = np.sort(np.random.default_rng(3).integers(0, 2**20, 300).astype(np.uint64))
    v = np.unique(v)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    join = simhash._Join(v, 3)
    join.run(np.array([[0], [len(v)], [0], [len(v)], [0]]), 63)
    expected = brute_components(list(enumerate(v.tolist())), 3)
    assert join.label.tolist() == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in range(7, 60)}, 199: 199, 200: 199}


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("xyz")
    base = [[word() for _ in range(300)] for _ in range(15)]
    docs = [(k, " ".join(w), "x", k) for k, w in enumerate(base)]
    docs += [(100 + k, " ".join([*w[:150], "new", *w[151:]]), "y", k) for k, w in enumerate(base)]
    docs += [(200 + k, " ".join(w), None, k) for k, w in enumerate(base)] + [(3, docs[3][1], "again", 3), (900, None, "n", 0), (901, "", "n", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, component_id string, w0 int")
    kept = without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(15), 900]


def test_rows_without_ids_and_rows_of_one_id(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    docs = [(1, text(1), 0), (1, text(2), 1), (None, text(3), 2), (None, text(3), 3), (None, text(1), 4), (2, text(4), 5), (2, text(4), 6), (9, text(2), 7), (None, None, 8), (None, "", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, row int").withColumnRenamed("row", "__first").withColumn("row", F.lit("x")).withColumn("__later", F.lit(None).cast("int"))
    kept = without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept.collect()) == [(0, ""), (0, "3w"), (1, "1w"), (1, "2w"), (2, "4w")]
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 2), (9, 1)]


def test_several_words_with_equal_parts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        a, b = int(rng.integers(0, 3)), int(rng.integers(0, 2**62))
        rows.append((k, a, b if k % 3 else a))
    df = spark.createDataFrame(rows, "least long, w0 long, w1 long")
    far = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    parent = list(range(300))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(300):
        for j in range(i):
            if min((rows[i][1] ^ rows[j][1]).bit_count(), (rows[i][2] ^ rows[j][2]).bit_count()) <= 5 and far(rows[i], rows[j]) <= 24:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for slot in (40, 4096):
        root = {r.node: r.root for r in components(links(df, 5, 2, 24, slot)).collect()}
        assert [root.get(i, i) for i in range(300)] == [find(i) for i in range(300)]
