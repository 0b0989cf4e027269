import random

import pytest

from tenderweave.llm.graph import components
from tenderweave.llm.jaccard import similar
from tenderweave.llm.simhash import shingle_hashes, without_near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs):
    """The least id of each document's group, by the similarity of all pairs; and the pairs by step of it."""
    sets, root, steps = [(d, shingles(t)) for d, t in sorted(docs, key=lambda x: x[0])], {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, s in sets:
        root[d] = d
        for e, t in sets:
            if e >= d:
                break
            both = len(s & t)
            share = both / (len(s) + len(t) - both)
            steps[int(share * 20)] = steps.get(int(share * 20), 0) + 1
            if 5 * both >= 4 * (len(s) + len(t) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}, steps


def corpus():
    """Groups of edited copies with similarities all around 0.8, over a line that every text has."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(12)]
    docs = []
    for group in range(24):
        base = [word() for _ in range(rng.choice([4, 7, 60, 200]))]
        for _ in range(60 if group == 3 else 7):
            text = list(base if rng.random() < 0.7 else docs[-1][1].split() if docs else base)
            for _ in range(rng.randrange(0, max(2, len(text) // 45))):
                text[rng.randrange(len(text))] = word()
            docs.append((rng.randrange(10**6) * 1000 + len(docs), " ".join(text + line * (rng.random() < 0.3))))
    return docs + [(5, None), (6, ""), (7, " \n"), (8, "One  two"), (9, "one two"), (10, "one")]


@pytest.mark.parametrize("crowd", [3, 32])
def test_groups_are_those_of_the_exact_similarity(spark, crowd):
    docs = corpus()
    expected, steps = brute(docs)
    assert min(steps.get(k, 0) for k in (14, 15, 16, 17)) >= 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.node: r.root for r in components(similar(df, lambda raw: shingle_hashes(raw, 5), crowd)).collect()}
    assert {d: found.get(d, d) for d in expected} == expected


def test_stage_keeps_the_least_of_each_group(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in without_near_copies(df).collect()) == sorted(set(brute(docs)[0].values()))
    assert without_near_copies(df.limit(0)).collect() == []


def test_tries_give_candidates_which_are_confirmed_and_completed(spark, monkeypatch):
    from tenderweave.llm import simhash as S

    docs = corpus()
    expected, _ = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    joined, real = [], S.links
    monkeypatch.setattr(S, "links", lambda *args: joined.append(real(*args)) or joined[-1])
    assert sorted(r.doc_id for r in without_near_copies(df).collect()) == sorted(set(expected.values()))
    assert len(joined) == 1 and joined[0].count() > 20
    rng = random.Random(8)
    ids = sorted(expected)
    wrong = [(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(300)) if expected[a] != expected[b]]
    right = [(d, r) for d, r in expected.items() if rng.random() < 0.3]
    seeds = spark.createDataFrame([*wrong, *right, *right[:5], (-1, ids[0])], "a long, b long")
    for crowd in (3, 32):
        found = {r.node: r.root for r in components(similar(df, lambda raw: shingle_hashes(raw, 5), crowd, seeds)).collect()}
        assert {d: found.get(d, d) for d in expected} == expected
