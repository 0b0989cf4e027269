import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[2]), str(Path(__file__).parent)]

import corpus_pipeline
from test_decontaminate import brute as brute_contamination
from test_suffix import WIDTH


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "be", "ci", "do", "ef"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for d in range(400):
        t = text(rng.randrange(3, 160)).split()
        toxic = d % 8 == 0
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["vilezz", "rudezz"])
        docs.append((d, " ".join(t)))
        if d % 2 == 0 or toxic:
            labels.append((d, 1, int(toxic)))
    items = [(i, text(40)) for i in range(5)]
    passage = text(60)
    for k in range(10):
        docs.append((520 + k, docs[k * 3 + 1][1]))  # exact copies
        docs.append((500 + k, text(200)))
        near = docs[-1][1].split()
        near[rng.randrange(200)] = "other"
        docs.append((600 + k, " ".join(near)))
        docs.append((700 + k, f"{text(30)} {passage} {text(20)}"))
        docs.append((800 + k, f"{text(30)} {items[k % 5][1]} {text(5)}"))
    docs += [(900, None), (901, ""), (902, "vilezz"), (903, text(9000)), (5, docs[5][1])]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def groups(docs):
    """Least ids of the components of pairs with a Jaccard similarity of 0.8 or more over five-word shingles."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def stripped(docs):
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - WIDTH + 1):
            first[raw[i : i + WIDTH]] = min(d, first.get(raw[i : i + WIDTH], d))
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - WIDTH + 1):
            if first[raw[i : i + WIDTH]] < d:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        if not raw or not all(gone):
            out[d] = None if t is None else bytes(b for b, g in zip(raw, gone) if not g).decode()
    return out


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    by_name = dict(corpus_pipeline.STAGES)
    clean = by_name["toxicity"](spark, docs, folder).cache()
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns
    assert set(kept) == {d for d, t in seen.items() if not any(w in (t or "") for w in ("vilezz", "rudezz"))}
    single = by_name["near_copies"](spark, clean, folder).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups(sorted(kept.items())))
    assert not {d for d in range(600, 610)} & {r.doc_id for r in single.collect()}
    left = by_name["repeats"](spark, single, folder).cache()
    assert left.columns == columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts == stripped([(r.doc_id, r.text) for r in single.collect()])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.collect())
    free = by_name["benchmarks"](spark, left, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in free.collect()) == sorted(r[0] for r in brute_contamination(list(texts.items()), items) if not r[5])
    pieces = by_name["packing"](spark, free, folder).collect()
    tokens = {r.doc_id: len((r.text or "").split()) + 1 for r in free.collect()}
    packed = {}
    for p in pieces:
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.n_tokens
    assert packed == tokens
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, pieces))


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
