import hashlib
import random

from pyspark.sql import functions as F

from tenderweave.llm.suffix import WIDTH, suffix_dedup, without_repeats


def brute(docs):
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - WIDTH + 1):
            s = raw[i : i + WIDTH]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - WIDTH + 1):
            if first[raw[i : i + WIDTH]] < d:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_random_texts_with_planted_repeats(spark):
    rng = random.Random(5)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([48, 49, 50, 51, 80, 300]))) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(0, 7)):
            parts.append(rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 90))))
        docs.append((d * 3 % 61, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "x" * 400), (103, "x" * 60), (104, "ab" * 100), (7, docs[3][1]), (105, docs[3][1])]
    docs += [(200 + k, passage[0] * 30) for k in range(20)]
    df = spark.createDataFrame([(d, t, "clash", d) for d, t in docs], "doc_id long, text string, block string, names long")
    assert rows(suffix_dedup(df)) == brute(docs)


def test_empty_table_and_kept_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).collect() == []
    docs = [(1, "é" * 40, "x", 40), (2, "q" + "é" * 40 + "z", None, 42), (3, None, "y", None), (4, "é" * 30, "gone", 30), (5, "", "z", 0)]
    kept = without_repeats(spark.createDataFrame(docs, "doc_id long, text string, block string, n_chars long"))
    assert kept.columns == ["doc_id", "text", "block", "n_chars"]
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "é" * 40, "x", 40), (2, "qz", None, 2), (3, None, "y", None), (5, "", "z", 0)]
    assert without_repeats(kept.limit(0)).collect() == []


def test_rows_without_ids_and_clashing_columns(spark):
    long = "abcdefghij" * 8
    docs = [(None, long, 1, 2**60 + 1, 80), (1, long, 2, None, 80), (2, long + "q", 3, 2**60 + 3, 81), (None, None, 4, 5, None), (None, "xé", 5, 6, 2), (7, None, 6, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __block int, part long, n_chars int").withColumn("at", F.current_timestamp()).withColumn("names", F.array(F.lit(1.5)))
    kept = without_repeats(df)
    assert kept.columns == df.columns and [f.dataType for f in kept.schema] == [f.dataType for f in df.schema]
    assert sorted(((r.doc_id or 0), r.text or "", r.part or 0, r.n_chars or 0) for r in kept.collect()) == [(0, "", 5, 0), (0, long, 2**60 + 1, 80), (0, "xé", 6, 2), (1, long, 0, 80), (2, "q", 2**60 + 3, 1), (7, "", 0, 0)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept_sha256) for r in suffix_dedup(df).collect()}
    assert got[None, 80] == (0, hashlib.sha256(long.encode()).hexdigest()) and got[2, 81][0] == 80 and got[None, 0][0] == 0 and len(got) == 6
