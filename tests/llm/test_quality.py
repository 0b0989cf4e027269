import random
import re
from collections import Counter

from tenderweave.llm.quality import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_base_rules_and_verdict(spark):
    rng = random.Random(9)
    good = [f"haus{i}" for i in range(60)]
    junk = [f"zz{i}%%" for i in range(60)]
    docs = [(d, rng.choice([" ", "\n", "\t"]).join(rng.choice(good if d % 3 else junk) for _ in range(rng.randrange(0, 200)))) for d in range(300)]
    docs += [(400, None), (401, ""), (402, "a b c a b c a b c"), (403, "é ü x\n\nsame\nsame\r\n same\nsame"), (404, "x y z " * 5000), (5, docs[5][1]), (405, "one two"), (406, "| # <b>&\n| # <b>&")]
    df = spark.createDataFrame([(d, t, "k", 1.5) for d, t in docs], "doc_id long, text string, kept string, score double")
    trusted = spark.createDataFrame([(d,) for d, _ in docs[:300] if d % 3 and d % 2] + [(7777,), (None,)], "doc_id long")
    rows = quality(df, trusted).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((d, *brute(t)) for d, t in docs)
    for r in rows:
        if r.doc_id < 300:
            assert r.kept == (not r.base_failed and r.doc_id % 3 > 0), r


def test_score_is_the_mean_log_ratio(spark):
    import math
    import zlib

    from tenderweave.llm import quality as q

    docs = [(1, "a b a"), (2, "a c c"), (3, "")]  # crc32 of "1" modulo 4 is 3: in the target
    bucket = lambda *w: (zlib.crc32(w[0]) % q.BUCKETS) if len(w) == 1 else (((zlib.crc32(w[0]) * 0x9E3779B97F4A7C15 + zlib.crc32(w[1]) * 0xC2B2AE3D27D4EB4F) % 2**64) >> 40) % q.BUCKETS
    grams = {d: [bucket(x) for x in t.encode().split()] + [bucket(*p) for p in zip(t.encode().split(), t.encode().split()[1:])] for d, t in docs}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    share = lambda c, g: (c[g] + 0.5) / (sum(c.values()) + 0.5 * q.BUCKETS)
    rows = quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).collect()
    for r in rows:
        x = grams[r.doc_id]
        expected = sum(math.log(share(target, g) / share(raw, g)) for g in x) / len(x) if x else 0
        assert abs(r.score - expected) < 1e-9


def test_without_trusted_or_documents(spark):
    df = spark.createDataFrame([(1, "w " * 3 + " ".join(map(str, range(60))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [(r.kept, r.score) for r in quality(df, none).collect()] == [(True, 0.0)]
    assert quality(df.limit(0), none).collect() == []


def test_all_trusted_documents_count_however_their_ids_are_joined(spark):
    rng = random.Random(3)
    docs = [(d, " ".join(rng.choice(["haus", "baum", "zz%", "rot"]) + str(rng.randrange(9)) for _ in range(80))) for d in range(120)] + [(None, "haus1 " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    trusted = spark.createDataFrame([(d,) for d in range(0, 120, 2)], "doc_id long")
    by = lambda n: sorted((r.doc_id or -1, r.score, r.threshold, r.kept) for r in quality(df, trusted, broadcast_ids=n).collect())
    assert by(0) == by(1000)


def test_repeats_of_more_words_than_the_packed_form_holds():
    import numpy as np

    from tenderweave.llm.quality import _repeat_words

    rng = np.random.default_rng(1)
    small = rng.integers(0, 12, 400)
    assert _repeat_words(small) == _repeat_words(small + (1 << 22)) == brute(" ".join(map(str, small)))[4]
