import random
import zlib

import numpy as np

from tenderweave.llm.toxicity import toxicity, train, words


def test_risk_separates_from_unlabelled():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)) < 0.2
    toxic = rng.random(3000) < 0.15
    x[toxic, 0] |= rng.random(toxic.sum()) < 0.95
    x[~toxic, 0] = False
    positive = np.zeros(3600, bool)
    positive[3000:] = True
    p = np.zeros((600, 6), bool)
    p[:, 1:] = rng.random((600, 5)) < 0.2
    p[:, 0] = rng.random(600) < 0.95
    w = train(np.vstack([x, p]), positive, 0.15)
    g = x @ w[:-1] + w[-1]
    assert w[0] > 2 * np.abs(w[1:-1]).max()
    assert ((g > -0.85) == x[:, 0]).mean() > 0.98


def test_held_out_accuracy_and_edge_rows(spark):
    rng = random.Random(7)
    mild, bad = [f"wort{i}" for i in range(80)], ["grob", "fies", "übeltat", "übelkeit"]
    docs, labels = [], []
    for d in range(1500):
        toxic = rng.random() < 0.2
        text = [rng.choice(mild) for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(bad).upper() + rng.choice(["", ",", "!"]))
        docs.append((d, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((d, int(toxic), "q"))
    truth = dict(zip([d for d, _ in docs], [bool(words(t) & {b.encode() for b in bad}) for _, t in docs]))
    docs += [(5000, None), (5001, ""), (3, docs[3][1]), (5002, "wort1 " * 30000 + "grob")]
    labels += [(labels[0][0], 0, "again"), (9999, 1, "no such document"), (4, None, "null")]
    df = spark.createDataFrame([(d, t, 0.5, True) for d, t in docs], "doc_id long, text string, score double, held_out boolean")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    rows = toxicity(df, lab).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert all(r.predicted == truth.get(r.doc_id, r.doc_id == 5002) for r in rows if r.doc_id not in (5000, 5001))
    assert all(r.predicted == 0 for r in rows if r.doc_id in (5000, 5001))


def test_without_positives_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(df, none).collect()] == [0, 0]
    assert toxicity(df.limit(0), none).collect() == []


def test_without_a_telling_word_nothing_is_toxic(spark):
    from tenderweave.llm.toxicity import without_toxic

    docs = spark.createDataFrame([(1, "a few words"), (3, "other words here"), (4, None), (5, ""), (6, "more"), (8, "so on " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 3, 4, 5, 6, 8)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity(docs, labels).collect()} == {0}
    assert without_toxic(docs, labels).count() == 6


def test_training_lowers_the_non_negative_risk():
    import numpy as np

    from tenderweave.llm.toxicity import train

    rng = np.random.default_rng(3)
    toxic = np.concatenate([np.ones(300, bool), rng.random(1500) < 0.2])  # 300 confirmed, 1,500 unlabelled of which a fifth are toxic
    x = (rng.random((1800, 6)) < np.where(toxic[:, None], [0.8, 0.7, 0.1, 0.3, 0.3, 0.3], [0.05, 0.1, 0.5, 0.3, 0.3, 0.3])).astype(np.float32)
    positive = np.arange(1800) < 300

    def risk(w):
        g = np.hstack([x, np.ones((1800, 1))]) @ w
        loss = lambda z: 1 / (1 + np.exp(z))
        p, u = g[positive], g[~positive]
        return 0.2 * loss(p).mean() + max(0, loss(-u).mean() - 0.2 * loss(-p).mean())

    start = np.append(np.zeros(6), np.log(0.2 / 0.8))
    few, many = train(x, positive, 0.2, steps=20), train(x, positive, 0.2, steps=400)
    assert risk(many) < risk(few) < risk(start)
    guess = np.hstack([x, np.ones((1800, 1))])[~positive] @ many > 0
    assert (guess == toxic[~positive]).mean() > 0.9
