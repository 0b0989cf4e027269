import pytest
from pyspark.sql import functions as F

from tenderweave.operators import evaluation as E
from tenderweave.operators import learning as L
from tenderweave.operators.records import sync_snapshot

HITS = [
    ("lexical", 1, 1, "IS 10322 : Part 5"), ("lexical", 1, 2, "IS 9"), ("vector", 1, 1, "IS 9"), ("fused", 1, 1, "is 10322 Part 5 Sec 3"), ("ranked", 1, 1, "IS 9"), ("ranked", 1, 6, "IS 10322"),
    ("lexical", 2, 1, "IS 8"), ("vector", 2, 3, "IS7"), ("fused", 2, 1, "IS 8"), ("ranked", 2, 1, "IS 7"), ("lexical", 3, 2, "IS: 5"), ("fused", 3, 1, ""), ("ranked", 3, 1, None), ("vector", 3, 1, None),
]
GOLD = [(1, "IS 10322 Part 5"), (2, "IS 7"), (3, "IS 5"), (4, "IS 1")]


def test_modes_of_matching(spark):
    hits, gold = spark.createDataFrame(HITS, "stage string, query_id int, rank int, number string"), spark.createDataFrame(GOLD, "query_id int, expected string")
    got = {(r["mode"], r.stage): (r.n_queries, r.recall_at_1, r.recall_at_3, r.mrr) for r in E.match_modes(hits, gold).collect()}
    assert len(got) == 12 and {n for n, *_ in got.values()} == {4}
    assert got["exact", "lexical"] == (4, 0.25, 0.5, 0.375) and got["exact", "fused"] == (4, 0.0, 0.0, 0.0)
    assert got["contained", "fused"] == (4, 0.25, 0.25, 0.25) and got["either_way", "vector"] == (4, 0.0, 0.0, 0.0)
    assert got["contained", "vector"] == (4, 0.0, 0.25, round(1 / 12, 4)) and got["either_way", "ranked"] == (4, 0.25, 0.25, round((1 + 1 / 6) / 4, 4))
    with pytest.raises(ValueError):
        E.matches("other", F.lit("a"), F.lit("b"))


def test_where_a_hit_is_lost(spark):
    hits, gold = spark.createDataFrame(HITS, "stage string, query_id int, rank int, number string"), spark.createDataFrame(GOLD, "query_id int, expected string")
    losses = E.stage_losses(hits, gold, "contained")
    assert {r.query_id: (r.lost_at, r.carried_by) for r in losses.collect()} == {1: ("ranking", "lexical"), 2: ("none", "vector"), 3: ("fusion", "lexical"), 4: ("retrieval", None)}
    d = E.stage_diagnosis(losses).first()
    assert (d.n_queries, d.lexical, d.fused, d.lost_at_ranking, d.finding) == (4, 50.0, 25.0, 1, "healthy")
    finds = lambda q: E.stage_diagnosis(losses.where(q)).first().finding
    assert finds("query_id = 1") == "ranker_buries_hits" and finds("query_id = 3") == "vector_is_weak" and finds("query_id = 4") == "nothing_matches"


def test_threshold_over_unseen_folds(spark, tmp_path):
    rows = [(f"g{i % 40}", float(i % 10), None if i % 7 == 0 else float(i % 3), float(i % 10 > 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "grp string, a double, b double, label double")
    model, unseen, chosen = L.train_by_folds(df, ["a", "b"], "grp", folds=2, depths=(2,), trees=5)
    folds = unseen.groupBy("grp").agg(F.count_distinct("fold").alias("n")).collect()
    assert {r.n for r in folds} == {1} and unseen.count() == 400  # each row once, a group in one fold
    assert 0 < chosen["threshold"] < 1 and chosen["f1"] > 0.95
    assert L.score_saved(spark, str(tmp_path / "none"), df).where("status = 'UNAVAILABLE' and probability is null").count() == 400
    L.save_model(model, str(tmp_path / "m"), ["a", "b"], chosen["threshold"])
    out = L.score_saved(spark, str(tmp_path / "m"), df)
    assert out.where(F.col("applicable") == (F.col("label") == 1)).count() > 380 and {r.status for r in out.select("status").distinct().collect()} == {"SCORED"}


def test_the_lowest_of_equal_thresholds(spark):
    df = spark.createDataFrame([(1.0, 0.8), (1.0, 0.6), (0.0, 0.3), (0.0, 0.1)], "label double, probability double")
    assert L.best_threshold(df) == (0.31, 1.0)


def test_better_of_two_text_classifiers(spark):
    words = {0.0: "valve pump steel pipe", 1.0: "cable lamp wire lumen", 2.0: "chair desk table wood"}
    rows = [(f"{words[float(k % 3)]} item {k % 5} of lot", float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "text string, label double")
    model, report = L.choose_text_classifier(df, df, trees=3)
    got = report.collect()
    assert sorted(r.model for r in got) == ["forest", "regression"] and sum(r.chosen for r in got) == 1
    assert max(r.macro_f1 for r in got) == [r.macro_f1 for r in got if r.chosen][0] > 0.9
    assert model.transform(df).where("prediction = label").count() > 54


def test_sync_snapshot(spark):
    kind = "analysis_id long, number string, synced_at long, seq long, changed boolean, n_errors int"
    rows = [(1, "IS 1", 5, 1, True, 0), (1, "IS 1", 9, 2, False, 1), (1, "IS 2", 7, 3, True, 0), (None, "IS 3", 4, 4, False, 0)]
    asked, running = spark.createDataFrame([(1,), (2,), (2,)], "analysis_id long"), spark.createDataFrame([(2, 8)], "analysis_id long, planned int")
    got = sorted(map(tuple, sync_snapshot(asked, spark.createDataFrame(rows, kind), running).collect()))
    assert got == [(1, "own", 7, 2, 1, 1, False, None), (2, "shared", 4, 1, 0, 0, True, 8)]
    alone = sync_snapshot(asked, spark.createDataFrame(rows[:3], kind), running.limit(0)).where("analysis_id = 2").first()
    assert tuple(alone) == (2, "none", None, 0, 0, 0, False, None)
