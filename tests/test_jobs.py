import pytest
from pyspark.sql import functions as F

from tenderweave.operators import corpus as X
from tenderweave.operators import frontier, learning
from tenderweave.operators import selection as P
from tenderweave.sources import files

GENUINE = [
    ("Rails to IS 3443 only", [("IS 3443", "IS 3443", None, "IS 3443", None, None)]),
    ("use IS 8009 (Part 2/Sec 1):1980 for footings", [("IS 8009 (Part 2/Sec 1):1980", "IS 8009", "Part 2/Sec 1", "IS 8009 : Part 2 : Sec 1", 1980, None)]),
    ("test by IS 4031 : Part 6 : 1988, twice", [("IS 4031 : Part 6 : 1988", "IS 4031", "Part 6", "IS 4031 : Part 6", 1988, None)]),
    ("IS 383-2016 amd 1 holds", [("IS 383-2016 amd 1", "IS 383", None, "IS 383", 2016, 1)]),
    ("IS 456 (newest issue) and IS:1786:2008; IS1239", [("IS 456 (newest issue)", "IS 456", "newest issue", "IS 456", None, None), ("IS:1786:2008", "IS 1786", None, "IS 1786", 2008, None), ("IS1239", "IS 1239", None, "IS 1239", None, None)]),
    ("IS 2386 : Part 1 to 8 inclusive", [("IS 2386", "IS 2386", None, "IS 2386", None, None)]),
]
PROSE = ["Its mass is 40 kg.", "On the basis 12 were sold.", "THE LIFE IS 15 YEARS", "THE CURRENT IS 16 A", "ITS WIDTH IS 300 mm", "THE SHARE IS 7%", "THE LOT IS 12 NOS", "THIS 55 IS NOT ONE", "", None]


def test_citations_and_prose(spark):
    texts = [t for t, _ in GENUINE] + PROSE
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in X.scan_citations(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.citation, r.number, r.part_section, r.designation, r.year, r.amendment))
    assert got == {i: e for i, (_, e) in enumerate(GENUINE)}


def test_cited_rows_survive_the_cut(spark):
    rows = [(1, k, f"IS {k}", "t", "s", 1.0 - k / 10, 0.0, "", "", "", [], ["IS 5"], True) for k in range(1, 8)]
    df = spark.createDataFrame(rows, "query_id int, pos int, is_number string, title string, search_text string, semantic_score double, bm25_score double, product string, application string, domain string, params array<string>, refs array<string>, verified boolean")
    ranked = P.rank_results(df.withColumn("semantic_score", F.col("semantic_score") / 2))
    kept = [(r.is_number, r["rank"]) for r in P.top_k_keep_cited(ranked, 3).orderBy("rank").collect()]
    assert "IS 5" in [n for n, _ in kept] and [k for _, k in kept] == [1, 2, 3] and len(kept) == 3


def test_frontier_bounds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("b", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert sorted(map(tuple, frontier.link_frontier(links, seeds, 2, 100).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert frontier.link_frontier(links, seeds, 9, 2).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"is_number": "IS 1", "year": 2001}, {"is_number": "IS 2"}]')
    (tmp_path / "b.json").write_text('{"standards": [{"is_number": "IS 3", "year": 2003}]}')
    kind = "is_number string, year int"
    a, b = (files.read_catalogue(spark, str(tmp_path / f), kind.replace(" ", ":", 1).replace(", year ", ",year:")) for f in ("a.json", "b.json"))
    assert sorted(map(tuple, a.union(b).collect()), key=str) == [("IS 1", 2001), ("IS 2", None), ("IS 3", 2003)]
    pairs = spark.createDataFrame([("x", float("nan")), ("y", 1.5)], "g string, v double")
    files.write_pairs(pairs, str(tmp_path / "pairs"))
    assert sorted(map(tuple, files.read_pairs(spark, str(tmp_path / "pairs"), "g string, v double").collect())) == [("x", None), ("y", 1.5)]
    with pytest.raises(ValueError):
        files.write_catalogue(a.limit(1), a, "is_number", str(tmp_path / "lost"))
    files.write_catalogue(a, a, "is_number", str(tmp_path / "kept"))
    assert files.index_is_fresh(spark.read.parquet(str(tmp_path / "kept")), files.index_mark(a, "is_number"), "is_number")
    assert not files.index_is_fresh(a.limit(1), files.index_mark(a, "is_number"), "is_number")


def test_applicability_model_handles_missing_values(spark):
    rows = [(i, float(i % 10) if i % 4 else float("nan"), None if i % 7 == 0 else float(i % 3), float(i % 10 > 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    model = learning.train_applicability(df, ["a", "b"], trees=10)
    out = learning.score_applicability(model, df, ["a", "b"]).collect()
    known = [r for r in out if r.id % 4]
    assert sum(r.applicable == (r.label == 1) for r in known) > 0.95 * len(known)
    assert {r.coverage for r in out} == {0.0, 0.5, 1.0} and all(0 <= r.probability <= 1 for r in out)


def test_decisions_and_families(spark):
    findings = spark.createDataFrame([(1, "partial"), (2, "conflicting"), (3, "partial"), (4, "covered")], "finding_id int, status string")
    decisions = spark.createDataFrame([(1, "accepted", 1, 1), (1, "rejected", 2, 2), (2, "rejected", 1, 3), (3, "deleted", 1, 4)], "finding_id int, decision string, ts int, seq int")
    assert sorted((r.finding_id, r.effective) for r in P.apply_decisions(findings, decisions).collect()) == [(1, "missing"), (2, "conflicting"), (4, "covered")]
    families = spark.createDataFrame([("a", 20, False), ("b", 10, False), ("c", 9, False), ("d", 8, True), ("e", 7, True), ("f", 6, True)], "family string, size int, topic boolean")
    assert sorted(r.family for r in P.sample_families(families, 45, 25).collect()) == ["a", "b", "d", "e"]


def test_applicability_model_does_not_depend_on_how_rows_lie(spark):
    rows = [(i, float(i * 37 % 101), float(i * 53 % 17), float((i * 37 % 101 + i * 29 % 50) > 70)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    said = [{r.id: r.probability for r in learning.score_applicability(learning.train_applicability(d, ["a", "b"], trees=5), df, ["a", "b"]).collect()} for d in (df.coalesce(1), df.repartition(5, "b"))]
    assert said[0] == said[1]
