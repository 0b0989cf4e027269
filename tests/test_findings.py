import datetime

from pyspark.sql import functions as F

from tenderweave.operators import findings as G
from tenderweave.plans import findings
from tenderweave.streaming import state as S
from tenderweave.streaming.tables import KeyedTable


def test_findings_take_the_worse_verdict(spark):
    said = [(1, "justified", 0.9, None, [10, 11]), (2, "wrong_scope", 0.8, 0.1, [10]), (3, "made_up", 0.7, None, None), (4, "outdated_reference", 0.8, None, [12]), (5, "justified", 0.9, None, [13, 14])]
    proposals = spark.createDataFrame(said, "req_id long, verdict string, confidence double, raw_confidence double, std_ids array<long>")
    candidates = spark.createDataFrame([(1, 10), (4, 12), (5, 13), (5, 14), (2, 10)], "req_id long, std_id long")
    checks = spark.createDataFrame([(1, 10, "outdated_reference", 0.7, True, False), (1, 11, "incorrect_standard", 0.9, False, True), (4, 12, "outdated_reference", 0.4, False, False), (5, 13, "wrong_scope", 0.7, True, True), (5, 14, "justified", 0.9, False, False)], "req_id long, std_id long, verdict string, confidence double, mismatch boolean, notified boolean")
    got = {r.req_id: (r.verdict, round(r.confidence, 2), r.resolution, r.n_applicable, r.n_cited, r.review) for r in G.assemble_findings(proposals, candidates, checks).collect()}
    assert got[1] == ("outdated_reference", 0.7, "check_override", 1, 0, False)
    assert got[2] == ("unsupported", 0.8, "proposal_only", 0, 0, False)
    assert got[3] == ("unable_to_determine", 0.7, "proposal_only", 0, 0, False)
    assert got[4] == ("outdated_reference", 0.6, "agree", 1, 0, False)
    assert got[5] == ("wrong_scope", 0.7, "check_override", 1, 1, True)


def test_context_of_an_edition(spark):
    rows = [(1, 0, "justified", 2010, 2010, "active", None, None, True, False, "A"), (1, 1, "outdated_reference", 2000, 2012, "superseded", "IS 2", datetime.date(2025, 1, 1), False, True, "B"), (1, 2, "justified", None, None, "active", None, None, True, True, "C")]
    frame = spark.createDataFrame(rows, "k int, pos int, verdict string, cited_year int, current_year int, status string, superseded_by string, deadline date, applicable boolean, notified boolean, ministry string")
    r = G.currentness_context(frame, "k", F.lit(datetime.date(2024, 6, 1))).first()
    assert (r.cited_year, r.gap_years, r.is_current, r.superseded_by, r.within_transition, r.notified, r.ministry) == (2000, 12, False, "IS 2", True, True, "C")


def test_changes_tried_out(spark):
    changes = spark.createDataFrame([(1, "copper cable"), (2, "wooden desk"), (3, "nothing alike")], "req_id long, text string")
    catalogue = spark.createDataFrame([(1, "copper cable", "justified"), (2, "copper pipe", "outdated_reference"), (3, "desk", "justified")], "std_id long, text string, verdict string")
    got = {r.req_id: (r.std_ids, r.verdict, r.impact) for r in G.simulate_modify(changes, catalogue).collect()}
    assert got == {1: ([1, 2], "outdated_reference", "risky"), 2: ([3], "justified", "acceptable"), 3: (None, None, "no_finding")}


def test_ingestion_in_batches(spark, tmp_path):
    rows = [("u1", "h1", 1, 1, 200, "A", "one"), ("u2", "h2", 2, 2, 404, "B", "lost"), ("u1", "h1", 3, 3, 200, "A", "same"), ("u1", "h3", 4, 4, 200, "A", "new"), ("u3", "h9", 5, 5, 304, "C", "none"), ("u4", "h8", 6, 6, 200, "D", "four")]
    schema = "url string, hash string, ts long, seq long, code int, number string, title string"
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "number", ["number", "title"]).awaitTermination()
    out = {(r.seq, r.outcome) for n in range(3) for r in spark.read.parquet(str(tmp_path / f"out/outcomes/{n}")).collect()}
    assert out == {(1, "success"), (2, "failed"), (3, "unchanged"), (4, "success"), (5, "unchanged"), (6, "success")}
    assert {(r.number, r.title, r.version) for r in KeyedTable(spark, str(tmp_path / "out/catalogue"), "number string, title string, version long", ["number"]).as_of().collect()} == {("A", "new", 4), ("D", "four", 6)}


def test_parts_over_a_million_take_the_place_that_the_sql_gives_them(spark, tmp_path):
    spark.createDataFrame([(1, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1050007, 7), (1, 28, 6)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    row = findings.QUERIES["r11_assemble_findings"](spark, str(tmp_path)).first()
    assert (row.verdict, row.confidence, row.resolution) == ("outdated_reference", 0.8, "check_override")
