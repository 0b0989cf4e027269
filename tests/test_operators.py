from datetime import date

import pytest
from pyspark.sql import functions as F

from tenderweave.functions.normalize import key_exact, key_family, key_tight
from tenderweave.operators import catalogue as C
from tenderweave.operators import retrieval as R
from tenderweave.operators import rules as K


def test_last_order_wins_and_nothing_is_lost(spark):
    standards = spark.createDataFrame([("IS 732",), ("is 732 : part 1",), ("IS 7320",), (None,)], "is_number string")
    kind = "order_pos int, is_number string, gazette_so_number string, issuing_ministry string, effective_date string, certification_scheme string"
    orders = spark.createDataFrame([(1, "IS  732", "a", "m", "d", "crs"), (2, "is 732", None, "n", "e", None), (3, "IS 1", "z", "m", "d", "crs")], kind)
    rows = {r.is_number: r for r in C.merge_orders(standards, orders, key_tight(F.col("is_number"))).collect()}
    assert len(rows) == 4 and rows["IS 732"].qco_notified and rows["IS 732"].qco_issuing_ministry == "n"
    assert "Notification N/A issued by n" in rows["IS 732"].certification_details
    assert not rows["IS 7320"].qco_notified and not rows[None].qco_notified
    report = C.merge_report(standards, orders, key_tight(F.col("is_number"))).first()
    assert (report.total_standards, report.matched, report.orphaned_orders, report.match_rate_pct) == (4, 1, 1, 25.0)
    assert C.merge_report(standards.limit(0), orders, key_tight(F.col("is_number"))).first().match_rate_pct == 0


def test_exact_before_family(spark):
    cat = spark.createDataFrame([(1, "IS 1554 : Part 1"), (2, "IS 15544"), (3, "IS 1554")], "std_id int, is_number string")
    cites = spark.createDataFrame([(10, "is 1554"), (11, "IS 1554 (Part 9)"), (12, "IS 9"), (13, None)], "cite_id int, is_number string")
    got = sorted(tuple(r) for r in C.resolve_citations(cites, cat, key_exact(F.col("is_number")), key_family(F.col("is_number"))).collect())
    assert got == [(10, 3, "exact"), (11, 1, "family"), (11, 3, "family")]


def test_upsert_and_strict_insert(spark):
    a = spark.createDataFrame([(1, "a", 5), (2, "b", 1)], "k int, v string, version int")
    b = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], a.schema)
    assert sorted(tuple(r)[:2] for r in C.upsert_rows(a, b, "k").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    with pytest.raises(ValueError):
        C.insert_strict(a, b, "k")
    assert C.insert_strict(a, b.where("k = 3"), "k").count() == 3


def test_fusion_rules(spark):
    lex = spark.createDataFrame([(1, 10, 8.0), (1, 11, 4.0), (1, 12, 0.5), (2, 10, 1.0), (2, 11, 0.1)], "query_id long, std_id long, score double")
    vec = spark.createDataFrame([(1, 11, 0.9), (1, 13, -0.9), (1, 14, 0.0)], "query_id long, std_id long, score double")
    got = {(r.query_id, r.std_id): (r.score, r["rank"], r.total) for r in R.hybrid_fuse(lex, vec, 0.6, 0.4).collect()}
    assert got == {(1, 11): (0.68, 1, 2), (1, 10): (0.6, 2, 2), (2, 10): (1.0, 1, 1)}


def test_vector_blocks_agree(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0 if i else 0.0]) for i in range(60)], "std_id long, vec array<double>")
    queries = rows.where("std_id % 6 = 0").withColumnRenamed("std_id", "query_id")
    one, several = (sorted(tuple(r) for r in R.vector_top_k(queries, rows, 4, chunk=b).collect()) for b in (100, 3))
    assert one == several and len(one) == 40
    assert R.vector_top_k(queries.limit(0), rows, 4).collect() == []


def test_verdict_cascade(spark):
    kind = "status string, deadline date, mismatch boolean, cited int, current int"
    cases = [
        (("withdrawn", None, True, 2000, 2000), ("incorrect_standard", 0.95)), (("superseded", date(2020, 1, 1), True, None, None), ("wrong_scope", 0.80)), (("superseded", date(2020, 1, 1), False, None, None), ("outdated_reference", 0.95)),
        (("superseded", date(2030, 1, 1), False, None, None), ("outdated_reference", 0.75)), (("superseded", None, False, None, None), ("outdated_reference", 0.85)), (("active", None, False, 2000, 2010), ("outdated_reference", 0.80)),
        (("active", None, False, 2000, 2005), ("outdated_reference", 0.70)), (("active", None, False, 2011, 2010), ("requires_human_verification", 0.55)), (("active", None, False, 2011, None), ("unable_to_determine", 0.45)),
        (("under_revision", None, False, 2010, 2010), ("requires_human_verification", 0.65)), (("active", None, False, None, 2010), ("ambiguous", 0.60)), (("unknown", None, False, 2010, 2010), ("unable_to_determine", 0.50)), (("active", None, False, 2010, 2010), ("justified", 0.85)),
    ]
    df = spark.createDataFrame([c for c, _ in cases], kind)
    verdict, sure = K.suggested_verdict(F.col("status"), F.col("deadline"), F.lit("2024-01-01").cast("date"), F.col("mismatch"), F.col("cited"), F.col("current"))
    assert [tuple(r) for r in df.coalesce(1).select(verdict, sure).collect()] == [v for _, v in cases]
