"""Queries of evidence, decisions, report facts and matched records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .base import CATALOGUE, REQUIREMENTS, STANDARDS, TENDER_LINES, TITLES, plain, view

_STD, _REQ, _CAT, _T, _L = plain(STANDARDS), plain(REQUIREMENTS), plain(CATALOGUE), plain(TITLES), plain(TENDER_LINES)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("r7_compliance_evidence", f"""SELECT std_id, 'bis_standard' AS source_type, 'BIS Standard ' || number AS source_name, 'BIS' AS authority, NULL::INT AS amendment, NULL::VARCHAR AS so_number FROM ({_STD})
       UNION ALL SELECT std_id, 'bis_amendment', number || ' Amendment ' || i, 'BIS', i::INT, CASE WHEN i = 2 THEN 'SO ' || std_id END FROM (SELECT std_id, number, unnest(range(1, n_amendments + 1)) AS i FROM ({_STD}))
       UNION ALL SELECT std_id, 'qco_notification', 'QCO Gazette ' || 'SO ' || std_id, coalesce(scheme, 'Government of India'), NULL, 'SO ' || std_id FROM ({_STD}) WHERE mandatory AND std_id % 5 > 0""")
def r7(spark, sf):
    std = view(spark, sf, STANDARDS)
    so = F.concat(F.lit("SO "), F.col("std_id").cast("string"))
    amendments = std.where("n_amendments > 0").select("std_id", F.explode(F.sequence(F.lit(1), F.col("n_amendments"))).alias("amendment")).withColumn("so_number", F.when(F.col("amendment") == 2, so))
    orders = std.where("mandatory").select("std_id", F.when(F.col("std_id") % 5 > 0, so).alias("so_number"), F.col("scheme").alias("ministry"))
    return E.compliance_evidence(std.select("std_id", F.col("number").alias("designation")), amendments, orders)


_STATUS = "CASE pos % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'restrictive' ELSE 'covered' END"
_DECISION = "CASE req_id % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'deleted' END"


@query("r21_effective_status", f"""SELECT req_id, machine_status, decision, CASE WHEN decision = 'accepted' THEN 'covered' WHEN decision = 'reviewed' THEN 'review' WHEN decision = 'rejected' AND machine_status NOT IN ('conflicting', 'restrictive') THEN 'missing' ELSE machine_status END AS status
       FROM (SELECT req_id, {_STATUS} AS machine_status, CASE WHEN req_id % 11 < 4 AND {_DECISION} IS NOT NULL THEN 'accepted' ELSE {_DECISION} END AS decision FROM ({_REQ})) WHERE decision IS DISTINCT FROM 'deleted'""")
def r21(spark, sf):
    req = view(spark, sf, REQUIREMENTS)
    first = req.select("req_id", F.expr(_DECISION).alias("decision"), F.lit(1).alias("ts")).where("decision is not null")
    second = req.where("req_id % 11 < 4").select("req_id", F.expr(_DECISION).alias("decision")).where("decision is not null").select("req_id", F.lit("accepted").alias("decision"), F.lit(2).alias("ts"))
    return E.effective_status(req.select("req_id", F.expr(_STATUS).alias("status")), first.union(second)).select("req_id", "machine_status", "decision", "status")


_FACTS = f"SELECT analysis_id, req_id, std_id, CASE pos % 3 WHEN 0 THEN 'justified' WHEN 1 THEN 'wrong_scope' ELSE 'outdated_reference' END AS verdict, flag <> 'R' AS applicable, discount > 0.05 AS review FROM ({_REQ})"


@query("r19_summary_facts", f"""SELECT a.*, b.applicable_standards, b.cited_only_standards FROM (SELECT analysis_id, count(DISTINCT req_id) AS requirements, count(*) FILTER (WHERE verdict <> 'justified') AS issues, count(*) FILTER (WHERE review) AS review_items FROM ({_FACTS}) GROUP BY analysis_id) a
       JOIN (SELECT analysis_id, count(*) FILTER (WHERE ok) AS applicable_standards, count(*) FILTER (WHERE NOT ok) AS cited_only_standards FROM (SELECT analysis_id, std_id, bool_or(applicable) AS ok FROM ({_FACTS}) GROUP BY ALL) GROUP BY analysis_id) b ON a.analysis_id = b.analysis_id""")
def r19(spark, sf):
    req = view(spark, sf, REQUIREMENTS)
    verdict = F.expr("CASE pos % 3 WHEN 0 THEN 'justified' WHEN 1 THEN 'wrong_scope' ELSE 'outdated_reference' END")
    return E.summary_facts(req.select("analysis_id", "req_id", "std_id", verdict.alias("verdict"), (F.col("flag") != "R").alias("applicable"), (F.col("discount") > 0.05).alias("review")))


_SOLID = r"regexp_replace(lower(trim({x})), '[\s:]', '', 'g')"


@query("j8_explicit_reference_match", f"""SELECT reference, min(std_id) AS std_id FROM (SELECT DISTINCT reference, {_SOLID.replace('{x}', 'reference')} AS k FROM ({_L}) WHERE reference IS NOT NULL) r
       JOIN (SELECT std_id, {_SOLID.replace('{x}', 'is_number')} AS n FROM ({_T})) s ON contains(n, k) OR contains(k, n) GROUP BY reference""")
def j8(spark, sf):
    cited = view(spark, sf, TENDER_LINES).where("reference is not null").select("reference")
    return E.explicit_reference_match(cited, view(spark, sf, TITLES).select("std_id", "is_number"))


_VERIFIED = "CASE WHEN size % 3 = 0 THEN NULL WHEN size % 3 = 1 THEN 'not_verified' ELSE 'verified' END"


@query("j6_enrich_from_raw", f"""WITH c AS (SELECT std_id, is_number, year, size, raw_status, latest_version, {_VERIFIED} AS v FROM ({_CAT})), w AS (SELECT is_number, min(latest_version) AS lv FROM c GROUP BY is_number),
       j AS (SELECT c.*, TRY_CAST(nullif(regexp_extract(trim(w.lv), ':(\\d{{4}})\\s*$', 1), '') AS INT) AS y0 FROM c JOIN w ON w.is_number = c.is_number)
       SELECT std_id, year AS record_year, CASE WHEN y BETWEEN 1901 AND 2030 THEN y ELSE CASE WHEN size % 4 = 0 THEN year END END AS latest_year, CASE WHEN coalesce(v, 'not_verified') = 'not_verified' AND contains(raw_status, 'Active') THEN 'partial' ELSE coalesce(v, 'not_verified') END AS verification FROM (SELECT *, y0 AS y FROM j)""")
def j6(spark, sf):
    cat = view(spark, sf, CATALOGUE)
    year = F.col("year").cast("int")
    records = cat.select("std_id", F.col("is_number").alias("key"), year.alias("edition_year"), F.when(F.col("size") % 2 == 0, year).alias("record_year"), F.when(F.col("size") % 4 == 0, year).alias("latest_year"), F.col("raw_status").alias("status"), F.expr(_VERIFIED).alias("verification"))
    return E.enrich_from_raw(records, cat.select(F.col("is_number").alias("key"), "latest_version")).select("std_id", "record_year", "latest_year", "verification")
