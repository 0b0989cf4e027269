"""Queries for records, reports, status layers and what is left of ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import records as Q
from ..operators import rules as K
from ..operators import selection as P
from ..sources.storage import table
from .base import CATALOGUE, FETCHES, STANDARDS, plain, view
from .matching import _FIND, _findings
from .selection import _RANK, _ranked

_STD, _CAT, _FET = plain(STANDARDS), plain(CATALOGUE), plain(FETCHES)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("s17_draft_records", f"SELECT std_id, CASE WHEN upper(title) LIKE 'DRAFT %' THEN title ELSE 'DRAFT ' || title END AS title, 'under_revision' AS status, 0.85::DOUBLE AS confidence FROM (SELECT std_id, CASE WHEN size % 3 = 0 THEN 'Draft ' || brand ELSE brand END AS title FROM ({_CAT}))")
def s17(spark, sf):
    rows = view(spark, sf, CATALOGUE).select("std_id", F.when(F.col("size") % 3 == 0, F.concat(F.lit("Draft "), "brand")).otherwise(F.col("brand")).alias("title"))
    return Q.draft_records(rows)


@query(
    "s18_tender_records",
    "SELECT o_orderkey AS tender_id, 0 AS clause, CASE WHEN o_orderkey % 6 = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, k, CASE WHEN o_orderkey % 6 = 0 THEN 0.8 ELSE 1.0 END FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 4 + 1)) AS k FROM orders)",
)
def s18(spark, sf):
    clauses = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")), lambda k: F.concat(F.lit("clause "), k.cast("string")))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tender_id"), F.slice(clauses, F.lit(2), F.greatest(F.size(clauses) - 1, F.lit(0))).alias("clauses"), (F.col("o_orderkey") % 6 == 0).alias("without_id"))
    return Q.tender_records(rows)


@query("s20_route_documents", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'named' WHEN contains(url, '.com/') THEN 'catalogue' WHEN contains(url, '/de/') THEN 'tender' ELSE 'generic' END AS route FROM pages) GROUP BY route")
def s20(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 10 == 0, "named").alias("adapter"))
    return Q.route_documents(rows, [("catalogue", F.contains("url", F.lit(".com/"))), ("tender", F.contains("url", F.lit("/de/")))]).groupBy("route").agg(F.count("*").alias("n"))


_RULES = [("Steel", ["steel"]), ("Metal", ["steel", "brass", "copper", "tin", "nickel"]), ("Small goods", ["small"]), ("Widgets", ["widget", "gizmo"]), ("Old", ["old"])]


@query("p35_fill_not_stated", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 5 > 1 THEN p_type WHEN p_size % 3 = 0 THEN 'Not stated' ELSE p_name END AS product, p_size % 3 = 0 AND p_size % 5 > 1 AS filled FROM part")
def p35(spark, sf):
    stated = F.when(F.col("p_size") % 3 == 0, "Not stated").otherwise(F.col("p_name"))
    context = F.when(F.col("p_size") % 5 == 0, " Unknown ").when(F.col("p_size") % 5 == 1, F.lit(None)).otherwise(F.col("p_type"))
    value, filled = Q.fill_not_stated(stated, context)
    return table(spark, sf, "part").select("p_partkey", value.alias("product"), filled.alias("filled"))


@query("w3_applicability_rerank", f"WITH {_RANK} SELECT query_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN line % 3 <> 0 THEN bm25 END, 0) DESC, relevance DESC, pos) AS INT) AS rank FROM k")
def w3(spark, sf):
    rows = _ranked(spark, sf).withColumn("ml_score", F.when(F.col("line") % 3 != 0, F.col("bm25")))
    return P.applicability_rerank(rows).select("query_id", "pos", "rank")


@query("w8_candidate_order", f"WITH {_RANK} SELECT query_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, relevance DESC, is_number, pos) AS INT) AS seat FROM k")
def w8(spark, sf):
    order = Window.partitionBy("query_id").orderBy(F.desc("cited"), F.desc("relevance"), "is_number", "pos")
    return _ranked(spark, sf).select("query_id", "pos", F.row_number().over(order).alias("seat"))


@query("w10_certification_source", f"SELECT analysis_id, std_id, mandatory FROM {_FIND} WHERE NOT mismatch QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY NOT mandatory, pos, std_id, req_id) = 1")
def w10(spark, sf):
    return K.certification_source(_findings(spark, sf)).select("analysis_id", "std_id", "mandatory")


@query("a4_ingest_report", "SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 7 BETWEEN 1 AND 4) AS titles_changed, count(*) FILTER (WHERE NOT regexp_matches(lower(p_type), 'steel|brass|copper')) AS scopes_generated, count(*) FILTER (WHERE p_size % 4 = 0) AS references_empty FROM part")
def a4(spark, sf):
    from ..functions import normalize as N

    rows = view(spark, sf, CATALOGUE)
    cleaned = N.extract_validity(N.strip_portal_noise(F.col("title")))[0]
    return rows.agg(F.count("*").alias("total"), F.count_if(F.trim(F.regexp_replace("title", r"\s+", " ")) != cleaned).alias("titles_changed"), F.count_if(~F.lower("type").rlike("steel|brass|copper")).alias("scopes_generated"), F.count_if(F.col("size") % 4 == 0).alias("references_empty"))


@query("a7_export_summary", "SELECT lang, count(*) AS n, round(avg(length(text)), 2) AS average_length, count(*) FILTER (WHERE length(text) > 1000) AS n_long FROM documents GROUP BY lang")
def a7(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 2).alias("average_length"), F.count_if(F.length("text") > 1000).alias("n_long"))


@query("a17_crawl_stats", f"SELECT host, count(*) AS pages, count(*) FILTER (WHERE NOT ok) AS failed, count(DISTINCT url) AS urls, count(*) FILTER (WHERE hash = '') AS empty FROM (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS host FROM ({_FET})) GROUP BY host")
def a17(spark, sf):
    from ..functions.normalize import extract_domain

    rows = view(spark, sf, FETCHES).withColumn("host", extract_domain(F.col("url")))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(~F.col("ok")).alias("failed"), F.count_distinct("url").alias("urls"), F.count_if(F.col("hash") == "").alias("empty"))


@query("j20_evidence_table", f"SELECT f.req_id, f.verdict, s.number, e.first_order FROM {_FIND} f JOIN ({_STD}) s ON s.std_id = f.std_id LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS first_order FROM lineitem WHERE l_quantity > 49 GROUP BY l_partkey) e ON e.l_partkey = f.std_id")
def j20(spark, sf):
    evidence = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("std_id")).agg(F.min("l_orderkey").alias("first_order"))
    rows = _findings(spark, sf).select("req_id", "verdict", "std_id").join(view(spark, sf, STANDARDS).select("std_id", "number"), "std_id")
    return rows.join(evidence, "std_id", "left").select("req_id", "verdict", "number", "first_order")


@query("j18_requirement_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def j18(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")


@query("u8_summary_numbers", "SELECT l_orderkey, bool_and(l_partkey % 10 <> 3) AS valid, count(DISTINCT l_partkey) AS n_named FROM lineitem GROUP BY l_orderkey")
def u8(spark, sf):
    """Summaries that name only standards they were given (those whose number doesn't end in 3)."""
    named = F.concat(F.lit("IS "), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda k: F.concat(F.lit("see IS "), k.cast("string"))), "; ").alias("summary"), F.collect_set(F.when(F.col("l_partkey") % 10 != 3, named)).alias("given"))
    ok, n = Q.summary_names(F.col("summary"), F.col("given"))
    return rows.select("l_orderkey", ok.alias("valid"), n.alias("n_named"))


@query("r15_frontend_status", f"SELECT req_id, CASE WHEN verdict = 'justified' THEN 'ok' WHEN verdict IN ('incorrect_standard', 'outdated_reference') THEN 'error' ELSE 'warning' END AS state, CASE WHEN verdict = 'incorrect_standard' THEN 'high' WHEN verdict = 'justified' THEN 'none' ELSE 'medium' END AS severity FROM {_FIND}")
def r15(spark, sf):
    state, severity = K.frontend_status(F.col("verdict"))
    return _findings(spark, sf).select("req_id", state.alias("state"), severity.alias("severity"))


@query("r12_recommended_action", f"SELECT req_id, CASE WHEN verdict = 'outdated_reference' AND superseded_by IS NOT NULL THEN 'Cite ' || superseded_by || ' instead.' WHEN verdict = 'outdated_reference' THEN 'Cite the ' || year || ' edition.' WHEN verdict = 'incorrect_standard' THEN 'Replace the withdrawn standard.' WHEN verdict = 'justified' THEN 'No action.' ELSE 'Verify manually.' END AS action FROM {_FIND}")
def r12(spark, sf):
    return _findings(spark, sf).select("req_id", K.recommended_action(F.col("verdict"), F.col("superseded_by"), F.col("year")).alias("action"))


@query("r10_dimensions", f"SELECT req_id, CASE WHEN verdict = 'wrong_scope' THEN 'applicability' WHEN verdict IN ('incorrect_standard', 'outdated_reference', 'ambiguous') THEN 'currentness' WHEN mandatory THEN 'certification' ELSE 'none' END AS axis, CASE WHEN mismatch THEN 'mismatch' ELSE 'match' END AS scope FROM {_FIND}")
def r10(spark, sf):
    return _findings(spark, sf).select("req_id", K.headline_axis(F.col("verdict"), F.col("mandatory")).alias("axis"), F.when(F.col("mismatch"), "mismatch").otherwise("match").alias("scope"))
