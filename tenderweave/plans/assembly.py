"""Queries that assemble pages, pairs, reports and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as X
from ..operators import learning as L
from ..operators import retrieval as R
from ..operators import rules as K
from ..operators.catalogue import first_seen
from ..sources.files import index_mark
from ..sources.storage import table
from .base import REQUIREMENTS, STANDARDS, plain, view
from .matching import _FIND, _findings

_STD, _REQ = plain(STANDARDS), plain(REQUIREMENTS)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "s7_pages_to_documents",
    r"""SELECT page_id, sha256(t) AS digest, length(t)::INT AS n_chars, CASE WHEN t = '' THEN 'EMPTY' ELSE 'SUCCESS' END AS status FROM (SELECT page_id,
        trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style|title[^>]*>.*?</title)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
)
def s7(spark, sf):
    return X.page_texts(table(spark, sf, "pages")).select("page_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"), "status")


@query("s14_index_mark", "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum FROM documents")
def s14(spark, sf):
    return index_mark(table(spark, sf, "documents"), "doc_id")


@query(
    "f3_tfidf_cosine",
    r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
        w AS (SELECT conv_id, turn, side, token, 1 + ln(count(*)) AS tf FROM (SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS token FROM p WHERE before IS NOT NULL UNION ALL SELECT conv_id, turn, 2, unnest(regexp_extract_all(lower(before), '[a-z0-9_]{2,}')) FROM p WHERE before IS NOT NULL) GROUP BY ALL),
        i AS (SELECT *, tf * (ln(3.0 / (1 + count(*) OVER (PARTITION BY conv_id, turn, token))) + 1) AS x FROM w),
        j AS (SELECT conv_id, turn, token, sum(CASE WHEN side = 1 THEN x ELSE 0 END) AS a, sum(CASE WHEN side = 2 THEN x ELSE 0 END) AS b FROM i GROUP BY ALL)
        SELECT conv_id, turn, round(CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0 END, 5) AS cosine FROM j GROUP BY ALL""",
)
def f3(spark, sf):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("a"), before.alias("b")).where("b is not null")
    return X.tfidf_cosine(pairs, ["conv_id", "turn"]).withColumn("cosine", F.round("cosine", 5))


@query(
    "f10_quantity_terms",
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, concat('load ', CAST(l_quantity AS INT), ' kg to ', l_suppkey, '.5 V and ', l_linenumber, ' and') AS text FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, unnest(regexp_extract_all(text, '\d+(?:\.\d+)?\s*[A-Za-z]+')) AS q FROM t)
        SELECT l_orderkey, l_linenumber, regexp_extract(q, '(\d+(?:\.\d+)?)', 1) AS amount, lower(regexp_extract(q, '([A-Za-z]+)$', 1)) AS unit, count(*) AS n FROM m WHERE lower(regexp_extract(q, '([A-Za-z]+)$', 1)) NOT IN ('and', 'or', 'to', 'with') GROUP BY ALL""",
)
def f10(spark, sf):
    text = F.concat(F.lit("load "), F.col("l_quantity").cast("int").cast("string"), F.lit(" kg to "), F.col("l_suppkey").cast("string"), F.lit(".5 V and "), F.col("l_linenumber").cast("string"), F.lit(" and"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.quantity_terms(text)).alias("q"))
    return rows.groupBy("l_orderkey", "l_linenumber", "q.amount", "q.unit").agg(F.count("*").alias("n"))


@query("f11_text_flags", r"SELECT doc_id, regexp_matches(text, '(?i)\bIS\s*\d{2,}') AS has_designation, regexp_matches(text, '(?i)\d+(?:\.\d+)?\s*(mm|kg|kw|v|w)\b') AS has_spec, CAST(len(regexp_extract_all(text, '[^\x00-\x7F]')) AS INT) AS n_beyond_ascii FROM documents")
def f11(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.rlike(r"(?i)\bIS\s*\d{2,}").alias("has_designation"), t.rlike(r"(?i)\d+(?:\.\d+)?\s*(mm|kg|kw|v|w)\b").alias("has_spec"), F.regexp_count(t, F.lit(r"[^\x00-\x7F]")).alias("n_beyond_ascii"))


@query("f19_next_page_url", r"SELECT page_id, CASE WHEN k IS NULL THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=2' WHEN k < 50 THEN regexp_replace(url, '([?&]page=)\d+', '\1' || (k + 1)) END AS next_url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS INT) AS k FROM pages)")
def f19(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.next_page_url(F.col("url")).alias("next_url"))


@query("f20_feature_coverage", "SELECT l_orderkey, l_linenumber, round_even(((CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END) + (CASE WHEN l_quantity > 40 THEN 0 ELSE 1 END) + 1) / 3, 3) AS coverage FROM lineitem")
def f20(spark, sf):
    nan = F.lit(float("nan"))
    columns = [F.when(F.col("l_linenumber") == 1, nan).otherwise(F.col("l_tax")), F.when(F.col("l_quantity") > 40, nan).otherwise(F.col("l_quantity")), F.col("l_discount")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.feature_coverage(columns).alias("coverage"))


_DOMAINS = [("metal goods", ["steel", "brass", "copper"]), ("tin ware", ["tin"]), ("nickel goods", ["nickel"])]


@query("p16_thesaurus", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN regexp_matches(lower(p_type), 'steel|brass|copper') THEN 'alloy plate rod' END, CASE WHEN contains(lower(p_type), 'small') THEN 'compact' END) AS expanded FROM part")
def p16(spark, sf):
    table_ = [("alloy plate rod", ["steel", "brass", "copper"]), ("compact", ["small"])]
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", T.labels_of(F.col("p_type"), table_)).alias("expanded"))


@query("p22_availability_map", f"SELECT std_id, concat_ws(',', 'scope=' || CASE WHEN verified THEN 'verified' ELSE 'unverified' END, 'certification=' || CASE WHEN mandatory AND verified THEN 'verified' WHEN mandatory THEN 'unverified' ELSE 'not_identified' END, 'year=' || CASE WHEN year IS NULL THEN 'not_available' ELSE 'verified' END) AS availability FROM ({_STD})")
def p22(spark, sf):
    return view(spark, sf, STANDARDS).select("std_id", F.array_join(F.transform(F.map_entries(K.availability_map()), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("availability"))


@query("p25_policy", "SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'allowed' WHEN regexp_matches(h, '(^|\\.)example\\.org$') THEN 'permission_required' ELSE 'source_blocked' END AS decision FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)")
def p25(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.policy_decision(F.col("url"), [("example.com", "allowed"), ("example.org", "permission_required")], "source_blocked").alias("decision"))


@query("p28_embedding_text", "SELECT p_partkey, concat_ws(' | ', nullif(trim(p_name), ''), CASE WHEN p_size % 3 <> 0 THEN 'Type: ' || p_type END, 'Brand: ' || p_brand) AS text FROM part")
def p28(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(" | ", F.nullif(F.trim("p_name"), F.lit("")), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Type: "), "p_type")), F.concat(F.lit("Brand: "), "p_brand")).alias("text"))


@query("p36_coerce_verdict", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unable_to_determine' END AS verdict FROM events")
def p36(spark, sf):
    return table(spark, sf, "events").select("event_id", K.coerce_label(F.col("event_type"), ["view", "click"], "unable_to_determine").alias("verdict"))


@query("p27_catalogue_search", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'old') OR contains(lower(p_type), 'steel')) AND p_size BETWEEN 5 AND 30")
def p27(spark, sf):
    hit = F.contains(F.lower("p_name"), F.lit("old")) | F.contains(F.lower("p_type"), F.lit("steel"))
    return table(spark, sf, "part").where(hit & F.col("p_size").between(5, 30)).select("p_partkey", "p_name")


@query("j12_compliance_pairs", f"SELECT r.req_id, coalesce(s.status, 'none') AS status, CASE WHEN r.cited_year IS NULL THEN 'no_citation' WHEN s.std_id IS NULL THEN 'not_found' ELSE 'paired' END AS branch FROM ({_REQ}) r LEFT JOIN (SELECT * FROM ({_STD}) WHERE std_id % 3 <> 0) s ON s.std_id = r.std_id AND r.cited_year IS NOT NULL")
def j12(spark, sf):
    return K.compliance_pairs(view(spark, sf, REQUIREMENTS), view(spark, sf, STANDARDS).where("std_id % 3 <> 0"))


@query("j15_resolve_ranked", "SELECT query_id, std_id, rank FROM (SELECT l_orderkey AS query_id, l_partkey AS std_id, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL) WHERE std_id IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def j15(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("std_id")).agg(F.min("l_linenumber").alias("rank"))
    return rows.join(table(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("std_id")), "std_id", "left_semi").select("query_id", "std_id", "rank")


@query("w13_primary_standard", f"SELECT analysis_id, std_id, n FROM (SELECT analysis_id, std_id, status, count(*) AS n, max(confidence) AS c FROM {_FIND} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY status IN ('withdrawn', 'superseded'), n DESC, c DESC, std_id) = 1")
def w13(spark, sf):
    grouped = _findings(spark, sf).groupBy("analysis_id", "std_id", "status").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return K.primary_standard(grouped).select("analysis_id", "std_id", "n")


@query("w14_cap_per_document", "SELECT doc_id, count(*) AS n, max(length(c))::INT AS longest FROM (SELECT doc_id, c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n+')) AS c, generate_subscripts(regexp_split_to_array(text, '\\n+'), 1) AS i FROM documents) WHERE trim(c) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 12) GROUP BY doc_id")
def w14(spark, sf):
    """The first twelve clauses of a document, as the profile takes them."""
    lines = X.split_lines(table(spark, sf, "documents"))
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("n <= 12")
    return first.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("clause")).alias("longest"))


@query("w15_catalogue_sorts", f"SELECT std_id, year, status FROM ({_STD}) ORDER BY status <> 'active', year DESC NULLS LAST, std_id LIMIT 50")
def w15(spark, sf):
    return view(spark, sf, STANDARDS).orderBy(F.col("status") != "active", F.desc_nulls_last("year"), "std_id").limit(50).select("std_id", "year", "status")


@query("r6_missing_requirements", f"SELECT std_id, 'missing_requirement' AS verdict FROM ({_STD}) WHERE mandatory AND std_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 44)")
def r6(spark, sf):
    cited = table(spark, sf, "lineitem").where("l_quantity > 44").select(F.col("l_partkey").alias("std_id")).distinct()
    return view(spark, sf, STANDARDS).where("mandatory").join(cited, "std_id", "left_anti").select("std_id", F.lit("missing_requirement").alias("verdict"))


@query("r14_selected_outdated", f"SELECT analysis_id, bool_or(status IN ('superseded', 'withdrawn', 'cancelled')) AS outdated, CASE WHEN bool_or(status IN ('superseded', 'withdrawn', 'cancelled')) THEN 0.95 ELSE max(confidence) END AS confidence FROM {_FIND} GROUP BY analysis_id")
def r14(spark, sf):
    old = F.bool_or(F.col("status").isin("superseded", "withdrawn", "cancelled"))
    return _findings(spark, sf).groupBy("analysis_id").agg(old.alias("outdated"), F.when(old, 0.95).otherwise(F.max("confidence")).alias("confidence"))


@query("r22_status_maps", f"SELECT s AS evidence, band, count(*) AS n FROM (SELECT CASE WHEN verdict = 'justified' THEN 'covered' WHEN verdict IN ('wrong_scope', 'incorrect_standard') THEN 'conflicting' WHEN verdict = 'missing_requirement' THEN 'missing' ELSE 'review' END AS s, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM {_FIND}) GROUP BY ALL")
def r22(spark, sf):
    return _findings(spark, sf).groupBy(K.evidence_status(F.col("verdict")).alias("evidence"), K.confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("a22_coverage_strip", f"SELECT analysis_id, count(*) FILTER (WHERE verdict = 'justified') AS covered, count(*) FILTER (WHERE verdict <> 'justified' AND verdict <> 'missing_requirement') AS review, round(100.0 * count(*) FILTER (WHERE verdict = 'justified') / count(*), 1) AS coverage_pct FROM {_FIND} GROUP BY analysis_id")
def a22(spark, sf):
    ok = F.count_if(F.col("verdict") == "justified")
    return _findings(spark, sf).groupBy("analysis_id").agg(ok.alias("covered"), F.count_if(~F.col("verdict").isin("justified", "missing_requirement")).alias("review"), F.round(100.0 * ok / F.count("*"), 1).alias("coverage_pct"))


@query("a19_requirements_per_standard", f"SELECT std_id, count(*) AS n, count(DISTINCT analysis_id) AS n_analyses, round(avg(confidence), 4) AS avg_confidence FROM {_FIND} GROUP BY std_id")
def a19(spark, sf):
    return _findings(spark, sf).groupBy("std_id").agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("n_analyses"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


@query("r23_regulatory_rows", f"SELECT std_id, number, scheme FROM ({_STD}) WHERE mandatory AND scheme IS NOT NULL AND contains(lower(title), 'e')")
def r23(spark, sf):
    return view(spark, sf, STANDARDS).where(F.col("mandatory") & F.col("scheme").isNotNull() & F.contains(F.lower("title"), F.lit("e"))).select("std_id", "number", "scheme")


@query("r16_simulate_remove", f"SELECT analysis_id, bool_or(mandatory AND pos = 1) AS violates, count(*) FILTER (WHERE pos <> 1) AS n_left FROM {_FIND} GROUP BY analysis_id")
def r16(spark, sf):
    rows = _findings(spark, sf).withColumn("removed", F.col("pos") == 1)
    return rows.groupBy("analysis_id").agg(F.bool_or(F.col("mandatory") & F.col("removed")).alias("violates"), F.count_if(~F.col("removed")).alias("n_left"))


@query("u5_evidence_union", f"SELECT analysis_id, count(*) AS n FROM (SELECT analysis_id, std_id FROM {_FIND} WHERE mandatory UNION SELECT analysis_id, std_id FROM {_FIND} WHERE verdict <> 'justified') GROUP BY analysis_id")
def u5(spark, sf):
    f = _findings(spark, sf)
    both = f.where("mandatory").select("analysis_id", "std_id").unionByName(f.where("verdict <> 'justified'").select("analysis_id", "std_id")).distinct()
    return both.groupBy("analysis_id").agg(F.count("*").alias("n"))


@query("u6_split_applicable", f"SELECT analysis_id, count(*) FILTER (WHERE NOT mismatch) AS applicable, count(*) FILTER (WHERE mismatch) AS cited_only FROM {_FIND} GROUP BY analysis_id")
def u6(spark, sf):
    return _findings(spark, sf).groupBy("analysis_id").agg(F.count_if(~F.col("mismatch")).alias("applicable"), F.count_if("mismatch").alias("cited_only"))


@query("r20_report_standards", "SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def r20(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(done, "l_orderkey").select("o_custkey", "l_partkey").distinct()


@query("w11_distinct_texts", "SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text)))")
def w11_texts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    return first_seen(rows, "k", "doc_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


_FEATURES = ["quantity", "tax", "size"]


@query("m2_applicability_model")
def m2(spark, sf):
    """Trains on one split of orders and scores all pairs: probability, class and coverage of each."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # few files are few tasks
    pairs = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    missing = F.lit(float("nan"))
    rows = pairs.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 == 0, missing).otherwise(F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"), F.col("p_size").cast("double").alias("size"), ((F.col("l_quantity") + F.col("p_size")) > 50).cast("double").alias("label"))
    split = R.group_split(rows, "l_orderkey", 7)
    model = L.train_applicability(split.where("split = 'train'").drop("split"), _FEATURES)
    return L.score_applicability(model, rows, _FEATURES).select("l_orderkey", "l_linenumber", "label", "probability", "applicable", "coverage")


@query("m4_text_classifier")
def m4(spark, sf):
    """Quality of every document by a classifier trained on the labelled ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    model = L.train_text_classifier(labelled)
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("predicted"))


@query(
    "r9_detect_gaps",
    """WITH r AS (SELECT p_partkey AS std_id, 'is' || p_partkey AS nn, p_size % 3 <> 0 AS ok, lower(concat_ws(' ', p_name || ' of ' || CASE WHEN p_size % 2 = 0 THEN 'rated voltage' ELSE 'rated power' END, p_type)) AS t, p_size % 4 AS tests, CASE p_size % 5 WHEN 0 THEN 'crs bis' ELSE '' END AS cert, 'is' || (p_partkey - p_size % 2) AS rr FROM part)
       SELECT std_id, 'SCOPE_UNCLEAR' AS gap_type, NULL AS subject, 'medium' AS severity FROM r WHERE NOT ok UNION ALL SELECT std_id, 'NO_TEST_METHOD', NULL, 'low' FROM r WHERE ok AND tests = 0
       UNION ALL SELECT std_id, 'PARAMETER_UNVERIFIABLE', 'power', 'medium' FROM r WHERE ok AND NOT regexp_matches(t, 'watt|power|w |120w|90w') UNION ALL SELECT std_id, 'PARAMETER_UNVERIFIABLE', 'Steel', 'medium' FROM r WHERE ok AND NOT contains(t, 'steel')
       UNION ALL SELECT std_id, 'CERTIFICATION_MISSING', 'BIS', 'high' FROM r WHERE ok AND NOT contains(cert, 'bis') AND NOT contains(t, 'bis') UNION ALL SELECT std_id, 'ADDITIONAL_STANDARD_CITED', 'IS ' || substr(rr, 3), 'high' FROM r WHERE ok AND NOT contains(nn, rr) AND NOT contains(rr, nn)""",
)
def r9(spark, sf):
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("std_id"), F.concat(F.lit("IS "), F.col("p_partkey").cast("string")).alias("is_number"), F.concat("p_name", F.lit(" of "), F.when(size % 2 == 0, "rated voltage").otherwise("rated power")).alias("scope"), (size % 3 != 0).alias("scope_verified"), F.col("p_type").alias("search_text"),
        (size % 4).alias("n_tests"), F.when(size % 5 == 0, "CRS BIS").alias("certification"), F.array(F.lit("power"), F.lit("Steel")).alias("params"), F.array(F.lit("BIS")).alias("certificates"), F.array(F.concat(F.lit("IS "), (F.col("p_partkey") - size % 2).cast("string"))).alias("refs"),
    )
    return K.detect_gaps(rows)


@query(
    "x3_cross_references",
    "SELECT l_orderkey, string_agg(n, ',' ORDER BY i) AS refs FROM (SELECT l_orderkey, 'IS ' || l_partkey AS n, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS i FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
)
def x3(spark, sf):
    line = F.concat(F.lit("item IS "), F.col("l_partkey").cast("string"), F.lit(" rated IS "), F.col("l_suppkey").cast("string"), F.lit(" kV,"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))).alias("lines"))
    texts = rows.select("l_orderkey", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("text"))
    return X.cross_references(texts, "l_orderkey", ["text"]).withColumn("refs", F.array_join("refs", ","))
