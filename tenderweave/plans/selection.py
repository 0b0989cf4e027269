"""Queries for ranking, selection, guardrails, decisions and batch feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection as P
from ..sources.storage import table
from .base import STANDARDS, plain, view

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Candidates of a query over lineitem and part, with what the query asks for.
CANDIDATES = """
    SELECT l_orderkey AS query_id, l_linenumber AS line, l_linenumber * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS pos, l_partkey AS std_id, concat('IS ', l_partkey % 300) AS number, concat('IS ', l_partkey, ' : Part ', l_linenumber) AS is_number, p_name AS title, p_type AS search_text,
           l_discount * 8 AS semantic_score, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS bm25, CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE l_quantity END AS bm25_score,
           CASE l_orderkey % 4 WHEN 0 THEN 'steel' WHEN 1 THEN 'brass widget' WHEN 2 THEN '' ELSE NULL END AS product, CASE l_orderkey % 3 WHEN 0 THEN 'copper' ELSE '' END AS application, 'nickel' AS domain,
           CASE l_orderkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'no such thing' ELSE '' END AS param, concat('is', l_orderkey % 50) AS ref, l_suppkey % 2 = 0 AS verified
    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"""
_CAN, _STD = plain(CANDIDATES), plain(STANDARDS)
_RANK = f"""c AS (SELECT *, lower(concat_ws(' ', search_text, title)) AS t, regexp_replace(lower(is_number), '[ :]', '', 'g') AS nn, regexp_replace(lower(ref), '[ :]', '', 'g') AS rr FROM ({_CAN})),
    s AS (SELECT *, contains(nn, rr) OR contains(rr, nn) AS cited, 0.4 * semantic_score + 0.15 * CASE WHEN bm25_score > 0 THEN least(bm25_score / 20.0, 1.0) ELSE 0 END
            + 0.2 * CASE WHEN coalesce(product, '') <> '' AND contains(t, product) THEN 1.0 WHEN len(list_filter(string_split(coalesce(product, ''), ' '), lambda w: length(w) > 3 AND contains(t, w))) > 0 THEN 0.6 ELSE 0 END
            + 0.1 * CASE WHEN application <> '' AND contains(t, application) THEN 1.0 WHEN contains(t, domain) THEN 0.7 ELSE 0 END + 0.1 * CASE WHEN contains(t, param) THEN 1.0 ELSE 0 END + 0.05 * CASE WHEN verified THEN 1.0 ELSE 0.5 END AS base FROM c),
    b AS (SELECT *, least(1.0, base + CASE WHEN cited THEN 0.3 ELSE 0 END) AS raw FROM s),
    r AS (SELECT *, round(raw, 4) AS relevance, CASE WHEN raw > 0.72 THEN 'high' WHEN raw > 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, pos) AS rank FROM r)"""


def _ranked(spark, sf):
    rows = view(spark, sf, CANDIDATES)
    return P.rank_results(rows.withColumn("params", F.array("param")).withColumn("refs", F.array("ref")))


@query("w1_rank_results", f"WITH {_RANK} SELECT query_id, std_id, pos, CAST(relevance AS DOUBLE) AS relevance, confidence, cited, CAST(rank AS INT) AS rank FROM k")
def w1(spark, sf):
    return _ranked(spark, sf).select("query_id", "std_id", "pos", "relevance", "confidence", "cited", "rank")


@query("w2_score_rank", f"SELECT query_id, pos, CAST(CASE WHEN n IS NOT NULL THEN min(n) OVER (PARTITION BY query_id, number) END AS INT) AS bm25_rank FROM (SELECT *, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC NULLS LAST, pos) END AS n FROM ({_CAN}))")
def w2(spark, sf):
    return P.score_rank(view(spark, sf, CANDIDATES), "bm25", "bm25_rank").select("query_id", "pos", "bm25_rank")


@query("w4_top_k_keep_cited", f"WITH {_RANK} SELECT query_id, std_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, rank) <= 3)")
def w4(spark, sf):
    return P.top_k_keep_cited(_ranked(spark, sf), 3).select("query_id", "std_id", "pos", "rank")


@query(
    "w5_reasoner_select",
    f"""WITH t AS (SELECT query_id, std_id, semantic_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, pos) AS r FROM ({_CAN})), g AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.3) AS n, max(score) AS m, arg_min(std_id, r) AS b FROM t WHERE r <= 5 GROUP BY query_id)
        SELECT query_id, CASE WHEN n > 0 THEN 'justified' ELSE 'requires_human_verification' END AS verdict, round(CASE WHEN n > 0 THEN m ELSE greatest(0.1, m) END, 6) AS confidence, n AS n_selected, CASE WHEN n > 0 THEN b END AS best FROM g""",
)
def w5(spark, sf):
    rows = view(spark, sf, CANDIDATES).withColumnRenamed("semantic_score", "score")
    return P.reasoner_select(rows).withColumn("confidence", F.round("confidence", 6))


@query(
    "w7_pool_candidates",
    f"""WITH p AS (SELECT query_id % 500 AS analysis_id, std_id, bool_or(line = 1) AS cited, max(bm25_score) AS s, count(*) AS n FROM ({_CAN}) GROUP BY ALL), q AS (SELECT *, CASE WHEN cited THEN 1.0 ELSE s END AS score FROM p)
        SELECT analysis_id, std_id, cited, CAST(score AS DOUBLE) AS score, n AS n_requirements, CAST(row_number() OVER w AS INT) AS rank FROM q WINDOW w AS (PARTITION BY analysis_id ORDER BY cited DESC, score DESC, std_id) QUALIFY row_number() OVER w <= 35""",
)
def w7(spark, sf):
    rows = view(spark, sf, CANDIDATES).select((F.col("query_id") % 500).alias("analysis_id"), "std_id", (F.col("line") == 1).alias("cited"), F.col("bm25_score").cast("double").alias("score"))
    return P.pool_candidates(rows, "analysis_id")


@query(
    "w20_sample_families",
    """WITH f AS (SELECT p_brand AS family, count(*) AS size, bool_or(p_size % 50 = 7) AS topic FROM part GROUP BY p_brand),
       b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM f), e AS (SELECT * FROM b WHERE x < 120 OR topic),
       s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM e) SELECT family, size, topic FROM s WHERE y < 400""",
)
def w20(spark, sf):
    families = table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("size"), F.bool_or(F.col("p_size") % 50 == 7).alias("topic"))
    return P.sample_families(families, 400, 120)


@query(
    "j10_candidate_guardrail",
    """WITH c AS (SELECT DISTINCT l_orderkey AS req_id, l_partkey AS std_id FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT l_orderkey AS req_id, CASE WHEN l_linenumber = 3 THEN l_partkey + 5 ELSE l_partkey END AS std_id, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
       SELECT p.req_id, p.std_id, p.pos, CASE WHEN p.std_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown' WHEN c.req_id IS NOT NULL THEN 'accepted' WHEN p.std_id IN (SELECT std_id FROM c) THEN 'other_requirement' ELSE 'not_retrieved' END AS outcome
       FROM p LEFT JOIN c ON c.req_id = p.req_id AND c.std_id = p.std_id""",
)
def j10(spark, sf):
    lines = table(spark, sf, "lineitem")
    proposed = lines.select(F.col("l_orderkey").alias("req_id"), F.when(F.col("l_linenumber") == 3, F.col("l_partkey") + 5).otherwise(F.col("l_partkey")).alias("std_id"), F.col("l_linenumber").alias("pos"))
    candidates = lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("req_id"), F.col("l_partkey").alias("std_id"))
    return P.guardrail(proposed, candidates, table(spark, sf, "part").select(F.col("p_partkey").alias("std_id")))


_TOKS = "unnest(string_split(lower({x}), ' '))"


@query(
    "j11_order_applicability",
    f"""WITH pr AS (SELECT DISTINCT p_partkey AS profile_id, {_TOKS.replace('{x}', "concat(p_name, ' ', p_type)")} AS token FROM part), nu AS (SELECT DISTINCT l_partkey AS profile_id, l_suppkey AS key FROM lineitem WHERE l_quantity > 45),
        ph AS (SELECT DISTINCT s_suppkey AS order_id, phrase, unnest(string_split(phrase, ' ')) AS token FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'steel widget' WHEN 1 THEN 'brass' WHEN 2 THEN 'copper small bolt' ELSE 'standard tin' END AS phrase FROM supplier)),
        nd AS (SELECT order_id, phrase, count(*) AS n FROM ph GROUP BY ALL), me AS (SELECT profile_id, ph.order_id, phrase, count(*) AS n FROM ph JOIN pr ON pr.token = ph.token GROUP BY ALL),
        p AS (SELECT DISTINCT me.profile_id, me.order_id FROM me JOIN nd ON nd.order_id = me.order_id AND nd.phrase = me.phrase AND nd.n = me.n), n AS (SELECT DISTINCT profile_id, s_suppkey AS order_id FROM nu JOIN supplier ON s_suppkey = key)
        SELECT coalesce(n.profile_id, p.profile_id) AS profile_id, coalesce(n.order_id, p.order_id) AS order_id, CASE WHEN n.order_id IS NOT NULL AND p.order_id IS NOT NULL THEN 'number+phrase' WHEN n.order_id IS NOT NULL THEN 'number' ELSE 'phrase' END AS reasons,
               CASE WHEN n.order_id IS NOT NULL AND p.order_id IS NOT NULL THEN 1.0 WHEN n.order_id IS NOT NULL THEN 0.95 ELSE 0.65 END::DOUBLE AS confidence FROM n FULL OUTER JOIN p ON p.profile_id = n.profile_id AND p.order_id = n.order_id""",
)
def j11(spark, sf):
    profiles = table(spark, sf, "part").select(F.col("p_partkey").alias("profile_id"), F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("token"))
    numbers = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("profile_id"), F.col("l_suppkey").alias("key"))
    k = F.col("s_suppkey") % 4
    phrase = F.when(k == 0, "steel widget").when(k == 1, "brass").when(k == 2, "copper small bolt").otherwise("standard tin")
    sup = table(spark, sf, "supplier")
    phrases = sup.select(F.col("s_suppkey").alias("order_id"), phrase.alias("phrase")).withColumn("token", F.explode(F.split("phrase", " ")))
    return P.order_applicability(profiles, numbers, sup.select(F.col("s_suppkey").alias("order_id"), F.col("s_suppkey").alias("key")), phrases)


@query("j9_attach_evidence", "SELECT p_partkey, count(l_orderkey) AS n_evidence, min(l_orderkey) AS first_evidence FROM part LEFT JOIN lineitem ON p_size % 9 <> 0 AND l_quantity > 48 AND l_partkey = p_partkey GROUP BY p_partkey")
def j9(spark, sf):
    url = lambda c, pad: F.concat(F.lit(pad + "http://x/"), c.cast("string"), F.lit(" "))
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, url(F.col("p_partkey"), " ")).alias("url"))
    evidence = table(spark, sf, "lineitem").where("l_quantity > 48").select(url(F.col("l_partkey"), "").alias("url"), F.col("l_orderkey").alias("evidence_id"))
    return P.attach_evidence(rows, evidence).select("p_partkey", "n_evidence", "first_evidence")


@query(
    "j17_compare_standards",
    f"""WITH s AS (SELECT std_id, status, CAST(year AS VARCHAR) AS year, scheme FROM ({_STD})), u AS (SELECT std_id, 'status' AS field, status AS v FROM s UNION ALL SELECT std_id, 'year', year FROM s UNION ALL SELECT std_id, 'scheme', scheme FROM s)
        SELECT a.std_id AS a, b.std_id AS b, a.field, CASE WHEN a.v IS NULL AND b.v IS NULL THEN 'neither' WHEN b.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS outcome FROM u a JOIN u b ON b.std_id = a.std_id + 1 AND b.field = a.field""",
)
def j17(spark, sf):
    rows = view(spark, sf, STANDARDS)
    pairs = rows.select(F.col("std_id").alias("a"), (F.col("std_id") + 1).alias("b"))
    return P.compare_rows(rows, pairs, "std_id", ["status", "year", "scheme"])


@query("j19_references", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def j19(spark, sf):
    return P.edges_both_ways(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("a15_top3_rollup", f"WITH {_RANK} SELECT query_id, string_agg(DISTINCT ref, '|' ORDER BY ref) AS refs FROM (SELECT query_id, unnest([title, number]) AS ref FROM k WHERE rank <= 3) GROUP BY query_id")
def a15(spark, sf):
    return P.top_rollup(_ranked(spark, sf).withColumn("_refs", F.array("title", "number")), 3, "_refs")


@query("a20_facet_counts", f"SELECT status, scheme, mandatory, count(*) AS n, CAST(grouping(status) * 4 + grouping(scheme) * 2 + grouping(mandatory) AS BIGINT) AS facet FROM ({_STD}) GROUP BY GROUPING SETS ((status), (scheme), (mandatory))")
def a20(spark, sf):
    rows = view(spark, sf, STANDARDS)
    return rows.groupingSets([[rows.status], [rows.scheme], [rows.mandatory]], rows.status, rows.scheme, rows.mandatory).agg(F.count("*").alias("n"), F.grouping_id().alias("facet"))


@query("a12_stage_diagnosis", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def a12(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return counted.fillna(0)


@query("a3_enrichment_profile", "SELECT p_brand, count(*) AS n, CAST(floor(avg(length(p_name))) AS BIGINT) AS average_length, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand")
def a3(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.floor(F.avg(F.length("p_name"))).alias("average_length"), F.count_distinct("p_type").alias("n_types"))


@query("a21_workspace_totals", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS completed FROM orders GROUP BY o_orderstatus")
def a21(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))


@query("u7_unique_edges", "SELECT src, dst, pos FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY pos) = 1")
def u7(spark, sf):
    from ..operators.catalogue import first_seen

    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return first_seen(edges, ["src", "dst"], "pos")


@query("u3_set_difference", "SELECT DISTINCT l_partkey AS std_id, l_suppkey AS ref FROM lineitem WHERE l_suppkey <> l_partkey EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u3(spark, sf):
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("std_id"), F.col("l_suppkey").alias("ref"), "l_returnflag")
    return refs.where("ref <> std_id").select("std_id", "ref").distinct().join(refs.where("l_returnflag = 'R'").select("std_id", "ref"), ["std_id", "ref"], "left_anti")


@query(
    "r18_apply_decisions",
    """WITH f AS (SELECT p_partkey AS finding_id, CASE p_size % 4 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'covered' WHEN 2 THEN 'restrictive' ELSE 'partial' END AS status FROM part),
       d AS (SELECT l_partkey AS finding_id, CASE l_linenumber % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' WHEN 2 THEN 'deleted' ELSE 'noted' END AS decision, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS n FROM lineitem WHERE l_quantity > 40)
       SELECT f.finding_id, f.status, d.decision, CASE WHEN d.decision = 'rejected' AND status NOT IN ('conflicting', 'restrictive') THEN 'missing' WHEN d.decision = 'accepted' THEN 'covered' ELSE status END AS effective FROM f LEFT JOIN d ON d.finding_id = f.finding_id AND d.n = 1 WHERE coalesce(d.decision, '') <> 'deleted'""",
)
def r18(spark, sf):
    k = F.col("p_size") % 4
    findings = table(spark, sf, "part").select(F.col("p_partkey").alias("finding_id"), F.when(k == 0, "conflicting").when(k == 1, "covered").when(k == 2, "restrictive").otherwise("partial").alias("status"))
    m = F.col("l_linenumber") % 4
    decisions = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("finding_id"), F.when(m == 0, "rejected").when(m == 1, "accepted").when(m == 2, "deleted").otherwise("noted").alias("decision"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return P.apply_decisions(findings, decisions)


@query("t4_follow_superseding", f"SELECT a.number, CASE WHEN b.number IS NOT NULL THEN a.superseded_by ELSE a.number END AS final FROM ({_STD}) a LEFT JOIN (SELECT DISTINCT number FROM ({_STD})) b ON b.number = a.superseded_by")
def t4(spark, sf):
    return P.follow_superseding(view(spark, sf, STANDARDS))


@query(
    "t3_catalogue_sync",
    f"""WITH s AS (SELECT number, coalesce(year, 0) AS year, title, status, superseded_by FROM ({_STD}) WHERE std_id % 4 <> 0), u AS (SELECT number, coalesce(year, 0) AS year, concat('new ', title) AS title, CASE WHEN std_id % 3 = 0 THEN 'withdrawn' ELSE status END AS status, CASE WHEN std_id % 5 = 0 THEN 'IS 1' ELSE NULL END AS superseded_by FROM ({_STD}) WHERE std_id % 6 < 3)
        SELECT coalesce(s.number, u.number) AS number, coalesce(s.year, u.year) AS year, coalesce(s.title, u.title) AS title, coalesce(u.status, s.status) AS status, coalesce(u.superseded_by, s.superseded_by) AS superseded_by,
               CASE WHEN s.number IS NULL THEN 'inserted' WHEN u.number IS NULL THEN 'kept' WHEN u.status <> s.status OR coalesce(u.superseded_by, s.superseded_by) IS DISTINCT FROM s.superseded_by THEN 'updated' ELSE 'unchanged' END AS change FROM s FULL OUTER JOIN u ON u.number = s.number AND u.year = s.year""",
)
def t3(spark, sf):
    rows = view(spark, sf, STANDARDS).withColumn("year", F.coalesce("year", F.lit(0)))
    state = rows.where("std_id % 4 <> 0").select("number", "year", "title", "status", "superseded_by")
    news = rows.where("std_id % 6 < 3").select("number", "year", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("std_id") % 3 == 0, "withdrawn").otherwise(F.col("status")).alias("status"), F.when(F.col("std_id") % 5 == 0, "IS 1").alias("superseded_by"), F.lit(2).alias("pos"))
    return P.catalogue_sync(state, news.unionByName(news.withColumns({"status": F.lit("active"), "pos": F.lit(1)})))


_TEXTS = "SELECT l_orderkey, l_linenumber, concat('LED lamp ', CAST(l_quantity AS INT), 'W IP', l_linenumber, ' at ', l_suppkey, ' V') AS req, concat(p_name, ' led ', l_linenumber, 'W ', CAST(l_quantity AS INT), 'W type ', p_size, ' ', p_brand) AS cand FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
_TECH = r"\b(?:[A-Z]{2,}|IP\d+|\d+(?:\.\d+)?(?:W|kW|V|A|Hz|mm|cm|m|kg|lx|lm))\b"
_NUM = r"\b\d+(?:\.\d+)?\b"


@query(
    "f4_f5_pair_features",
    f"""WITH t AS (SELECT *, regexp_extract_all(req, '{_TECH}') AS k, regexp_extract_all(req, '{_NUM}') AS a, regexp_extract_all(cand, '{_NUM}') AS b FROM ({plain(_TEXTS)}))
        SELECT l_orderkey, l_linenumber, round(len(list_filter(k, lambda x: contains(lower(cand), lower(x)))) / len(k), 6) AS tech_overlap, round(len(list_filter(a, lambda x: contains(lower(cand), lower(x)))) / len(a), 6) AS numeric_match, CAST(len(a) AS DOUBLE) AS n_req, CAST(len(b) AS DOUBLE) AS n_std FROM t""",
)
def f4(spark, sf):
    match, n_req, n_std = T.numeric_features(F.col("req"), F.col("cand"))
    return view(spark, sf, _TEXTS).select("l_orderkey", "l_linenumber", F.round(T.tech_keyword_overlap(F.col("req"), F.col("cand")), 6).alias("tech_overlap"), F.round(match, 6).alias("numeric_match"), n_req.alias("n_req"), n_std.alias("n_std"))


@query("f15_hash_embedding", "WITH e AS (SELECT doc_id, list_transform(range(0, 8), lambda i: CAST(('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2)) AS INT) / 127.5 - 1) AS v FROM (SELECT doc_id, sha256(text) AS h FROM documents)) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS total FROM e")
def f15(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 5).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(
    "p17_build_search_text",
    """WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(concat_ws(' ', p_name, p_type, p_brand, upper(p_name)), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(concat_ws(' ', p_name, p_type, p_brand, upper(p_name)), '\\s+'), 1) AS i FROM part),
       f AS (SELECT * FROM t WHERE length(w) >= 2 QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(w) ORDER BY i) = 1) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS search_text FROM f GROUP BY p_partkey""",
)
def p17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.search_text(F.array("p_name", "p_type", "p_brand", F.upper("p_name"))).alias("search_text"))


@query("s12_lookup_by_status", f"SELECT std_id, number, year FROM ({_STD}) WHERE status IN ('active', 'reaffirmed') AND NOT coalesce(mismatch, false)")
def s12(spark, sf):
    return view(spark, sf, STANDARDS).where(F.col("status").isin("active", "reaffirmed") & ~F.col("mismatch")).select("std_id", "number", "year")


@query("s16_standard_evidence", f"SELECT std_id, kind, count(*) AS n FROM (SELECT std_id, 'standard' AS kind FROM ({_STD}) UNION ALL SELECT std_id, 'amendment' FROM (SELECT std_id, unnest(range(0, n_amendments)) AS k FROM ({_STD})) UNION ALL SELECT std_id, 'order' FROM ({_STD}) WHERE mandatory) GROUP BY ALL")
def s16(spark, sf):
    rows = view(spark, sf, STANDARDS)
    amendments = rows.where("n_amendments > 0").select("std_id", F.explode(F.sequence(F.lit(1), F.col("n_amendments")))).select("std_id", F.lit("amendment").alias("kind"))
    every = rows.select("std_id", F.lit("standard").alias("kind")).unionByName(amendments).unionByName(rows.where("mandatory").select("std_id", F.lit("order").alias("kind")))
    return every.groupBy("std_id", "kind").agg(F.count("*").alias("n"))


@query("s4_drop_bad_records", "SELECT bad, count(*) AS n FROM (SELECT CASE WHEN p_size % 11 = 0 THEN 'no_number' WHEN p_size % 13 = 0 THEN 'no_title' ELSE 'kept' END AS bad FROM part) GROUP BY bad")
def s4(spark, sf):
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") % 11 != 0, F.col("p_partkey")).alias("number"), F.when(F.col("p_size") % 13 == 0, "").otherwise(F.col("p_name")).alias("title"))
    bad = F.when(F.col("number").isNull(), "no_number").when(F.coalesce("title", F.lit("")) == "", "no_title").otherwise("kept")
    return rows.groupBy(bad.alias("bad")).agg(F.count("*").alias("n"))
