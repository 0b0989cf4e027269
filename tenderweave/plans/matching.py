"""Queries for retrieval, rules, findings, reports, evaluation and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import frontier, retrieval as R, rules as K
from ..sources.storage import table
from ..streaming import state as S
from .base import FETCHES, REQUIREMENTS, STANDARDS, plain, view

_STD, _REQ, _FET = plain(STANDARDS), plain(REQUIREMENTS), plain(FETCHES)
TODAY = "2024-01-15"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TOK = r"""list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+')), lambda t: length(t) >= 2)"""
_LEX = f"""q AS (SELECT item_id AS query_id, unnest({_TOK.replace('{x}', 'text')}) AS token FROM benchmark),
    p AS (SELECT doc_id AS std_id, 3.0 AS w, unnest({_TOK.replace('{x}', 'split_part(text, chr(10), 1)')}) AS token FROM documents UNION ALL SELECT doc_id, 1.5, unnest({_TOK.replace('{x}', 'text')}) FROM documents),
    lex AS (SELECT query_id, std_id, sum(w) AS score, count(DISTINCT q.token) AS n_terms FROM q JOIN p ON p.token = q.token GROUP BY query_id, std_id)"""


def _lexical(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("std_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"), "text")
    return R.lexical_score(queries, rows, {"title": "head", "scope": "text"})


@query("w17_lexical_score", f"WITH {_LEX} SELECT query_id, std_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) AS rank FROM lex) WHERE rank <= 10")
def w17(spark, sf):
    return R.ranked(_lexical(spark, sf), [F.desc("score"), F.asc("std_id")], 10).select("query_id", "std_id", "score", F.col("rank").cast("long").alias("rank"))


_COS = """SELECT q.vec_id AS query_id, e.vec_id AS std_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (q.n * e.n) AS score, e.label = q.label AS relevant
          FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) e WHERE q.vec_id <> e.vec_id"""


def _vectors(spark, sf, k):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("std_id"), F.col("embedding").alias("vec"))
    queries = rows.where("std_id % 50 = 0").select(F.col("std_id").alias("query_id"), "vec")
    return R.vector_top_k(queries, rows, k + 1).where("query_id <> std_id")


@query("w16_vector_top_k", f"SELECT query_id, std_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) AS r FROM ({_COS})) WHERE r <= 5")
def w16(spark, sf):
    found = R.ranked(_vectors(spark, sf, 5).drop("rank"), [F.desc("score"), F.asc("std_id")], 5)
    return found.select("query_id", "std_id", F.round("score", 5).alias("score"))


@query(
    "a11_retrieval_eval",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) AS rank FROM ({_COS})), b AS (SELECT query_id, min(rank) FILTER (WHERE relevant AND rank <= 10) AS best FROM r GROUP BY query_id)
        SELECT 'cosine' AS stage, count(*) AS n_queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 4) AS recall_at_3, round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 4) AS recall_at_5, round(avg(coalesce(1.0 / best, 0)), 4) AS mrr FROM b""",
)
def a11(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = R.ranked(_vectors(spark, sf, 10).drop("rank"), [F.desc("score"), F.asc("std_id")], 10)
    hits = hits.join(labels.select(F.col("vec_id").alias("std_id"), F.col("label").alias("a")), "std_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id")
    return R.retrieval_eval(hits.select(F.lit("cosine").alias("stage"), "query_id", "rank", (F.col("a") == F.col("b")).alias("relevant")), hits.select("query_id"))


_FUSE = f"""WITH {_LEX}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) AS r FROM lex) WHERE r <= 20),
    e AS (SELECT kind, id, list_transform(range(0, 8), lambda i: CAST(('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2)) AS INT) / 127.5 - 1) AS x FROM (SELECT 1 AS kind, item_id AS id, sha256(text) AS h FROM benchmark UNION ALL SELECT 2, doc_id, sha256(text) FROM documents)),
    u AS (SELECT kind, id, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM e),
    v AS (SELECT a.id AS query_id, b.id AS std_id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 12) AS score FROM u a, u b WHERE a.kind = 1 AND b.kind = 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])), 12) DESC, b.id) <= 20),
    b AS (SELECT coalesce(lt.query_id, v.query_id) AS query_id, coalesce(lt.std_id, v.std_id) AS std_id, lt.score AS lex, v.score AS vec FROM lt FULL OUTER JOIN v ON v.query_id = lt.query_id AND v.std_id = lt.std_id),
    n AS (SELECT *, count(vec) OVER (PARTITION BY query_id) > 0 AS has, least(1, coalesce(lex, 0) / max(lex) OVER (PARTITION BY query_id)) AS l, CASE WHEN coalesce(vec, 0) <> 0 THEN (vec + 1) / 2 ELSE 0 END AS c FROM b),
    f AS (SELECT query_id, std_id, CASE WHEN has THEN 0.6 * coalesce(l, 0) + 0.4 * c ELSE l END AS raw, CASE WHEN has THEN 0.35 ELSE 0.2 END AS cut FROM n),
    s AS (SELECT query_id, std_id, round(raw, 4) AS score, count(*) OVER (PARTITION BY query_id) AS total FROM f WHERE raw >= cut)"""


@query("w18_hybrid_fuse", _FUSE + " SELECT query_id, std_id, CAST(score AS DOUBLE) AS score, total FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, std_id) <= 10")
def w18(spark, sf):
    lexical = R.ranked(_lexical(spark, sf), [F.desc("score"), F.asc("std_id")], 20)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("std_id"), T.hash_embedding(F.col("text")).alias("vec"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.hash_embedding(F.col("text")).alias("vec"))
    vectors = R.vector_top_k(items, docs, 20)
    return R.hybrid_fuse(lexical, vectors, 0.6, 0.4, 10).select("query_id", "std_id", "score", "total")


_BM = """q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS token FROM benchmark),
    t AS (SELECT doc_id AS std_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS token FROM documents) GROUP BY ALL),
    l AS (SELECT std_id, sum(tf) AS len FROM t GROUP BY std_id), d AS (SELECT token, count(*) AS df FROM t GROUP BY token), c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) AS tokens),
    s AS (SELECT query_id, t.std_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (tokens / n)))) AS score FROM q JOIN d ON d.token = q.token JOIN t ON t.token = q.token JOIN l ON l.std_id = t.std_id, c GROUP BY query_id, t.std_id)"""


def _bm25(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return R.bm25_score(queries, table(spark, sf, "documents").select(F.col("doc_id").alias("std_id"), "text"))


@query("w19_bm25", f"WITH {_BM} SELECT query_id, round(max(score), 4) AS best, count(*) AS n_scored FROM s GROUP BY query_id")
def w19(spark, sf):
    return _bm25(spark, sf).groupBy("query_id").agg(F.round(F.max("score"), 4).alias("best"), F.count("*").alias("n_scored"))


@query(
    "w19_rrf",
    """WITH r AS (SELECT l_suppkey AS query_id, l_partkey AS std_id, sum(l_quantity) AS a, sum(l_discount) AS b FROM lineitem GROUP BY ALL),
       k AS (SELECT query_id, std_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, std_id) AS rank FROM r UNION ALL SELECT query_id, std_id, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 4) DESC, std_id) FROM r)
       SELECT query_id, std_id, round(sum(1 / (60 + rank)), 8) AS score FROM k GROUP BY ALL""",
)
def w19_rrf(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("std_id")).agg(F.sum("l_quantity").alias("a"), F.sum("l_discount").alias("b"))
    lists = [R.ranked(sums, [by, F.asc("std_id")], None).select("query_id", "std_id", "rank") for by in (F.desc("a"), F.desc(F.round("b", 4)))]
    return R.rrf_fuse(lists[0].unionByName(lists[1])).select("query_id", "std_id", F.round("score", 8).alias("score"))


_PAIRS = f"(SELECT r.*, s.status, s.deadline, s.year, s.mandatory, s.scheme, s.mismatch, s.superseded_by, s.n_amendments, s.verified FROM ({_REQ}) r JOIN ({_STD}) s ON s.std_id = r.std_id)"


def _pairs(spark, sf):
    return view(spark, sf, REQUIREMENTS).join(view(spark, sf, STANDARDS).drop("number", "title"), "std_id")


@query("r1_version_check", f"SELECT req_id, CASE WHEN cited_year IS NULL THEN 'year_omitted' WHEN year IS NULL THEN 'year_unknown' WHEN year = cited_year THEN 'equal' WHEN year > cited_year THEN 'behind' ELSE 'ahead' END AS outcome, year - cited_year AS gap, cited_year IS NULL OR coalesce(year = cited_year, false) AS is_current FROM {_PAIRS}")
def r1(spark, sf):
    outcome, gap, current = K.version_check(F.col("cited_year"), F.col("year"))
    return _pairs(spark, sf).select("req_id", outcome.alias("outcome"), gap.alias("gap"), current.alias("is_current"))


_IN = f"coalesce(status = 'superseded' AND DATE '{TODAY}' <= deadline, false)"


@query("r2_status_check", f"SELECT std_id, status, CASE WHEN status = 'withdrawn' THEN false WHEN status = 'superseded' THEN {_IN} ELSE true END AS usable, CASE WHEN DATE '{TODAY}' <= deadline THEN CAST(date_diff('day', DATE '{TODAY}', deadline) AS INT) END AS days_left FROM ({_STD})")
def r2(spark, sf):
    today = F.lit(TODAY).cast("date")
    return view(spark, sf, STANDARDS).select("std_id", "status", K.usable(F.col("status"), F.col("deadline"), today).alias("usable"), K.days_left(F.col("deadline"), today).alias("days_left"))


@query("r3_order_check", f"SELECT std_id, CASE WHEN mandatory THEN CASE scheme WHEN 'isi_mark' THEN '{K.SCHEMES['isi_mark']}' WHEN 'crs' THEN '{K.SCHEMES['crs']}' ELSE 'BIS certification (scheme unspecified)' END END AS needed FROM ({_STD})")
def r3(spark, sf):
    return view(spark, sf, STANDARDS).select("std_id", K.order_check(F.col("mandatory"), F.col("scheme")).alias("needed"))


_RULES = (
    ("status = 'withdrawn'", "incorrect_standard", 0.95), ("mismatch", "wrong_scope", 0.80), (f"status = 'superseded' AND deadline IS NOT NULL AND NOT {_IN}", "outdated_reference", 0.95), (f"status = 'superseded' AND {_IN}", "outdated_reference", 0.75),
    ("status = 'superseded'", "outdated_reference", 0.85), ("year - cited_year > 5", "outdated_reference", 0.80), ("year - cited_year > 0", "outdated_reference", 0.70), ("year - cited_year < 0", "requires_human_verification", 0.55),
    ("cited_year IS NOT NULL AND year IS NULL", "unable_to_determine", 0.45), ("status = 'under_revision'", "requires_human_verification", 0.65), ("cited_year IS NULL", "ambiguous", 0.60), ("status = 'unknown'", "unable_to_determine", 0.50),
)
_VERDICT = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v, _ in _RULES) + " ELSE 'justified' END"
_SURE = "CASE " + " ".join(f"WHEN {c} THEN {x}::DOUBLE" for c, _, x in _RULES) + " ELSE 0.85::DOUBLE END"
_FIND = f"(SELECT *, {_VERDICT} AS verdict, {_SURE} AS confidence FROM {_PAIRS})"


def _findings(spark, sf):
    verdict, sure = K.suggested_verdict(F.col("status"), F.col("deadline"), F.lit(TODAY).cast("date"), F.col("mismatch"), F.col("cited_year"), F.col("year"))
    return _pairs(spark, sf).withColumns({"verdict": verdict, "confidence": sure})


@query("r5_suggested_verdict", f"SELECT req_id, verdict, confidence FROM {_FIND}")
def r5(spark, sf):
    return _findings(spark, sf).select("req_id", "verdict", "confidence")


@query(
    "r8_currentness",
    f"""SELECT req_id, v AS verdict, CASE WHEN v = 'UNVERIFIABLE' THEN 0.4 WHEN verified THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT *, CASE WHEN status = 'withdrawn' THEN 'WITHDRAWN' WHEN superseded_by IS NOT NULL THEN 'SUPERSEDED' WHEN cited_year < year THEN 'OUTDATED_REFERENCE'
        WHEN n_amendments > 0 THEN 'AMENDMENT_AVAILABLE' WHEN NOT verified AND year IS NULL THEN 'UNVERIFIABLE' ELSE 'UP_TO_DATE' END AS v FROM {_PAIRS})""",
)
def r8(spark, sf):
    verdict, sure = K.currentness(F.col("status"), F.col("superseded_by"), F.col("cited_year"), F.col("year"), F.col("n_amendments"), F.col("verified"))
    return _pairs(spark, sf).select("req_id", verdict.alias("verdict"), sure.alias("confidence"))


@query(
    "w9_merge_verdicts",
    f"""SELECT analysis_id, verdict, confidence, n AS n_pairs FROM (SELECT *, count(*) OVER (PARTITION BY analysis_id) AS n, row_number() OVER (PARTITION BY analysis_id ORDER BY list_position({list(K.SEVERITY)}, verdict), pos, verdict, confidence) AS r FROM {_FIND}) WHERE r = 1""",
)
def w9(spark, sf):
    return K.merge_verdicts(_findings(spark, sf), "analysis_id")


@query("a8_verdict_counts", f"SELECT verdict, count(*) AS n, count(DISTINCT analysis_id) AS n_analyses FROM {_FIND} GROUP BY verdict")
def a8(spark, sf):
    return _findings(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("analysis_id").alias("n_analyses"))


@query("a8_verdict_rollup", f"SELECT flag, verdict, count(*) AS n FROM {_FIND} GROUP BY ROLLUP (flag, verdict)")
def a8_rollup(spark, sf):
    return _findings(spark, sf).rollup("flag", "verdict").agg(F.count("*").alias("n"))


@query(
    "a9_scorecard",
    f"""SELECT analysis_id, count(*) AS total, CASE WHEN a > 0 THEN round(100 * (a - m) / a, 1) END AS completeness_pct, CASE WHEN a > 0 THEN round(100 * count(*) FILTER (WHERE verdict = 'justified') / a, 1) END AS defensibility_pct, greatest(0, 100 - 10 * count(*) FILTER (WHERE mandatory AND verdict <> 'justified')) AS regulatory,
        count(*) FILTER (WHERE confidence < 0.6) AS for_review FROM (SELECT *, count(*) FILTER (WHERE verdict <> 'unable_to_determine') OVER (PARTITION BY analysis_id) AS a, count(*) FILTER (WHERE verdict = 'missing_requirement') OVER (PARTITION BY analysis_id) AS m FROM {_FIND}) GROUP BY analysis_id, a, m""",
)
def a9(spark, sf):
    return K.scorecard(_findings(spark, sf), "analysis_id")


@query(
    "a10_risk_summary",
    f"""SELECT analysis_id, bool_or(mandatory) AS any_mandatory, bool_or(scheme = 'crs') AS any_crs, count(*) FILTER (WHERE verdict <> 'justified') AS issues, CASE WHEN count(*) FILTER (WHERE verdict = 'incorrect_standard' OR (mandatory AND verdict <> 'justified')) > 0 THEN 'high' WHEN count(*) FILTER (WHERE verdict <> 'justified') > 0 THEN 'medium' ELSE 'low' END AS risk_level FROM {_FIND} GROUP BY analysis_id""",
)
def a10(spark, sf):
    return K.risk_summary(_findings(spark, sf), "analysis_id")


@query("j13_cross_reference_gaps", "SELECT std_id, count(*) AS n_refs, count(*) FILTER (WHERE ref NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)) AS n_unmet FROM (SELECT DISTINCT l_partkey AS std_id, l_suppkey AS ref FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY std_id")
def j13(spark, sf):
    lines = table(spark, sf, "lineitem")
    return K.cross_reference_gaps(lines.select(F.col("l_partkey").alias("std_id"), F.col("l_partkey").alias("own"), F.col("l_suppkey").alias("ref")), lines.where("l_quantity > 49").select(F.col("l_suppkey").alias("ref")))


@query("j14_superseding", f"SELECT DISTINCT a.superseded_by AS src, a.number AS dst, 'supersedes' AS edge FROM ({_STD}) a JOIN ({_STD}) b ON b.number = a.superseded_by")
def j14(spark, sf):
    return K.superseding(view(spark, sf, STANDARDS))


_YP = "(SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE toxic END AS p FROM labels)"


@query(
    "a13_classification_metrics",
    f"""WITH c AS (SELECT * FROM {_YP}), k AS (SELECT DISTINCT unnest([y, p]) AS label FROM c),
        e AS (SELECT label, (SELECT count(*) FROM c WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM c WHERE y = label) AS r, (SELECT count(*) FROM c WHERE p = label) AS s FROM k),
        f AS (SELECT *, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS pr, CASE WHEN r > 0 THEN tp / r ELSE 0 END AS re FROM e), g AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM f)
        SELECT sum(r)::BIGINT AS n, round(sum(tp) / sum(r), 4) AS accuracy, round(avg(pr), 4) AS macro_precision, round(avg(re), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * r) / sum(r), 4) AS weighted_f1 FROM g""",
)
def a13(spark, sf):
    return R.classification_metrics(table(spark, sf, "labels").select(F.col("quality").alias("y"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("toxic")).alias("p")))


@query("a14_class_distribution", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a14(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "m6_group_split",
    """WITH g AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT o_custkey, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_custkey, (row_number() OVER (ORDER BY md5(o_custkey || '#7')) - 1) / (SELECT count(*) FROM g) AS x FROM g))
       SELECT o_orderkey, split FROM orders JOIN s ON s.o_custkey = orders.o_custkey""",
)
def m6(spark, sf):
    return R.group_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7).select("o_orderkey", "split")


@query(
    "t1_document_state",
    f"""WITH f AS (SELECT * FROM ({_FET})), s AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY ts, seq) AS b, row_number() OVER (PARTITION BY hash ORDER BY ts, seq) AS n FROM f WHERE hash <> '')
        SELECT seq, url, CASE WHEN b = hash THEN 'unchanged' WHEN b IS NOT NULL THEN 'modified' WHEN n > 1 THEN 'duplicate_url' ELSE 'new' END AS state FROM s UNION ALL SELECT seq, url, 'new' FROM f WHERE hash = ''""",
)
def t1(spark, sf):
    return S.document_state(view(spark, sf, FETCHES).select("url", "hash", "ts", "seq")).select("seq", "url", "state")


@query(
    "t2_url_sync_state",
    f"""WITH f AS (SELECT *, sum(ok::INT) OVER (PARTITION BY url ORDER BY ts, seq) AS run FROM ({_FET}))
        SELECT url, arg_max(etag, (ts, seq)) FILTER (WHERE etag IS NOT NULL) AS etag, arg_max(hash, (ts, seq)) AS hash, arg_max(status, (ts, seq)) AS status, count(*) FILTER (WHERE run = m AND NOT ok) AS errors FROM (SELECT *, max(run) OVER (PARTITION BY url) AS m FROM f) GROUP BY url""",
)
def t2(spark, sf):
    return S.url_sync_state(view(spark, sf, FETCHES))


@query("t7_analysis_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def t7(spark, sf):
    return S.analysis_status(table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status")), "user_id")


@query("t8_windowed_activity", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t8(spark, sf):
    return S.windowed_activity(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query(
    "t6_link_frontier",
    """WITH RECURSIVE l AS (SELECT DISTINCT concat('p', l_partkey) AS src, concat('p', l_suppkey * 3) AS dst FROM lineitem),
       r AS (SELECT DISTINCT concat('p', p_partkey) AS url, 0 AS depth FROM part WHERE p_partkey % 40 = 7 UNION SELECT l.dst, r.depth + 1 FROM r JOIN l ON l.src = r.url WHERE r.depth < 3)
       SELECT url, min(depth) AS depth FROM r GROUP BY url ORDER BY min(depth), url LIMIT 500""",
)
def t6(spark, sf):
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    links = table(spark, sf, "lineitem").select(p(F.col("l_partkey")).alias("src"), p(F.col("l_suppkey") * 3).alias("dst")).distinct()
    seeds = table(spark, sf, "part").where("p_partkey % 40 = 7").select(p(F.col("p_partkey")).alias("url"))
    return frontier.link_frontier(links, seeds, 3, 500)


@query("a16_sync_snapshot", "SELECT event_type, max(ts) AS last_seen, count(*) AS total, count(*) FILTER (WHERE value > 100) AS large FROM events GROUP BY event_type")
def a16(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("last_seen"), F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("large"))
