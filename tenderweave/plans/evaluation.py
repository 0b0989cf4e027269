"""Queries that measure retrieval by stage, and that train and choose models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import retrieval as R
from ..operators.records import sync_snapshot
from ..sources.storage import table
from .base import CATALOGUE, plain, view
from .files import folder
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: The lines of an order as hits of four stages, their parts' numbers spelled as in the catalogue; the ranking takes a part of
#: what the fusion has, and the expected number is that of the order's first part, spelled plainly.
HITS = f"""
    WITH c AS (SELECT std_id, is_number FROM ({CATALOGUE})),
         l AS (SELECT l_orderkey AS query_id, c.is_number AS number, l_quantity AS q, l_linenumber AS n, l_suppkey AS s FROM {{lineitem}} JOIN c ON c.std_id = l_partkey),
         e AS (SELECT 'lexical' AS stage, query_id, number, q, n FROM l WHERE s % 5 <> 0 UNION ALL SELECT 'vector', query_id, number, -q, n FROM l WHERE s % 7 <> 0
               UNION ALL SELECT 'fused', query_id, number, -q, n FROM l WHERE s % 11 <> 0 UNION ALL SELECT 'ranked', query_id, number, -q * (1 + n % 3), n FROM l WHERE n % 4 <> 0)
    SELECT stage, query_id, number, CAST(row_number() OVER (PARTITION BY stage, query_id ORDER BY q, n, number) AS INT) AS rank FROM e"""
GOLD = """
    SELECT query_id, CASE WHEN part % 4 = 3 THEN concat('IS/IEC ', part % 700) WHEN part % 4 = 0 THEN concat('IS: ', part % 700) ELSE concat('is ', part % 700, ' Part ', size % 5 + 1) END AS expected
    FROM (SELECT l_orderkey AS query_id, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey) JOIN (SELECT p_partkey, p_size AS size FROM {part}) ON p_partkey = part"""


def _hits(spark, sf):
    """The rows of HITS in one pass: a line meets its part once, and its order's lines are in one task before they become
    hits of four stages and are ranked."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("std_id"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"))
    numbers = view(spark, sf, CATALOGUE).select("std_id", F.col("is_number").alias("number"))
    dealt = lines.join(numbers, "std_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    q, n, s = F.col("q"), F.col("n"), F.col("s")
    stages = [("lexical", q, s % 5 != 0), ("vector", -q, s % 7 != 0), ("fused", -q, s % 11 != 0), ("ranked", -q * (1 + n % 3), n % 4 != 0)]
    at = F.explode(F.array_compact(F.array(*[F.when(keep, F.struct(F.lit(name).alias("stage"), by.alias("by"))) for name, by, keep in stages])))
    hits = dealt.select("query_id", "number", "n", at.alias("h")).select("h.stage", "query_id", "number", "n", "h.by")
    rank = F.row_number().over(Window.partitionBy("stage", "query_id").orderBy("by", "n", "number"))
    return hits.select("stage", "query_id", "number", rank.alias("rank"))


_SPACED = r"trim(regexp_replace(lower({0}), '[\s:]+', ' ', 'g'))"
_SQUEEZED = "replace(replace(lower({0}), ' ', ''), ':', '')"


def _judged(mode: str) -> str:
    a, b = ((_SPACED if mode == "either_way" else _SQUEEZED).format(c) for c in ("number", "expected"))
    return f"{a} = {b}" if mode == "exact" else f"(contains({a}, {b}) OR contains({b}, {a}))"


_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, stage, query_id, min(rank) FILTER (WHERE {_judged(m)}) AS best FROM h JOIN g USING (query_id) GROUP BY stage, query_id" for m in E.MODES)


@query(
    "a11_match_modes",
    f"""WITH h AS ({plain(HITS)}), g AS ({plain(GOLD)}), b AS ({_MODES}),
        x AS (SELECT m.mode, s.stage, g.query_id, b.best FROM (SELECT DISTINCT mode FROM b) m, (SELECT DISTINCT stage FROM h) s, g LEFT JOIN b ON b.mode = m.mode AND b.stage = s.stage AND b.query_id = g.query_id)
        SELECT mode, stage, count(*) AS n_queries, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0 END), 4) AS recall_at_3,
               round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0 END), 4) AS recall_at_5, round(avg(coalesce(1.0 / best, 0)), 4) AS mrr FROM x GROUP BY mode, stage""",
)
def a11_modes(spark, sf):
    return E.match_modes(_hits(spark, sf), view(spark, sf, GOLD))


_FLAGS = ", ".join(f"coalesce(bool_or(stage = '{n}'), false) AS {n}" for n in ("lexical", "vector", "fused", "ranked"))
_LOSSES = f"""
    WITH h AS ({plain(HITS)}), g AS ({plain(GOLD)}), f AS (SELECT query_id, {_FLAGS} FROM h JOIN g USING (query_id) WHERE rank <= 3 AND {_judged('either_way')} GROUP BY query_id),
         a AS (SELECT g.query_id, coalesce(lexical, false) AS lexical, coalesce(vector, false) AS vector, coalesce(fused, false) AS fused, coalesce(ranked, false) AS ranked FROM g LEFT JOIN f ON f.query_id = g.query_id)
    SELECT *, CASE WHEN ranked THEN 'none' WHEN fused THEN 'ranking' WHEN lexical OR vector THEN 'fusion' ELSE 'retrieval' END AS lost_at,
           CASE WHEN lexical AND vector THEN 'both' WHEN lexical THEN 'lexical' WHEN vector THEN 'vector' END AS carried_by FROM a"""


@query("a12_stage_losses", _LOSSES)
def a12_losses(spark, sf):
    return E.stage_losses(_hits(spark, sf), view(spark, sf, GOLD), k=3)


@query(
    "a12_diagnosis",
    "SELECT count(*) AS n_queries, "
    + ", ".join(f"round(100 * avg({n}::INT), 2) AS {n}" for n in ("lexical", "vector", "fused", "ranked"))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE lost_at = '{at}') AS lost_at_{at}" for at in ("ranking", "fusion", "retrieval"))
    + f", 'healthy' AS finding FROM ({_LOSSES})",
)
def a12_diagnosis(spark, sf):
    return E.stage_diagnosis(E.stage_losses(_hits(spark, sf), view(spark, sf, GOLD), k=3))


_FEATURES = ["quantity", "tax", "size"]


def _pairs(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gap = F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return both.select("l_orderkey", "l_linenumber", gap.alias("quantity"), F.col("l_tax").alias("tax"), F.col("p_size").cast("double").alias("size"), ((F.col("l_quantity") + F.col("p_size")) > 50).cast("double").alias("label"))


@query("m2_out_of_fold")
def m2_folds(spark, sf):
    """Trains by grouped folds over orders, saves the model with its threshold, and scores all pairs by what was saved."""
    rows = _pairs(spark, sf)
    model, _, chosen = L.train_by_folds(rows, _FEATURES, "l_orderkey", folds=2, depths=(4,), trees=8)
    path = folder(spark, "model")
    L.save_model(model, path, _FEATURES, chosen["threshold"])
    return L.score_saved(spark, path, rows).select("l_orderkey", "l_linenumber", "label", "probability", "applicable", "coverage", "status")


@query("m4_chosen_classifier")
def m4_chosen(spark, sf):
    """Forest and regression over labelled documents by macro F1 on the documents kept out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    split = R.group_split(rows, "doc_id", 7)
    return L.choose_text_classifier(split.where("split = 'train'").drop("split"), split.where("split <> 'train'").drop("split"))[1]


#: Syncs over events: some of an analysis, some of the bucket that all share.
SYNCED = """
    SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id % 400 END AS analysis_id, concat('IS ', event_id % 40) AS number, ts AS synced_at, event_id AS seq, event_type IN ('view', 'click') AS changed,
           CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS n_errors FROM {events} WHERE user_id % 3 > 0"""
ASKED = "SELECT DISTINCT user_id % 500 AS analysis_id FROM {events}"
RUNNING = "SELECT user_id % 500 AS analysis_id, CAST(user_id % 7 AS INT) AS planned FROM {events} WHERE event_id % 50 = 0"
_SUMS = "max(synced_at) FILTER (WHERE n_errors = 0) AS last_synced_at, count(*) AS total_synced, count(*) FILTER (WHERE n_errors > 0) AS error_count, count(*) FILTER (WHERE changed) AS changed_count"


@query(
    "a16_sync_status",
    f"""WITH l AS (SELECT * FROM ({plain(SYNCED)}) QUALIFY row_number() OVER (PARTITION BY analysis_id, number ORDER BY synced_at DESC, seq DESC) = 1),
        o AS (SELECT analysis_id, {_SUMS} FROM l WHERE analysis_id IS NOT NULL GROUP BY analysis_id), s AS (SELECT {_SUMS} FROM l WHERE analysis_id IS NULL),
        n AS (SELECT analysis_id, max(planned) AS planned FROM ({plain(RUNNING)}) GROUP BY analysis_id)
        SELECT a.analysis_id, CASE WHEN o.analysis_id IS NOT NULL THEN 'own' WHEN s.total_synced > 0 THEN 'shared' ELSE 'none' END AS bucket, CASE WHEN o.analysis_id IS NOT NULL THEN o.last_synced_at ELSE s.last_synced_at END AS last_synced_at,
               coalesce(o.total_synced, s.total_synced) AS total_synced, coalesce(o.error_count, s.error_count) AS error_count, coalesce(o.changed_count, s.changed_count) AS changed_count, n.analysis_id IS NOT NULL AS in_progress, n.planned
        FROM ({plain(ASKED)}) a LEFT JOIN o ON o.analysis_id = a.analysis_id LEFT JOIN n ON n.analysis_id = a.analysis_id, s""",
)
def a16_status(spark, sf):
    return sync_snapshot(view(spark, sf, ASKED), view(spark, sf, SYNCED), view(spark, sf, RUNNING))
