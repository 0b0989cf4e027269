"""Queries that judge pairs of requirements and standards: materials, scope and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as M
from ..operators import scope as S
from ..sources.storage import table
from .base import TENDER_LINES, TITLES, view

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _standards(spark, sf):
    return view(spark, sf, TITLES).select("std_id", "title", "scope", F.col("reference").alias("keywords"), F.col("is_number").alias("designation"), "status")


@query("a18_material_vocabulary")
def a18(spark, sf):
    alias, covers = S.material_vocabulary(_standards(spark, sf))
    return alias.join(covers, ["attribute", "material"]).select("attribute", "alias", "material", "spelling", F.size("designations").alias("n_designations"))


@query("x20_materials_in_titles")
def x20(spark, sf):
    return S.materials_in(_standards(spark, sf), ["std_id"], "title")


@query("x20_required_materials")
def x20_required(spark, sf):
    alias, _ = S.material_vocabulary(_standards(spark, sf))
    return S.required_materials(view(spark, sf, TENDER_LINES).select("line_id", "text"), ["line_id"], "text", alias)


@query("r4_scope_check")
def r4(spark, sf):
    pairs = view(spark, sf, TENDER_LINES).select(F.col("line_id").alias("req_id"), "std_id", "text")
    return S.scope_check(pairs, _standards(spark, sf)).withColumn("alternatives", F.size("alternatives"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda t: t <> ''))"
_COUNT = r"len(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda t: t <> ''))"
_TECH = r"regexp_extract_all({x}, '\b(?:[A-Z]{{2,}}|IP\d+|\d+(?:\.\d+)?(?:W|kW|V|A|Hz|mm|cm|m|kg|lx|lm))\b')"
_NUM = r"regexp_extract_all({x}, '\b\d+(?:\.\d+)?\b')"
_UNIT = r"list_distinct(list_transform(regexp_extract_all({x}, '(?i)\b(?:W|kW|V|A|Hz|mm|cm|m|kg|g|lx|lm|cd|K|nm|dB|IP\d+)\b'), lambda u: upper(u)))"
# \b in the other engine knows ASCII only: other letters become one of it first
_f = lambda form, x: form.replace("{x}", f"regexp_replace({x}, '[À-ÖØ-öø-ÿ]', 'q', 'g')" if "regexp_extract_all" in form else x).replace("{{", "{").replace("}}", "}")


def _rank(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'nan'::DOUBLE ELSE row_number() OVER (PARTITION BY conv_id ORDER BY {c} DESC NULLS LAST, turn)::DOUBLE END"


def _found(form: str) -> str:
    a = _f(form, "a")
    return f"CASE WHEN len({a}) > 0 THEN len(list_filter({a}, lambda k: contains(lower(b), lower(k)))) / len({a}) ELSE 'nan'::DOUBLE END"


_M1 = f"""WITH r AS (SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
    p AS (SELECT conv_id, turn, a, prior AS b, CASE WHEN turn % 5 <> 0 THEN (turn * 37 % 100) / 100.0 END AS s, (turn * 13 % 50) / 10.0 AS m, 1.0 / (60 + turn) AS f FROM r WHERE prior IS NOT NULL),
    w AS (SELECT conv_id, turn, side, token, 1 + ln(count(*)) AS tf FROM (SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(lower(a), '[a-z0-9_]{{2,}}')) AS token FROM p UNION ALL SELECT conv_id, turn, 2, unnest(regexp_extract_all(lower(b), '[a-z0-9_]{{2,}}')) FROM p) GROUP BY ALL),
    i AS (SELECT *, tf * (ln(3.0 / (1 + count(*) OVER (PARTITION BY conv_id, turn, token))) + 1) AS x FROM w),
    j AS (SELECT conv_id, turn, token, sum(CASE WHEN side = 1 THEN x ELSE 0 END) AS u, sum(CASE WHEN side = 2 THEN x ELSE 0 END) AS v FROM i GROUP BY ALL),
    c AS (SELECT conv_id, turn, CASE WHEN sum(u * u) > 0 AND sum(v * v) > 0 THEN sum(u * v) / sqrt(sum(u * u) * sum(v * v)) ELSE 0 END AS cosine FROM j GROUP BY ALL)
    SELECT p.conv_id, p.turn, coalesce(s, 'nan'::DOUBLE)::DOUBLE AS embedding_cosine_sim, {_rank('s')} AS embedding_cosine_sim_rank, m::DOUBLE AS bm25_score, {_rank('m')} AS bm25_score_rank,
        round(CASE WHEN trim(a) = '' OR trim(b) = '' THEN 'nan'::DOUBLE ELSE coalesce(cosine, 0) END, 5) AS tfidf_cosine_sim,
        len(list_intersect({_f(_WORDS, 'a')}, {_f(_WORDS, 'b')})) / len(list_distinct(list_concat({_f(_WORDS, 'a')}, {_f(_WORDS, 'b')}))) AS token_jaccard, {_found(_TECH)} AS technical_keyword_overlap_ratio,
        {_found(_NUM)} AS numeric_param_match_ratio, len({_f(_NUM, 'a')})::DOUBLE AS numeric_param_count_requirement, len({_f(_NUM, 'b')})::DOUBLE AS numeric_param_count_standard,
        CASE WHEN len({_f(_UNIT, 'a')}) > 0 THEN len(list_intersect({_f(_UNIT, 'a')}, {_f(_UNIT, 'b')})) / len(list_distinct(list_concat({_f(_UNIT, 'a')}, {_f(_UNIT, 'b')}))) ELSE 'nan'::DOUBLE END AS unit_overlap_ratio,
        round(f, 6)::DOUBLE AS rrf_score, {_rank('f')} AS rrf_rank, {_f(_COUNT, 'a')} / {_f(_COUNT, 'b')} AS requirement_length_ratio
    FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn""".replace("(PARTITION BY conv_id ORDER BY s", "(PARTITION BY p.conv_id ORDER BY s").replace("(PARTITION BY conv_id ORDER BY m", "(PARTITION BY p.conv_id ORDER BY m").replace("(PARTITION BY conv_id ORDER BY f", "(PARTITION BY p.conv_id ORDER BY f").replace("NULLS LAST, turn)", "NULLS LAST, p.turn)")


@query("m1_applicability_features", _M1)
def m1(spark, sf):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumn("before", before).where("before is not null")
    turn = F.col("turn")
    pairs = rows.select("conv_id", "turn", F.col("text").alias("requirement_text"), F.col("before").alias("candidate_text"), F.when(turn % 5 != 0, (turn * 37 % 100) / 100.0).alias("semantic_score"), ((turn * 13 % 50) / 10.0).alias("bm25_score"), (1.0 / (60 + turn)).alias("rrf_score"))
    return M.applicability_features(pairs, ["conv_id"], "turn").withColumn("tfidf_cosine_sim", F.round("tfidf_cosine_sim", 5)).withColumn("rrf_score", F.round("rrf_score", 6))


@query("m8_featurise_pairs")
def m8(spark, sf):
    lines = view(spark, sf, TENDER_LINES).where("pos = 1")
    titles = view(spark, sf, TITLES)
    labelled = lines.join(titles.select("std_id", "title"), "std_id").select(F.col("tender_id").alias("group_id"), F.col("text").alias("requirement_text"), F.col("title").alias("standard_title"), F.col("reference").isNotNull().cast("int").alias("label"))
    score = lambda k: (F.pmod(F.xxhash64("tender_id", "std_id", F.lit(k)), F.lit(1000)) / 1000.0)
    candidates = view(spark, sf, TENDER_LINES).groupBy("tender_id", "std_id").count().select(F.col("tender_id").alias("group_id"), "std_id", score(1).alias("semantic_score"), score(2).alias("bm25_score"), score(3).alias("rrf_score"))
    return M.featurise_pairs(labelled, titles.select("std_id", "title", "scope", F.col("summary").alias("search_text")), candidates)
