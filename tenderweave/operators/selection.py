"""Ranking, selection and guardrails over (query, candidate) rows, and the joins that assemble their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the six signals, and the boost of a cited standard.
SIGNALS = {"semantic": 0.40, "lexical": 0.15, "product": 0.20, "application": 0.10, "technical": 0.10, "metadata": 0.05}
CITED_BOOST = 0.3
#: Orders in a block, and groups of profiles over which a class of orders is dealt out.
BLOCK, DEALT = 4096, 64


def _solid(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[ :]", "")


def rank_results(rows: DataFrame) -> DataFrame:
    """rows with relevance, confidence, rank (by relevance, then pos) and cited.

    rows has query_id, pos, is_number, title, search_text, semantic_score, bm25_score, product,
    application, domain, params (array), refs (array), verified. Empty parameters count as matched, as
    an empty string is part of every text; without parameters nothing is taken off.
    """
    text = F.lower(F.concat_ws(" ", "search_text", "title"))
    has = lambda term: (F.coalesce(term, F.lit("")) != "") & F.contains(text, F.lower(term))
    partly = F.exists(F.filter(F.split(F.lower(F.coalesce("product", F.lit(""))), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.contains(text, w))
    n_params = F.size("params")
    matched = F.size(F.filter("params", lambda p: F.contains(text, F.lower(p))))
    number = _solid(F.col("is_number"))
    cited = F.exists("refs", lambda r: F.contains(number, _solid(r)) | F.contains(_solid(r), number))
    lexical = F.when(F.col("bm25_score") > 0, F.least(F.col("bm25_score") / 20.0, F.lit(1.0))).otherwise(0.0)
    score = (
        SIGNALS["semantic"] * F.col("semantic_score")
        + SIGNALS["lexical"] * lexical
        + SIGNALS["product"] * F.when(has(F.col("product")), 1.0).when(partly, 0.6).otherwise(0.0)
        + SIGNALS["application"] * F.when(has(F.col("application")), 1.0).when(has(F.col("domain")), 0.7).otherwise(0.0)
        + SIGNALS["technical"] * F.when(n_params > 0, matched / n_params).otherwise(1.0)
        + SIGNALS["metadata"] * F.when(F.col("verified"), 1.0).otherwise(0.5)
    )
    out = rows.withColumn("cited", cited).withColumn("_raw", score)
    out = out.withColumn("_raw", F.least(F.lit(1.0), F.col("_raw") + F.when(F.col("cited"), CITED_BOOST).otherwise(0.0)))
    out = out.withColumn("relevance", F.round("_raw", 4)).withColumn("confidence", F.when(F.col("_raw") > 0.72, "high").when(F.col("_raw") > 0.45, "medium").otherwise("low")).drop("_raw")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "pos")))


def score_rank(rows: DataFrame, score: str, name: str) -> DataFrame:
    """rows with the 1-based rank of the first row of the same number by score; null scores have none."""
    order = F.when(F.col(score).isNotNull(), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), "pos")))
    first = F.min("_r").over(Window.partitionBy("query_id", "number"))
    return rows.withColumn("_r", order).withColumn(name, F.when(F.col("_r").isNotNull(), first)).drop("_r")


def top_k_keep_cited(ranked: DataFrame, k: int) -> DataFrame:
    """The first k of each query by rank, but cited ones first: fillers give way; the old order is kept and numbered anew."""
    seat = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("cited")), "rank"))
    kept = ranked.withColumn("_s", seat).where(F.col("_s") <= k).drop("_s")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def reasoner_select(rows: DataFrame, least: float = 0.3, n: int = 5) -> DataFrame:
    """(query_id, verdict, confidence, n_selected, best): justified by the best of at most n with a score of
    `least` or more, else for human review with the best score, 0.1 at least."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    top = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    got = top.groupBy("query_id").agg(F.count_if(F.col("score") >= least).alias("n_selected"), F.max("score").alias("best_score"), F.min_by("std_id", "_r").alias("_best"))
    ok = F.col("n_selected") > 0
    return got.select("query_id", F.when(ok, "justified").otherwise("requires_human_verification").alias("verdict"), F.when(ok, F.col("best_score")).otherwise(F.greatest(F.lit(0.1), "best_score")).alias("confidence"), "n_selected", F.when(ok, F.col("_best")).alias("best"))


def pool_candidates(rows: DataFrame, group: str, cap: int = 35) -> DataFrame:
    """The best score of each standard in a group, citations first and at 1, at most cap of them, in order."""
    best = rows.groupBy(group, "std_id").agg(F.bool_or("cited").alias("cited"), F.max("score").alias("score"), F.count("*").alias("n_requirements"))
    best = best.withColumn("score", F.when(F.col("cited"), 1.0).otherwise(F.col("score")))
    order = Window.partitionBy(group).orderBy(F.desc("cited"), F.desc("score"), "std_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def guardrail(proposed: DataFrame, candidates: DataFrame, standards: DataFrame) -> DataFrame:
    """proposed (req_id, std_id, pos), the first of each pair, with outcome: accepted if retrieved for the
    requirement and known, else unknown, other_requirement or not_retrieved."""
    first = proposed.groupBy("req_id", "std_id").agg(F.min("pos").alias("pos"))
    own = candidates.select("req_id", "std_id").distinct().withColumn("_own", F.lit(True))
    any_ = candidates.select("std_id").distinct().withColumn("_any", F.lit(True))
    known = standards.select("std_id").distinct().withColumn("_known", F.lit(True))
    joined = first.join(own, ["req_id", "std_id"], "left").join(any_, "std_id", "left").join(known, "std_id", "left")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_own"), "accepted").when(F.col("_any"), "other_requirement").otherwise("not_retrieved")
    return joined.select("req_id", "std_id", "pos", outcome.alias("outcome"))


def order_applicability(profiles: DataFrame, numbers: DataFrame, orders: DataFrame, phrases: DataFrame) -> DataFrame:
    """(profile_id, order_id, reasons, confidence): orders whose number is cited, or one of whose product
    phrases has all its tokens in the profile; 1.0 for both, 0.95 for the number alone, 0.65 for a phrase.

    profiles (profile_id, token), numbers (profile_id, key), orders (order_id, key), phrases (order_id,
    phrase, token). Relational division: a phrase fits if as many of its tokens meet as it has. Every order of a phrase
    that fits is a pair, so pairs are many; orders of the same phrases are one class that a profile meets once,
    and its orders follow in blocks at the very end, in front of which no pair is shuffled.
    """
    by_number = numbers.distinct().join(orders, "key").select("profile_id", "order_id").distinct()
    token_sets = phrases.distinct().groupBy("order_id", "phrase").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.count("*").alias("need")).where(F.size("tokens") == F.col("need"))
    classes = token_sets.groupBy("order_id").agg(F.array_sort(F.collect_set("tokens")).alias("class"))
    wanted = token_sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    fit = wanted.join(profiles.distinct(), "token").groupBy("profile_id", "tokens").agg(F.count("*").alias("met")).where(F.col("met") == F.size("tokens"))
    kinds = classes.select("class").distinct().select("class", F.explode("class").alias("tokens"))
    held = fit.join(kinds, "tokens").select("profile_id", "class").distinct()

    numbered = by_number.join(classes, "order_id", "left").join(held.withColumn("_p", F.lit(True)), ["profile_id", "class"], "left")
    cited = numbered.where("_p").groupBy("profile_id", "class").agg(F.collect_list("order_id").alias("cited"))
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    listed = classes.join(sizes, "class").groupBy("class", F.pmod(F.xxhash64("order_id"), "blocks").alias("block")).agg(F.collect_list("order_id").alias("orders"))
    # classes are few and large: each is dealt out over DEALT groups of profiles
    listed = listed.select("class", "orders", F.explode(F.array(*map(F.lit, range(DEALT)))).alias("part"))
    dealt = held.join(cited, ["profile_id", "class"], "left").withColumn("part", F.pmod(F.xxhash64("profile_id"), F.lit(DEALT)).cast("int"))
    rest = F.when(F.col("cited").isNull(), F.col("orders")).otherwise(F.array_except("orders", "cited"))
    by_phrase = dealt.join(listed, ["class", "part"]).select("profile_id", F.explode(rest).alias("order_id"), F.lit("phrase").alias("reasons"), F.lit(0.65).alias("confidence"))
    by_number = numbered.select("profile_id", "order_id", F.when(F.col("_p"), "number+phrase").otherwise("number").alias("reasons"), F.when(F.col("_p"), 1.0).otherwise(0.95).alias("confidence"))
    return by_number.unionByName(by_phrase)


def attach_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows (url, ...) with the number of evidence rows of the same trimmed URL and the least id; null meets nothing."""
    found = evidence.where("url is not null").groupBy(F.trim("url").alias("_u")).agg(F.count("*").alias("n_evidence"), F.min("evidence_id").alias("first_evidence"))
    return rows.join(found, F.trim(rows["url"]) == F.col("_u"), "left").drop("_u").fillna({"n_evidence": 0})


def compare_rows(rows: DataFrame, pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(a, b, field, outcome): same, different, only_a, only_b or neither, field by field."""
    cells = rows.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "value"))
    left = pairs.join(cells.select(F.col(key).alias("a"), "field", F.col("value").alias("va")), "a")
    both = left.join(cells.select(F.col(key).alias("b"), "field", F.col("value").alias("vb")), ["b", "field"])
    outcome = F.when(F.col("va").isNull() & F.col("vb").isNull(), "neither").when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").when(F.col("va") == F.col("vb"), "same").otherwise("different")
    return both.select("a", "b", "field", outcome.alias("outcome"))


def edges_both_ways(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) over distinct edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))


def top_rollup(rows: DataFrame, n: int, refs: str) -> DataFrame:
    """(query_id, refs): sorted distinct references of the first n results of each query."""
    first = rows.where(F.col("rank") <= n).select("query_id", F.explode(refs).alias("ref"))
    return first.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), "|").alias("refs"))


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings without deleted ones, with the latest decision (by ts, seq): rejected keeps conflicting and
    restrictive states and makes others missing, accepted makes them covered, none changes nothing."""
    latest = decisions.groupBy("finding_id").agg(F.max_by("decision", F.struct("ts", "seq")).alias("decision"))
    joined = findings.join(latest, "finding_id", "left").where("coalesce(decision, '') <> 'deleted'")
    effective = F.when((F.col("decision") == "rejected") & ~F.col("status").isin("conflicting", "restrictive"), "missing").when(F.col("decision") == "accepted", "covered").otherwise(F.col("status"))
    return joined.withColumn("effective", effective)


def sample_families(families: DataFrame, n: int = 50, always: int = 25) -> DataFrame:
    """(family, size, ...) kept: by size, all until `always` rows are in, then those with a priority topic, until n rows are in."""
    order = Window.orderBy(F.desc("size"), "family").rowsBetween(Window.unboundedPreceding, -1)
    first = families.withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    eligible = first.where((F.col("_before") < always) | F.col("topic"))
    return eligible.withColumn("_sofar", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("_sofar") < n).drop("_before", "_sofar")


def follow_superseding(rows: DataFrame) -> DataFrame:
    """(number, final): one step along superseded_by, where the row it names is there."""
    newer = rows.select(F.col("number").alias("superseded_by"), F.lit(True).alias("_there")).distinct()
    return rows.join(newer, "superseded_by", "left").select("number", F.when(F.col("_there"), F.col("superseded_by")).otherwise(F.col("number")).alias("final"))


def catalogue_sync(state: DataFrame, updates: DataFrame) -> DataFrame:
    """state (number, year, title, status, superseded_by) after updates: for a known (number, year) only the
    status, and superseded_by where given, change; others are added. Repeats within a batch: the last by pos."""
    newest = updates.withColumn("_n", F.row_number().over(Window.partitionBy("number", "year").orderBy(F.desc("pos")))).where("_n = 1")
    u = newest.select("number", "year", F.col("title").alias("_t"), F.col("status").alias("_s"), F.col("superseded_by").alias("_b"))
    joined = state.join(u, ["number", "year"], "full_outer")
    change = F.when(F.col("title").isNull(), "inserted").when(F.col("_s").isNull(), "kept").when((F.col("_s") != F.col("status")) | ~F.coalesce(F.col("_b"), "superseded_by").eqNullSafe(F.col("superseded_by")), "updated").otherwise("unchanged")
    return joined.select("number", "year", F.coalesce("title", "_t").alias("title"), F.coalesce("_s", "status").alias("status"), F.coalesce("_b", "superseded_by").alias("superseded_by"), change.alias("change"))


def applicability_rerank(rows: DataFrame) -> DataFrame:
    """rows ranked anew by ml_score (0 where there is none), then relevance, then pos."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("ml_score", F.lit(0.0))), F.desc("relevance"), "pos")
    return rows.withColumn("rank", F.row_number().over(order))
