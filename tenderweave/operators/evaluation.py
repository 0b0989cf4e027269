"""How well stages of retrieval find what was expected, in three ways of comparing numbers, and where it is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("either_way", "exact", "contained")


def spaced(number: Column) -> Column:
    """Lower case, blanks and colons as one blank."""
    return F.trim(F.regexp_replace(F.lower(number), r"[\s:]+", " "))


def squeezed(number: Column) -> Column:
    """Lower case without blanks and colons."""
    return F.translate(F.lower(number), " :", "")


def matches(mode: str, found: Column, expected: Column) -> Column:
    """Whether a found number is the expected one. exact: equal when squeezed; contained: one holds the other when squeezed;
    either_way: one holds the other when spaced. An empty or null number matches nothing."""
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    form = spaced if mode == "either_way" else squeezed
    return _same(mode, form(found), form(expected))


def _same(mode: str, a: Column, b: Column) -> Column:
    same = a == b if mode == "exact" else F.contains(a, b) | F.contains(b, a)
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def match_modes(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(mode, stage, n_queries, recall_at_k..., mrr) of hits (stage, query_id, rank, number) against gold (query_id, expected).

    A query counts in every stage, also where the stage has no hit for it. A query with several expected numbers is
    found with the first of them. Hits meet the expected numbers of their own query only, by an equi-join, and are
    read once for all modes; expected numbers are spelled before they are met.
    """
    wanted = gold.select("query_id", spaced(F.col("expected")).alias("_spaced"), squeezed(F.col("expected")).alias("_squeezed"))
    told = hits.join(wanted, "query_id", "left").withColumns({"_a": spaced(F.col("number")), "_b": squeezed(F.col("number"))})
    near = lambda m: _same(m, *((F.col("_a"), F.col("_spaced")) if m == "either_way" else (F.col("_b"), F.col("_squeezed"))))
    best = told.groupBy("query_id", "stage").agg(*[F.min(F.when(near(m), F.col("rank"))).alias(m) for m in MODES])
    found = best.groupBy("stage").agg(*[F.struct(*[F.count_if(F.col(m) <= k).alias(f"_{k}") for k in ks], F.sum(1 / F.col(m)).alias("_rr")).alias(m) for m in MODES])
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), f"{m}.*") for m in MODES])).alias("w")
    every = found.select("stage", modes).select("stage", "w.*").crossJoin(gold.agg(F.count_distinct("query_id").alias("n_queries")))  # one row
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n_queries"), 4)
    return every.select("mode", "stage", "n_queries", *[share(f"_{k}").alias(f"recall_at_{k}") for k in ks], share("_rr").alias("mrr"))


def stage_losses(hits: DataFrame, gold: DataFrame, mode: str = "either_way", k: int = 5) -> DataFrame:
    """(query_id, lexical, vector, fused, ranked, lost_at, carried_by) of each query of gold, for hits of the stages of these
    names: whether the stage has the expected number among its first k, where it was lost, and who found it.

    lost_at: none (the ranking has it), ranking (the fusion had it), fusion (one of the retrievers had it), retrieval
    (none had it). carried_by: both, lexical, vector, or null.
    """
    names = ("lexical", "vector", "fused", "ranked")
    got = hits.where(F.col("rank") <= k).join(gold, "query_id").where(matches(mode, F.col("number"), F.col("expected")))
    flags = got.groupBy("query_id").agg(*[F.max((F.col("stage") == n).cast("int")).alias(n) for n in names])
    every = gold.select("query_id").distinct().join(flags, "query_id", "left")
    every = every.select("query_id", *[(F.coalesce(n, F.lit(0)) == 1).alias(n) for n in names])
    lost = F.when(F.col("ranked"), "none").when(F.col("fused"), "ranking").when(F.col("lexical") | F.col("vector"), "fusion").otherwise("retrieval")
    carried = F.when(F.col("lexical") & F.col("vector"), "both").when(F.col("lexical"), "lexical").when(F.col("vector"), "vector")
    return every.withColumns({"lost_at": lost, "carried_by": carried})


def stage_diagnosis(losses: DataFrame) -> DataFrame:
    """One row over stage_losses: n_queries, the share of queries that each stage has, how many were lost at each, and the
    finding: ranker_buries_hits, vector_is_weak, lexical_is_weak, fusion_loses_hits, nothing_matches, or healthy."""
    names = ("lexical", "vector", "fused", "ranked")
    total = losses.agg(
        F.count("*").alias("n_queries"), *[F.round(100 * F.avg(F.col(n).cast("int")), 2).alias(n) for n in names],
        *[F.count_if(F.col("lost_at") == at).alias(f"lost_at_{at}") for at in ("ranking", "fusion", "retrieval")],
    )
    lexical, vector, fused, ranked = (F.col(n) for n in names)
    finding = F.when((fused > 0) & (ranked == 0), "ranker_buries_hits").when((vector == 0) & (lexical > 30), "vector_is_weak").when((lexical == 0) & (vector > 30), "lexical_is_weak")
    finding = finding.when((fused == 0) & ((lexical > 0) | (vector > 0)), "fusion_loses_hits").when((fused == 0) & (lexical == 0) & (vector == 0), "nothing_matches")
    return total.withColumn("finding", finding.otherwise("healthy"))
