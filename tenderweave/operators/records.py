"""Source payloads as rows of standards and evidence, and small fills over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import labels_of

NOT_STATED = "Not stated"
UNKNOWN = ("", "unknown", "n/a", "none", "not stated")


def draft_records(rows: DataFrame) -> DataFrame:
    """Titles begin with DRAFT, status under_revision, confidence 0.85."""
    title = F.when(F.upper("title").startswith("DRAFT "), F.col("title")).otherwise(F.concat(F.lit("DRAFT "), "title"))
    return rows.select("std_id", title.alias("title"), F.lit("under_revision").alias("status"), F.lit(0.85).alias("confidence"))


def tender_records(rows: DataFrame) -> DataFrame:
    """(tender_id, clause, confidence): the tender itself as clause 0 and a row for each clause; 0.8 without an id."""
    sure = F.when(F.col("without_id"), 0.8).otherwise(1.0)
    own = rows.select("tender_id", F.lit(0).alias("clause"), sure.alias("confidence"))
    return own.unionByName(rows.select("tender_id", F.posexplode("clauses").alias("clause", "text"), sure.alias("confidence")).select("tender_id", (F.col("clause") + 1).alias("clause"), "confidence"))


def route_documents(rows: DataFrame, parsers: list[tuple[str, Column]]) -> DataFrame:
    """rows with route: the named adapter, else the first parser whose predicate holds, else generic."""
    route = F.when(F.col("adapter").isNotNull(), F.col("adapter"))
    for name, holds in parsers:
        route = route.when(holds, name)
    return rows.withColumn("route", route.otherwise("generic"))


def top_labels(text: Column, rules: list[tuple[str, list[str]]], n: int, default: str) -> Column:
    """The first n labels in the order of the rules, or the default alone."""
    found = F.slice(F.array_distinct(labels_of(text, rules)), 1, n)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def infer_references(own: Column, key: Column, lookup: dict[str, list[str]]) -> Column:
    """The row's references, or where it has none those of its key in the lookup."""
    table = F.create_map(*[x for k, v in lookup.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(table[key], F.expr("cast(array() as array<string>)")))


def fill_not_stated(stated: Column, context: Column) -> tuple[Column, Column]:
    """(value, filled): the context's value only where the document says nothing and the context knows something."""
    knows = ~F.lower(F.trim(F.coalesce(context, F.lit("")))).isin(*UNKNOWN)
    fill = stated.startswith(NOT_STATED) & knows  # also the profile's longer form
    return F.when(fill, context).otherwise(stated), fill


def material_vocabulary(rows: DataFrame) -> DataFrame:
    """(attribute, alias, material, n_designations): aliases of one material only; withdrawn rows don't count as coverage."""
    grouped = rows.groupBy("attribute", "alias").agg(F.count_distinct("material").alias("_kinds"), F.min("material").alias("material"), F.count_distinct(F.when(~F.col("withdrawn"), F.col("designation"))).alias("n_designations"))
    return grouped.where("_kinds = 1").drop("_kinds")


def summary_names(summary: Column, given: Column) -> tuple[Column, Column]:
    """(whether the text names only what was given, how many different numbers it names)."""
    named = F.array_distinct(F.regexp_extract_all(summary, F.lit(r"\bIS \d+"), 0))
    return F.size(F.array_except(named, given)) == 0, F.size(named).cast("long")


def excerpt_choice(candidates: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """(group, std_id, pos, score, excerpt): the distinct standards of candidates (group, pos, std_id, own_score, score,
    own_excerpt, scope), each at its first place.

    The excerpt is the standard's own, else those of its evidence (group, std_id, pos, excerpt) in their order with
    rules between, else its scope, else null; blanks count for nothing. The score is the standard's own, else
    that of the retrieval.
    """
    first = candidates.groupBy(group, "std_id").agg(F.min_by(F.struct("pos", "own_score", "score", "own_excerpt", "scope"), "pos").alias("c"))
    texts = evidence.withColumn("excerpt", F.trim("excerpt")).where("excerpt <> ''").groupBy(group, "std_id")
    said = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "excerpt"))), lambda x: x["excerpt"]), "\n---\n").alias("said"))
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return first.join(said, [group, "std_id"], "left").select(group, "std_id", "c.pos", F.coalesce("c.own_score", "c.score").alias("score"), F.coalesce(given("c.own_excerpt"), "said", given("c.scope")).alias("excerpt"))


def sync_snapshot(asked: DataFrame, results: DataFrame, running: DataFrame) -> DataFrame:
    """(analysis_id, bucket, last_synced_at, total_synced, error_count, changed_count, in_progress, planned) for each of asked
    (analysis_id).

    results (analysis_id, number, synced_at, seq, changed, n_errors) are what syncs found; a null analysis_id is the bucket
    that all share. Of several results of a number in a bucket the last by (synced_at, seq) counts. An analysis without
    results of its own shows the shared ones (bucket `shared`), or nothing (`none`). last_synced_at is that of the
    last result without errors. running (analysis_id, planned) are the syncs that go on now.
    """
    newest = Window.partitionBy("analysis_id", "number").orderBy(F.desc("synced_at"), F.desc("seq"))
    last = results.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    sums = [
        F.max(F.when(F.col("n_errors") == 0, F.col("synced_at"))).alias("last_synced_at"), F.count("*").alias("total_synced"), F.count_if(F.col("n_errors") > 0).alias("error_count"), F.count_if("changed").alias("changed_count"),
    ]
    own = last.where("analysis_id IS NOT NULL").groupBy("analysis_id").agg(F.lit("own").alias("bucket"), *sums)
    shared = last.where("analysis_id IS NULL").agg(*sums).where("total_synced > 0")  # one row at most
    names = ["last_synced_at", "total_synced", "error_count", "changed_count"]
    both = asked.select("analysis_id").distinct().join(own, "analysis_id", "left").join(F.broadcast(shared.select(*[F.col(c).alias(f"_{c}") for c in names])), F.lit(True), "left")
    lacks = F.col("bucket").isNull()
    shown = both.select(
        "analysis_id", F.when(~lacks, "own").when(F.col("_total_synced").isNotNull(), "shared").otherwise("none").alias("bucket"), F.when(lacks, F.col("_last_synced_at")).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        *[F.coalesce(F.when(lacks, F.col(f"_{c}")).otherwise(F.col(c)), F.lit(0)).alias(c) for c in names[1:]],
    )
    now = running.groupBy("analysis_id").agg(F.max("planned").alias("planned"), F.lit(True).alias("_on"))
    return shown.join(now, "analysis_id", "left").select("analysis_id", "bucket", *names, F.coalesce("_on", F.lit(False)).alias("in_progress"), "planned")
