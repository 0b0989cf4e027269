"""Catalogue building: de-duplication, order merging, reconciliation, upserts and their reports.

Order in the inputs is an explicit column, so every "first" and "last" is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """The first row of each key by pos (null keys are a key of their own)."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("_n = 1").drop("_n")


def last_seen(df: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """The last row of each key by pos."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pos)))).where("_n = 1").drop("_n")


def merge_orders(standards: DataFrame, orders: DataFrame, key: Column, pos: str = "order_pos") -> DataFrame:
    """Every standard with the order for its number, if there is one; of several orders the last wins.

    `key` is the key expression over column is_number; orders have is_number, gazette_so_number,
    issuing_ministry, effective_date and certification_scheme.
    """
    wanted = ["gazette_so_number", "issuing_ministry", "effective_date", "certification_scheme"]
    lookup = last_seen(orders.withColumn("_key", key), "_key", pos).select("_key", *[F.col(c).alias(f"_{c}") for c in wanted])
    joined = standards.withColumn("_key", key).join(lookup.withColumn("_hit", F.lit(True)), "_key", "left")
    hit = F.coalesce("_hit", F.lit(False))
    details = F.concat(
        F.lit("Mandatory under QCO Gazette Notification "), F.coalesce("_gazette_so_number", F.lit("N/A")), F.lit(" issued by "), F.coalesce("_issuing_ministry", F.lit("Government of India")),
        F.lit(". Effective from "), F.coalesce("_effective_date", F.lit("N/A")), F.lit("."),
    )
    return joined.select(
        *standards.columns, hit.alias("qco_notified"), F.col("_gazette_so_number").alias("qco_gazette_so_number"), F.col("_issuing_ministry").alias("qco_issuing_ministry"), F.col("_effective_date").alias("qco_effective_date"),
        F.col("_certification_scheme").alias("certification_scheme"), hit.alias("is_mandatory"), F.when(hit, details).alias("certification_details"), F.when(hit, "BIS,QCO").otherwise("BIS").alias("unified_sources"), F.lit("unified_v1").alias("schema_version"),
    )


def unmatched(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Rows of left whose key no row of right has."""
    return left.withColumn("_key", key).join(right.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def merge_report(standards: DataFrame, orders: DataFrame, key: Column) -> DataFrame:
    """One row: totals, matched, standards without an order, orders without a standard, match rate in percent."""
    keys = orders.select(key.alias("_key")).distinct()
    known = standards.select(key.alias("_key"))
    matched = known.join(keys.withColumn("_hit", F.lit(1)), "_key", "left").agg(F.count("*").alias("total_standards"), F.count("_hit").alias("matched"))
    orphans = keys.join(known.distinct(), "_key", "left_anti").agg(F.count("*").alias("orphaned_orders"))
    rate = F.when(F.col("total_standards") > 0, F.round(100 * F.col("matched") / F.col("total_standards"), 1)).otherwise(0.0)
    one = matched.crossJoin(orphans).crossJoin(orders.agg(F.count("*").alias("total_orders")))  # one row each
    return one.select("total_standards", "total_orders", "matched", (F.col("total_standards") - F.col("matched")).alias("standards_only"), "orphaned_orders", rate.alias("match_rate_pct"))


def reconcile(base: DataFrame, curated: DataFrame, priced: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """One row for each key of base (the first); blocks scope and status from curated where it has them,
    else from base if their source is official; price and validity from priced."""
    first = first_seen(base.withColumn("_key", key), "_key", pos)
    over = first_seen(curated.withColumn("_key", key), "_key", pos).select("_key", F.col("scope").alias("_scope"), F.col("status").alias("_status"))
    price = first_seen(priced.withColumn("_key", key), "_key", pos).select("_key", F.col("price").alias("_price"), F.col("valid_upto").alias("_upto"))
    official = F.col("scope_source").isin("official", "curated")
    out = first.join(over, "_key", "left").join(price, "_key", "left")
    scope = F.coalesce("_scope", F.when(official, F.col("scope")))
    state = F.when(F.col("_scope").isNotNull(), "verified").when(official & F.col("scope").isNotNull(), "verified").otherwise("not_available")
    return out.select("is_number", "title", scope.alias("scope"), F.coalesce("_status", "status").alias("status"), F.col("_price").alias("price"), F.col("_upto").alias("valid_upto"), state.alias("scope_availability"))


def curated_merge(base: DataFrame, curated: DataFrame, key: Column) -> DataFrame:
    """Rows of both; where both have a key, curated title and year win if they are given."""
    a = base.select(key.alias("_key"), F.col("is_number").alias("a_number"), F.col("title").alias("a_title"), F.col("year").alias("a_year"))
    b = curated.select(key.alias("_key"), F.col("is_number").alias("b_number"), F.col("title").alias("b_title"), F.col("year").alias("b_year"))
    return a.join(b, "_key", "full_outer").select(
        F.coalesce("a_number", "b_number").alias("is_number"), F.coalesce(F.nullif("b_title", F.lit("")), "a_title").alias("title"), F.coalesce("b_year", "a_year").alias("year"),
        F.when(F.col("a_number").isNull(), "added").when(F.col("b_number").isNull(), "kept").otherwise("updated").alias("change"),
    )


def link_versions(df: DataFrame, number: str, year: str, designation: str) -> DataFrame:
    """Latest year and its designation on every row of a number with several rows; null on single ones."""
    w = Window.partitionBy(number)
    several = F.count("*").over(w) > 1
    newest = F.max_by(F.struct(F.col(year).alias("y"), F.col(designation).alias("d")), F.struct(F.coalesce(year, F.lit(0)), designation)).over(w)
    return df.withColumn("latest_year", F.when(several, newest["y"])).withColumn("latest_designation", F.when(several, newest["d"]))


def upsert_rows(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of target, those of a key in updates replaced by the row there (the last by version)."""
    every = target.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc("_side"), F.desc("version"))
    return every.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_side")


def insert_strict(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with rows; a key that is there already, or twice in rows, is an error."""
    twice = rows.groupBy(key).count().where("count > 1").select(key).union(rows.join(target, key, "left_semi").select(key))
    if found := twice.take(3):
        raise ValueError(f"duplicate {key}: {[r[0] for r in found]}")
    return target.unionByName(rows)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def missing_from(catalogue: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return catalogue.join(index.select(key).distinct(), key, "left_anti")


def list_page(df: DataFrame, number: str, year: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(number, F.coalesce(year, F.lit(0))).offset(offset).limit(limit)


def cleaning_report(df: DataFrame) -> DataFrame:
    """One row: rows, filled fields, and numbers that occur more than once."""
    families = df.groupBy("is_number").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_families"))
    filled = df.agg(F.count("*").alias("total"), F.count_if(F.col("title") != "").alias("with_title"), F.count("valid_upto").alias("with_validity"), F.count("year").alias("with_year"), F.count_if(F.col("status") == "unknown").alias("status_unknown"))
    return filled.crossJoin(families)  # one row each


def availability_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, state, n) in one scan: available where the field is not null."""
    states = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), "available").otherwise("not_available").alias("state")) for f in fields]))
    return df.select(states.alias("s")).groupBy("s.field", "s.state").agg(F.count("*").alias("n"))


def normalize_amendments(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, number, year, description, pos): distinct by number, year and description, the last wins."""
    keep = last_seen(df.where("number is not null"), [key, "number", "year", "description"], "pos")
    order = F.array_sort(F.collect_list(F.struct("number", F.coalesce("year", F.lit(0)).alias("year"), "description")))
    return keep.groupBy(key).agg(F.count("*").alias("n_amendments"), F.array_join(F.transform(order, lambda a: F.concat_ws("/", a["number"].cast("string"), a["year"].cast("string"))), ",").alias("amendments"))


def latest_edition(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """For each wanted family the exact designation, else the newest published of its editions.

    Rows of one designation are one edition, published when the last of them was, before any is met.
    """
    editions = catalogue.groupBy("family", "designation").agg(F.max("published").alias("published"))
    joined = wanted.join(editions, "family")
    order = Window.partitionBy("wanted").orderBy(F.desc(F.col("designation") == F.col("wanted")), F.desc_nulls_last("published"), "designation")
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("wanted", "designation", "published")


def resolve_citations(citations: DataFrame, catalogue: DataFrame, exact: Column, family: Column) -> DataFrame:
    """(cite_id, std_id, how): by exact key, and only for citations without an exact match by family key."""
    left = citations.select("cite_id", exact.alias("_exact"), family.alias("_family"))
    right = catalogue.select("std_id", exact.alias("_exact"), family.alias("_family"))
    found = left.join(right.select("std_id", "_exact"), "_exact").select("cite_id", "std_id", F.lit("exact").alias("how"))
    rest = left.join(found.select("cite_id").distinct(), "cite_id", "left_anti")
    return found.unionByName(rest.join(right.select("std_id", "_family"), "_family").select("cite_id", "std_id", F.lit("family").alias("how")))
