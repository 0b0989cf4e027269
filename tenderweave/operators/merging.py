"""Standards with all that the orders on them say, and what met nothing on either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import last_seen

#: What an order says, by its own name; the merged record has each as qco_<name>, but for the scheme.
FIELDS = ("gazette_so_number", "issuing_ministry", "effective_date", "publication_date", "notification_title", "mandate_text", "products_covered", "exemptions", "source_url")
OWN = "certification_requirements"


def merged_records(standards: DataFrame, orders: DataFrame, key: Column, pos: str = "order_pos") -> DataFrame:
    """Every standard once, with qco_<field> of the order on its number, certification_scheme, is_mandatory, qco_notified,
    qco_enriched, unified_sources (a list), schema_version, and the struct certification_requirements.

    `key` is an expression over is_number. Of several orders on a key the last by pos counts, as a whole. Fields that orders
    have no column for are null. certification_requirements (applicable, mandatory, scheme, gazette_so_number,
    issuing_ministry, details) is made from the order; without one, a standard's own (applicable, details) stays, and
    mandatory is false unless it says whether it is applicable. A null number matches nothing.
    """
    have = set(orders.columns)
    wanted = [*FIELDS, "certification_scheme"]
    said = [(F.col(c) if c in have else F.lit(None).cast("string")).alias(f"_{c}") for c in wanted]
    lookup = last_seen(orders.withColumn("_key", key).where("_key IS NOT NULL"), "_key", pos).select("_key", F.lit(True).alias("_hit"), *said)
    joined = standards.withColumn("_key", key).join(lookup, "_key", "left")
    hit = F.coalesce("_hit", F.lit(False))
    details = F.concat(
        F.lit("Mandatory under QCO Gazette Notification "), F.coalesce("_gazette_so_number", F.lit("N/A")), F.lit(" issued by "), F.coalesce("_issuing_ministry", F.lit("Government of India")),
        F.lit(". Effective from "), F.coalesce("_effective_date", F.lit("N/A")), F.lit("."),
    )
    own = OWN in standards.columns
    applicable = F.col(f"{OWN}.applicable") if own else F.lit(None).cast("boolean")
    before = F.col(f"{OWN}.details") if own else F.lit(None).cast("string")
    block = F.struct(
        F.when(hit, True).otherwise(applicable).alias("applicable"), F.when(hit, True).when(applicable.isNull(), False).alias("mandatory"), F.when(hit, F.col("_certification_scheme")).alias("scheme"),
        F.when(hit, F.col("_gazette_so_number")).alias("gazette_so_number"), F.when(hit, F.col("_issuing_ministry")).alias("issuing_ministry"), F.when(hit, details).otherwise(before).alias("details"),
    )
    return joined.select(
        *[c for c in standards.columns if c != OWN], hit.alias("qco_notified"), *[F.col(f"_{c}").alias(f"qco_{c}") for c in FIELDS], F.col("_certification_scheme").alias("certification_scheme"), hit.alias("is_mandatory"), hit.alias("qco_enriched"),
        block.alias(OWN), F.when(hit, F.array(F.lit("BIS"), F.lit("QCO"))).otherwise(F.array(F.lit("BIS"))).alias("unified_sources"), F.lit("unified_v1").alias("schema_version"),
    )


def merge_lists(standards: DataFrame, orders: DataFrame, key: Column, pos: str = "order_pos") -> DataFrame:
    """(kind, is_number): matched and bis_only for each standard, orphaned for each key of orders that no standard has, by the
    number that its last order gives. What merge_report() counts."""
    keyed = orders.withColumn("_key", key).where("_key IS NOT NULL")
    known = standards.select("is_number", key.alias("_key"))
    told = known.join(keyed.select("_key").distinct().withColumn("_hit", F.lit(True)), "_key", "left").select(F.when(F.col("_hit"), "matched").otherwise("bis_only").alias("kind"), "is_number")
    orphans = last_seen(keyed, "_key", pos).join(known.select("_key").distinct(), "_key", "left_anti").select(F.lit("orphaned").alias("kind"), "is_number")
    return told.unionByName(orphans)
