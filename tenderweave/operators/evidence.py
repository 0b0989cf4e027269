"""Evidence of compliance, officers' decisions, report facts, and records matched by what is cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import year_at_end


def compliance_evidence(standards: DataFrame, amendments: DataFrame, orders: DataFrame) -> DataFrame:
    """(std_id, source_type, source_name, authority, amendment, so_number): a row for each of standards (std_id,
    designation), one for each of its amendments (std_id, amendment, so_number), and one for each order (std_id,
    so_number, ministry) that has a gazette number."""
    none = F.lit(None)
    own = standards.select("std_id", F.lit("bis_standard").alias("source_type"), F.concat(F.lit("BIS Standard "), "designation").alias("source_name"), F.lit("BIS").alias("authority"), none.cast("int").alias("amendment"), none.cast("string").alias("so_number"))
    named = standards.select("std_id", "designation")
    changed = amendments.join(named, "std_id").select("std_id", F.lit("bis_amendment"), F.concat("designation", F.lit(" Amendment "), F.col("amendment").cast("string")), F.lit("BIS"), F.col("amendment").cast("int"), "so_number")
    ordered = orders.where(F.coalesce("so_number", F.lit("")) != "").join(named, "std_id", "left_semi")
    ordered = ordered.select("std_id", F.lit("qco_notification"), F.concat(F.lit("QCO Gazette "), "so_number"), F.coalesce("ministry", F.lit("Government of India")), none.cast("int"), "so_number")
    return own.union(changed).union(ordered)


def effective_status(requirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """requirements (req_id, status) with machine_status, decision and the status that the latest decision (req_id,
    decision, ts) leaves: accepted covers, reviewed asks for review, rejected makes missing what is neither
    conflicting nor restrictive. Requirements whose latest decision deletes them go."""
    last = decisions.groupBy("req_id").agg(F.max_by("decision", "ts").alias("decision"))
    both = requirements.join(last, "req_id", "left").where("decision is null or decision <> 'deleted'").withColumnRenamed("status", "machine_status")
    said, machine = F.col("decision"), F.col("machine_status")
    status = F.when(said == "accepted", "covered").when(said == "reviewed", "review").when((said == "rejected") & ~machine.isin("conflicting", "restrictive"), "missing").otherwise(machine)
    return both.withColumn("status", status)


def summary_facts(findings: DataFrame) -> DataFrame:
    """One row for each analysis of findings (analysis_id, req_id, verdict, std_id, applicable, review): requirements,
    issues (any verdict but justified), items for review, distinct applicable standards, and cited ones that are not."""
    per_standard = findings.groupBy("analysis_id", "std_id").agg(F.max("applicable").alias("applicable"))
    standards = per_standard.groupBy("analysis_id").agg(F.count_if("applicable").alias("applicable_standards"), F.count_if(~F.col("applicable") & F.col("std_id").isNotNull()).alias("cited_only_standards"))
    facts = findings.groupBy("analysis_id").agg(F.count_distinct("req_id").alias("requirements"), F.count_if(F.col("verdict") != "justified").alias("issues"), F.count_if("review").alias("review_items"))
    return facts.join(standards, "analysis_id")


def _solid(number: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(number)), r"[\s:]", "")


def _parts(key: Column) -> Column:
    """All substrings of a short key."""
    n = F.length(key)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(key, i, k)))))


def explicit_reference_match(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(reference, std_id) of the first row, by std_id, of catalogue (std_id, is_number) whose number holds the cited
    reference or is held by it, case, spaces and colons apart.

    Instead of a theta join both sides meet on substrings, of which numbers have few. References without
    a match have no row.
    """
    refs = citations.select("reference").distinct().withColumn("key", _solid(F.col("reference"))).where("key <> ''")
    rows = catalogue.groupBy(_solid(F.col("is_number")).alias("number")).agg(F.min("std_id").alias("std_id")).where("number <> ''")
    inside = rows.select("std_id", F.explode(_parts(F.col("number"))).alias("key")).join(refs, "key").select("reference", "std_id")
    around = refs.select("reference", F.explode(_parts(F.col("key"))).alias("number")).join(rows, "number").select("reference", "std_id")
    return inside.union(around).groupBy("reference").agg(F.min("std_id").alias("std_id"))


def enrich_from_raw(records: DataFrame, raw: DataFrame) -> DataFrame:
    """records (key, edition_year, record_year, latest_year, status, verification) completed: the year at the end of the
    raw record's latest_version (key, latest_version) where the latest year is unknown or only the record's own;
    record_year from the edition; an active record that nobody verified is verified in part."""
    found = records.join(raw.groupBy("key").agg(F.min("latest_version").alias("latest_version")), "key", "left")
    year = year_at_end(F.col("latest_version"))
    latest = F.when(year.isNotNull() & (F.col("latest_year").isNull() | (F.col("latest_year") == F.col("record_year"))), year).otherwise(F.col("latest_year"))
    verification = F.when((F.coalesce("verification", F.lit("not_verified")) == "not_verified") & F.contains("status", F.lit("Active")), "partial").otherwise(F.coalesce("verification", F.lit("not_verified")))
    return found.select(*[c for c in records.columns if c not in ("record_year", "latest_year", "verification")], F.coalesce("record_year", "edition_year").alias("record_year"), latest.alias("latest_year"), verification.alias("verification"))
