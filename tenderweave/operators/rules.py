"""Deterministic rules over joined (requirement, standard) pairs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMES = {"isi_mark": "BIS ISI mark (CM/L license number required in bid)", "crs": "BIS CRS registration (R-number required in bid)", "hallmarking": "BIS Hallmarking (HUID required)"}

#: Most severe first; ties by position.
SEVERITY = (
    "incorrect_standard", "outdated_reference", "wrong_scope", "conflicting", "missing_requirement", "unsupported", "requires_human_verification", "unable_to_determine", "ambiguous", "over_restrictive", "partially_justified", "justified",
)


def version_check(cited: Column, current: Column) -> tuple[Column, Column, Column]:
    """(outcome, gap in years, whether current) of a cited edition."""
    gap = current - cited
    outcome = F.when(cited.isNull(), "year_omitted").when(current.isNull(), "year_unknown").when(gap == 0, "equal").when(gap > 0, "behind").otherwise("ahead")
    return outcome, gap, outcome.isin("year_omitted", "equal")


def within_transition(status: Column, deadline: Column, today: Column) -> Column:
    return F.coalesce((status == "superseded") & (today <= deadline), F.lit(False))


def usable(status: Column, deadline: Column, today: Column) -> Column:
    """Withdrawn never, superseded in its transition only, all others always."""
    return F.when(status == "withdrawn", False).when(status == "superseded", within_transition(status, deadline, today)).otherwise(True)


def days_left(deadline: Column, today: Column) -> Column:
    return F.when(today <= deadline, F.datediff(deadline, today))


def order_check(notified: Column, scheme: Column) -> Column:
    """What a bid needs: null without an order."""
    names = F.coalesce(*[F.when(scheme == k, v) for k, v in SCHEMES.items()], F.lit("BIS certification (scheme unspecified)"))
    return F.when(notified, names)


def suggested_verdict(status: Column, deadline: Column, today: Column, mismatch: Column, cited: Column, current: Column) -> tuple[Column, Column]:
    """(verdict, confidence): the first rule that applies."""
    gap, inside = current - cited, within_transition(status, deadline, today)
    rules = [
        (status == "withdrawn", "incorrect_standard", 0.95),
        (mismatch, "wrong_scope", 0.80),
        ((status == "superseded") & deadline.isNotNull() & ~inside, "outdated_reference", 0.95),
        ((status == "superseded") & inside, "outdated_reference", 0.75),
        (status == "superseded", "outdated_reference", 0.85),
        (gap > 5, "outdated_reference", 0.80),
        (gap > 0, "outdated_reference", 0.70),
        (gap < 0, "requires_human_verification", 0.55),
        (cited.isNotNull() & current.isNull(), "unable_to_determine", 0.45),
        (status == "under_revision", "requires_human_verification", 0.65),
        (cited.isNull(), "ambiguous", 0.60),
        (status == "unknown", "unable_to_determine", 0.50),
    ]
    verdict = confidence = F
    for when, name, sure in rules:
        verdict, confidence = verdict.when(when, name), confidence.when(when, sure)
    return verdict.otherwise("justified"), confidence.otherwise(0.85)


def currentness(status: Column, superseded_by: Column, cited: Column, latest: Column, n_amendments: Column, verified: Column) -> tuple[Column, Column]:
    """(verdict, confidence) of a catalogue record against a cited year (null: only the record itself)."""
    sure = F.when(verified, 0.9).otherwise(0.6)
    unknown = ~verified & latest.isNull()
    verdict = (
        F.when(status.isin("withdrawn", "cancelled"), "WITHDRAWN")
        .when(F.coalesce(superseded_by, F.lit("")) != "", "SUPERSEDED")
        .when(cited < latest, "OUTDATED_REFERENCE")
        .when(n_amendments > 0, "AMENDMENT_AVAILABLE")
        .when(unknown, "UNVERIFIABLE")
        .otherwise("UP_TO_DATE")
    )
    return verdict, F.when(verdict == "UNVERIFIABLE", 0.4).otherwise(sure)


def severity(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), verdict)


def merge_verdicts(pairs: DataFrame, group: str) -> DataFrame:
    """(group, verdict, confidence, n_pairs): the most severe verdict of each group; ties by pos."""
    worst = F.min(F.struct(severity(F.col("verdict")).alias("s"), "pos", "verdict", "confidence")).alias("w")
    return pairs.groupBy(group).agg(worst, F.count("*").alias("n_pairs")).select(group, "w.verdict", "w.confidence", "n_pairs")


def scorecard(findings: DataFrame, group: str) -> DataFrame:
    """Completeness and defensibility in percent, regulatory score of 100 less 10 for each mandatory order
    not asked for (0 at least), items for review; null percentages where nothing was assessed."""
    assessed = F.count_if(F.col("verdict") != "unable_to_determine")
    pct = lambda n: F.when(assessed > 0, F.round(100 * n / assessed, 1))
    return findings.groupBy(group).agg(
        F.count("*").alias("total"), pct(F.count_if(F.col("verdict") != "missing_requirement") - F.count_if(F.col("verdict") == "unable_to_determine")).alias("completeness_pct"), pct(F.count_if(F.col("verdict") == "justified")).alias("defensibility_pct"),
        F.greatest(F.lit(0), 100 - 10 * F.count_if(F.col("mandatory") & (F.col("verdict") != "justified"))).alias("regulatory"), F.count_if(F.col("confidence") < 0.60).alias("for_review"),
    )


def risk_summary(findings: DataFrame, group: str) -> DataFrame:
    """Whether anything is mandatory or under CRS, counts, and a level: high with a withdrawn or unmet one, else medium with any issue."""
    issues = F.count_if(F.col("verdict") != "justified")
    bad = F.count_if((F.col("verdict") == "incorrect_standard") | (F.col("mandatory") & (F.col("verdict") != "justified")))
    return findings.groupBy(group).agg(
        F.bool_or("mandatory").alias("any_mandatory"), F.bool_or(F.col("scheme") == "crs").alias("any_crs"), issues.alias("issues"), F.when(bad > 0, "high").when(issues > 0, "medium").otherwise("low").alias("risk_level")
    )


def cross_reference_gaps(references: DataFrame, cited: DataFrame) -> DataFrame:
    """(std_id, n_refs, n_unmet): references of standards (std_id, own, ref) other than to themselves, and those nobody cites."""
    other = references.where("own <> ref").select("std_id", "ref").distinct()
    found = other.join(cited.select("ref").distinct().withColumn("_hit", F.lit(1)), "ref", "left")
    return found.groupBy("std_id").agg(F.count("*").alias("n_refs"), F.count_if(F.col("_hit").isNull()).alias("n_unmet"))


def superseding(rows: DataFrame) -> DataFrame:
    """(src, dst, edge): rows (number, superseded_by) joined to the row that supersedes them."""
    newer = rows.select(F.col("number").alias("superseded_by")).distinct()
    return rows.where("superseded_by is not null").join(newer, "superseded_by").select(F.col("superseded_by").alias("src"), F.col("number").alias("dst"), F.lit("supersedes").alias("edge")).distinct()


def availability_map() -> Column:
    """Section to verified, unverified, not_available or not_identified, of a standards row."""
    state = {
        "scope": F.when(F.col("verified"), "verified").otherwise("unverified"),
        "certification": F.when(F.col("mandatory") & F.col("verified"), "verified").when(F.col("mandatory"), "unverified").otherwise("not_identified"),
        "year": F.when(F.col("year").isNull(), "not_available").otherwise("verified"),
    }
    return F.create_map(*[x for k, v in state.items() for x in (F.lit(k), v)])


def coerce_label(label: Column, known: list[str], default: str) -> Column:
    return F.when(label.isin(known), label).otherwise(default)


def compliance_pairs(requirements: DataFrame, standards: DataFrame) -> DataFrame:
    """(req_id, status, branch): paired with the cited standard, not_found, or no_citation."""
    cites = F.col("cited_year").isNotNull()
    right = standards.select(F.col("std_id").alias("_id"), "status")
    joined = requirements.join(right, (F.col("std_id") == F.col("_id")) & cites, "left")
    branch = F.when(~cites, "no_citation").when(F.col("_id").isNull(), "not_found").otherwise("paired")
    return joined.select("req_id", F.coalesce("status", F.lit("none")).alias("status"), branch.alias("branch"))


def primary_standard(rows: DataFrame) -> DataFrame:
    """The first standard of each analysis: retired ones last, then by requirements, confidence and id."""
    order = Window.partitionBy("analysis_id").orderBy(F.col("status").isin("withdrawn", "superseded"), F.desc("n"), F.desc("c"), "std_id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def evidence_status(verdict: Column) -> Column:
    return F.when(verdict == "justified", "covered").when(verdict.isin("wrong_scope", "incorrect_standard"), "conflicting").when(verdict == "missing_requirement", "missing").otherwise("review")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


# Words that stand for a parameter.
ALIASES = {
    "power": ["watt", "power", "w ", "120w", "90w"], "voltage": ["volt", "voltage", "v ac", "vac"], "ip_rating": ["ip", "ingress protection", "ip6", "ip5"], "cct": ["color temperature", "colour temperature", "cct", "kelvin", "5700", "6500"],
    "efficacy": ["lm/w", "lumen", "efficacy", "luminous"], "thd": ["harmonic", "thd", "distortion"], "power_factor": ["power factor", "pf "], "surge_kv": ["surge", "spd", "kv"],
}


def detect_gaps(rows: DataFrame) -> DataFrame:
    """(std_id, gap_type, subject, severity) of rows (std_id, is_number, scope, scope_verified, search_text,
    n_tests, certification, params, certificates, refs). Without a verified scope that alone is the gap."""
    clear = F.coalesce(F.col("scope_verified") & (F.col("scope") != ""), F.lit(False))
    text = F.lower(F.concat_ws(" ", "scope", "search_text"))
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    gap = lambda kind, subject, severity: F.struct(F.lit(kind).alias("gap_type"), subject.alias("subject"), F.lit(severity).alias("severity"))
    nobody = F.lit(None).cast("string")
    none = F.filter(F.array(gap("", nobody, "")), lambda x: F.lit(False))
    number = F.regexp_replace(F.lower("is_number"), "[ :]", "")
    solid = lambda r: F.regexp_replace(F.lower(r), "[ :]", "")
    uncovered = F.filter("params", lambda p: ~F.exists(F.coalesce(table[p], F.array(F.lower(p))), lambda a: F.contains(text, a)))
    missing = F.filter("certificates", lambda c: ~F.contains(F.lower(F.coalesce("certification", F.lit(""))), F.lower(c)) & ~F.contains(text, F.lower(c)))
    others = F.filter("refs", lambda r: ~F.contains(number, solid(r)) & ~F.contains(solid(r), number))
    full = F.concat(
        F.when(F.col("n_tests") > 0, none).otherwise(F.array(gap("NO_TEST_METHOD", nobody, "low"))),
        F.transform(uncovered, lambda p: gap("PARAMETER_UNVERIFIABLE", p, "medium")),
        F.transform(missing, lambda c: gap("CERTIFICATION_MISSING", c, "high")),
        F.transform(others, lambda r: gap("ADDITIONAL_STANDARD_CITED", r, "high")),
    )
    gaps = F.when(clear, full).otherwise(F.array(gap("SCOPE_UNCLEAR", nobody, "medium")))
    return rows.select("std_id", F.explode(gaps).alias("g")).select("std_id", "g.*")


def certification_source(findings: DataFrame) -> DataFrame:
    """The first notified applicable standard of an analysis, else the first applicable one."""
    order = Window.partitionBy("analysis_id").orderBy(~F.col("mandatory"), "pos", "std_id", "req_id")
    return findings.where(~F.col("mismatch")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def frontend_status(verdict: Column) -> tuple[Column, Column]:
    """(state, severity)."""
    state = F.when(verdict == "justified", "ok").when(verdict.isin("incorrect_standard", "outdated_reference"), "error").otherwise("warning")
    return state, F.when(verdict == "incorrect_standard", "high").when(verdict == "justified", "none").otherwise("medium")


def recommended_action(verdict: Column, superseded_by: Column, year: Column) -> Column:
    old = verdict == "outdated_reference"
    return (
        F.when(old & superseded_by.isNotNull(), F.concat(F.lit("Cite "), superseded_by, F.lit(" instead.")))
        .when(old, F.concat(F.lit("Cite the "), year.cast("string"), F.lit(" edition.")))
        .when(verdict == "incorrect_standard", "Replace the withdrawn standard.")
        .when(verdict == "justified", "No action.")
        .otherwise("Verify manually.")
    )


def headline_axis(verdict: Column, mandatory: Column) -> Column:
    return F.when(verdict == "wrong_scope", "applicability").when(verdict.isin("incorrect_standard", "outdated_reference", "ambiguous"), "currentness").when(mandatory, "certification").otherwise("none")
