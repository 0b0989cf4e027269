"""Findings in full: which standards apply and which are only cited, the evidence, each axis of the judgement, and what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import LEAST_SURE, LEAST_TRUST
from .rules import SEVERITY, severity

CURRENTNESS = ("incorrect_standard", "outdated_reference", "ambiguous")
#: What a person does about each verdict.
ACTIONS = {
    "justified": "Nothing to do: the reference is right and current.",
    "outdated_reference": "Cite the current edition.",
    "incorrect_standard": "Take the withdrawn standard out and find its replacement.",
    "wrong_scope": "Cite a standard for this product, or correct what the text asks for.",
    "missing_requirement": "Name the standard that applies.",
    "ambiguous": "Give the year of the edition.",
    "requires_human_verification": "Have a senior officer look at it first.",
    "over_restrictive": "Check whether it shuts bidders out, and accept equivalents.",
    "unable_to_determine": "Check it by hand.",
}
LOOK = "Look at this requirement."
MANDATORY = " Ask for the mark of certification: an order makes it mandatory."
FIELDS = ("std_id", "designation", "verdict", "confidence", "status", "superseded_by", "cited_year", "current_year", "mismatch", "notified", "scheme", "ministry", "so_number", "unmet")
ROW = (*FIELDS, "proofs", "rank")
PART_BYTES = 4 << 20


def axis(verdict: Column) -> Column:
    return F.when(verdict.isin(*CURRENTNESS), "currentness").otherwise("applicability")


def currentness_label(check: Column) -> Column:
    """One word for a check's edition and status; unknown without a check."""
    gap = check["current_year"] - check["cited_year"]
    by_year = F.when(check["cited_year"].isNull(), "year_omitted").when(check["current_year"].isNull(), "unverifiable").when(gap < 0, "ahead_of_catalogue").when(gap == 0, "current").otherwise("outdated")
    return F.when(check.isNull(), "unknown").when(check["status"].isin("withdrawn", "superseded"), check["status"]).otherwise(by_year)


def standard_action(check: Column) -> Column:
    """What to do about one standard: its status comes before its edition, that before its scope."""
    label = currentness_label(check)
    gone = check["status"].isin("withdrawn", "superseded")
    return (
        F.when(gone & check["superseded_by"].isNotNull(), F.concat(F.lit("Cite "), check["superseded_by"], F.lit(" instead.")))
        .when(gone, "It can't be used: find its replacement.")
        .when(label == "year_omitted", "Give the year of the edition.")
        .when(label != "current", "Give the current year.")
        .when(check["mismatch"], "Check whether it covers this product.")
        .otherwise("No issue found.")
    )


def _first(rows: Column, test) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def finding_details(proposals: DataFrame, candidates: DataFrame, checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """One finding for each of proposals (req_id, verdict, confidence, raw_confidence, std_ids, evidence_ids, reason):

    (req_id, verdict, confidence, resolution, applicable, cited, evidence, unmet, dimensions, reason, action, notes, review).

    Verdict, confidence and resolution are those of assemble_findings(). applicable and cited are the proposed standards
    that are candidates (req_id, std_id) of their own requirement, in the proposal's order, told apart by whether their
    check found the scope to mismatch; the check that leads the finding moves its standard to the end of the applicable
    ones, unless it leads by the scope. evidence lists the proposal's own evidence as far as it exists in evidence
    (evidence_id, std_id), then that of each checked standard. unmet are what these depend on and the tender does not
    name. dimensions has what each axis says by itself: applicability (the proposal), currentness (the worst check),
    scope (the first check that mismatches, else the first that was assessed), certification (the first notified
    applicable standard, else the first applicable one) and headline. notes say what to do about each applicable standard.
    checks has req_id and the columns of FIELDS; mismatch is null where scope was not assessed. A requirement's checks meet its
    proposal in one row, so its own work grows with its named times its checked standards; tasks are more where the files are.
    """
    weak = F.coalesce(F.coalesce("raw_confidence", "confidence") < LEAST_TRUST, F.lit(False))
    verdict = F.when(weak, "unsupported").when(F.col("verdict").isin(*SEVERITY), F.col("verdict")).otherwise("unable_to_determine")
    why = F.when(weak, "No standard of the catalogue fits this requirement.").otherwise(F.coalesce("reason", F.lit("")))
    none = F.array().cast("array<long>")
    said = proposals.select("req_id", verdict.alias("said"), F.col("confidence").alias("sure"), F.when(~weak, F.col("std_ids")).alias("std_ids"), F.coalesce("evidence_ids", none).alias("evidence_ids"), why.alias("why"))

    named = candidates.where("req_id IS NOT NULL").groupBy("req_id").agg(F.collect_set("std_id").alias("named"))
    own = evidence.where("std_id IS NOT NULL").groupBy("std_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("proofs"))
    checked = checks.where("req_id IS NOT NULL").select("req_id", *FIELDS).join(own, "std_id", "left")
    checked = checked.withColumn("proofs", F.when(F.col("verdict").isNotNull(), F.coalesce("proofs", none)).otherwise(none)).withColumn("rank", severity(F.col("verdict")))
    listed = checked.repartition(partitions(checks), "req_id").groupBy("req_id").agg(F.collect_list(F.struct(*ROW)).alias("found"))

    real = said.select("req_id", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
    real = real.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("given"))

    both = said.join(named, "req_id", "left").join(listed, "req_id", "left").join(real, "req_id", "left")
    both = both.withColumn("rows", _rows(dict(checked.dtypes)))
    both = both.withColumn("worst", F.array_min(F.transform(F.filter("rows", lambda r: r["verdict"].isNotNull()), lambda r: F.struct(r["rank"].alias("rank"), r["pos"].alias("pos"), r.alias("r")))))
    w = F.col("worst.r")
    mine, theirs = severity(F.col("said")), F.col("worst.rank")
    both = both.withColumn("resolution", F.when(theirs.isNull(), "proposal_only").when(theirs < mine, "check_override").when(mine < theirs, "proposal_primary").otherwise("agree"))
    led = F.col("resolution") == "check_override"
    both = both.withColumns({
        "verdict": F.when(led, w["verdict"]).otherwise(F.col("said")),
        "confidence": F.when(led, w["confidence"]).when(F.col("resolution") == "agree", (F.col("sure") + w["confidence"]) / 2).otherwise(F.col("sure")),
        "moved": F.when(F.coalesce(w["mismatch"], F.lit(False)) & (w["verdict"] != "wrong_scope"), w["std_id"]),
    })
    off = lambda r: F.coalesce(r["mismatch"], F.lit(False))
    both = both.withColumns({
        "fit": F.concat(F.filter("rows", lambda r: ~off(r)), F.filter("rows", lambda r: off(r) & F.coalesce(r["std_id"] == F.col("moved"), F.lit(False)))),
        "unfit": F.filter("rows", lambda r: off(r) & ~F.coalesce(r["std_id"] == F.col("moved"), F.lit(False))),
        "unmet": F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["unmet"], F.array().cast("array<string>")))))),
    })
    both = both.withColumns({
        "order": F.coalesce(_first(F.col("fit"), lambda r: F.coalesce(r["notified"], F.lit(False))), _first(F.col("fit"), lambda r: r["verdict"].isNotNull())),
        "scoped": F.coalesce(_first(F.col("rows"), off), _first(F.col("rows"), lambda r: r["mismatch"].isNotNull())),
        "notified": F.exists("rows", lambda r: F.coalesce(r["notified"], F.lit(False))),
    })
    o, s = F.col("order"), F.col("scoped")
    crossed = led & (axis(F.col("said")) != axis(F.col("verdict")))
    depends = F.when(F.size("unmet") > 0, F.concat(F.lit(" It depends on "), F.array_join("unmet", ", "), F.lit(", which the tender does not name.")))
    dimensions = F.struct(
        F.struct(F.col("said").alias("verdict"), F.col("sure").alias("confidence")).alias("applicability"),
        F.struct(currentness_label(w).alias("label"), F.when(w["verdict"].isin(*CURRENTNESS), w["verdict"]).alias("verdict"), w["cited_year"].alias("cited_year"), w["current_year"].alias("current_year")).alias("currentness"),
        F.struct(s.isNotNull().alias("assessed"), s["mismatch"].alias("mismatch"), s["designation"].alias("designation")).alias("scope"),
        F.struct(F.coalesce(o["notified"], F.lit(False)).alias("notified"), o["scheme"].alias("scheme"), o["ministry"].alias("ministry"), o["so_number"].alias("so_number")).alias("certification"),
        F.struct(F.col("verdict"), axis(F.col("verdict")).alias("axis"), F.when(crossed, F.concat(F.lit("The proposal's "), F.col("said"), F.lit(" holds beside it."))).alias("note")).alias("headline"),
    )
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    newer = F.get(F.filter(F.transform("rows", lambda r: r["superseded_by"]), lambda x: x.isNotNull()), F.lit(0))
    todo = F.when((F.col("verdict") == "outdated_reference") & newer.isNotNull(), F.concat(F.lit("Cite "), newer, F.lit(" instead."))).otherwise(F.coalesce(table[F.col("verdict")], F.lit(LOOK)))
    todo = F.concat(todo, F.when(F.col("notified") & F.col("verdict").isin("justified", "missing_requirement"), MANDATORY).otherwise(""), F.when(F.size("unmet") > 0, F.concat(F.lit(" Name "), F.array_join("unmet", ", "), F.lit(" too, or say why not."))).otherwise(""))
    notes = F.transform("fit", lambda r: F.struct(r["std_id"].alias("std_id"), r["designation"].alias("designation"), currentness_label(r).alias("currentness"), (~r["status"].isin("withdrawn", "superseded")).alias("usable"), standard_action(r).alias("action")))
    proofs = F.concat(F.coalesce("given", none), F.flatten(F.transform("rows", lambda r: r["proofs"])))
    review = (F.col("verdict") == "requires_human_verification") | (F.col("confidence") < LEAST_SURE) | F.col("notified")
    ids = lambda c: F.transform(c, lambda r: r["std_id"])
    return both.select(
        "req_id", "verdict", "confidence", "resolution", ids("fit").alias("applicable"), ids("unfit").alias("cited"), F.array_distinct(proofs).alias("evidence"), "unmet", dimensions.alias("dimensions"),
        F.trim(F.concat("why", F.coalesce(depends, F.lit("")))).alias("reason"), todo.alias("action"), notes.alias("notes"), F.coalesce(review, F.lit(False)).alias("review"),
    )


def _rows(kinds: dict[str, str]) -> Column:
    """The rows of found for those of std_ids that are in named, in the order of std_ids, with their place as pos; a row without
    a check for one that has none. These lists are one requirement's, so its standards are met in place and no pair is moved."""
    bare = lambda x: F.struct(*[(x if c == "std_id" else F.array() if c == "proofs" else F.lit(None)).cast(kinds[c]).alias(c) for c in ROW])
    found = lambda x: F.filter("found", lambda r: r["std_id"] == x)
    of = lambda x: F.when(F.coalesce(F.size(found(x)) > 0, F.lit(False)), found(x)).otherwise(F.array(bare(x)))
    placed = F.transform(F.array_intersect("std_ids", "named"), lambda x, i: F.transform(F.array_sort(of(x)), lambda r: F.struct(i.alias("pos"), *[r[c].alias(c) for c in ROW])))
    return F.coalesce(F.flatten(placed), F.array().cast(f"array<struct<pos:int,{','.join(f'{c}:{kinds[c]}' for c in ROW)}>>"))


def partitions(*frames: DataFrame) -> int:
    """As many as shuffles have, or more if the files that these frames are made of would be over PART_BYTES for each."""
    plans = [f._jdf.queryExecution().analyzed().collectLeaves() for f in frames]
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for leaves in plans for k in range(leaves.size())]
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x for x in sizes if x < 1 << 60) // PART_BYTES + 1)  # over that, a size is not known
