"""Findings: another reader's proposals under the rules' checks, the context of an edition, and changes tried out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import bm25_score, ranked
from .rules import SEVERITY, severity, version_check, within_transition

# The confidence under which a proposal counts for nothing, that under which a person looks, and standards retrieved for a changed text.
LEAST_TRUST, LEAST_SURE, RETRIEVED = 0.2, 0.60, 3
# End of the fixed values.


def assemble_findings(proposals: DataFrame, candidates: DataFrame, checks: DataFrame) -> DataFrame:
    """(req_id, verdict, confidence, resolution, n_applicable, n_cited, review): one finding for each of proposals
    (req_id, verdict, confidence, raw_confidence, std_ids).

    A proposal under 0.2 (raw, else plain, confidence) names no standard and is unsupported; an unknown verdict
    is unable_to_determine. A proposed standard counts if it is a candidate (req_id, std_id) of its own requirement.
    The worst of the checks (req_id, std_id, verdict, confidence, mismatch, notified), ties by the proposal's order,
    leads if it is worse than the proposal; of equals the confidences are averaged. A standard whose scope
    mismatches is cited only, unless it gives that worst check for another reason. review: low confidence, a
    standard under an order, or a verdict that asks for it.
    """
    weak = F.coalesce("raw_confidence", "confidence") < LEAST_TRUST
    verdict = F.when(weak, "unsupported").when(F.col("verdict").isin(*SEVERITY), F.col("verdict")).otherwise("unable_to_determine")
    said = proposals.select("req_id", verdict.alias("said"), F.col("confidence").alias("sure"), F.when(~F.coalesce(weak, F.lit(False)), F.col("std_ids")).alias("std_ids"))
    named = said.select("req_id", F.posexplode("std_ids").alias("pos", "std_id")).join(candidates.select("req_id", "std_id"), ["req_id", "std_id"], "left_semi")
    named = named.groupBy("req_id", "std_id").agg(F.min("pos").alias("pos")).join(checks, ["req_id", "std_id"], "left").withColumn("rank", severity(F.col("verdict")))
    worst = F.min(F.when(F.col("verdict").isNotNull(), F.struct("rank", "pos", "verdict", "confidence", F.coalesce("mismatch", F.lit(False)).alias("mismatch")))).alias("worst")
    off = F.coalesce("mismatch", F.lit(False))
    checked = named.groupBy("req_id").agg(worst, F.count_if(~off).alias("fit"), F.count_if(off).alias("unfit"), F.max(F.coalesce("notified", F.lit(False))).alias("notified"))
    both = said.join(checked, "req_id", "left")
    mine, theirs = severity(F.col("said")), F.col("worst.rank")
    resolution = F.when(theirs.isNull(), "proposal_only").when(theirs < mine, "check_override").when(mine < theirs, "proposal_primary").otherwise("agree")
    both = both.withColumn("resolution", resolution)
    led = F.col("resolution") == "check_override"
    final = both.withColumn("verdict", F.when(led, F.col("worst.verdict")).otherwise(F.col("said")))
    final = final.withColumn("confidence", F.when(led, F.col("worst.confidence")).when(F.col("resolution") == "agree", (F.col("sure") + F.col("worst.confidence")) / 2).otherwise(F.col("sure")))
    moved = F.coalesce(F.col("worst.mismatch") & (F.col("worst.verdict") != "wrong_scope"), F.lit(False)).cast("long")
    review = (F.col("verdict") == "requires_human_verification") | (F.col("confidence") < LEAST_SURE) | F.coalesce("notified", F.lit(False))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return final.select("req_id", "verdict", "confidence", "resolution", (count("fit") + moved).alias("n_applicable"), (count("unfit") - moved).alias("n_cited"), F.coalesce(review, F.lit(False)).alias("review"))


def currentness_context(results: DataFrame, key: str, today: Column) -> DataFrame:
    """(key, cited_year, current_year, is_current, year_omitted, gap_years, status, superseded_by, deadline,
    within_transition, notified, ministry): editions and status are those of the most severe of results (key, pos,
    verdict, cited_year, current_year, status, superseded_by, deadline, applicable, notified, ministry), ties by pos; the
    order is that of the first notified applicable one, else of the first applicable one."""
    fields = F.struct("cited_year", "current_year", "status", "superseded_by", "deadline").alias("f")
    source = F.when(F.col("applicable"), F.struct(~F.coalesce("notified", F.lit(False)), "pos"))
    worst = results.groupBy(key).agg(F.min_by(fields, F.struct(severity(F.col("verdict")), "pos")).alias("f"), F.min_by(F.struct("notified", "ministry"), source).alias("o"))
    outcome, gap, current = version_check(F.col("f.cited_year"), F.col("f.current_year"))
    known = F.when(outcome.isin("behind", "ahead", "equal"), gap)
    return worst.select(key, "f.cited_year", "f.current_year", current.alias("is_current"), (outcome == "year_omitted").alias("year_omitted"), known.alias("gap_years"), "f.status", "f.superseded_by", "f.deadline", within_transition(F.col("f.status"), F.col("f.deadline"), today).alias("within_transition"), F.coalesce("o.notified", F.lit(False)).alias("notified"), "o.ministry")


def impact(verdict: Column) -> Column:
    """What a changed requirement's verdict means for the change."""
    return F.when(verdict == "justified", "acceptable").when(verdict.isin("outdated_reference", "incorrect_standard"), "risky").when(verdict.isNull(), "no_finding").otherwise("unclear")


def simulate_modify(changes: DataFrame, catalogue: DataFrame, k: int = RETRIEVED) -> DataFrame:
    """(req_id, std_ids, verdict, impact): for each of changes (req_id, text) the k standards retrieved anew from
    catalogue (std_id, text, verdict), best first, ties by std_id, and the worst of their verdicts.

    Scores are cut to six decimals, so that the order of additions decides nothing.
    """
    scores = bm25_score(changes.select(F.col("req_id").alias("query_id"), F.col("text").alias("query_text")), catalogue.select("std_id", "text")).withColumn("score", F.round("score", 6))
    top = ranked(scores, [F.desc("score"), F.asc("std_id")], k).join(catalogue.select("std_id", "verdict"), "std_id")
    worst = F.min(F.struct(severity(F.col("verdict")), "rank", "verdict")).alias("w")
    found = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "std_id"))), lambda x: x["std_id"]).alias("std_ids"), worst)
    both = changes.select("req_id").join(found, F.col("req_id") == F.col("query_id"), "left")
    return both.select("req_id", "std_ids", F.col("w.verdict").alias("verdict"), impact(F.col("w.verdict")).alias("impact"))
