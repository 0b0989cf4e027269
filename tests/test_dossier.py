import os
import re

from tenderweave.operators import dossier as D
from tenderweave.plans.dossier import QUERIES

CHECKS = "req_id long, std_id long, designation string, verdict string, confidence double, status string, superseded_by string, cited_year int, current_year int, mismatch boolean, notified boolean, scheme string, ministry string, so_number string, unmet array<string>"


def test_findings_in_full(spark):
    said = [
        (1, "justified", 0.9, None, [12, 10, 11, 99], [5, 404], "Fits well."), (2, "wrong_scope", 0.8, 0.1, [10], [5], "x"), (3, "made_up", 0.7, None, None, None, None), (4, "wrong_scope", 0.7, None, [20, 21], [], "Other goods."),
        (5, "outdated_reference", 0.5, None, [30], None, None),
    ]
    proposals = spark.createDataFrame(said, "req_id long, verdict string, confidence double, raw_confidence double, std_ids array<long>, evidence_ids array<long>, reason string")
    candidates = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (4, 20), (4, 21), (5, 30)], "req_id long, std_id long")
    checks = spark.createDataFrame([
        (1, 10, "IS 10", "outdated_reference", 0.8, "active", None, 2000, 2010, True, False, None, None, None, ["IS 77"]), (1, 11, "IS 11", "justified", 0.9, "active", None, 2011, 2011, None, True, "crs", "M", "S.O. 1", None),
        (1, 12, "IS 12", "justified", 0.9, "active", None, None, 2012, True, False, None, None, None, ["IS 77", "IS 5"]), (4, 20, "IS 20", "incorrect_standard", 0.95, "withdrawn", None, 1990, 1990, False, False, None, None, None, []),
        (4, 21, "IS 21", "justified", 0.9, "active", None, 2001, 2000, False, False, "isi", "N", None, []), (5, 30, "IS 30", "outdated_reference", 0.9, "superseded", "IS 31", 1990, 1995, None, False, None, None, None, []),
    ], CHECKS)
    evidence = spark.createDataFrame([(5, None), (50, 10), (51, 10), (52, 11), (53, 20), (54, 12)], "evidence_id long, std_id long")
    got = {r.req_id: r for r in D.finding_details(proposals, candidates, checks, evidence).collect()}
    a = got[1]
    assert (a.verdict, a.confidence, a.resolution, a.review) == ("outdated_reference", 0.8, "check_override", True)
    assert (a.applicable, a.cited, a.evidence, a.unmet) == ([11, 10], [12], [5, 54, 50, 51, 52], ["IS 5", "IS 77"])
    d = a.dimensions
    assert (d.applicability.verdict, d.currentness.label, d.currentness.verdict, d.scope.mismatch, d.scope.designation) == ("justified", "outdated", "outdated_reference", True, "IS 12")
    assert (d.certification.notified, d.certification.so_number, d.headline.axis, d.headline.note) == (True, "S.O. 1", "currentness", "The proposal's justified holds beside it.")
    assert a.reason == "Fits well. It depends on IS 5, IS 77, which the tender does not name." and a.action == "Cite the current edition. Name IS 5, IS 77 too, or say why not."
    assert [(n.std_id, n.currentness, n.usable, n.action) for n in a.notes] == [(11, "current", True, "No issue found."), (10, "outdated", True, "Give the current year.")]
    b = got[2]
    assert (b.verdict, b.resolution, b.applicable, b.evidence, b.reason, b.action) == ("unsupported", "proposal_only", [], [5], "No standard of the catalogue fits this requirement.", D.LOOK)
    assert (b.dimensions.currentness.label, b.dimensions.scope.assessed, b.dimensions.certification.notified) == ("unknown", False, False)
    assert (got[3].verdict, got[3].applicable, got[3].cited, got[3].evidence, got[3].reason) == ("unable_to_determine", [], [], [], "")
    c = got[4]
    assert (c.verdict, c.resolution, c.applicable, c.evidence) == ("incorrect_standard", "check_override", [20, 21], [53])
    assert (c.dimensions.currentness.label, c.dimensions.certification.scheme, c.dimensions.headline.note) == ("withdrawn", None, "The proposal's wrong_scope holds beside it.")
    assert [(n.usable, n.action) for n in c.notes] == [(False, "It can't be used: find its replacement."), (True, "Give the current year.")]
    e = got[5]
    assert (e.verdict, e.resolution, e.confidence, e.action, e.review) == ("outdated_reference", "agree", 0.7, "Cite IS 31 instead.", False)


def test_checks_meet_their_proposal_in_place(spark):
    proposals = spark.createDataFrame([(1, "justified", 0.9, None, [7, None, 5, 7, 6, 9], None, None), (2, "justified", 0.9, None, [5], [], None), (None, "justified", 0.9, None, [5], None, None)], "req_id long, verdict string, confidence double, raw_confidence double, std_ids array<long>, evidence_ids array<long>, reason string")
    candidates = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (1, 7), (1, None), (1, 8), (2, 6), (None, 5)], "req_id long, std_id int")
    check = lambda req, std, name: (req, std, name, "justified", 0.9, "active", None, 2000, 2000, False, False, None, None, None, None)
    checks = spark.createDataFrame([check(1, 5, "b"), check(1, 5, "a"), check(1, 9, "x"), check(1, None, "x"), check(2, 5, "x"), check(None, 5, "x"), check(1, 8, "x")], CHECKS)
    evidence = spark.createDataFrame([(50, 5), (70, 7), (90, 9)], "evidence_id long, std_id long")
    found = D.finding_details(proposals, candidates, checks, evidence)
    got = {r.req_id: r for r in found.collect()}
    assert len(got) == 3
    assert (got[1].applicable, got[1].evidence) == ([7, 5, 5, 6], [50])  # 7 and 6 have no check, so no evidence of theirs counts
    assert [(n.std_id, n.designation) for n in got[1].notes] == [(7, None), (5, "a"), (5, "b"), (6, None)]
    assert [(got[k].applicable, got[k].evidence, got[k].resolution) for k in (2, None)] == [([], [], "proposal_only")] * 2


def test_tasks_of_details_grow_with_the_files(spark, sf_dir, monkeypatch):
    rows = lambda: sorted(map(str, QUERIES["r11_finding_details"](spark, sf_dir).collect()))
    few, size = rows(), sum(os.path.getsize(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    monkeypatch.setattr(D, "PART_BYTES", size // 9)
    plan = QUERIES["r11_finding_details"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert {k for k, _ in dealt} == {"l_orderkey", "l_partkey", "req_id"} and {n for _, n in dealt} == {str(size // (size // 9) + 1)}
    assert not re.search(r"hashpartitioning\(\w+#\w+, \w+#", plan), "no pair of requirement and standard is moved to meet its check"
    assert rows() == few
