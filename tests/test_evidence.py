from tenderweave.operators import evidence as E


def test_evidence_of_standard_amendments_and_orders(spark):
    std = spark.createDataFrame([(1, "IS 1:2000"), (2, "IS 2")], "std_id long, designation string")
    amendments = spark.createDataFrame([(1, 1, "SO 9"), (1, 2, None), (3, 1, None)], "std_id long, amendment int, so_number string")
    orders = spark.createDataFrame([(2, "SO 5", None), (1, "", "M"), (1, None, "M")], "std_id long, so_number string, ministry string")
    got = sorted((r.std_id, r.source_type, r.source_name, r.authority) for r in E.compliance_evidence(std, amendments, orders).collect())
    assert got == [
        (1, "bis_amendment", "IS 1:2000 Amendment 1", "BIS"), (1, "bis_amendment", "IS 1:2000 Amendment 2", "BIS"), (1, "bis_standard", "BIS Standard IS 1:2000", "BIS"),
        (2, "bis_standard", "BIS Standard IS 2", "BIS"), (2, "qco_notification", "QCO Gazette SO 5", "Government of India"),
    ]


def test_the_latest_decision_counts(spark):
    req = spark.createDataFrame([(1, "partial"), (2, "conflicting"), (3, "partial"), (4, "covered"), (5, "partial")], "req_id long, status string")
    said = spark.createDataFrame([(1, "accepted", 1), (1, "rejected", 2), (2, "rejected", 1), (3, "accepted", 1), (3, "deleted", 2), (5, "reviewed", 1)], "req_id long, decision string, ts int")
    got = {r.req_id: (r.status, r.machine_status) for r in E.effective_status(req, said).collect()}
    assert got == {1: ("missing", "partial"), 2: ("conflicting", "conflicting"), 4: ("covered", "covered"), 5: ("review", "partial")}


def test_references_match_both_ways(spark):
    cited = spark.createDataFrame([("IS 694",), ("is 10322:2012",), ("IS 5",), ("none",), ("",), (None,)], "reference string")
    rows = spark.createDataFrame([(3, "IS 694 : 2010"), (1, "IS 10322"), (2, "IS 15"), (9, None), (4, "IS 5555")], "std_id long, is_number string")
    assert {r.reference: r.std_id for r in E.explicit_reference_match(cited, rows).collect()} == {"IS 694": 3, "is 10322:2012": 1, "IS 5": 4}
