from pyspark.sql import functions as F

from tenderweave.operators import notices as N

TENDER = """Tender Ref: NH/2024-17
CPWD invites bids. Closing Date: 12th March 2024
Cables shall conform to IS 694 and IS 7098
is 694 again
short IS 694"""


def test_tender_notices(spark):
    rows = spark.createDataFrame([(1, "Cables", TENDER, None), (2, None, None, "A"), (3, "Tender No 5", "due date 2024-05-01", "B")], "doc_id long, title string, text string, author string")
    a, b, c = N.tender_notices(rows).orderBy("doc_id").collect()
    assert (a.tender_id, a.authority, a.closing_date, a.referenced) == ("NH/2024-17", "Central Public Works Department (CPWD)", "12th March 2024", ["IS 694", "IS 7098"])
    assert a.clauses == ["Cables shall conform to IS 694 and IS 7098"]
    assert (b.tender_id, b.authority, b.closing_date, b.referenced, b.clauses) == ("TENDER_NOTICE", "A", None, [], None)
    assert (c.tender_id, c.authority, c.closing_date) == ("5", "B", "2024-05-01")


def test_order_and_gazette_notices(spark):
    rows = spark.createDataFrame([(1, "T", "S.O. 1203 (e) of the Ministry of Steel, IS 1786 : 2008, from 3rd Jan 2023 or 2024-01-01"), (2, None, None)], "doc_id long, title string, text string")
    a, b = N.order_notices(rows).orderBy("doc_id").collect()
    assert (a.so_number, a.is_number, a.ministry, a.effective_date) == ("S.O. 1203(E)", "IS 1786 : 2008", "Ministry of Steel", "3rd Jan 2023")
    assert (b.so_number, b.is_number, b.excerpt, b.effective_date) == ("S.O. Notification", "Mandatory Standard", "Quality Control Order", None)
    pages = spark.createDataFrame([(1, None, "see IS 15"), (2, "CG-DL-E-01012024-77", "IS 20"), (3, None, None)], "doc_id long, title string, text string")
    cells = [(1, 0, 1, 0, "id", "CG-DL-E-02022024-9"), (1, 0, 1, 1, "ministry", "Ministry of Mines"), (1, 0, 1, 2, "subject", "Order of IS 99"), (1, 0, 1, 3, "c", "02-Feb-2024"), (1, 0, 2, 0, "id", "CG-DL-E-02022024-10"), (2, 0, 0, 0, "x", "no id")]
    got = {r.doc_id: (r.gazette_id, r.is_number, r.title, r.ministry, r.effective_date) for r in N.gazette_notices(pages, spark.createDataFrame(cells, "doc_id long, table int, row int, col int, name string, value string")).collect()}
    assert got[1] == ("CG-DL-E-02022024-9", "IS 99", "Order of IS 99", "Ministry of Mines", "02-Feb-2024")
    assert got[2][:3] == ("CG-DL-E-01012024-77", "IS 20", "CG-DL-E-01012024-77") and got[3][:2] == ("Gazette Notification", "Mandatory Notification")


def test_standards_of_a_catalogue_page(spark):
    text = "Catalogue ETD 20\nIS 732\nCode of practice for wiring\nIS 10322 : Part 5 : 2012 luminaires of CED 5 here\nThe standard IS 732 was reissued in 2019 and is much longer now\n" + "x" * 130 + " IS 10322"
    rows = N.catalogue_standards(spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")).orderBy("nth").collect()
    assert [(r.is_number, r.part, r.year, r.committee, r.division) for r in rows] == [("IS 732", None, 2019, "ETD 20", "Electrotechnical Division"), ("IS 10322", 5, 2012, "CED 5", "Civil Engineering Division")]
    assert rows[0].title.startswith("The standard IS 732 was") and rows[1].title == "x" * 120


def test_payloads_and_order_fields(spark):
    rows = [(1, "bis", None, "as is 456 says", None), (2, "bis", "IS list", "", None), (3, "draft", None, "Draft: MED/22 of it", None), (4, "tender", None, "Tender ID: A-9.", "X"), (5, "order", None, "S.O. 5 (E)", None), (6, "other", None, None, None)]
    got = {r.doc_id: (r.identifier, r.authority) for r in N.payloads(spark.createDataFrame(rows, "doc_id long, kind string, title string, text string, author string")).collect()}
    assert got == {1: ("IS 456", None), 2: ("IS list", None), 3: ("DRAFT MED/22", None), 4: ("A-9", "X"), 5: ("S.O. 5(E)", "Ministry / DPIIT"), 6: (None, None)}
    fields = spark.createDataFrame([(1, " ", "SO 5", None, "CRS ", "2024-02-30"), (2, "IS 9", "", "M", "x", "2024-02-03"), (3, "", None, "M", None, None)], "k int, is_number string, so_number string, ministry string, scheme string, effective_date string")
    a, b, c = N.order_records(fields, "k").orderBy("k").collect()
    assert (a.ok, a.is_number, a.ministry, a.scheme, a.effective_date, a.source_name) == (True, None, "Government of India", "crs", None, "QCO Gazette Notification SO 5")
    assert (b.so_number, b.scheme, str(b.publication_date), b.excerpt) == (None, None, "2024-02-03", "QCO Notification  requiring mandatory BIS certification for IS 9.")
    assert not c.ok and c.ministry is None


def test_crawl_decisions(spark):
    policies = spark.createDataFrame([(1, "B", "b.org", False, ["/private"], []), (2, "C", "x.b.org", True, [], []), (3, "D", "d.org", False, [], ["/docs"]), (4, "E", " E.org", True, None, None)], "pos int, source string, domain string, blocked boolean, denied array<string>, allowed array<string>")
    want = {"https://b.org/a": "allowed", "http://x.B.org:80/private/1": "access_restricted", "https://ab.org/": "permission_required", "https://d.org/docs/1?x": "allowed", "https://d.org?x": "access_restricted", "https://e.org/": "source_blocked", "": "access_restricted", None: "access_restricted", "plain": "permission_required"}
    got = N.crawl_decisions(spark.createDataFrame([(u,) for u in want], "url string"), policies).collect()
    assert {r.url: r.decision for r in got} == want and len(got) == len(want)
    types = spark.createDataFrame([("text/html; charset=x",), ("image/png",), ("",), (None,)], "t string").select(N.content_type_allowed(F.col("t"), ["text/html", "application/pdf"]).alias("ok")).collect()
    assert [r.ok for r in types] == [True, False, True, True]


def test_excerpts_of_candidates(spark):
    from tenderweave.operators.records import excerpt_choice

    candidates = spark.createDataFrame([(1, 0, 7, None, 0.5, " ", "scope"), (1, 1, 8, 0.9, 0.4, "own ", "s"), (1, 2, 7, 0.1, 0.1, "late", None), (1, 3, 9, None, 0.3, None, " s9 "), (2, 0, 7, None, 0.2, None, "")], "q int, pos int, std_id int, own_score double, score double, own_excerpt string, scope string")
    evidence = spark.createDataFrame([(1, 7, 1, "two"), (1, 7, 0, " one "), (1, 7, 2, " "), (1, 9, 0, None), (1, 8, 0, "x")], "q int, std_id int, pos int, excerpt string")
    got = {(r.q, r.std_id): (r.pos, r.score, r.excerpt) for r in excerpt_choice(candidates, evidence, "q").collect()}
    assert got == {(1, 7): (0, 0.5, "one\n---\ntwo"), (1, 8): (1, 0.9, "own"), (1, 9): (3, 0.3, "s9"), (2, 7): (0, 0.2, None)}
