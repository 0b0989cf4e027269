from pyspark.sql import functions as F

from tenderweave.functions import vocabulary as V
from tenderweave.operators import clauses as C

TENDER = """--- PAGE 2 ---

TECHNICAL REQUIREMENTS OF WORK

1. Lamps shall conform to IS 9999 : 2010
and carry a mark.
2) Cables rated 1.1 kV, approx. 3 km long
3.1 Spares for two years of use

Sl. No.

a) the first lettered item of it
b) the second lettered item of it
d) not the third but a continuation
c) the third lettered item of it

--- page 4 ---

- one bullet alone is a paragraph

* bullet the first of the list
* bullet the second of the list

A plain paragraph of the tender that says
nothing of note. See IS 1234 (Part 2).
"""


def frame(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_clauses_and_their_offsets(spark):
    text = "Pumps of 1.1 kV grade; see Amd. 2 of it. Next one!\n\n  (a) first item\n4.2 second item\n110 m of pipe, e.g. steel\n- third. End"
    rows = [(r.pos, r.offset, r.clause) for r in C.split_clauses(frame(spark, text, None, " ")).orderBy("doc_id", "pos").collect()]
    clauses = ["Pumps of 1.1 kV grade;", "see Amd. 2 of it.", "Next one!", "(a) first item", "4.2 second item 110 m of pipe, e.g. steel", "- third.", "End"]
    assert [c for _, _, c in rows] == clauses and [p for p, _, _ in rows] == list(range(7))
    assert all(text[o:].startswith(c[:6]) for _, o, c in rows)


def test_clause_at_a_place(spark):
    long = "word " * 100 + "IS 77 here " + "more " * 100
    docs = frame(spark, "One thing. Two IS 5 things. Three.", long)
    places = spark.createDataFrame([(0, 15), (1, 500)], "doc_id long, offset long")
    got = {r.doc_id: r.clause for r in C.clause_at(docs, places).collect()}
    assert got[0] == "Two IS 5 things."
    assert got[1].startswith("…") and got[1].endswith("…") and "IS 77 here" in got[1] and len(got[1]) <= 402


def test_spans_of_lists_and_paragraphs(spark):
    got = [(r.page, r.text, r.structural) for r in C.requirement_spans(frame(spark, TENDER)).orderBy("pos").collect()]
    assert got == [
        (2, "TECHNICAL REQUIREMENTS OF WORK", False),
        (2, "Lamps shall conform to IS 9999 : 2010 and carry a mark.", True),
        (2, "Cables rated 1.1 kV, approx. 3 km long", True),
        (2, "Spares for two years of use", True),
        (2, "Sl. No.", False),
        (2, "the first lettered item of it", True),
        (2, "the second lettered item of it d) not the third but a continuation", True),
        (2, "the third lettered item of it", True),
        (4, "- one bullet alone is a paragraph", False),
        (4, "bullet the first of the list", True),
        (4, "bullet the second of the list", True),
        (4, "A plain paragraph of the tender that says\nnothing of note. See IS 1234 (Part 2).", False),
    ]


def test_requirements_have_place_category_and_confidence(spark):
    rows = C.requirements(frame(spark, TENDER, "", None)).orderBy("pos").collect()
    assert {r.location for r in rows} == {"TECHNICAL REQUIREMENTS OF WORK"} and len(rows) == 10
    assert [(r.reference, r.cited_year, r.confidence, r.category) for r in (rows[0], rows[1], rows[-1])] == [("IS 9999", 2010, 0.90, "technical_specification"), (None, None, 0.65, "other"), ("IS 1234", None, 0.80, "technical_specification")]
    assert len(C.requirements(frame(spark, TENDER), most=3).collect()) == 3


def test_noise_and_headings(spark):
    texts = ["--- PAGE 3 ---", "Page 4 of 9", "17", ".......", "Tender No.", "SCOPE OF WORK ITEMS", "4.2 GENERAL TERMS", "ALL LAMPS SHALL GLOW", "AS PER IS 123", "plain text"]
    rows = frame(spark, *texts).select("doc_id", C.is_noise(F.col("text")).alias("n"), C.is_heading(F.col("text")).alias("h")).orderBy("doc_id").collect()
    assert [r.n for r in rows] == [True] * 5 + [False] * 5
    assert [r.h for r in rows][5:] == [True, True, False, False, False]


def test_designations_and_ids(spark):
    row = spark.range(1).select(
        V.base_designation(F.lit("IS 10"), F.lit("Part 5"), F.lit("Sec 3")).alias("a"), V.base_designation(F.lit("IS 10 (Part 5)"), F.lit("Part 5"), F.lit(None)).alias("b"),
        V.designation(F.lit("IS 26"), F.lit(None), F.lit(None), F.lit(2015), F.array(F.lit(1), F.lit(2))).alias("c"), V.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("www.example.com")).alias("d"),
    ).first()
    import uuid

    assert (row.a, row.b, row.c, row.d) == ("IS 10 (Part 5/Sec 3)", "IS 10 (Part 5)", "IS 26:2015 Amd.2", str(uuid.uuid5(uuid.NAMESPACE_DNS, "www.example.com")))
