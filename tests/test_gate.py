from pyspark.sql import functions as F

from tenderweave.operators import gate as G

CASES = {
    "IS 10322": None, "N95 mask": None, "12345": "no_analysable_content", "  ": "empty", None: "empty", "qwertyuiop": "no_meaningful_content", "asdfghjkl zzzzzz": "no_meaningful_content", "kjh gfd saq": "no_meaningful_content",
    "borewell": None, "PVC THD MCB": None, "fhbjfbdjvfdjhbdf dhdjfhfjfjfjfjsjs qwertyuiop tubewell": None, "fhbjfbdj dhdjfhfj qwertyuio bcdfghjkl tubewell": "dominated_by_gibberish", "fhbjfbdj dhdjfhfj qwertyuio bcdfghjkl IS 456": None,
    "पानी का पंप": None, "230V": None, "IE3": None, "?!": "no_analysable_content", "lengthy": None,
}


def test_gate(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id int, text string")
    got = {r.doc_id: r for r in G.quality_gate(df).collect()}
    assert [got[k].reason for k in range(len(CASES))] == list(CASES.values())
    assert all(got[k].meaningful == (got[k].reason is None) for k in got)
    at = lambda t: got[list(CASES).index(t)]
    assert at("kjh gfd saq").rejected == ["kjh", "gfd"] and (at("kjh gfd saq").n_short, at("kjh gfd saq").n_malformed) == (1, 2)
    assert at("fhbjfbdj dhdjfhfj qwertyuio bcdfghjkl tubewell").rejected == ["fhbjfbdj", "dhdjfhfj", "qwertyuio", "bcdfghjkl"]
    assert at("पानी का पंप").n_foreign >= 3 and at("N95 mask").code and at("230V").specification and at("IS 10322").designation
    cut = spark.createDataFrame([(1, "12345 borewell")], "doc_id int, text string")
    assert G.quality_gate(cut, sample=5).first().reason == "no_analysable_content" and G.quality_gate(cut).first().reason is None


def test_keyboard_runs_and_pages(spark):
    rows = [("qwerty",), ("qwert",), ("poiuyt",), ("asasas",), ("letter",), ("a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(G.keyboard_run(F.col("t"))).collect()]
    assert got == [True, False, True, True, False, False]
    texts = [("--- PAGE 1 ---\nx\n  --- page 2 ---\n",), ("x --- page 2 --- y",), (None,)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").coalesce(1).select(G.page_count(F.col("t"))).collect()] == [2, 1, 1]


def test_marks_end_at_letters_of_other_scripts(spark):
    said = {"éIS 10322": "designation", "IS 10322é": "designation", "Iſ 123": "designation", "90 Wé": "specification", "çIP66": "specification", "5 \u212ag": "specification", "N95é": "code", "9µA3": "code"}
    unsaid = {"IS\x0b10322": "designation", "90\x0bW": "specification", "AIS 10322": "designation", "90 Wx": "specification", "N-95": "code"}
    df = spark.createDataFrame(list(enumerate([*said, *unsaid])), "doc_id int, text string")
    got = {r.doc_id: r for r in G.quality_gate(df).collect()}
    assert [got[k][mark] for k, mark in enumerate([*said.values(), *unsaid.values()])] == [True] * len(said) + [False] * len(unsaid)
