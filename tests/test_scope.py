from tenderweave.operators import scope as S

STANDARDS = [
    (1, "PVC insulated cables for wiring", None, "", "IS 1", "active"),
    (2, "Cross Linked Polyethylene (XLPE) insulated, PVC sheathed cables", None, "", "IS 2", "active"),
    (3, "Rubber insulated cables", "also for XLPE cores", "", "IS 3", "active"),
    (4, "Paper insulated cables", None, "", "IS 4", "withdrawn"),
    (5, "Paper insulated lines", None, "", "IS 5", "active"),
    (6, "Wooden doors", None, "", "IS 6", "active"),
    (7, "cross linked  Polyethylene (XLPE) insulated lines", None, "", "IS 7", "active"),
    (8, "Oil filled Polyvinyl (PVX) insulated and Polymer (PVX) insulated cords", None, "", "IS 8", "active"),
]
PAIRS = [
    (1, 1, "1.1 kV XLPE insulated cable"), (2, 2, "with XLPE insulation"), (3, 3, "xlpe insulated"), (4, 1, "paper insulated lead"), (5, 1, "PVC insulated or XLPE insulated"),
    (6, 6, "XLPE insulated"), (7, 1, "well insulated"), (8, 2, "PVC sheathed and cross linked polyethylene insulated"), (9, 1, "PVX insulated"), (10, 1, None), (11, 2, "rubber sheathed"),
]


def frames(spark):
    standards = spark.createDataFrame(STANDARDS, "std_id long, title string, scope string, keywords string, designation string, status string")
    return standards, spark.createDataFrame(PAIRS, "req_id long, std_id long, text string")


def test_materials_of_titles(spark):
    standards, _ = frames(spark)
    got = sorted((r.std_id, r.attribute, r.phrase) for r in S.materials_in(standards, ["std_id"], "title").collect())
    assert got[:5] == [(1, "insulated", "PVC"), (2, "insulated", "Cross Linked Polyethylene (XLPE)"), (2, "sheathed", "PVC"), (3, "insulated", "Rubber"), (4, "insulated", "Paper")]


def test_vocabulary_leaves_ambiguous_aliases_and_withdrawn_cover_out(spark):
    alias, covers = S.material_vocabulary(frames(spark)[0])
    known = {(r.attribute, r.alias): r.material for r in alias.collect()}
    assert known["insulated", "xlpe"] == known["insulated", "cross linked polyethylene"] and ("insulated", "pvx") not in known
    by = {(r.attribute, r.material): (r.spelling, r.designations) for r in covers.collect()}
    assert by["insulated", "paper"] == ("Paper", ["IS 5"])
    assert by["insulated", "cross linked polyethylene (xlpe)"] == ("Cross Linked Polyethylene (XLPE)", ["IS 2", "IS 7"])


def test_scope_check(spark):
    standards, pairs = frames(spark)
    got = {r.req_id: r for r in S.scope_check(pairs, standards).collect()}
    assert len(got) == len(PAIRS)
    assert {k for k, r in got.items() if r.mismatch} == {1, 4}
    assert {k for k, r in got.items() if r.checked} == {1, 2, 3, 4, 8}
    assert (got[1].attribute, got[1].as_written, got[1].covered, got[1].alternatives) == ("insulated", "xlpe", "PVC", ["IS 2", "IS 7"])
    assert got[4].alternatives == ["IS 5"] and got[2].alternatives == []
