from pyspark.sql import functions as F

from tenderweave.functions.normalize import key_tight
from tenderweave.operators import merging as M


def test_merged_records(spark):
    standards = spark.createDataFrame(
        [("IS 1", (True, "own")), ("is  2", (None, None)), ("IS 3", None), (None, (False, "no"))],
        "is_number string, certification_requirements struct<applicable: boolean, details: string>",
    )
    orders = spark.createDataFrame([(1, "IS 2", "SO 1", "M", None, "crs", ["a", "b"]), (2, "is   2", None, "N", "2024", None, None), (3, "IS 9", "SO 9", "M", "2023", "crs", []), (4, None, "SO 0", "M", "x", "crs", [])],
        "order_pos int, is_number string, gazette_so_number string, issuing_ministry string, effective_date string, certification_scheme string, products_covered array<string>")
    got = {r.is_number: r for r in M.merged_records(standards, orders, key_tight(F.col("is_number"))).collect()}
    assert len(got) == 4 and not got["IS 1"].qco_notified and tuple(got["IS 1"].certification_requirements) == (True, None, None, None, None, "own")
    two = got["is  2"]
    assert (two.qco_notified, two.qco_gazette_so_number, two.qco_issuing_ministry, two.certification_scheme, two.qco_products_covered, two.qco_source_url) == (True, None, "N", None, None, None)
    assert two.unified_sources == ["BIS", "QCO"] and two.certification_requirements.details == "Mandatory under QCO Gazette Notification N/A issued by N. Effective from 2024." and two.certification_requirements.mandatory
    assert tuple(got["IS 3"].certification_requirements) == (None, False, None, None, None, None) and got[None].qco_enriched is False and got[None].certification_requirements.mandatory is None
    lists = sorted((r.kind, str(r.is_number)) for r in M.merge_lists(standards, orders, key_tight(F.col("is_number"))).collect())
    assert lists == [("bis_only", "IS 1"), ("bis_only", "IS 3"), ("bis_only", "None"), ("matched", "is  2"), ("orphaned", "IS 9")]
