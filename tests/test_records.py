import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tenderweave.functions import payloads
from tenderweave.sources import records as R


def test_broken_lines_are_counted_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": "IS 1", "t": "one"}\n\n{"n": "IS 2", "t": \n{"n": null, "t": ""}\n{"n": "IS 3"}\nnot json\n{"n": {"x": 1}, "t": "kept as text"}\n{"n": "IS 4", "t": "four", "y": "1999x"}\n')
    seen = Observation("x")
    kept = R.drop_bad_records(R.read_records(spark, str(tmp_path), "n string, t string, y int"), ["n", "t"], seen)
    assert sorted(r.n for r in kept.collect()) == ["IS 1", '{"x": 1}'] and kept.columns == ["n", "t", "y"]
    assert seen.get == {"n_read": 7, "n_corrupt": 3, "n_kept": 2, "no_n": 1, "no_t": 2}
    plain = spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "n string, x int")
    assert [r.x for r in R.drop_bad_records(plain, ["n", "x"]).collect()] == [1]


def test_json_documents(spark):
    rows = [('{"name": "N", "title": "", "scope": false, "description": "D"}',), ("[1, {\"b\": 1, \"a\": 2}]",), ("7",), ("{",), ("",), (None,), ('{"title": ["x", "y"]}',)]
    got = [(r.status, r.payload, r.title, r.description) for r in R.json_documents(spark.createDataFrame(rows, "body string"), "body", ["title", "name"], ["scope", "description"]).collect()]
    assert got == [
        ("SUCCESS", '{"description":"D","name":"N","scope":false,"title":""}', "N", "D"), ("SUCCESS", '{"items":[1,{"a":2,"b":1}]}', None, None), ("SUCCESS", '{"items":7}', None, None),
        ("MALFORMED", None, None, None), ("MALFORMED", None, None, None), ("MALFORMED", None, None, None), ("SUCCESS", '{"title":["x","y"]}', '["x","y"]', None),
    ]


def test_fingerprints_ignore_the_order_of_keys(spark):
    rows = [('{"a": 1, "b": {"c": [1, 2], "d": null}}', '{ "b": {"d": null, "c": [1,2]}, "a":1}'), ("[1, 2]", "[2, 1]")]
    got = spark.createDataFrame(rows, "x string, y string").select(*[payloads.canonical_fingerprint(F.col(c)).alias(c) for c in "xy"]).collect()
    assert got[0].x == got[0].y and got[1].x != got[1].y


def test_publish_checks_before_it_replaces(spark, tmp_path):
    kind, path = "k long, v string", str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    first = R.publish(rows((1, "a"), (2, "b")), path, "k")
    with pytest.raises(ValueError, match="lost"):
        R.publish(rows((1, "z")), path, "k", must_hold=first)
    with pytest.raises(ValueError, match="duplicate"):
        R.publish(rows((1, "z"), (1, "y"), (2, "x")), path, "k", must_hold=first)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
    assert os.listdir(tmp_path) == ["t"]
    R.publish(rows((1, "z"), (2, "b"), (3, "c")), path, "k", must_hold=first)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "z"), (2, "b"), (3, "c")]
    assert os.listdir(tmp_path) == ["t"]


def test_round_trip_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("nan")], None), (2, 0.5, None, "x")], "i int, d double, a array<double>, s string")
    assert sorted(map(tuple, R.round_trip(df, str(tmp_path / "j")).collect())) == [(1, None, [1.0, None], None), (2, 0.5, None, "x")]
