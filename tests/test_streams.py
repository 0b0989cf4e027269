import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tenderweave.functions import payloads
from tenderweave.streaming import keyed
from tenderweave.streaming import state as S
from tenderweave.streaming.tables import KeyedTable, upserted

KIND = "url string, hash string, ts timestamp, seq long"


def at(k):
    return datetime(2024, 1, 1) + timedelta(minutes=k)


FETCHES = [
    ("u1", "a", at(0), 1), ("u1", "a", at(1), 2), ("u1", "b", at(2), 3), ("u2", "a", at(3), 4), ("u1", "a", at(4), 5), ("u3", "", at(5), 6),
    ("u3", None, at(6), 7), ("u3", "c", at(7), 8), ("u2", "c", at(8), 9), ("u4", "b", at(9), 10), ("u4", "d", at(10), 11), ("u4", "e", at(11), 12), ("u5", "e", at(12), 13),
]
STATES = {1: "new", 2: "unchanged", 3: "modified", 4: "duplicate_url", 5: "modified", 6: "new", 7: "new", 8: "new", 9: "modified", 10: "duplicate_url", 11: "modified", 12: "modified", 13: "duplicate_url"}
VERSIONS = {"a": (1, ["u1", "u2"]), "b": (2, ["u4"]), "c": (1, ["u3"]), "d": (3, []), "e": (4, ["u5"])}


def test_document_state_in_keyed_store(spark, tmp_path):
    df = spark.createDataFrame(FETCHES, KIND)
    assert {r.seq: r.state for r in S.document_state(df).collect()} == STATES
    assert {r.hash: (r.version_count, r.urls) for r in S.document_versions(df).collect()} == VERSIONS
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for a, b in ((0, 3), (3, 4), (4, 13)):  # each run goes on from the checkpoint of the one before
        df.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        if b == 4:  # the second step fails to run once: the next run takes up what it missed
            keyed.start_moves(stream, out, f"{check}/moves").awaitTermination()
        else:
            keyed.run_documents(stream, out, check)
    assert {r.seq: r.state for r in keyed.stream_results(spark, out).collect()} == STATES
    assert {r.hash: (r.version_count, r.urls) for r in keyed.stream_versions(spark, out).collect()} == VERSIONS


def test_long_chain_of_versions(spark):
    rows = [("u", f"h{k}", at(k), k) for k in range(40)] + [("v", "h39", at(50), 50), ("v", "x", at(51), 51)]
    got = {r.hash: r.version_count for r in S.document_versions(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {**{f"h{k}": k + 1 for k in range(40)}, "x": 41}
    assert S.document_versions(spark.createDataFrame([], KIND)).count() == 0


EVENTS = "url string, ts timestamp, seq long, ok boolean, etag string, last_modified string, hash string, status string"


def test_url_sync_stream_equals_batch(spark, tmp_path):
    rows = [("u", at(0), 1, True, "e1", None, "h1", "success"), ("u", at(1), 2, False, "no", None, None, "failed"), ("u", at(2), 3, False, None, None, "no", "failed"), ("v", at(2), 4, False, None, None, None, "blocked")]
    rows += [("u", at(3), 5, True, "", "Mon", None, "unchanged"), ("v", at(4), 6, False, None, None, None, "failed"), ("u", at(600), 7, False, None, None, None, "failed"), ("w", at(601), 8, True, "w", None, "h9", "success")]
    df = spark.createDataFrame(rows, EVENTS)
    want = {"u": ("e1", "Mon", "h1", "failed", 1), "v": (None, None, None, "failed", 2), "w": ("w", None, "h9", "success", 0)}
    pick = lambda df: {r.url: (r.etag, r.last_modified, r.hash, r.status, r.errors) for r in df.collect()}
    assert pick(S.sync_states(df)) == want
    source = str(tmp_path / "in")
    for a, b in ((0, 4), (4, 6), (6, 8)):
        df.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        keyed.run_url_sync(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        keyed.run_url_sync(stream, str(tmp_path / "timed"), str(tmp_path / "check2"), silence="2 hours").awaitTermination()
    latest = keyed.latest_sync(spark, str(tmp_path / "out"))
    assert pick(latest) == want
    assert {r.url: r.headers for r in keyed.conditional_headers(latest).collect()} == {"u": {"If-None-Match": "e1", "If-Modified-Since": "Mon"}, "v": {}, "w": {"If-None-Match": "w"}}
    silent = spark.read.parquet(str(tmp_path / "timed")).where("silent").select("url", "seq").collect()
    assert {(r.url, r.seq) for r in silent} == {("v", 6)}  # u came again with the batch that moved the watermark on
    assert {r.url: r.silent for r in keyed.latest_sync(spark, str(tmp_path / "timed")).collect()} == {"u": False, "v": True, "w": False}


def test_keyed_table_leaves_other_buckets_alone(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, n long", ["k"], 8)
    last = upserted(["k"], [F.desc("n")])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    t.change(0, rows(*[(f"k{i}", 0) for i in range(40)]), last)
    files = {f: os.path.getmtime(f) for f in glob.glob(str(tmp_path / "t/*/*/*.parquet"))}
    for _ in range(2):  # the same batch twice
        t.change(1, rows(("k3", 5), ("k3", 4), ("new", 1)), last)
    assert {f: os.path.getmtime(f) for f in files} == files
    touched = t.touched(rows(("k3", 0), ("new", 0)))
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in glob.glob(str(tmp_path / "t/*/batch=1/*"))} == set(touched)
    assert {r.k: r.n for r in t.as_of().collect()} == {**{f"k{i}": 0 for i in range(40)}, "k3": 5, "new": 1}
    assert {r.n for r in t.as_of(0).collect()} == {0}
    replaced = [b for b in touched if os.path.exists(tmp_path / f"t/bucket={b}/batch=0")]
    assert t.prune(1) == 0 and t.prune(2) == len(replaced)
    assert {r.k: r.n for r in t.as_of().collect()}["k3"] == 5 and t.as_of().count() == 41


def test_catalogue_sync_stream(spark, tmp_path):
    kind = "number string, year int, title string, status string, superseded_by string, detail string, ts timestamp, seq long"
    rows = [
        ("IS 1", 2000, "one", "active", None, '{"a": 1, "b": [1, {"y": 2, "x": 1}]}', at(0), 1), ("IS 2", 2001, "two", "active", "IS 9", '{"a": 2}', at(0), 2),
        ("IS 1", 2000, "other", "active", None, '{"b": [1, {"x": 1, "y": 2}], "a": 1}', at(1), 3), ("IS 1", 2000, "other", "withdrawn", "IS 3", '{"a": 5}', at(2), 4),
        ("IS 2", 2001, "two", "withdrawn", None, '{"a": 3}', at(3), 5), ("IS 2", 2010, "two", "active", None, "no json", at(3), 6), ("IS 2", 2010, "two", "active", None, "no json", at(4), 7),
    ]
    for a, b in ((0, 2), (2, 4), (4, 7)):
        spark.createDataFrame([r for r in rows if a < r[-1] <= b], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        S.run_catalogue_sync(stream, str(tmp_path / "out"), str(tmp_path / "check"), 16).awaitTermination()
        if a == 0:
            files = {f: os.path.getmtime(f) for f in glob.glob(str(tmp_path / "out/rows/*/*/*.parquet"))}
        if a == 2:  # IS 2 had no row in this batch: its file stays
            assert sum(os.path.getmtime(f) == t for f, t in files.items()) == len(files) >= 1
    table = KeyedTable(spark, str(tmp_path / "out/rows"), S.SYNCED, ["number"], 16)
    assert {(r.number, r.year, r.title, r.status, r.superseded_by) for r in table.as_of().collect()} == {("IS 1", 2000, "one", "withdrawn", "IS 3"), ("IS 2", 2001, "two", "withdrawn", "IS 9"), ("IS 2", 2010, "two", "active", None)}
    changes = {r.seq: r.change for r in spark.read.parquet(str(tmp_path / "out/changes")).collect()}
    assert changes == {1: "inserted", 2: "inserted", 3: "unchanged", 4: "changed", 5: "changed", 6: "inserted", 7: "unchanged"}
    after, _ = S.catalogue_changes(spark.createDataFrame([], S.SYNCED), spark.createDataFrame(rows, kind))
    assert sorted(map(str, after.collect())) == sorted(map(str, table.as_of().collect()))


def test_late_rows_drop_out(spark, tmp_path):
    kind = "ts timestamp, event_type string, value double"
    batches = [[(at(5), "view", 1.0), (at(30), "view", 2.0)], [(at(200), "view", 4.0), (at(50), "view", 8.0)], [(at(10), "view", 16.0), (at(195), "click", 32.0), (at(400), "view", 1.0)]]
    late = 0
    for b in batches:
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = S.run_windowed_activity(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        late += S.late_rows(q)
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(at(0), "view"): (3, 11.0), (at(180), "view"): (1, 4.0), (at(180), "click"): (1, 32.0)} and late == 1


@pytest.mark.parametrize("text,want", [('{"b": {"z": 1, "a": [3, {"q": null, "c": "x y"}]}, "a": 1.5}', '{"a":1.5,"b":{"a":[3,{"c":"x y","q":null}],"z":1}}'), ("[2, 1]", "[2,1]"), ("nope", None), ("", None), (None, None)])
def test_canonical_json(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(payloads.canonical_json(F.col("t"))).first()[0] == want


def test_state_is_read_once_and_written_only_when_it_changes():
    class Last:
        def __init__(self, kept):
            self.kept, self.written = kept, []

        def get(self):
            return self.kept

        def update(self, value):
            self.written.append(value)

    fetch = lambda content, seq: Row(url="u", hash=content, ts=seq * 1000, seq=seq)
    for kept, said, moves, written in [(("a",), "aa", ["unchanged", "unchanged"], []), (("a",), "ab", ["unchanged", "modified"], [("b",)]), (None, "a", ["first"], [("a",)])]:
        step = keyed.UrlMoves()
        step.last = Last(kept)
        assert [r.move for r in step.handleInputRows(("u",), iter([fetch(c, n) for n, c in enumerate(said)]), None)] == moves
        assert step.last.written == written
