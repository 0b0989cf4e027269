"""Queries that write what Spark derives from the given tables, and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..sources import records as R
from ..sources.storage import ensure_checkpoint_dir, table
from .base import view
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _json(text: str) -> str:
    """SQL that makes a text; << and >> stand for braces, @x@ for the value of the expression x."""
    pieces = text.replace("<<", "@chr(123)@").replace(">>", "@chr(125)@").split("@")
    return "concat(" + ", ".join(p if k % 2 else f"'{p}'" for k, p in enumerate(pieces) if p) + ")"


_WHOLE = _json('<<"std_id": @p_partkey@, "is_number": "IS @p_partkey@", "title": "@p_name@", "more": 1>>')
#: Lines of a catalogue file: whole records, some without number or title, some cut off, some of a wrong type.
LINES = f"""
    SELECT p_partkey AS std_id, CASE p_partkey % 9
        WHEN 0 THEN {_json('<<"std_id": @p_partkey@, "is_number": "IS @p_partkey@", "tit')}
        WHEN 1 THEN {_json('<<"std_id": @p_partkey@, "is_number": "", "title": "@p_name@">>')}
        WHEN 2 THEN {_json('<<"std_id": @p_partkey@, "is_number": "IS @p_partkey@">>')}
        WHEN 3 THEN {_json('<<"std_id": "x@p_partkey@", "is_number": "IS 1", "title": "t">>')}
        WHEN 4 THEN {_json('<<"std_id": @p_partkey@, "title": " ">>')} ELSE {_WHOLE} END AS value
    FROM {{part}}"""

#: Payloads of portals: objects with a title here or there, arrays, single values, and broken ones.
PAYLOADS = f"""
    SELECT p_partkey AS doc_id, CASE p_partkey % 8
        WHEN 0 THEN {_json('<<"a": [1, 2, <<"x": null>>], "description": "On @p_type@", "title": "@p_name@">>')}
        WHEN 1 THEN {_json('[<<"k": @p_size@>>, "@p_brand@", true]')}
        WHEN 2 THEN {_json('<<"is_number": "IS @p_partkey@", "name": "", "scope": "For @p_brand@">>')}
        WHEN 3 THEN {_json('<<"title": "@p_name@"')}
        WHEN 4 THEN {_json('"@p_name@"')}
        WHEN 5 THEN {_json('<<"description": null, "name": "@p_name@", "scope": [@p_size@, 2], "title": 0>>')}
        WHEN 6 THEN '' ELSE {_json('@p_size@')} END AS body
    FROM {{part}}"""


@query(
    "s4_read_records",
    "SELECT p_partkey AS std_id, concat('IS ', p_partkey) AS is_number, p_name AS title FROM part WHERE p_partkey % 9 > 4",
)
def s4_records(spark, sf):
    path = folder(spark, "lines")
    view(spark, sf, LINES).select("value").write.text(path)
    return R.drop_bad_records(R.read_records(spark, path, "std_id long, is_number string, title string"), ["is_number", "title"])


@query(
    "s4_record_counts",
    """SELECT count(*) AS n_read, count(*) FILTER (WHERE k IN (0, 3)) AS n_corrupt, count(*) FILTER (WHERE k > 4) AS n_kept,
       count(*) FILTER (WHERE k IN (1, 4)) AS no_is_number, count(*) FILTER (WHERE k IN (2, 4)) AS no_title FROM (SELECT p_partkey % 9 AS k FROM part)""",
)
def s4_counts(spark, sf):
    path, seen = folder(spark, "lines"), Observation("records")
    view(spark, sf, LINES).select("value").write.text(path)
    kept = R.drop_bad_records(R.read_records(spark, path, "std_id long, is_number string, title string"), ["is_number", "title"], seen)
    kept.write.parquet(folder(spark, "kept"))
    return spark.createDataFrame([seen.get], "n_read long, n_corrupt long, n_kept long, no_is_number long, no_title long")


@query(
    "s8_json_payloads",
    f"""WITH d AS (SELECT doc_id, body, CASE WHEN body <> '' AND json_valid(body) THEN body::JSON END AS j FROM ({PAYLOADS.replace("{part}", "part")})),
        o AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j WHEN j IS NOT NULL THEN json_object('items', j) END AS p FROM d)
        SELECT doc_id, CASE WHEN p IS NULL THEN 'MALFORMED' ELSE 'SUCCESS' END AS status, json(p)::VARCHAR AS payload, octet_length(encode(body))::INT AS n_bytes,
               CASE WHEN body <> '' THEN sha256(body) END AS digest,
               coalesce(nullif(nullif(p->>'$.title', ''), '0'), nullif(p->>'$.name', ''), nullif(p->>'$.is_number', '')) AS title, coalesce(p->>'$.description', p->>'$.scope') AS description
        FROM o""",
)
def s8_payloads(spark, sf):
    return R.json_documents(view(spark, sf, PAYLOADS), "body", ["title", "name", "is_number"], ["description", "scope"]).drop("body")


@query(
    "s2_pairs_round_trip",
    """SELECT l_orderkey * 10 + l_linenumber AS pair_id, l_returnflag AS group_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS semantic,
       [l_tax, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_discount END] AS scores FROM lineitem""",
)
def s2_pairs(spark, sf):
    gap = lambda n: F.when(F.col("l_linenumber") % n == 0, F.lit(float("nan")))
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_returnflag").alias("group_id"), gap(3).otherwise(F.col("l_quantity")).alias("semantic"), F.array("l_tax", gap(2).otherwise(F.col("l_discount"))).alias("scores")
    )
    return R.round_trip(rows, folder(spark, "pairs"))


_CATALOGUE = "SELECT p_partkey AS std_id, concat('IS ', p_partkey) AS is_number, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' revised' ELSE '' END) AS title FROM part"


@query("s5_publish_catalogue", _CATALOGUE)
def s5(spark, sf):
    path, rows = folder(spark, "catalogue"), table(spark, sf, "part").select(F.col("p_partkey").alias("std_id"), F.concat(F.lit("IS "), F.col("p_partkey").cast("string")).alias("is_number"), F.col("p_name").alias("title"))
    R.publish(rows, path, "std_id", rows)
    revised = rows.withColumn("title", F.concat("title", F.when(F.col("std_id") % 3 == 0, " revised").otherwise("")))
    return R.publish(revised, path, "std_id", rows)


@query("s10_insert_strict", "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer")
def s10(spark, sf):
    path = folder(spark, "evidence")
    target = R.publish(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), path, "key")
    added = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000000).alias("key"), F.col("c_name").alias("name"))
    return R.publish(C.insert_strict(target, added, "key"), f"{path}-next", "key", target)
