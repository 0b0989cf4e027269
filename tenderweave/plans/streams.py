"""Queries of the streams: each reads a given table as a stream, runs it to its end, and returns what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import ensure_checkpoint_dir, table
from ..streaming import keyed
from ..streaming import state as S
from ..streaming.tables import KeyedTable
from .base import FETCHES, plain
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Fetches with all that the sync state keeps.
SYNCS = """
    SELECT concat('https://host', user_id % 50, '.example.org/', user_id % 300) AS url, ts, event_id AS seq, event_type NOT IN ('error', 'signup') AS ok,
           CASE event_id % 4 WHEN 0 THEN concat('e', event_id) WHEN 1 THEN '' ELSE NULL END AS etag, CASE WHEN event_id % 5 = 0 THEN concat('d', event_id) ELSE NULL END AS last_modified,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('h', user_id * 31 % 200) END AS hash, event_type AS status
    FROM {events}"""

#: What a portal says about standards, with the payload it came in.
PORTAL = """
    SELECT concat('IS ', user_id % 250) AS number, CAST(2000 + user_id % 3 AS INT) AS year, concat('title ', event_id % 11) AS title, event_type AS status,
           CASE WHEN event_id % 6 = 0 THEN concat('IS ', event_id % 90) WHEN event_id % 6 = 1 THEN '' ELSE NULL END AS superseded_by, props AS detail, ts, event_id AS seq
    FROM {events}"""


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its files. The table may be one file, which a stream takes only from a pattern."""
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path)


def streamed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, events=stream(spark, sf_dir, "events"))


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """A folder for what a run writes and one for its checkpoint, in the shared place."""
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{top}/out", f"{top}/checkpoint"


_STATES = f"""
    WITH f AS (SELECT * FROM ({plain(FETCHES)})),
         s AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY ts, seq) AS b, row_number() OVER (PARTITION BY hash ORDER BY ts, seq) AS n FROM f WHERE hash <> '')
    SELECT seq, url, CASE WHEN b = hash THEN 'unchanged' WHEN b IS NOT NULL THEN 'modified' WHEN n > 1 THEN 'duplicate_url' ELSE 'new' END AS state FROM s
    UNION ALL SELECT seq, url, 'new' FROM f WHERE hash = ''"""

_VERSIONS = f"""
    WITH RECURSIVE f AS (SELECT * FROM ({plain(FETCHES)})),
         s AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY ts, seq) AS parent FROM f WHERE hash <> ''),
         m AS (SELECT * FROM s WHERE hash IS DISTINCT FROM parent),
         p AS (SELECT hash, url, ts, parent FROM m QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts, seq) = 1),
         r AS (SELECT hash, 1 AS version FROM p WHERE parent IS NULL UNION ALL SELECT p.hash, r.version + 1 FROM p JOIN r ON p.parent = r.hash),
         u AS (SELECT hash, count(DISTINCT url) AS n, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM m WHERE parent IS NULL GROUP BY hash)
    SELECT p.hash, p.url AS canonical_url, p.ts AS first_seen, r.version::INT AS version_count, coalesce(u.n, 0)::BIGINT AS n_urls, coalesce(u.urls, '') AS urls
    FROM p JOIN r ON r.hash = p.hash LEFT JOIN u ON u.hash = p.hash"""


@query("t1_document_stream", _STATES)
def t1_stream(spark, sf):
    out, checkpoint = folders(spark, "documents")
    keyed.run_documents(streamed(spark, sf, FETCHES), out, checkpoint)
    return keyed.stream_results(spark, out).select("seq", "url", "state")


@query("t1_document_versions", _VERSIONS)
def t1_versions(spark, sf):
    fetches = spark.sql(FETCHES, events=table(spark, sf, "events")).select("url", "hash", "ts", "seq")
    ensure_checkpoint_dir(spark)
    return S.document_versions(fetches).withColumn("urls", F.array_join("urls", " "))


_SYNC = f"""
    WITH e AS (SELECT * FROM ({plain(SYNCS)})),
         g AS (SELECT *, max((ts, seq)) FILTER (WHERE ok) OVER (PARTITION BY url) AS good FROM e)
    SELECT url, arg_max(etag, (ts, seq)) FILTER (WHERE ok AND etag <> '') AS etag, arg_max(last_modified, (ts, seq)) FILTER (WHERE ok AND last_modified <> '') AS last_modified,
           arg_max(hash, (ts, seq)) FILTER (WHERE ok AND hash <> '') AS hash, arg_max(status, (ts, seq)) AS status,
           count(*) FILTER (WHERE NOT ok AND (good IS NULL OR (ts, seq) > good)) AS errors, max(seq) FILTER (WHERE (ts, seq) = top) AS seq
    FROM (SELECT *, max((ts, seq)) OVER (PARTITION BY url) AS top FROM g) GROUP BY url"""


@query("t2_sync_states", _SYNC)
def t2_states(spark, sf):
    return S.sync_states(spark.sql(SYNCS, events=table(spark, sf, "events"))).drop("ts")


@query("t2_url_sync_stream", _SYNC)
def t2_stream(spark, sf):
    out, checkpoint = folders(spark, "sync")
    keyed.run_url_sync(streamed(spark, sf, SYNCS), out, checkpoint).awaitTermination()
    return keyed.latest_sync(spark, out).drop("ts", "silent")


@query(
    "t2_conditional_headers",
    f"""SELECT url, concat_ws(' ', 'If-None-Match=' || etag, 'If-Modified-Since=' || last_modified) AS headers FROM ({_SYNC})""",
)
def t2_headers(spark, sf):
    headers = keyed.conditional_headers(S.sync_states(spark.sql(SYNCS, events=table(spark, sf, "events"))))
    return headers.select("url", F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("headers"))


_PORTAL = f"p AS (SELECT *, sha256(json(detail)::VARCHAR) AS fingerprint FROM ({plain(PORTAL)}))"
_SYNCED = f"""
    WITH {_PORTAL}
    SELECT number, year, arg_min(title, (ts, seq)) AS title, arg_max(status, (ts, seq)) AS status, arg_max(superseded_by, (ts, seq)) FILTER (WHERE superseded_by <> '') AS superseded_by,
           arg_max(fingerprint, (ts, seq)) AS fingerprint, max(ts) AS ts FROM p GROUP BY number, year"""


@query("t3_catalogue_stream", _SYNCED)
def t3_stream(spark, sf):
    out, checkpoint = folders(spark, "catalogue")
    S.run_catalogue_sync(streamed(spark, sf, PORTAL), out, checkpoint).awaitTermination()
    return KeyedTable(spark, f"{out}/rows", S.SYNCED, ["number"]).as_of().drop("seq")


@query(
    "t3_catalogue_changes",
    f"""WITH {_PORTAL}, c AS (SELECT *, row_number() OVER w AS n, lag(fingerprint) OVER w AS b FROM p WINDOW w AS (PARTITION BY number, year ORDER BY ts, seq))
        SELECT number, year, seq, CASE WHEN n = 1 THEN 'inserted' WHEN b = fingerprint THEN 'unchanged' ELSE 'changed' END AS change FROM c""",
)
def t3_changes(spark, sf):
    batch = spark.sql(PORTAL, events=table(spark, sf, "events"))
    return S.catalogue_changes(spark.createDataFrame([], S.SYNCED), batch)[1].drop("ts")


@query(
    "t8_closed_windows",
    """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
       SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def t8_closed(spark, sf):
    out, checkpoint = folders(spark, "windows")
    events = stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_windowed_activity(events, out, checkpoint).awaitTermination()
    closed = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(out)
    return closed.withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})
