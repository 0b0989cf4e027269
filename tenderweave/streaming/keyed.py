"""State per key in Spark's state store: documents by URL and by content, and the sync state of URLs.

Each function starts a query over one stream and returns it. State lives in the store under the query's
checkpoint, so a batch reads and writes only the keys that it has rows of, and a restart goes on from there.
A key's rows of one micro-batch are put in order of (ts, seq) inside its task; bound them by the source's
own limit on files or offsets for a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "url string, hash string, ts timestamp, seq long, move string, before string"
SIGHTS = "hash string, url string, ts timestamp, seq long, state string, parent string, first boolean, linked boolean"
_MOVED, _SIGHTED = MOVES.replace("ts timestamp", "ts long"), SIGHTS.replace("ts timestamp", "ts long")  # as the processors give them
SYNC = "url string, etag string, last_modified string, hash string, status string, errors long, ts timestamp, seq long, silent boolean"


@contextmanager
def rocks(spark: SparkSession):
    """State of several variables to a key needs the RocksDB store; a query keeps the one that it was started with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _counted(rows: DataFrame) -> DataFrame:
    """rows with ts in microseconds: a number goes to Python and back much cheaper than a timestamp, for every row."""
    return rows.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("ts"))


def _moment(micros: int | None) -> datetime | None:
    return None if micros is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros)


def _ordered(rows) -> list[Row]:
    return sorted(rows, key=lambda r: (r.ts, r.seq))


class UrlMoves(StatefulProcessor):
    """By URL: keeps its last hash; tells whether a fetch is the URL's first, unchanged, or a change and from what."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.last.get()
        kept = before = found[0] if found else None
        for r in _ordered(rows):
            if not r.hash:  # nothing is known of its content: new, and no trace of it stays
                yield Row(url=key[0], hash=r.hash, ts=r.ts, seq=r.seq, move="blank", before=None)
                continue
            move = "first" if before is None else "unchanged" if before == r.hash else "modified"
            yield Row(url=key[0], hash=r.hash, ts=r.ts, seq=r.seq, move=move, before=before if move == "modified" else None)
            before = r.hash
        if before is not None and (self.ttl_ms or before != kept):
            self.last.update((before,))

    def close(self) -> None:
        pass


class HashSights(StatefulProcessor):
    """By content hash: keeps that it was seen, and the URLs that brought it on their first fetch."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ts timestamp, seq long", self.ttl_ms)
        self.urls = handle.getMapState("urls", "url string", "ts timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.exists()
        for r in _ordered(rows):
            linked = False
            if r.move == "first" and not self.urls.containsKey((r.url,)):
                self.urls.updateValue((r.url,), (_moment(r.ts),))
                linked = True
            state = "modified" if r.move == "modified" else "duplicate_url" if known else "new"
            yield Row(hash=key[0], url=r.url, ts=r.ts, seq=r.seq, state=state, parent=r.before, first=not known, linked=linked)
            if not known:
                self.seen.update((_moment(r.ts), r.seq))
                known = True

    def close(self) -> None:
        pass


def _with_time(ttl_ms: int | None) -> str:
    return "ProcessingTime" if ttl_ms else "None"


def start_moves(fetches: DataFrame, folder: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Step one: fetches (url, hash, ts, seq) with what each one is to its URL, into folder/moves, each row once.

    ttl_ms: a URL that is not fetched for so long is forgotten, and new when it comes again."""
    with rocks(fetches.sparkSession):
        moves = _counted(fetches.select("url", "hash", "ts", "seq")).groupBy("url").transformWithState(UrlMoves(ttl_ms), _MOVED, "Append", _with_time(ttl_ms))
        return _timed(moves).writeStream.format("parquet").option("path", f"{folder}/moves").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_sights(spark: SparkSession, folder: str, checkpoint: str, ttl_ms: int | None = None, files: int = 1000) -> StreamingQuery:
    """Step two: the first fetches and changes among folder/moves by their hash, into folder/sights, each row once.

    Unchanged and blank fetches don't get here: they decide nothing, and they are most of a crawl. A micro-batch
    takes up to `files` files of step one, in the order they were written."""
    moves = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", files).parquet(f"{folder}/moves").where("move IN ('first', 'modified')")
    with rocks(spark):
        sights = _counted(moves).groupBy("hash").transformWithState(HashSights(ttl_ms), _SIGHTED, "Append", _with_time(ttl_ms))
        return _timed(sights).writeStream.format("parquet").option("path", f"{folder}/sights").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_documents(fetches: DataFrame, folder: str, checkpoint: str, ttl_ms: int | None = None) -> None:
    """Both steps over what the stream has now; called again, over what came since, also after a failure in between."""
    start_moves(fetches, folder, f"{checkpoint}/moves", ttl_ms).awaitTermination()
    start_sights(fetches.sparkSession, folder, f"{checkpoint}/sights", ttl_ms).awaitTermination()


def stream_results(spark: SparkSession, folder: str) -> DataFrame:
    """(url, hash, ts, seq, state) of every fetch so far."""
    moves = spark.read.parquet(f"{folder}/moves").where("move IN ('blank', 'unchanged')")
    plain = moves.select("url", "hash", "ts", "seq", F.when(F.col("move") == "blank", "new").otherwise("unchanged").alias("state"))
    return plain.unionByName(spark.read.parquet(f"{folder}/sights").select("url", "hash", "ts", "seq", "state"))


def stream_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What document_versions() gives, from the rows that the stream has written."""
    from .state import versions

    sights = spark.read.parquet(f"{folder}/sights")
    return versions(sights.where("first").select("hash", "url", "ts", "parent"), sights.where("linked").select("hash", "url"))


class UrlSync(StatefulProcessor):
    """By URL: its last ETag, date and hash that were given, its status, and its failures in a row; a timer for silence."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "etag string, last_modified string, hash string, status string, errors long, ts timestamp, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.state.get() if self.state.exists() else None
        etag, modified, content, status, errors, ts, seq = found if found else (None, None, None, None, 0, None, None)
        for r in _ordered(rows):
            if r.ok:
                etag, modified, content, errors = r.etag or etag, r.last_modified or modified, r.hash or content, 0
            else:
                errors += 1
            status, ts, seq = r.status, r.ts, r.seq
        self.state.update((etag, modified, content, status, errors, ts, seq))
        if self.silence_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(ts.timestamp() * 1000) + self.silence_ms)
        yield Row(url=key[0], etag=etag, last_modified=modified, hash=content, status=status, errors=errors, ts=ts, seq=seq, silent=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        etag, modified, content, status, errors, ts, seq = self.state.get()
        yield Row(url=key[0], etag=etag, last_modified=modified, hash=content, status=status, errors=errors, ts=ts, seq=seq, silent=True)

    def close(self) -> None:
        pass


def run_url_sync(events: DataFrame, folder: str, checkpoint: str, silence: str | None = None, late: str = "0 seconds") -> StreamingQuery:
    """Starts the sync state of a stream of events (url, ts, seq, ok, etag, last_modified, hash, status).

    After each batch the URLs that it touched are written to folder; with `silence` (as '6 hours') a URL also gets
    a row when event time has passed its last event by so much. `latest_sync` reads what holds now. A row later than
    `late` behind the watermark is dropped where silence is watched, as timers need event time."""
    spark = events.sparkSession
    kept = events.select("url", "ts", "seq", "ok", "etag", "last_modified", "hash", "status")
    ms = None
    if silence is not None:
        ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {silence})").first()[0])
        kept = kept.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    with rocks(spark):
        out = kept.groupBy("url").transformWithState(UrlSync(ms), SYNC, "Append", "EventTime" if ms is not None else "None")
        return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The last row of each URL; silent while nothing came since its timer."""
    newest = Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("seq"), F.desc("silent"))
    return spark.read.schema(SYNC).parquet(folder).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def conditional_headers(sync: DataFrame) -> DataFrame:
    """(url, headers): what to ask a server with, as far as something is known; a URL without either has an empty map."""
    pairs = F.array(
        F.struct(F.lit("If-None-Match").alias("k"), F.col("etag").alias("v")),
        F.struct(F.lit("If-Modified-Since").alias("k"), F.col("last_modified").alias("v")),
    )
    return sync.select("url", F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != "")).alias("headers"))
