"""Document, URL, catalogue and window state: batch forms by windows and aggregates, and streams over keyed tables.

The streams of documents and of URLs keep their state in Spark's state store (`keyed`); the ones here keep
what users query, so it lies in tables (`tables.KeyedTable`) of which a batch rewrites only what it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..functions.payloads import canonical_fingerprint
from ..operators.catalogue import upsert_rows
from .tables import KeyedTable


def document_state(fetches: DataFrame) -> DataFrame:
    """fetches (url, hash, ts, seq) with state: new, unchanged, modified or duplicate_url.

    The last hash of the same URL decides between unchanged and modified; a URL seen for the first time
    is a duplicate if its hash was seen before anywhere. An empty or null hash is always new and leaves no trace.
    """
    blank = fetches.where("coalesce(hash, '') = ''").withColumn("state", F.lit("new"))
    seen = fetches.where("coalesce(hash, '') <> ''")
    before = F.lag("hash").over(Window.partitionBy("url").orderBy("ts", "seq"))
    first = F.row_number().over(Window.partitionBy("hash").orderBy("ts", "seq")) == 1
    state = F.when(before == F.col("hash"), "unchanged").when(before.isNotNull(), "modified").when(~first, "duplicate_url").otherwise("new")
    return seen.withColumn("state", state).unionByName(blank)


def versions(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """(hash, canonical_url, first_seen, version_count, n_urls, urls) of each content.

    firsts (hash, url, ts, parent): the first sighting of each hash, parent being the hash that its URL had just
    before, null where the URL had none. A content's version is its place in the chain of parents, counted from 1;
    chains are followed in strides that double, so rounds grow with the logarithm of the longest. links (hash, url):
    URLs whose first content it was.
    """
    first = F.row_number().over(Window.partitionBy("hash").orderBy("ts", "url"))
    firsts = firsts.withColumn("_n", first).where("_n = 1").drop("_n")
    chain = firsts.select("hash", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps")).checkpoint()
    while chain.where("jump IS NOT NULL").limit(1).count():
        on = chain.select(F.col("hash").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"))
        chain = chain.join(on, "jump", "left").select("hash", F.col("_jump").alias("jump"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")).checkpoint()
    urls = links.distinct().groupBy("hash").agg(F.count("*").alias("n_urls"), F.array_sort(F.collect_list("url")).alias("urls"))
    known = firsts.join(chain, "hash").join(urls, "hash", "left")
    return known.select(
        "hash", F.col("url").alias("canonical_url"), F.col("ts").alias("first_seen"), (F.col("steps") + 1).alias("version_count"),
        F.coalesce("n_urls", F.lit(0)).cast("long").alias("n_urls"), F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
    )


def document_versions(fetches: DataFrame) -> DataFrame:
    """versions() of all fetches (url, hash, ts, seq): empty and null hashes leave no trace. A URL that first had a
    content counts among its URLs; one that changed to it doesn't. A new content of a changed URL is one version on
    from what the URL had; going back to an old content keeps that one's version."""
    seen = fetches.where("coalesce(hash, '') <> ''")
    marked = seen.withColumn("parent", F.lag("hash").over(Window.partitionBy("url").orderBy("ts", "seq"))).where("NOT hash <=> parent")
    first = F.row_number().over(Window.partitionBy("hash").orderBy("ts", "seq"))
    firsts = marked.withColumn("_n", first).where("_n = 1").select("hash", "url", "ts", "parent")
    return versions(firsts, marked.where("parent IS NULL").select("hash", "url"))


def url_sync_state(events: DataFrame) -> DataFrame:
    """(url, etag, hash, status, errors) after all events (url, ts, seq, ok, etag, hash, status): the last
    ETag and hash that were given, the last status, and the errors since the last success."""
    order = Window.partitionBy("url").orderBy("ts", "seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = events.withColumn("_run", F.sum(F.col("ok").cast("int")).over(order)).withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("seq"))))
    marked = marked.withColumns({"etag": F.last("etag", True).over(whole), "hash": F.last("hash", True).over(whole), "_last": F.max("_run").over(Window.partitionBy("url"))})
    return marked.groupBy("url").agg(
        F.max(F.when(F.col("_n") == 1, F.col("etag"))).alias("etag"), F.max(F.when(F.col("_n") == 1, F.col("hash"))).alias("hash"), F.max(F.when(F.col("_n") == 1, F.col("status"))).alias("status"),
        F.count_if((F.col("_run") == F.col("_last")) & ~F.col("ok")).alias("errors"),
    )


def sync_states(events: DataFrame) -> DataFrame:
    """(url, etag, last_modified, hash, status, errors, ts, seq) of each URL after all events (url, ts, seq, ok, etag,
    last_modified, hash, status): the last that a success gave (empty counts as not given), the last status, and the
    failures since the last success."""
    at = F.struct("ts", "seq")
    given = {c: F.when(F.col("ok") & (F.coalesce(c, F.lit("")) != ""), F.struct(at, F.col(c).alias("v"))) for c in ("etag", "last_modified", "hash")}
    good = F.max(F.when(F.col("ok"), at)).over(Window.partitionBy("url"))
    marked = events.withColumn("_bad", ~F.col("ok") & F.coalesce(at > good, F.lit(True)))
    return marked.groupBy("url").agg(
        *[F.max(v)["v"].alias(c) for c, v in given.items()], F.max_by("status", at).alias("status"), F.count_if("_bad").alias("errors"), F.max(at).alias("_at")
    ).select("url", "etag", "last_modified", "hash", "status", "errors", "_at.ts", "_at.seq")


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows of event time; as a stream, rows later than `late` drop out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_windowed_activity(stream: DataFrame, folder: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Starts windowed_activity of a stream into folder. A window is written once, when the watermark (the greatest
    event time of the batches before, less `late`) has passed its end; rows of windows that are closed by then are
    dropped, and `late_rows` counts them."""
    out = windowed_activity(stream, width, late).writeStream.format("parquet").option("path", folder)
    return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators have dropped as late, over the batches whose progress it still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def analysis_status(events: DataFrame, key: str) -> DataFrame:
    """(key, status, n): the latest status of each key, ties by the greatest seq."""
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("n"))


def ingest(state: DataFrame, target: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of ingestion: (outcomes, new state, new target) of fetches batch (url, hash, ts, seq, code, and the
    columns of target but version).

    Code 304 and an unchanged hash are unchanged, a code of 400 or more is failed; neither touches target. The last
    row of a key by (ts, seq) that is left replaces that of target; its version is its seq. state is the last fetch
    with a hash of each URL: only that decides whether a fetch is unchanged.
    """
    columns = ["url", "hash", "ts", "seq"]
    fetched = batch.where("code < 400 and code <> 304")
    every = state.select(columns).withColumn("_old", F.lit(True)).unionByName(fetched.select(columns).withColumn("_old", F.lit(False))).where("coalesce(hash, '') <> ''")
    before = F.lag("hash").over(Window.partitionBy("url").orderBy("ts", "seq"))
    same = every.withColumn("_same", F.coalesce(before == F.col("hash"), F.lit(False))).where("not _old and _same").select("url", "seq", "_same")
    last = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("seq")))
    kept = every.withColumn("_n", last).where("_n = 1").select(columns)
    told = batch.join(same, ["url", "seq"], "left")
    outcome = F.when(F.col("code") == 304, "unchanged").when(F.coalesce("code", F.lit(500)) >= 400, "failed").when(F.col("_same"), "unchanged").otherwise("success")
    told = told.withColumn("outcome", outcome).drop("_same")
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    fresh = told.where("outcome = 'success'").withColumn("version", F.col("seq")).withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return told, kept, upsert_rows(target, fresh.select(target.columns), key)


def run_ingest_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, fields: list[str], buckets: int = 64) -> StreamingQuery:
    """Starts ingestion of a stream. State and catalogue are keyed tables (folder/state, folder/catalogue): a batch
    rewrites the buckets of the URLs and keys that it has rows of, and no others; outcomes of batch n go to
    folder/outcomes/n. A batch run again after a failure overwrites its own files and starts from what the one before left."""
    spark = stream.sparkSession
    kinds = {f.name: f for f in stream.schema.fields}
    state = KeyedTable(spark, f"{folder}/state", StructType([kinds[c] for c in ("url", "hash", "ts", "seq")]), ["url"], buckets)
    target = KeyedTable(spark, f"{folder}/catalogue", StructType([*[kinds[c] for c in fields], StructField("version", kinds["seq"].dataType)]), [key], buckets)

    def handle(batch: DataFrame, n: int) -> None:
        urls, keys = state.touched(batch), target.touched(batch)
        old = state.as_of(n - 1).where(state.bucket().isin(urls))
        rows = target.as_of(n - 1).where(target.bucket().isin(keys))
        outcomes, kept, rows = ingest(old, rows, batch, key)
        outcomes.write.mode("overwrite").parquet(f"{folder}/outcomes/{n}")
        state.write(n, urls, kept)
        target.write(n, keys, rows)
        state.prune(n)
        target.prune(n)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalogue_changes(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state after the batch, what each row of the batch did): capture of changes by fingerprint.

    batch (number, year, title, status, superseded_by, detail, ts, seq); state has these columns without detail and with
    fingerprint. A fingerprint is of the canonical JSON of detail. Rows of a (number, year) apply in order of (ts, seq);
    all of them together move it to the last status, the last superseded_by that was given, and the last fingerprint,
    while title stays what it was first. A row is `inserted` if it is the first of its (number, year), otherwise
    `changed` or `unchanged` by the fingerprint before it.
    """
    order = Window.partitionBy("number", "year").orderBy("_old", "ts", "seq")
    news = batch.withColumn("fingerprint", canonical_fingerprint(F.col("detail"))).withColumn("_old", F.lit(1))
    every = state.withColumn("_old", F.lit(0)).unionByName(news.drop("detail"))
    before = F.lag("fingerprint").over(order)
    marked = every.withColumns({"_row": F.row_number().over(order), "change": F.when(F.row_number().over(order) == 1, "inserted").when(before.eqNullSafe(F.col("fingerprint")), "unchanged").otherwise("changed")})
    told = marked.where("_old = 1").select("number", "year", "ts", "seq", "change")
    at = F.struct("_old", "ts", "seq")
    after = every.groupBy("number", "year").agg(
        F.min_by("title", at).alias("title"), F.max_by("status", at).alias("status"),
        F.max(F.when(F.coalesce("superseded_by", F.lit("")) != "", F.struct(at, "superseded_by")))["superseded_by"].alias("superseded_by"),
        F.max_by("fingerprint", at).alias("fingerprint"), F.max(at).alias("_at"),
    )
    return after.select("number", "year", "title", "status", "superseded_by", "fingerprint", "_at.ts", "_at.seq"), told


SYNCED = "number string, year int, title string, status string, superseded_by string, fingerprint string, ts timestamp, seq long"


def run_catalogue_sync(stream: DataFrame, folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Starts catalogue_changes of a stream over the keyed table folder/rows; changes of batch n go to folder/changes/batch=n.
    Buckets without rows of the batch keep their files, and a batch run again overwrites only its own."""
    table = KeyedTable(stream.sparkSession, f"{folder}/rows", SYNCED, ["number"], buckets)

    def handle(batch: DataFrame, n: int) -> None:
        touched = table.touched(batch)
        after, told = catalogue_changes(table.as_of(n - 1).where(table.bucket().isin(touched)), batch)
        told.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")
        table.write(n, touched, after)
        table.prune(n)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
