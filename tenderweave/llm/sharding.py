"""Sharding by fixed virtual slots and a versioned slot map.

Records hash into SLOTS slots by doc_id. The bytes of each slot are added up, and a map gives every
slot a shard: slots by falling size, each to the shard with the fewest bytes so far. The map is a
table of at most SLOTS rows with a version; growing edits it, moving slots to the new shard only.
The law is `bytes`: shards hold nearly equal bytes. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLOTS = 4096
SHARDS = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot); a null text has no bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def new_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: (version, vslot, shard, bytes, n, first). first is the number of the slot's first row in its shard."""
    entry = F.struct((-F.col("bytes")).alias("less"), "vslot", "bytes", "n")  # sorts by falling bytes, then slot
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.expr("cast(array() as array<int>)").alias("shard"))

    def place(acc, slot):
        least = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda x, i: F.when(i == least - 1, x + slot["bytes"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(acc["shard"], F.array(least - 1)).alias("shard"))

    one = sizes.agg(F.array_sort(F.collect_list(entry)).alias("slots"))  # SLOTS entries at most
    placed = one.select("slots", F.aggregate("slots", start, place)["shard"].alias("shards"))
    rows = placed.select(F.explode(F.arrays_zip("slots", "shards")).alias("x")).select(F.lit(1).alias("version"), "x.slots.vslot", F.col("x.shards").alias("shard"), "x.slots.bytes", "x.slots.n")
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number `shards` added: every other shard gives it the slots beyond
    its new share, in the order of their hashes; no slot moves between old shards."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    running, whole = F.sum("bytes").over(order), F.sum("bytes").over(Window.partitionBy("shard"))
    stays = running * (shards + 1) <= whole * shards
    moved = slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(stays, F.col("shard")).otherwise(F.lit(shards)).alias("shard"), "bytes", "n")
    return _numbered(moved)


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    slot numbers the rows of a shard from 0 without gaps (by virtual slot, then doc_id). docs has
    doc_id and text; other columns don't matter. Null doc_ids share a slot; rows that repeat a doc_id
    share one too, and copies of a text spread over all slots. grown_shard is null under this law.
    No documents: no rows.
    """
    rows = records(docs, slots)
    slot_map = stored(new_map(slot_sizes(rows), shards), "slot-map")
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(slot_map), "vslot").select(  # SLOTS rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version")
    )
