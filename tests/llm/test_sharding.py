import random
import zlib
from collections import defaultdict

from tenderweave.llm.sharding import grown_map, new_map, records, sharded, slot_sizes


def make(spark):
    rng = random.Random(8)
    docs = [(d, "é" * rng.randrange(0, 900) if d % 3 else "copy " * 40) for d in range(2000)] + [(5000, None), (5001, ""), (7, "again"), (7, "again"), (5002, "x" * 20000)]
    return docs, spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, shard string, size int")


def test_rows_bytes_and_numbers(spark):
    docs, df = make(spark)
    rows = sharded(df).collect()
    expected = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    load, numbers = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        numbers[r.shard].append(r.slot)
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values())
    assert sharded(df.limit(0)).collect() == []


def test_slots_take_the_lightest_shard(spark):
    _, df = make(spark)
    sizes = {r.vslot: r.bytes for r in slot_sizes(records(df, 64)).collect()}
    load, expected = [0] * 3, {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        expected[slot] = k = load.index(min(load))
        load[k] += size
    assert {r.vslot: r.shard for r in new_map(slot_sizes(records(df, 64)), 3).collect()} == expected


def test_growing_moves_slots_to_the_new_shard_only(spark):
    _, df = make(spark)
    old = new_map(slot_sizes(records(df)), 8)
    before = {r.vslot: r for r in old.collect()}
    after = {r.vslot: r for r in grown_map(old, 8).collect()}
    assert before.keys() == after.keys() and {r.version for r in after.values()} == {2}
    assert all(r.shard in (8, before[k].shard) for k, r in after.items())
    load = defaultdict(int)
    for r in after.values():
        load[r.shard] += r.bytes
    assert len(load) == 9 and max(load.values()) < 1.3 * sum(load.values()) / 9
