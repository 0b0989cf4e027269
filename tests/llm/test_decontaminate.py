import hashlib
import random
import re

from tenderweave.llm import decontaminate
from tenderweave.llm.decontaminate import _Search, contamination, decontaminated


def brute(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if of := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= of
        joined = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def make(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, [d], "x") for d, t in docs], "doc_id long, text string, items array<long>, hits string"),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int"),
    )


def test_against_brute_force_in_one_and_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "Bee", "see", "dé", "longerword1", "longerword2", "7"])
    items = [(i, " ".join(word() for _ in range(rng.choice([10, 12, 30])))) for i in range(12)]
    items += [(20, "only three words"), (21, "one"), (22, ""), (23, None), (24, items[0][1]), (24, items[0][1]), (25, "!!"), (-3, items[1][1].upper())]
    docs = []
    for d in range(80):
        parts = [word() for _ in range(rng.randrange(0, 600 if d % 9 == 0 else 60))]
        if d % 2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items)[1] or "")
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(80, None), (81, ""), (82, "..."), (5, docs[7][1]), (5, docs[7][1]), (83, "only Three-words one")]
    expected = brute(docs, items)
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 3000)
    for size in (1 << 20, 400):
        got = contamination(*make(spark, docs, items), block_bytes=size)
        assert sorted(tuple(r) for r in got.collect()) == expected
        clean = decontaminated(*make(spark, docs, items), block_bytes=size)
        assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in expected if not r[5])


def test_no_items_no_documents(spark):
    docs, items = make(spark, [(1, "a b c")], [])
    assert [r.contaminated for r in contamination(docs, items).collect()] == [False]
    docs, items = make(spark, [], [(1, "a b c")])
    assert contamination(docs, items).collect() == []


def test_tables_grow_with_the_patterns_and_still_skip():
    few, many = ({" ".join(f"w{k}x{i}" for i in range(10)).encode(): [k] for k in range(n)} for n in (10, 20_000))
    assert _Search(10, few).bits == 12 and _Search(10, many).bits == 20
    assert (_Search(10, many).shift > 0).mean() > 0.95
