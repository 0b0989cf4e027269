import hashlib
import random
import zlib

import numpy as np
import pytest

from tenderweave.llm.runs import collapsed, grouped, periodic_runs, runs_of, stretches


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            smaller = any(all(w[x] == w[x + q] for x in range(s, e - q)) for q in range(1, p))
            if e - s >= max(6, 4 * p) and not smaller:
                out.append((s, e - s, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(w):
    def lyndon(x):
        return all(x < x[k:] for k in range(1, len(x)))

    return [max(k for k in range(1, len(w) - i + 1) if lyndon(w[i : i + k])) for i in range(len(w))]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_grouping_gives_the_lyndon_array(letters):
    rng = random.Random(letters)
    for n in [*range(1, 12), 30, 40]:
        for _ in range(6):
            w = [rng.randrange(letters) for _ in range(n)]
            length, group = grouped(w)
            assert length == brute_lyndon(w)
            for i in range(n):
                for j in range(n):
                    assert (group[i] == group[j]) == (w[i : i + length[i]] == w[j : j + length[j]])


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_runs_are_those_of_the_definition(letters):
    rng = random.Random(letters)
    for n in [0, 1, 5, 6, 7, 12, 30, 60, 90]:
        for _ in range(25):
            w = [rng.randrange(letters) for _ in range(n)]
            if n > 20:  # a planted repetition, with something behind it or not
                p, s = rng.randrange(1, 9), rng.randrange(n // 2)
                for i in range(s + p, min(n, s + p * rng.randrange(3, 7) + rng.randrange(p + 1))):
                    w[i] = w[i - p]
            assert runs_of(np.array(w, np.int64)) == brute_runs(w), w


def test_stretches_leave_ordinary_text_out():
    w = np.random.default_rng(1).integers(0, 300, 20000)
    w[5000:6000] = np.tile(np.arange(50) + 1000, 20)
    assert [b - a >= 1000 and a <= 5000 for a, b in stretches(w)] == [True]
    big = np.concatenate([np.arange(1 << 20, (1 << 20) + 40), np.tile([7, 1 << 21, 9], 8)])  # names beyond 20 bits
    assert runs_of(big) == [(40, 24, 3)]


def brute(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *((*best, best[1] * 1000 // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_rows(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["a", "b", "ü x", "the　end"]) for _ in range(rng.randrange(60))), "x", 1) for i in range(120)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (502, " \t\n", "x", 1), (503, "no " * 3000, "x", 1), (None, "go on " * 9, "x", 1), (3, "a\x0bb\x0ca b a b a b", "x", 1), (3, "a b", "x", 1)]
    rows += [(10_000 + i, "one two three four five six seven eight nine ten " * 3, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int")
    got = sorted(map(tuple, periodic_runs(docs, tails=True).collect()), key=str)
    assert got == sorted((brute(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got) > 3
    assert periodic_runs(docs.limit(0)).count() == 0
    out = {r["doc_id"]: r for r in collapsed(docs.where("doc_id >= 500 and doc_id < 510")).collect()}
    assert out[503]["collapsed"] == "no" and [tuple(x) for x in out[503]["runs"]] == [(0, 3000, 1)] and out[500]["collapsed"] == "" and out[500]["runs"] == []
