import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tenderweave.llm.packing import LENGTHS, Left, best_fit, cost, opened, pack


def slow_open(size, rest, lengths):
    """The least-cost length, by filling each bin from a sorted copy of the rest."""
    options = []
    for c in lengths:
        if c >= size:
            room, full = c - size, size
            for r in sorted(rest, reverse=True):
                if r <= room:
                    room, full = room - r, full + r
            options.append((round(cost(min(x for x in lengths if x >= full)) / full, 9), c))
    return min(options)[1]


def slow_pack(sizes, lengths):
    """The same policy by scanning all bins."""
    bins = []
    for k, size in enumerate(sizes):
        fit = [i for i, (c, u) in enumerate(bins) if c - u >= size]
        if fit:
            least = min(bins[i][0] - bins[i][1] for i in fit)
            b = [i for i in fit if bins[i][0] - bins[i][1] == least]
        else:
            bins.append([slow_open(size, sizes[k + 1 :], lengths), 0])
            b = [len(bins) - 1]
        chosen = yield b
        bins[chosen][1] += size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_every_piece_takes_the_tightest_bin(sizes):
    sizes.sort(reverse=True)
    lengths = (8, 16, 32, 60)
    where, at, final = pack(sizes, lengths)
    slow, used = slow_pack(sizes, lengths), defaultdict(int)
    for k, size in enumerate(sizes):
        allowed = next(slow) if k == 0 else slow.send(where[k - 1])
        assert where[k] in allowed
        assert at[k] == used[where[k]]
        used[where[k]] += size
    for b, c in enumerate(final):
        assert c == min(x for x in lengths if x >= used[b])


def test_lengths_are_weighed_against_each_other():
    assert opened(10, Left([]), (512, 1024)) == 512
    assert opened(10, Left([10] * 100_000), LENGTHS) == 2048
    assert opened(3000, Left([10] * 100_000), LENGTHS) == 4096
    assert opened(1500, Left([1100] * 100), LENGTHS) == 8192  # 2048 would stay a quarter empty


def test_lengths_together_cost_less_than_any_alone():
    rng = random.Random(8)
    mixes = [[rng.choice([1500, 1100, 700]) for _ in range(2000)], [rng.choice([500, 510, 900, 4000]) for _ in range(2000)], [min(8192, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(4000)]]
    for sizes in mixes:
        sizes.sort(reverse=True)
        total = lambda lengths: sum(cost(c) for c in pack(sizes, lengths)[2])
        assert total(LENGTHS) < min(total((c,)) for c in LENGTHS if c >= sizes[0])


def test_pieces_of_long_documents_fill_groups(spark):
    df = spark.createDataFrame([(1, "w " * 40_000), (None, "w " * 30_000), (1, "w " * 40_000)], "doc_id long, text string")
    rows = best_fit(df, (16, 64), group=200).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.bin_id >> 32] += 1
    assert sum(r.n_tokens for r in rows) == 110_003 and len(groups) == 9 and max(groups.values()) < 300


def test_every_token_once(spark):
    rng = random.Random(2)
    docs = [(d, " ".join(["w"] * rng.choice([0, 1, 30, 700, 2500, 9000, 20000]))) for d in range(150)] + [(900, None), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in docs], "doc_id long, text string, bin_id int, part string")
    rows = best_fit(df).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin_id].append(r)
    for d, t in docs:
        total = sum(r.n_tokens for r in by_doc[d])
        assert total == (6 if d == 5 else 0) + (0 if d == 5 else len((t or "").split()) + 1) + (len(docs[5][1].split()) + 1 if d == 5 else 0)
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.bin_start)
        at = 0
        for r in rs:
            assert r.bin_start == at
            at += r.n_tokens
        assert {(r.bin_length, r.bin_tokens) for r in rs} == {(min(c for c in LENGTHS if c >= at), at)}
    assert sum(r.n_tokens for r in rows) / sum(rs[0].bin_length for rs in by_bin.values()) > 0.95
    assert best_fit(df.limit(0)).collect() == []
