"""Best-fit packing with bins of several permitted sequence lengths.

Pieces are taken by falling size. A piece goes into the open bin that it leaves with the least room.
If none has room, a bin opens, and the permitted lengths compete for it: for each length the bin is
filled in thought, always with the largest of the pieces still to place that fits, and shrunk to the
least permitted length that holds this; the length with the least cost for a token wins, where
c tokens of sequence cost

    OVERHEAD + c + c * c / QUADRATIC

So a length is chosen for what is really left to fill it: short ones pay their fixed part, long ones
their attention, and each what stays empty. At the end each bin shrinks to the least permitted length
that holds its contents. Documents longer than the greatest length are cut into pieces of that length.

Pieces are dealt by hash into groups of about GROUP pieces, whatever documents they are of; a group
is packed by one task. Only lengths travel, never texts. A group leaves few bins part-filled, so groups
cost next to nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP = 8192
OVERHEAD = 64
QUADRATIC = 1 << 16


def cost(c: int) -> float:
    return OVERHEAD + c + c * c / QUADRATIC


class Left:
    """The sizes still to place: distinct ones in rising order, and how many there are of each."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size], self.sizes[bisect_left(self.sizes, size)]

    def filled(self, room: int) -> int:
        """Of a bin with this room: what is filled if the largest size that fits goes in again and again."""
        start, k = room, len(self.sizes)
        while room and (k := bisect_right(self.sizes, room, 0, k)):
            size = self.sizes[k - 1]
            room -= size * min(self.count[size], room // size)
            k -= 1
        return start - room


def opened(size: int, left: Left, lengths: tuple[int, ...]) -> int:
    """The permitted length with the least cost for a token of what would fill it; left is without the piece. Ties: the shorter."""
    best, chosen = None, lengths[-1]
    for c in lengths:
        if c >= size:
            full = size + left.filled(c - size)
            worth = cost(next(x for x in lengths if x >= full)) / full
            if best is None or worth < best - 1e-12:
                best, chosen = worth, c
    return chosen


def pack(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """For sizes by falling size: bin and offset of each, and the final length of each bin."""
    rooms: list[int] = []  # distinct free rooms, ascending
    bins_of: dict[int, list[int]] = {}
    used: list[int] = []
    where, at, left = [], [], Left(sizes)

    def give(room: int, b: int) -> None:
        if room not in bins_of:
            bins_of[room] = []
            insort(rooms, room)
        bins_of[room].append(b)

    for size in sizes:
        left.take(size)
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = bins_of[room].pop()
            if not bins_of[room]:
                del bins_of[room], rooms[k]
        else:
            b, room = len(used), opened(size, left, lengths)
            used.append(0)
        where.append(b)
        at.append(used[b])
        used[b] += size
        if room > size:
            give(room - size, b)
    return where, at, [min(c for c in lengths if c >= u) for u in used]


def _packer(lengths: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable", na_position="last")
        where, at, final = pack(pdf["n_tokens"].tolist(), lengths)
        used = [0] * len(final)
        for b, n in zip(where, pdf["n_tokens"].tolist()):
            used[b] += n
        first = int(pdf["part"].iloc[0]) << 32
        return pdf.assign(bin_id=[first + b for b in where], bin_start=at, bin_length=[final[b] for b in where], bin_tokens=[used[b] for b in where])[["doc_id", "piece", "doc_start", "n_tokens", "bin_id", "bin_start", "bin_length", "bin_tokens"]]

    return run


def word_tokens(text: str = "text") -> Column:
    """Words of the text and an end token."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, doc_start, n_tokens, bin_id, bin_start, bin_length, bin_tokens.

    docs has doc_id and text (or what `tokens` counts); other columns don't matter. By default the
    tokens are words: a document has its words and an end token, so null and empty texts have one.
    Give `tokens` where sequences are measured in a tokenizer's ids. Documents without tokens give no
    piece; very long ones give many, dealt over all groups. Equal sizes go by doc_id, null ones last.
    Repeated doc_ids are packed a row each. Every token is in exactly one bin; no documents: no bins.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tokens if tokens is not None else word_tokens()).cast("long").alias("n")).where("n > 0")
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")  # counted once; row numbers stay
    count = F.floor((F.col("n") - 1) / most) + 1
    groups = max(1, -(-(sized.agg(F.sum(count)).first()[0] or 0) // group))
    pieces = sized.select("row", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.select("row", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("doc_start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens"))
    part = F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int")
    kind = "doc_id long, piece int, doc_start long, n_tokens int, bin_id long, bin_start int, bin_length int, bin_tokens int"
    return pieces.withColumn("part", part).groupBy("part").applyInPandas(_packer(lengths), kind)
