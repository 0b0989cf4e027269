"""Quality rules: hashed n-gram log-likelihood ratio of documents between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into BUCKETS, a fixed number of features as in
importance resampling with hashed n-grams. The raw multinomial counts them over every document; the
target multinomial over all trusted documents but a quarter by hash. A document's score is the mean
over its n-grams of log(target share / raw share), so texts of all lengths compare. The cut is
deterministic: the CUT quantile of the scores of the trusted documents that the target was not counted
from (those of the quarter), less MARGIN; every document is held against it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 16
BROADCAST_IDS = 1 << 20  # 16 MB of ids; more are joined by a shuffle
GRID = 10_000  # scores are compared in steps of 1 / GRID when the cut is taken
CUT = 0.01
MARGIN = 0.1
MIN_WORDS = 50
MAX_REPEAT = 50
_SYMBOLS = b"#*$%&|<>"
_ID_BITS = 21


class _Words(dict):
    """Numbers for words, and the words' hashes. Three numbers fit into 63 bits."""

    def __init__(self):
        self.hash: list[int] = []
        self.table = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hash)
        self.hash.append(zlib.crc32(word))
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.hash):
            self.table = np.append(self.table, np.array(self.hash[len(self.table) :], np.uint64))
        return self.table[numbers]

    def room(self) -> None:
        if len(self.hash) > 400_000:
            self.__init__()
            self.clear()


def _grams(h: np.ndarray) -> np.ndarray:
    """Buckets of the words and of the pairs."""
    mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate((h % np.uint64(BUCKETS), (mixed >> np.uint64(40)) % np.uint64(BUCKETS))).astype(np.int64)


def _repeat_words(numbers: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(numbers) < 4:
        return 0
    if int(numbers.max()) >> _ID_BITS:  # more different words than the packed form has room for
        order = np.lexsort((numbers[2:], numbers[1:-1], numbers[:-2]))
        same = np.ones(len(order) - 1, bool)
        for k in range(3):
            same &= numbers[order[1:] + k] == numbers[order[:-1] + k]
    else:
        key = (numbers[:-2] << 2 * _ID_BITS) | (numbers[1:-1] << _ID_BITS) | numbers[2:]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(numbers), bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _words_of(known: _Words, raw: bytes) -> tuple[list[bytes], np.ndarray]:
    words = raw.split()
    known.room()
    return words, known.numbers(words)


def _raw(text) -> bytes:
    return text.as_py().encode("utf-8") if text.is_valid else b""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, raw, target = _Words(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, trusted in zip(batch.column("text"), batch.column("trusted").to_pylist()):
            words, numbers = _words_of(known, _raw(text))
            if words:
                grams = _grams(known.hashes(numbers))
                for table in (raw, target) if trusted else (raw,):
                    if len(grams) < BUCKETS // 64:
                        np.add.at(table, grams, 1)
                    else:
                        table += np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _mean_ratio(ratio: np.ndarray, h: np.ndarray) -> float:
    return float(ratio[_grams(h)].mean()) if len(h) else 0.0


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                string = text.as_py() or ""
                raw = string.encode("utf-8")
                words, numbers = _words_of(known, raw)
                lines = [x for x in raw.split(b"\n") if x.strip()] if words else []
                blank = len(raw) - len(b"".join(words))
                repeat = _repeat_words(numbers)
                failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(words)
                out.append((len(words), len(string) - blank, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, _mean_ratio(ratio, known.hashes(numbers))))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trusted"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "trusted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"])

    return run


_KIND = "doc_id long, trusted boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double"


def _cut(scores: DataFrame, share: float) -> float | None:
    """The score at this share of the rows, on the grid; null without rows. One row for each step comes to the driver."""
    steps = scores.groupBy(F.floor(F.col("score") * GRID).alias("step")).count().orderBy("step").collect()  # log ratios span some 30
    wanted, seen = share * (sum(r["count"] for r in steps) - 1), 0
    for r in steps:
        seen += r["count"]
        if seen > wanted:
            return r["step"] / GRID
    return None


def quality(docs: DataFrame, trusted: DataFrame, cut: float = CUT, margin: float = MARGIN, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Per document: the base figures, base_failed, score, threshold and kept.

    docs has doc_id and text; trusted has the doc_ids of good documents: three in four, by hash, are
    the target, the others give the threshold; other columns don't matter. A null text has no words; a
    text of any length is counted whole. A text without n-grams scores 0. A score equal to the threshold
    is kept. Without trusted documents all scores are 0 and the base rules alone decide. Repeated
    doc_ids give a row each, null ones too: they are never trusted. No documents: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = stored(ids.withColumn("trusted", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 > 0), "trusted")
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    marked = docs.join(side, "doc_id", "left")  # trusted: true in the target, false in the quarter, else null
    counted = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # BUCKETS rows at most
    counts = np.zeros((2, BUCKETS))
    for bucket, *n in counted:
        counts[:, bucket] = n
    share = [(c + 0.5) / (c.sum() + 0.5 * BUCKETS) for c in counts]
    ratio = np.log(share[1] / share[0]) if counts[1].any() else np.zeros(BUCKETS)
    scored = stored(marked.mapInArrow(_scorer(ratio), _KIND), "scores")  # figures only, no texts
    low = _cut(scored.where("not trusted and not base_failed"), cut)
    threshold = low - margin if low is not None else 0.0
    return scored.drop("trusted").withColumn("threshold", F.lit(threshold)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
