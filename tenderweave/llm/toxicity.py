"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is trained in numpy from confirmed toxic documents
(P) and unlabelled documents (U) with the class-prior-corrected, non-negative risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]),

where loss(z) = 1 / (1 + exp(z)), the bounded loss for which the estimator was proposed. Both samples
are bounded: the first POSITIVE and UNLABELLED ids by hash; copies of one text count once in each. Whole words and beginnings of 3 to 6 characters that occur in P far more often than in U (by a
z-score) are the features; they are counted by Spark over the samples. Every document is then scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

POSITIVE = 4000
UNLABELLED = 8000
FEATURES = 512
LEAST_Z = 6.0
LEAST_SHARE = 0.02
STEPS = 800
THRESHOLD = 0.3

CACHE_WORDS = 400_000

#: ASCII other than letters, digits and the apostrophe separates words.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8").translate(_TABLE).split()) if text else set()


def features_of(word: bytes) -> list[bytes]:
    """The whole word, and its beginnings of 3 to 6 characters."""
    text = word.decode("utf-8")
    return [b"=" + word, *(b"^" + text[:k].encode("utf-8") for k in range(3, min(6, len(text)) + 1))]


def train(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the intercept, that minimise the non-negative risk by full-batch Adam.

    x has a row of features for each document, positive tells P from U. Where the bracket is
    negative, its gradient alone is followed upwards, as the method's authors propose.
    """
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        negative = su.mean() - prior * sp.mean()
        d_p = (sp * (1 - sp)) @ p / len(p)
        d_negative = (su * (1 - su)) @ u / len(u) - prior * d_p
        d_positive = -prior * d_p
        grad = d_positive + d_negative if negative >= 0 else -d_negative
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([list({f for w in words(t.as_py()) for f in features_of(w)}) for t in batch.column("text")], pa.list_(pa.binary()))], ["positive", "words"])


def fit(docs: DataFrame, positive: DataFrame, pool: DataFrame, prior: float | None) -> tuple[list[bytes], np.ndarray]:
    """Words and their weights, the intercept last, from the confirmed toxic ids and the pool of unlabelled ids."""
    first = lambda ids, n: ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = stored(first(positive, POSITIVE).withColumn("positive", F.lit(True)).union(first(pool, UNLABELLED).withColumn("positive", F.lit(False))), "sample")
    sample = stored(docs.join(F.broadcast(ids), "doc_id").select("positive", "text").dropDuplicates(["positive", "text"]).mapInArrow(_present, "positive boolean, words array<binary>"), "words")  # ids are bounded
    n_u, n_p = (sample.where(F.col("positive") == flag).count() for flag in (False, True))
    if not n_p or not n_u:
        return [], np.array([-6.0])
    prior = min(max(prior if prior is not None else n_p / (n_p + n_u), 0.001), 0.9)
    counted = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    rate = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u) + 1e-12)
    chosen = counted.withColumn("z", z).where((F.col("z") >= LEAST_Z) & (F.col("p") >= max(3, LEAST_SHARE * n_p))).orderBy(F.desc("z"), "word").limit(FEATURES).select("word").collect()
    vocabulary = sorted(bytes(r[0]) for r in chosen)
    if not vocabulary:  # nothing tells toxic texts from others: a share of labels alone must not condemn all of them
        return [], np.array([-6.0])
    found = sample.select("positive", F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.expr("array(x'')")).alias("words")).collect()  # a row for each of the sample
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(found), len(vocabulary)), np.float32)
    for i, r in enumerate(found):
        x[i, [place[bytes(w)] for w in r["words"] if bytes(w) in place]] = 1
    order = np.lexsort((*x.T, np.array([r["positive"] for r in found])))  # the order of rows can't matter
    flags = np.array([r["positive"] for r in found], bool)
    return vocabulary, train(x[order], flags[order], prior)


class _Known(dict):
    """The model's features in a word. Forgets all at CACHE_WORDS."""

    def __init__(self, weight: dict[bytes, float]):
        self.weight = weight

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = tuple(f for f in features_of(word) if f in self.weight)
        return found


def _scores(vocabulary: list[bytes], weights: np.ndarray):
    """A function from a column of texts to their scores."""
    weight, intercept = dict(zip(vocabulary, weights.tolist())), float(weights[-1])
    known = _Known(weight)

    def score(texts: pa.Array) -> np.ndarray:
        g = []
        for text in texts:
            found = set()
            for some in map(known.__getitem__, words(text.as_py())):
                if some:
                    found.update(some)
            g.append(intercept + sum(weight[f] for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(g, np.float64), -700, 700)))

    return score


def _scorer(vocabulary: list[bytes], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(vocabulary, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score(batch.column("text")))], ["doc_id", "held_out", "score"])

    return run


def _filter(vocabulary: list[bytes], weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(vocabulary, weights)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text")) < threshold))

    return run


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame, prior: float | None) -> tuple[list[bytes], np.ndarray]:
    """fit() on the rows that are not held out."""
    labels = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~_held_out())
    if prior is None:
        prior = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_held_out())
    return fit(pool, labels.where("toxic = 1"), pool, prior)


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold).

    docs has doc_id and text, labels has doc_id and toxic; other columns don't matter. Rows whose
    crc32 of the doc_id modulo 4 is 2 are held out: neither their labels nor their texts are learnt
    from. prior is the share of toxic documents; by default that of the labelled rows learnt from.
    Of several labels of one doc_id the highest counts, null labels don't. A null or empty text gets
    the intercept's score; a very long one is read whole. Without toxic labels, and where no word tells
    toxic texts from others, every score is near 0 and no document is called toxic. Repeated doc_ids give a
    row each; no documents: no rows.
    """
    vocabulary, weights = learnt(docs, labels, prior)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", _held_out())
    scored = rows.mapInArrow(_scorer(vocabulary, weights), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold; else as toxicity()."""
    vocabulary, weights = learnt(docs, labels, prior)
    return docs.mapInArrow(_filter(vocabulary, weights, threshold), docs.schema)
