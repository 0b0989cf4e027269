"""Candidate retrieval for batches of queries: token joins, exact vector search, fusion, and their evaluation.

Lexical scoring never crosses queries with rows: tokens that no query asks for leave first, then both
sides meet in an equi-join on the token. All tokens of a row are in one task until its scores are summed,
so pairs of queries and rows are made and ranked there and not moved.
Vectors are packed into chunks; each chunk of rows meets each chunk of queries once, in a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, norm, tokenize_set

#: Weights of a matching token by field.
WEIGHTS = {"number": 5.0, "title": 3.0, "scope": 1.5, "keyword": 2.0, "committee": 1.0, "council": 1.0}
CHUNK = 2048  # vectors in a chunk


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key into as many partitions as shuffles have, however little they are: each gives many pairs."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, token): distinct tokens of each field."""
    parts = F.array(*[F.struct(F.lit(name).alias("field"), tokenize_set(F.col(column)).alias("tokens")) for name, column in fields.items()])
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.field", F.explode("p.tokens").alias("token"))


def lexical_score(queries: DataFrame, catalogue: DataFrame, fields: dict[str, str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, std_id, score, matched): weighted number of common tokens over the fields; matched terms sorted.

    queries has query_id and query_text, catalogue std_id and the fields' columns. Pairs without a
    common token have no row.
    """
    asked = queries.select("query_id", F.explode(tokenize_set(F.col("query_text"))).alias("token"))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    wanted = postings(catalogue, "std_id", fields).join(asked.select("token").distinct(), "token", "left_semi")
    weighed = _dealt(wanted, "std_id").groupBy("std_id", "token").agg(F.sum(table[F.col("field")]).alias("weight"))
    return asked.join(weighed, "token").groupBy("query_id", "std_id").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("matched"))


def ranked(scored: DataFrame, by: list[Column], k: int | None, group: str = "query_id") -> DataFrame:
    """Rows with rank (1 is best), the first k of each group."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by)))
    return out.where(F.col("rank") <= k) if k else out


def _packed(key: str, chunk: int):
    """Rows of key and vec as chunks: ids and unit vectors of 64-bit floats, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), chunk):
                part = batch.slice(first, chunk)
                x = np.array(part.column("vec").to_pylist(), np.float64).reshape(len(part), -1)
                size = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(key).to_numpy().astype(np.int64).tobytes()]), pa.array([x.tobytes()])], ["ids", "vecs"])

    return run


def _best(k: int, least: float | None):
    """Of a chunk of queries and one of rows: the best k for each query, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                scores = np.round(np.frombuffer(r["q_vecs"]).reshape(len(q), -1) @ np.frombuffer(r["vecs"]).reshape(len(ids), -1).T, 12)
                out = []
                for i, row in enumerate(scores):
                    at = np.flatnonzero(row >= (np.partition(row, -k)[-k] if len(row) > k else -2))
                    at = at[np.lexsort((ids[at], -row[at]))[:k]]
                    at = at if least is None else at[row[at] >= least]
                    out.append((np.repeat(q[i], len(at)), ids[at], row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "std_id", "score"])

    return run


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query_id, std_id, score, rank): exact cosine; ties by std_id. queries and rows have integer ids and vec.

    Chunks of rows are dealt into as many groups as there are shuffle partitions, chunks of queries go to
    each group, so every pair of chunks meets in one row of an equi-join that spills; a task keeps the best
    k of a pair of chunks. Zero vectors score 0, null ones and null ids take no part. Vectors have one length.
    """
    groups = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = lambda df, key: df.select(key, "vec").where(F.col(key).isNotNull() & F.col("vec").isNotNull()).mapInArrow(_packed(key, chunk), "ids binary, vecs binary")
    dealt = chunks(rows, "std_id").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = chunks(queries, "query_id").select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    found = dealt.join(asked, "part").select("q_ids", "q_vecs", "ids", "vecs").mapInArrow(_best(k, least), "query_id long, std_id long, score double")
    return ranked(found, [F.desc("score"), F.asc("std_id")], k)


def hybrid_fuse(lexical: DataFrame, vectors: DataFrame, lexical_weight: float = 0.6, vector_weight: float = 0.4, k: int | None = None) -> DataFrame:
    """(query_id, std_id, score, rank, total): weighted sum of both scores, each brought to 0..1.

    Below 0.35 a candidate drops out, below 0.20 where the query has no vector hits and the lexical
    score stands alone. total counts what stays before the cut to k.
    """
    both = lexical.select("query_id", "std_id", F.col("score").alias("lex")).join(vectors.select("query_id", "std_id", F.col("score").alias("vec")), ["query_id", "std_id"], "full_outer")
    per_query = Window.partitionBy("query_id")
    most = F.max("lex").over(per_query)
    lex = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("lex"), F.lit(0.0)) / F.when(most > 0, most).otherwise(1.0)))
    raw = F.coalesce(F.col("vec"), F.lit(0.0))
    vec = F.when(raw != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw + 1) / 2))).otherwise(0.0)
    has = F.count("vec").over(per_query) > 0
    fused = both.select("query_id", "std_id", F.when(has, lexical_weight * lex + vector_weight * vec).otherwise(lex).alias("raw"), F.when(has, 0.35).otherwise(0.20).alias("cut")).where("raw >= cut")
    fused = fused.select("query_id", "std_id", F.round("raw", 4).alias("score"), F.count("*").over(per_query).alias("total"))
    return ranked(fused, [F.desc("score"), F.asc("std_id")], k)


def bm25_score(queries: DataFrame, rows: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, std_id, score): Okapi BM25 over runs of letters and digits of text.

    Lengths are sizes of token arrays; of a row's tokens only those that a query asks for go on, counted, and with
    them one empty token that carries the row itself into the corpus's length: texts are read once. Rows then
    meet the queries where all their tokens are.
    """
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("token"))
    split = rows.select("std_id", tokens(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens"))
    known = asked.select(F.explode(F.array("token", F.lit(""))).alias("token")).distinct()
    wanted = split.select("std_id", "len", F.explode(F.array_append("tokens", F.lit(""))).alias("token")).join(known, "token", "left_semi")
    tf = wanted.groupBy("std_id", "token", "len").agg(F.count("*").alias("tf"))
    # every branch takes all columns of tf, so that they share its shuffle
    df = tf.groupBy("token").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("len")).alias("tokens"))
    row = lambda c: F.max(F.when(F.col("token") == "", F.col(c))).alias(c)
    corpus = df.agg(row("n"), row("tokens"))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = df.select("token", "df").crossJoin(F.broadcast(corpus)).select("token", idf.alias("idf"), (F.col("tokens") / F.col("n")).alias("usual"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("usual")))
    parts = _dealt(tf.join(terms, "token").select("std_id", "token", part.alias("part")), "std_id")
    return parts.join(asked, "token").groupBy("query_id", "std_id").agg(F.sum("part").alias("score"))


def rrf_fuse(ranks: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, std_id, score): sum of 1 / (k + rank) over the lists in which a row stands."""
    return ranks.groupBy("query_id", "std_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def retrieval_eval(hits: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(stage, n_queries, recall_at_k..., mrr) of hits (stage, query_id, rank, relevant) over all queries."""
    best = hits.where("relevant").groupBy("stage", "query_id").agg(F.min("rank").alias("best"))
    grid = hits.select("stage").distinct().crossJoin(queries.select("query_id").distinct())  # stages are few
    scored = grid.join(best, ["stage", "query_id"], "left")
    return scored.groupBy("stage").agg(
        F.count("*").alias("n_queries"),
        *[F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_at_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 4).alias("mrr"),
    )


def classification_metrics(rows: DataFrame) -> DataFrame:
    """One row of accuracy, macro precision, recall and F1, weighted F1, over (y, p); a division by zero is 0."""
    cells = rows.groupBy("y", "p").agg(F.count("*").alias("n"))
    label = cells.select(F.explode(F.array("y", "p")).alias("label")).distinct()
    tp = cells.where("y = p").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    real = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("real"))
    said = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    each = label.join(tp, "label", "left").join(real, "label", "left").join(said, "label", "left").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    each = each.withColumn("precision", share("tp", "said")).withColumn("recall", share("tp", "real"))
    each = each.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return each.agg(
        F.sum("real").alias("n"), F.round(F.sum("tp") / F.sum("real"), 4).alias("accuracy"), F.round(F.avg("precision"), 4).alias("macro_precision"), F.round(F.avg("recall"), 4).alias("macro_recall"),
        F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("real")) / F.sum("real"), 4).alias("weighted_f1"),
    )


def group_split(rows: DataFrame, group: str, seed: int, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """rows with split: groups go whole to train, validation or test, in exact shares of the groups, by md5.

    A group's place in that order is its place among the groups whose md5 begins alike, and the number of
    those before them: no task sees more than one of 4,096 ranges.
    """
    hashed = rows.select(group).distinct().withColumn("_md5", F.md5(F.concat(F.col(group).cast("string"), F.lit(f"#{seed}"))))
    groups = hashed.withColumn("_range", F.substring("_md5", 1, 3))
    sizes = groups.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_md5")) - 1
    share = (F.col("_before") + F.col("_place")) / F.col("_all")
    named = groups.withColumn("_place", place).join(F.broadcast(sizes), "_range")
    return rows.join(named.select(group, F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test").alias("split")), group)
