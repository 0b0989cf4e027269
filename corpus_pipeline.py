"""The corpus pipeline: five stages over documents, each written and read again by its runner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderweave.llm.common import read, stored
from tenderweave.llm.decontaminate import decontaminated
from tenderweave.llm.packing import best_fit
from tenderweave.llm.simhash import without_near_copies
from tenderweave.llm.suffix import without_repeats
from tenderweave.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has go; so do documents with nothing left."""
    return without_repeats(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the training sequences."""
    return best_fit(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeats", repeats), ("benchmarks", benchmarks), ("packing", packing)]

#: Learning, fingerprints and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
