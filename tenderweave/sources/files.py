"""Readers and writers of the catalogue's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import point_id
from pyspark.sql.types import StructType


def read_catalogue(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a JSON file that holds an array, or an object with the array in `standards`.

    Records that don't parse come with nulls; the caller drops them by a required field.
    """
    kind = schema if isinstance(schema, str) else schema.simpleString()
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<standards:array<struct<{kind}>>>" if isinstance(schema, str) else f"struct<standards:array<{kind}>>")
    plain = F.from_json("value", f"array<struct<{kind}>>" if isinstance(schema, str) else f"array<{kind}>")
    is_array = F.ltrim("value").startswith("[")
    records = F.when(is_array, plain).otherwise(wrapped["standards"])
    return text.select(F.explode(records).alias("r")).select("r.*")


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """JSON lines with NaN as null."""
    df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).write.json(path)


def write_catalogue(df: DataFrame, inputs: DataFrame, key: str, path: str) -> None:
    """Parquet in the order of the key; refuses if a key of inputs is lost."""
    if lost := inputs.select(key).join(df.select(key), key, "left_anti").take(3):
        raise ValueError(f"lost {key}: {[r[0] for r in lost]}")
    df.orderBy(key).write.parquet(path)


def index_mark(df: DataFrame, key: str) -> DataFrame:
    """One row (n, checksum) that changes with any key; the order of rows doesn't matter."""
    return df.agg(F.count("*").alias("n"), F.sum(point_id(F.col(key).cast("string")).cast("decimal(38,0)")).cast("string").alias("checksum"))


def index_is_fresh(df: DataFrame, mark: DataFrame, key: str) -> bool:
    return index_mark(df, key).first() == mark.first()


def export_vectors(df: DataFrame, text: str, vector: str, metadata: list[str]) -> DataFrame:
    """(std_id, text, embedding, metadata) rows as an index takes them."""
    return df.select("std_id", F.col(text).alias("text"), F.transform(vector, lambda x: x.cast("float")).alias("embedding"), F.struct(*metadata).alias("metadata"))
