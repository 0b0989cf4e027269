"""Reading records that may be broken, JSON documents, and writes that are checked before they count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import payloads

CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of JSON lines with the fields of schema, and _corrupt_record: the line, where it doesn't parse or a field
    has another type. Blank lines are no records."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*kind.fields, *StructType.fromDDL(f"{CORRUPT} string").fields])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def drop_bad_records(df: DataFrame, needed: list[str], seen: Observation | None = None) -> DataFrame:
    """The records of df that parse and have all the needed fields with something in them, without _corrupt_record.

    `seen` counts in the same pass that reads them: n_read, n_corrupt, n_kept, and no_<field> for each needed field of the
    records that parse (a record may lack several). df may come from read_records or have no _corrupt_record at all.
    """
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    lacks = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in needed}
    bad = corrupt
    for lack in lacks.values():
        bad = bad | lack
    if seen is not None:
        counts = {"n_read": F.lit(True), "n_corrupt": corrupt, "n_kept": ~bad} | {f"no_{c}": ~corrupt & lack for c, lack in lacks.items()}
        df = df.observe(seen, *[F.count_if(x).alias(name) for name, x in counts.items()])
    return df.where(~bad).drop(CORRUPT)


def json_documents(df: DataFrame, text: str, titles: list[str], descriptions: list[str]) -> DataFrame:
    """df with status (SUCCESS or MALFORMED), payload (canonical JSON of the object; what is no object is wrapped as
    {"items": it}), title and description (the first of these fields that says something), digest (sha256 of the text as
    it came) and n_bytes; malformed, empty and null texts have neither payload nor hints."""
    raw = F.coalesce(F.col(text), F.lit(""))
    parsed = df.withColumn("_p", payloads.wrapped_payload(F.col(text)))
    return parsed.withColumns(
        {
            "status": F.when(F.col("_p").isNull(), "MALFORMED").otherwise("SUCCESS"), "payload": F.to_json("_p"), "title": payloads.hint(F.col("_p"), *titles),
            "description": payloads.hint(F.col("_p"), *descriptions), "digest": F.when(raw != "", F.sha2(raw, 256)), "n_bytes": F.octet_length(raw),
        }
    ).drop("_p")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, key: str, must_hold: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Writes df to path in two steps, and gives it back as it is read from there.

    First it is staged beside path. Then what was staged, not what is planned, is checked: every key of `must_hold` is in
    it, and with `strict` no key is in it twice. Only then the staged folder takes the place of path, by a rename. If a
    check fails, ValueError names some keys, the staged folder goes, and what was at path before stays; the same
    holds when the job is lost half-way, but that the staged folder is left behind.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(staged)
    there = spark.read.schema(df.schema).parquet(staged)
    source, fs = _fs(spark, staged)
    lost = must_hold.select(key).join(there.select(key), key, "left_anti").take(3) if must_hold is not None else []
    twice = there.groupBy(key).count().where("count > 1").take(3) if strict else []
    if lost or twice:
        fs.delete(source, True)
        raise ValueError(f"lost {key}: {[r[0] for r in lost]}" if lost else f"duplicate {key}: {[r[0] for r in twice]}")
    target, _ = _fs(spark, path)
    old = None
    if fs.exists(target):
        old, _ = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
        fs.rename(target, old)
    if not fs.rename(source, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"{staged} could not be renamed to {path}")
    if old is not None:
        fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def without_nan(df: DataFrame) -> DataFrame:
    """df with null for NaN in every column of floating point, also inside arrays: JSON has no NaN."""

    def plain(c: str, t: str) -> Column:
        if t in ("double", "float"):
            return F.when(~F.isnan(c), F.col(c)).alias(c)
        if t in ("array<double>", "array<float>"):
            return F.transform(c, lambda x: F.when(~F.isnan(x), x)).alias(c)
        return F.col(c)

    return df.select(*[plain(c, t) for c, t in df.dtypes])


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """df as JSON lines at path, NaN as null, read back by its own schema."""
    without_nan(df).write.option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
