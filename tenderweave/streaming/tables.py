"""A keyed table that a stream changes a few buckets of at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """Rows by key in buckets of a key hash; folder/bucket=b/batch=n holds a whole bucket as batch n left it.

    A batch writes only the buckets that its keys fall into and leaves the files of the others alone. A batch
    that is run again after a failure overwrites its own files and starts from what the batches before it left,
    so nothing counts twice. Files that a later batch has replaced are removed by `prune`.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def _files(self) -> DataFrame | None:
        path = self._path()
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        places = StructType.fromDDL("bucket int, batch long")
        return self.spark.read.schema(StructType([*self.schema.fields, *places.fields])).parquet(self.folder)

    def as_of(self, batch: int | None = None) -> DataFrame:
        """The rows after the batches up to this one (all of them: None)."""
        rows = self._files()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        if batch is not None:
            rows = rows.where(F.col("batch") <= batch)
        newest = rows.select("bucket", "batch").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row for each bucket
        return rows.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of these keys; at most as many as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def write(self, batch: int, touched: list[int], rows: DataFrame) -> None:
        """The whole of the touched buckets, as this batch leaves them."""
        if not touched:
            return
        placed = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).withColumn("batch", F.lit(batch).cast("long"))
        placed = placed.where(F.col("bucket").isin(touched)).repartition(min(len(touched), self.buckets), "bucket")
        placed.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)

    def change(self, batch: int, rows: DataFrame, merge) -> None:
        """merge(rows of the touched buckets so far, rows of the batch) gives what these buckets hold now."""
        touched = self.touched(rows)
        if touched:
            before = self.as_of(batch - 1).where(self.bucket().isin(touched))
            self.write(batch, touched, merge(before, rows))

    def prune(self, batch: int) -> int:
        """Removes files that were replaced before this batch, so that it can still be run again; gives their folders' number."""
        rows = self._files()
        if rows is None:
            return 0
        found = rows.select("bucket", "batch").where(F.col("batch") < batch).distinct()
        order = Window.partitionBy("bucket").orderBy(F.desc("batch"))
        old = found.withColumn("n", F.row_number().over(order)).where("n > 1").collect()
        path = self._path()
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bucket={r.bucket}/batch={r.batch}"), True)
        return len(old)


def upserted(key: list[str], order: list[Column]):
    """A merge for `change`: the last row of each key, those of the batch after those before."""

    def merge(before: DataFrame, rows: DataFrame) -> DataFrame:
        every = before.withColumn("_new", F.lit(0)).unionByName(rows.select(*before.columns).withColumn("_new", F.lit(1)))
        last = Window.partitionBy(*key).orderBy(F.desc("_new"), *order)
        return every.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")

    return merge
