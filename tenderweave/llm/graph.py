"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of the component.

    Each round joins every node to the least of its neighbours, first from the smaller side of its
    edges, then from the larger; the rounds needed grow with the logarithm of a component's size.
    All state is a table of at most as many edges as there were; nothing comes to the driver but a
    count and a checksum. No edges: no rows.
    """
    star = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now[0] == 0 or (now == mark and now[0] == now[2]):
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())
        mark = now
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = stored(small.union(lower.select("a", "m")).distinct(), "edges")
