"""Breadth-first reachability over a stored link table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import classify_link, extract_domain
from ..sources.storage import ensure_checkpoint_dir


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the URL's host is one of the domains, or under one."""
    host = extract_domain(url)
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains], F.lit(False))


def link_frontier(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, domains: list[str] | None = None, paged: bool = False) -> DataFrame:
    """(url, depth) of pages reached from seeds (url) over links (src, dst) in at most max_depth steps, the
    first max_pages by (depth, url). With domains, other hosts are never entered. With paged, a link to
    a further page of a list keeps the depth of the page that it is on.

    Each round is a join of the last new pages with the links and an anti-join against what was
    visited; only the new pages are written, and checkpoint() cuts their lineage.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    if domains is not None:
        links, seeds = links.where(allowed(F.col("dst"), domains)), seeds.where(allowed(F.col("url"), domains))
    step = F.when(classify_link(F.col("dst"))[0] == "pagination", 0).otherwise(1) if paged else F.lit(1)
    links = links.select("src", "dst", step.alias("step")).groupBy("src", "dst").agg(F.min("step").alias("step"))
    fresh = seeds.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    rounds = [fresh]
    while not fresh.isEmpty():
        visited = reduce(DataFrame.unionByName, rounds).groupBy("url").agg(F.min("depth").alias("known"))
        found = fresh.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), (F.col("depth") + F.col("step")).alias("depth")).where(F.col("depth") <= max_depth)
        found = found.groupBy("url").agg(F.min("depth").alias("depth")).join(visited, "url", "left").where("known is null or depth < known").select("url", "depth")
        fresh = found.checkpoint()
        rounds.append(fresh)
    return reduce(DataFrame.unionByName, rounds).groupBy("url").agg(F.min("depth").alias("depth")).orderBy("depth", "url").limit(max_pages)
