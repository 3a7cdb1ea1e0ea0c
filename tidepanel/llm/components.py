"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames


def _least(edges: DataFrame) -> DataFrame:
    """``u`` and the least of it and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of a table of links ``a``, ``b``.

    Each round halves the depth at least; rounds go on until the edges stay the same. All state is a written table.
    """
    edges = frames.materialise(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least(down)
        small = down.join(least, "u").select(F.col("v"), F.col("m").alias("u")).where("u < v")
        edges = frames.materialise(small.unionByName(least.select(F.col("u").alias("v"), F.col("m").alias("u"))).where("u < v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
