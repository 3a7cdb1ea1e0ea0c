"""Exact quantiles and distribution distances without sorting a column through one task.

Values are counted first, so a value that makes up a third of the rows is one row afterwards. The distinct values
are then range-partitioned: running totals are taken inside each partition and shifted by the totals of the partitions
before it. The placement is materialised first; the boundaries only balance the work, results do not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.session import cut_lineage


def value_counts(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., column, value, n) for several numeric columns in one pass; NULLs are left out."""
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                 for c in columns]))
    return (df.select(*by, melted.alias("m")).select(*by, "m.*").filter(F.col("value").isNotNull())
            .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def running_totals(counts: DataFrame, measures: list[str]) -> DataFrame:
    """Add ``cum_<m>``: per ``column``, the total of m over values up to and including this one."""
    sliced = cut_lineage(counts.repartitionByRange("column", "value").withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy("column").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_totals = sliced.groupBy("column", "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    # At most one row per column and range partition.
    offsets = slice_totals.select("column", "_slice", *[
        F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures])
    inside = Window.partitionBy("column", "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumns({f"cum_{m}": F.sum(m).over(inside) for m in measures})
    joined = out.join(F.broadcast(offsets), ["column", "_slice"])
    return joined.withColumns({f"cum_{m}": F.col(f"cum_{m}") + F.col(f"_off_{m}") for m in measures}).drop(
        "_slice", *[f"_off_{m}" for m in measures])


def exact_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """(column, n, <name of each probability>) by linear interpolation between order statistics."""
    cum = running_totals(value_counts(df, columns), ["n"])
    totals = cum.groupBy("column").agg(F.sum("n").alias("_total"))
    ranked = cum.join(F.broadcast(totals), "column")

    def order_stat(rank):
        return F.min(F.when(F.col("cum_n") > rank, F.col("value")))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        aggs += [order_stat(F.floor(pos)).alias(f"_lo_{name}"), order_stat(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_w_{name}")]
    stats = ranked.groupBy("column").agg(F.max("_total").alias("n"), *aggs)
    return stats.select("column", "n", *[
        (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_w_{m}")).alias(m) for m in probs])


def ks_distance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks): largest gap between the two empirical distribution functions."""
    tagged = value_counts(a.select(*columns, F.lit("a").alias("side")).unionByName(
        b.select(*columns, F.lit("b").alias("side"))), columns, by=["side"])
    counts = tagged.groupBy("column", "value").agg(
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("b"))
    cum = running_totals(counts, ["a", "b"])
    totals = cum.groupBy("column").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    gap = F.abs(ratio(F.col("cum_a"), F.col("_na")) - ratio(F.col("cum_b"), F.col("_nb")))
    return cum.join(F.broadcast(totals), "column").groupBy("column").agg(F.max(gap).alias("ks"))
