"""Classical additive decomposition per category and the share of variance in each component.

A category's weekly series has one row per calendar week, so its windows stay small whatever the number of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators.rollup import fill_gaps
from tidepanel.operators.splits import sorted_weeks

SEASON = 52


def category_series(df: DataFrame, how: str = "sum") -> DataFrame:
    """(category, week, value): total or mean sales, gaps filled by straight lines between known weeks."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    known = df.groupBy("category", "week").agg(agg("units_sold").alias("value"))
    return interpolate(fill_gaps(known, ["category"], "week", 7, []), ["category"], "week", "value")


def interpolate(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = df.withColumns({"_prev": F.last(here, ignorenulls=True).over(back),
                          "_next": F.first(here, ignorenulls=True).over(ahead)})
    span, done = F.datediff("_next.o", "_prev.o"), F.datediff(order, "_prev.o")
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * ratio(done, span)
    return out.withColumn(value, F.coalesce(value, line)).drop("_prev", "_next")


def decompose(series: DataFrame, keys: list[str] = ("category",), season: int = SEASON) -> DataFrame:
    """trend: centred average over one season, the two ends at half weight; seasonal: mean detrended value of the
    phase, centred to zero; residual: the rest. Weeks without a full season around them have no trend."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("week")
    half = season // 2
    inner, outer = w.rowsBetween(-(half - 1), half - 1), w.rowsBetween(-half, half)
    ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
    trend = F.when(F.count("value").over(outer) == season + 1, (F.sum("value").over(inner) + ends / 2) / season)
    phased = series.withColumns({"trend": trend, "phase": (F.row_number().over(w) - 1) % season})
    detrended = phased.withColumn("_d", F.col("value") - F.col("trend"))
    means = detrended.groupBy(*keys, "phase").agg(F.avg("_d").alias("_s"))
    centred = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(Window.partitionBy(*keys))).drop("_s")
    return detrended.join(centred, [*keys, "phase"]).withColumn("residual", F.col("_d") - F.col("seasonal")).drop("_d")


def variance_shares(parts: DataFrame, keys: list[str] = ("category",)) -> DataFrame:
    """Population variance of each component over that of the series, on weeks that have all of them."""
    full = parts.filter(F.col("residual").isNotNull())
    total = F.var_pop("value")
    return full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weeks"), ratio(F.var_pop("seasonal"), total).alias("seasonal_share"),
        ratio(F.var_pop("trend"), total).alias("trend_share"), ratio(F.var_pop("residual"), total).alias("resid_share"))


def variance_robustness(df: DataFrame) -> DataFrame:
    """Shares on totals against shares on means, with the number of active items in the first and last week."""
    by_sum = variance_shares(decompose(category_series(df, "sum")))
    by_mean = variance_shares(decompose(category_series(df, "mean")))
    active = df.groupBy("category", "week").agg(F.countDistinct("sku").alias("n")).groupBy("category").agg(
        F.min_by("n", "week").alias("skus_first"), F.max_by("n", "week").alias("skus_last"))

    def named(t: DataFrame, suffix: str) -> DataFrame:
        return t.select("category", *[F.col(c).alias(f"{c}_{suffix}") for c in ("seasonal_share", "trend_share")])

    return active.join(named(by_sum, "sum"), "category").join(named(by_mean, "mean"), "category")
