"""Context, enrichment and hypothesis features on the weekly panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.calendar import SCHOOL_BREAK_MONTHS, event_score, monday
from tidepanel.functions.numeric import ratio
from tidepanel.operators.rollup import add_age_and_calendar, internal_columns, labelled_weeks, series_window
from tidepanel.session import cut_lineage
from tidepanel.schema import ENRICHED_COLUMNS, FEATURE_TABLE_COLUMNS, SERIES, STATIC_ATTRS, WEEK_KEYS

# Seasonal temperature curve per region rank, and the price-level path.
TEMP_BASE, TEMP_BASE_STEP = 9.0, 0.6
TEMP_AMPLITUDE, TEMP_AMPLITUDE_STEP = 9.0, 0.5
TEMP_PHASE_DAYS, DAYS_PER_YEAR = 172, 365.25
INFLATION_START, INFLATION_RATE = 160.0, 0.018
PROMO_RATE_WEEKS = 8


def item_table(daily: DataFrame) -> DataFrame:
    """(sku, first_seen, brand, segment, category); raises when an attribute is not static per item.

    Days are first reduced to the attribute values of an item: least and greatest texts make Spark sort what they aggregate.
    """
    varies = F.greatest(*[F.when(F.min(c).eqNullSafe(F.max(c)), 0).otherwise(1) for c in STATIC_ATTRS])
    found = daily.groupBy("sku", *STATIC_ATTRS).agg(F.min("date").alias("first_seen"))
    items = found.groupBy("sku").agg(F.min("first_seen").alias("first_seen"), *[F.min(c).alias(c) for c in STATIC_ATTRS],
                                     varies.alias("_varies"))
    complaint = F.raise_error(F.concat(F.lit("attributes must be static per item: "), "sku"))
    return items.withColumn("sku", F.when(F.col("_varies") == 1, complaint).otherwise(F.col("sku"))).drop("_varies")


def static_attrs(daily: DataFrame) -> DataFrame:
    return item_table(daily).drop("first_seen")


def attach_static_attrs(weekly: DataFrame, daily: DataFrame) -> DataFrame:
    return weekly.join(static_attrs(daily), "sku", "left")


def internal_aggregates(daily: DataFrame) -> DataFrame:
    """Weekly aggregates of the recorded rows, only for weeks that have a price."""
    return daily.groupBy(*SERIES, monday("date").alias("week")).agg(
        *internal_columns()).filter(F.col("price_avg").isNotNull())


def region_climate(weekly: DataFrame) -> DataFrame:
    """(region, base, amplitude) by rank of the region name; ranks run over the distinct regions only."""
    rank = F.row_number().over(Window.orderBy("region")) - 1
    return weekly.select("region").distinct().withColumn("_rank", rank).select(
        "region", (TEMP_BASE + TEMP_BASE_STEP * F.col("_rank")).alias("temp_base"),
        (TEMP_AMPLITUDE + TEMP_AMPLITUDE_STEP * F.col("_rank")).alias("temp_amplitude"))


def add_context(weekly: DataFrame) -> DataFrame:
    """Seasonal temperature, price level, school flag and event score, from the week and region alone."""
    first_week = weekly.agg(F.min("week")).scalar()
    phase = 2 * math.pi * (F.dayofyear("week") - TEMP_PHASE_DAYS) / DAYS_PER_YEAR
    elapsed = F.datediff("week", first_week) / 7.0
    out = event_score(weekly.join(region_climate(weekly), "region", "left"))
    return out.withColumns({
        "avg_temp": F.col("temp_base") + F.col("temp_amplitude") * F.sin(phase),
        "inflation_index": INFLATION_START * F.pow(F.lit(1 + INFLATION_RATE), elapsed / 52.0),
        "school_in_session": (~F.month("week").isin(SCHOOL_BREAK_MONTHS)).cast("int"),
    }).drop("temp_base", "temp_amplitude")


def context_features(weekly: DataFrame) -> DataFrame:
    """One row per region and week."""
    return add_context(weekly.select("region", "week").distinct())


def category_week_stats(weekly: DataFrame) -> DataFrame:
    """Per category, region and week: sales trend and the category's mean price in that week.

    The facts are summed to this small grain first; the expanding mean and the across-region price mean are
    windows over calendar-sized groups, never over the rows of a large category.
    """
    cells = weekly.groupBy("category", "region", "week").agg(
        F.avg("units_sold").alias("_mean_units"),
        F.sum("price_unit").alias("_price_sum"), F.count("price_unit").alias("_price_n"))
    growing = Window.partitionBy("category", "region").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    same_week = Window.partitionBy("category", "week")
    price = ratio(F.sum("_price_sum").over(same_week), F.sum("_price_n").over(same_week))
    return cells.select(
        "category", "region", "week",
        ratio(F.avg("_mean_units").over(growing), F.first("_mean_units").over(growing)).alias("category_trend"),
        price.alias("category_price"))


def category_trend(weekly: DataFrame) -> DataFrame:
    return category_week_stats(weekly).drop("category_price")


def enrich(weekly: DataFrame, daily: DataFrame) -> DataFrame:
    """Attach attributes, weekly aggregates, context and category trend, each at its own grain.

    The panel is read by its main line, the category statistics and the context; materialising it once keeps the
    scan of the facts behind it from being repeated for each of them.
    """
    labelled = cut_lineage(attach_static_attrs(weekly, daily))
    return (add_context(labelled)
            .join(internal_aggregates(daily), WEEK_KEYS, "left")
            .join(category_trend(labelled), ["category", "region", "week"], "left")
            .select(*ENRICHED_COLUMNS))


def add_price_index(df: DataFrame) -> DataFrame:
    """Price relative to the category's mean price that week (two-phase mean, then a join)."""
    mean = df.groupBy("category", "week").agg(F.avg("price_unit").alias("_mean"))
    return (df.join(mean, ["category", "week"], "left")
            .withColumn("price_index", ratio(F.col("price_unit"), F.col("_mean"))).drop("_mean"))


def add_promo_recency(df: DataFrame) -> DataFrame:
    """Weeks since the last promotion in the series; NULL before the first one."""
    w = series_window()
    row = F.row_number().over(w)
    last = F.last(F.when(F.col("promotion_flag") == 1, F.col("_row")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_row", row).withColumn(
        "promo_recency", (F.col("_row") - last).cast("double")).drop("_row")


def add_rolling_promo_rate(df: DataFrame, weeks: int = PROMO_RATE_WEEKS) -> DataFrame:
    frame = series_window().rowsBetween(-(weeks - 1), 0)
    return df.withColumn("rolling_promo_rate", F.avg("promotion_flag").over(frame))


def add_cross_channel_share(df: DataFrame) -> DataFrame:
    """Channel's share of the item's sales in the same region and week; group size is the number of channels."""
    total = F.sum("units_sold").over(Window.partitionBy("sku", "region", "week"))
    return df.withColumn("cross_channel_demand_share", ratio(F.col("units_sold"), total))


def add_series_features(df: DataFrame) -> DataFrame:
    """Hypothesis features that need only the item's own rows."""
    return add_cross_channel_share(add_rolling_promo_rate(add_promo_recency(df)))


def feature_table(daily: DataFrame) -> DataFrame:
    """The 40-column model table: two passes over the facts (weekly cells, items), then small-table joins."""
    base = cut_lineage(add_age_and_calendar(labelled_weeks(daily, extra=internal_columns()), item_table(daily)))
    priced = (add_context(base)
              .join(category_week_stats(base), ["category", "region", "week"], "left")
              .withColumn("price_index", ratio(F.col("price_unit"), F.col("category_price"))))
    return add_series_features(priced).select(*FEATURE_TABLE_COLUMNS)
