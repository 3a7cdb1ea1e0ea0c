"""Descriptive audits of the daily facts, the weekly tables and newly arriving batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.calendar import monday
from tidepanel.functions.numeric import ratio
from tidepanel.operators.ledger import set_difference
from tidepanel.operators.quantiles import exact_quantiles, ks_distance
from tidepanel.operators.rollup import weekly_rollup
from tidepanel.operators.validate import count_if, duplicate_rows
from tidepanel.schema import DAILY_COLUMNS, DAY_KEYS, SERIES, WEEK_KEYS

AUDITED_MEASURES = ["units_sold", "price_unit", "stock_available", "delivered_qty", "delivery_days"]
# Thresholds below which a batch counts as consistent with history.
KS_LIMIT, COVERAGE_LIMIT, PROMO_RATE_LIMIT, PROMO_LIFT_LIMIT = 0.2, 0.1, 0.1, 0.25


def stack_metrics(one_row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One-row table to (metric, value)."""
    items = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in one_row.columns])
    return one_row.select(F.explode(items).alias("m")).select("m.*")


def panel_completeness(daily: DataFrame) -> DataFrame:
    """Recorded days against calendar days in each series' active span."""
    per_series = daily.groupBy(*SERIES, "date").agg(F.count(F.lit(1)).alias("n")).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("days"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span"))
    return per_series.agg(F.sum("span").alias("expected_days"), F.sum("days").alias("actual_days"),
                          ratio(F.sum("days"), F.sum("span")).alias("present_fraction"))


def _mean_cv(df: DataFrame, name: str) -> DataFrame:
    """Mean over series of std / mean; series with a non-positive mean or a single row do not count."""
    mean = F.avg("units_sold")
    cv = df.groupBy(*SERIES).agg(F.when(mean > 0, F.stddev_samp("units_sold") / mean).alias("cv"))
    return cv.agg(F.avg("cv").alias(name))


def grain_noise(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    daily_cv, weekly_cv = _mean_cv(daily, "daily_cv"), _mean_cv(weekly, "weekly_cv")
    return daily_cv.withColumn("weekly_cv", weekly_cv.scalar()).withColumn(
        "ratio", ratio(F.col("daily_cv"), F.col("weekly_cv")))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + rtol * F.abs(b)


def stock_transitions(daily: DataFrame) -> DataFrame:
    """Does the next row's stock equal stock + delivered - sold? Split by the day gap between the rows.

    A window partition holds one item-region's days, after the facts are unique per series and day.
    """
    w = Window.partitionBy("sku", "region").orderBy("date", "channel")
    expected = F.greatest(F.lit(0.0), F.col("stock_available") + F.col("delivered_qty") - F.col("units_sold"))
    rows = daily.select("sku", "region", "channel", "date", "stock_available", "delivered_qty", "units_sold").select(
        F.lead("stock_available").over(w).alias("next_stock"), expected.alias("expected"),
        F.datediff(F.lead("date").over(w), "date").alias("gap"))
    exact = close(F.col("next_stock"), F.col("expected"))
    aggs = []
    for name, cond in [("adjacent_row", F.lit(True)), ("same_date", F.col("gap") == 0),
                       ("next_day", F.col("gap") == 1), ("longer_gap", F.col("gap") > 1)]:
        usable = F.col("next_stock").isNotNull() & cond
        aggs += [count_if(usable).alias(f"{name}_n"), count_if(usable & exact).alias(f"{name}_exact")]
    moves = rows.agg(*aggs)
    shared = daily.groupBy("sku", "region", "date").agg(
        F.countDistinct("channel").alias("c"), F.countDistinct("stock_available").alias("s")).agg(
        count_if(F.col("c") >= 2).alias("multi_channel_dates"),
        count_if((F.col("c") >= 2) & (F.col("s") == 1)).alias("same_stock_dates"))
    return stack_metrics(moves).unionByName(stack_metrics(shared))


def enrichment_semantics(daily: DataFrame, features: DataFrame) -> DataFrame:
    """What do ``deliveries`` and ``stock_avg`` really hold? Compared with a fresh recomputation, NULL-safely."""
    rates = daily.agg(F.avg((F.col("delivered_qty") > 0).cast("int")).alias("delivered_qty_positive_rate"),
                      F.avg(F.col("delivery_days").isNull().cast("int")).alias("delivery_days_null_rate"))
    fresh = daily.groupBy(*SERIES, monday("date").alias("week")).agg(
        F.avg("stock_available").alias("_stock"), F.count("delivery_days").alias("_rows"),
        F.sum(F.when(F.col("delivered_qty") > 0, 1).otherwise(0)).alias("_positive"))
    both = features.select(*WEEK_KEYS, "deliveries", "stock_avg", "stock_available").join(fresh, WEEK_KEYS, "left")

    def unequal(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    def far(a: str, b: str) -> Column:
        return (F.col(a).isNull() != F.col(b).isNull()) | F.coalesce(~close(F.col(a), F.col(b)), F.lit(False))

    mismatches = both.agg(
        count_if(unequal("deliveries", "_rows")).alias("deliveries_vs_row_count"),
        count_if(unequal("deliveries", "_positive")).alias("deliveries_vs_positive_days"),
        count_if(far("stock_avg", "_stock")).alias("stock_avg_vs_recomputed"),
        count_if(far("stock_available", "_stock")).alias("stock_available_vs_recomputed"),
        count_if(far("stock_avg", "stock_available")).alias("stock_avg_vs_stock_available"))
    spread = features.groupBy("deliveries").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("deliveries="), F.coalesce(F.col("deliveries").cast("string"), F.lit("none"))).alias("metric"),
        "value")
    return stack_metrics(rates).unionByName(stack_metrics(mismatches)).unionByName(spread)


def grain_violations(features: DataFrame, columns: list[str], grain: list[str] = ("region", "week")) -> DataFrame:
    """Columns that ought to be constant inside a coarser grain: how many groups vary, and by how much."""
    per_group = features.groupBy(*grain).agg(
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
        *[(F.min(c) != F.max(c)).cast("int").alias(f"varies_{c}") for c in columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"std_{c}").alias("std"),
                               F.col(f"varies_{c}").alias("varies")) for c in columns])
    return per_group.select(F.explode(items).alias("v")).select("v.*").groupBy("column").agg(
        F.count("varies").alias("n_groups"), F.sum("varies").alias("n_varying"),
        F.avg("std").alias("mean_std"), F.max("std").alias("max_std"))


def promo_profile(features: DataFrame) -> DataFrame:
    """Raw differences between promoted and other weeks, before any control."""
    def mean_by(key: str, value: str, name: str) -> DataFrame:
        return features.groupBy(F.col(key).cast("string").alias("level")).agg(F.avg(value).alias("value")).select(
            F.lit(name).alias("profile"), "level", "value")

    promoted, other = (F.avg(F.when(F.col("promotion_flag") == v, F.col("units_sold"))) for v in (1, 0))
    uplift = features.agg((ratio(promoted, other) - 1).alias("value")).select(
        F.lit("naive_uplift").alias("profile"), F.lit("all").alias("level"), "value")
    return (mean_by("promotion_flag", "price_unit", "price_by_promotion")
            .unionByName(mean_by("channel", "promotion_flag", "promotion_by_channel"))
            .unionByName(mean_by("is_summer", "promotion_flag", "promotion_by_summer"))
            .unionByName(uplift))


def describe(daily: DataFrame, columns: list[str] = AUDITED_MEASURES) -> DataFrame:
    """Counts, NULLs, moments and exact quartiles per numeric column."""
    moments = daily.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in
                          [("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]],
                        F.count(F.lit(1)).alias("_rows"))
    items = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), (F.col("_rows") - F.col(f"n_{c}")).alias("n_null"),
        *[F.col(f"{s}_{c}").cast("double").alias(s) for s in ("mean", "std", "min", "max")]) for c in columns])
    table = moments.select(F.explode(items).alias("d")).select("d.*")
    quartiles = exact_quantiles(daily, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return table.join(quartiles, "column", "left")


def group_profile(daily: DataFrame) -> DataFrame:
    """Promotion rate by category, units by channel and number of series."""
    promo = daily.groupBy(F.col("category").alias("level")).agg(F.avg("promotion_flag").alias("value")).select(
        F.lit("promo_rate_by_category").alias("profile"), "level", "value")
    units = daily.groupBy(F.col("channel").alias("level")).agg(F.sum("units_sold").alias("value")).select(
        F.lit("units_by_channel").alias("profile"), "level", "value")
    series = daily.select(*SERIES).distinct().groupBy().agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("series").alias("profile"), F.lit("all").alias("level"), "value")
    return promo.unionByName(units).unionByName(series)


def rollup_conservation(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Nothing is lost between the grains: totals, Monday labels, unique keys, series lengths."""
    days = daily.agg(F.sum("units_sold").alias("daily_units"))
    per_key = weekly.groupBy(*WEEK_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("units_sold").alias("u"))
    per_series = per_key.groupBy(*SERIES).agg(
        F.sum("u").alias("u"), F.sum(F.col("n") - 1).alias("dup"), F.count(F.lit(1)).alias("weeks"),
        count_if(F.weekday("week") != 0).alias("off"))
    weeks = per_series.agg(
        F.sum("u").alias("weekly_units"), F.sum("off").alias("weeks_not_monday"), F.sum("dup").alias("duplicate_keys"),
        F.count(F.lit(1)).alias("n_series"), F.min("weeks").alias("min_weeks"), F.max("weeks").alias("max_weeks"))
    return stack_metrics(days).unionByName(stack_metrics(weeks))


def total_sales_trend(daily: DataFrame, days: int = 7) -> DataFrame:
    """Total units per day and their trailing mean; the window runs over one row per calendar day."""
    totals = daily.groupBy("date").agg(F.sum("units_sold").alias("units"))
    frame = Window.orderBy("date").rowsBetween(-(days - 1), 0)
    full = F.count(F.lit(1)).over(frame) == days
    return totals.withColumn("trend", F.when(full, F.avg("units").over(frame)))


# ---------------------------------------------------------------- new batches against history

def full_weeks(rows: DataFrame) -> DataFrame:
    """Rows from the first Monday after the first recorded day."""
    start = rows.agg(F.next_day(F.min("date"), "MON")).scalar()
    return rows.filter(F.col("date") >= start)


def _week_parts(rows: DataFrame) -> DataFrame:
    parts = rows.groupBy(*SERIES, monday("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_sold").alias("u"))
    return parts.agg(F.avg("n").alias("rows"), F.avg("u").alias("units")).withColumn(
        "units_per_row", ratio(F.col("units"), F.col("rows")))


def level_shift(reference: DataFrame, new: DataFrame) -> DataFrame:
    """Change of weekly units per series = change in rows per week x change in units per row."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return stack_metrics(_week_parts(df)).withColumnRenamed("value", name)

    return tagged(reference, "reference").join(tagged(new, "new"), "metric").withColumn(
        "ratio", ratio(F.col("new"), F.col("reference")))


def _side_stats(rows: DataFrame) -> DataFrame:
    """Scalars of one side of the contract, in one row. Every grouped count is reduced before it is combined."""
    per_day = rows.groupBy(*DAY_KEYS).agg(F.count(F.lit(1)).alias("n"))
    span = (F.datediff(F.max("date"), F.min("date")) + 1)
    per_series = per_day.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("n") - 1).alias("dup"),
                                              F.max("n").alias("max_n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    shape = per_series.agg(F.sum("dup").alias("duplicates"), F.max("max_n").alias("max_rows"),
                           F.avg("days").alias("mean_days"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                           F.countDistinct("sku").alias("n_sku"))
    shape = shape.withColumn("span", F.datediff("hi", "lo") + 1).withColumn(
        "coverage", ratio(F.col("mean_days"), F.col("span")))
    shape = shape.withColumn("n_dates", rows.agg(F.countDistinct("date")).scalar())
    lift = ratio(F.avg(F.when(F.col("promotion_flag") == 1, F.col("units_sold"))),
                 F.avg(F.when(F.col("promotion_flag") == 0, F.col("units_sold"))))
    moments = rows.agg(F.avg("promotion_flag").alias("promo_rate"), lift.alias("lift"),
                       *[F.avg(c).alias(f"mean_{c}") for c in AUDITED_MEASURES],
                       *[F.min(c).alias(f"min_{c}") for c in AUDITED_MEASURES],
                       *[F.max(c).alias(f"max_{c}") for c in AUDITED_MEASURES])
    both = shape.select(F.struct(*shape.columns).alias("shape")).withColumn(
        "moments", moments.select(F.struct(*moments.columns)).scalar())
    return both.select("shape.*", "moments.*")


def contract_audit(history: DataFrame, batches: DataFrame) -> DataFrame:
    """The 14 properties of history that downstream code relies on, and whether the batches keep them.

    (check, history_value, batch_value, statistic, consistent); statistic is the Kolmogorov-Smirnov distance for the
    per-row measures and the calendar span for the date check.
    """
    h = _side_stats(history).select(F.struct("*").alias("h"))
    both = h.withColumn("b", _side_stats(batches).select(F.struct("*")).scalar())
    hist_types = {f.name: f.dataType for f in history.schema.fields if f.name in DAILY_COLUMNS}
    batch_types = {f.name: f.dataType for f in batches.schema.fields if f.name in DAILY_COLUMNS}
    unknown = set_difference(history.select("sku"), batches.select("sku"), "sku").scalar()

    def num(c) -> Column:
        return c.cast("double") if isinstance(c, Column) else F.lit(c).cast("double")

    def row(name, hv, bv, ok, stat=None) -> Column:
        return F.struct(F.lit(name).alias("check"), num(hv).alias("history_value"), num(bv).alias("batch_value"),
                        num(stat).alias("statistic"), F.coalesce(ok, F.lit(False)).alias("consistent"))

    H, B = (lambda c: F.col(f"h.{c}")), (lambda c: F.col(f"b.{c}"))
    simple = [
        row("columns and types", len(hist_types), len(batch_types), F.lit(hist_types == batch_types)),
        row("items in batch", H("n_sku"), B("n_sku"), unknown == 0),
        row("date range continues", F.datediff(B("lo"), H("hi")), B("n_dates"),
            (B("lo") > H("hi")) & (B("n_dates") == B("span")), B("span")),
        row("duplicate series-day rows", H("duplicates"), B("duplicates"),
            (H("duplicates") == 0) & (B("duplicates") == 0)),
        row("rows per series-day", H("max_rows"), B("max_rows"), B("max_rows") <= H("max_rows")),
        row("share of calendar days with a row", H("coverage"), B("coverage"),
            F.abs(B("coverage") - H("coverage")) < COVERAGE_LIMIT),
        row("promotion rate per row", H("promo_rate"), B("promo_rate"),
            F.abs(B("promo_rate") - H("promo_rate")) < PROMO_RATE_LIMIT),
        row("units per row, promo over no promo", H("lift"), B("lift"), F.abs(B("lift") - H("lift")) < PROMO_LIFT_LIMIT),
    ]
    measures = F.array(*[F.struct(F.lit(c).alias("column"), H(f"mean_{c}").alias("hm"), B(f"mean_{c}").alias("bm"))
                         for c in AUDITED_MEASURES])
    ks = ks_distance(history, batches, AUDITED_MEASURES)
    per_row = (both.select(F.explode(measures).alias("m")).select("m.*").join(ks, "column").select(
        F.concat("column", F.lit(" per row")).alias("check"), F.col("hm").alias("history_value"),
        F.col("bm").alias("batch_value"), F.col("ks").alias("statistic"), (F.col("ks") < KS_LIMIT).alias("consistent")))
    h_weeks = exact_quantiles(weekly_rollup(history), ["units_sold"], {"history_value": 0.99})
    b_weeks = exact_quantiles(weekly_rollup(full_weeks(batches)), ["units_sold"], {"batch_value": 0.5})
    weekly = h_weeks.drop("n").join(b_weeks.drop("n"), "column", "left").select(
        F.lit("weekly units per series").alias("check"), "history_value", "batch_value",
        F.lit(None).cast("double").alias("statistic"),
        F.coalesce(F.col("batch_value") <= F.col("history_value"), F.lit(False)).alias("consistent"))
    return both.select(F.explode(F.array(*simple)).alias("r")).select("r.*").unionByName(per_row).unionByName(weekly)
