"""Daily facts to gap-filled weekly panels, and the base features on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.calendar import calendar_flags, holiday_flags, monday
from tidepanel.schema import BASE_COLUMNS, DAYS_PER_WEEK, LABEL, SERIES

ROLLING_WEEKS = 4
GROWTH_UNTIL_WEEK, MATURE_UNTIL_WEEK = 12, 52
LAG_COLUMNS = ["lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "momentum"]


def series_window(keys: list[str] = SERIES, order: str = "week") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def internal_columns() -> list[Column]:
    """Weekly means and the number of recorded rows behind them."""
    return [F.avg("price_unit").alias("price_avg"), F.avg("promotion_flag").alias("promo_rate"),
            F.avg("stock_available").alias("stock_avg"), F.count("delivery_days").alias("deliveries")]


def weekly_cells(daily: DataFrame, keys: list[str] = SERIES, extra: list[Column] = ()) -> DataFrame:
    """Weeks that have rows: the only pass over the facts, combined map-side before its shuffle."""
    return daily.groupBy(*keys, monday("date").alias("week")).agg(
        F.sum("units_sold").alias("units_sold"),
        F.sum("delivered_qty").alias("delivered_qty"),
        F.avg("price_unit").alias("price_unit"),
        F.avg("stock_available").alias("stock_available"),
        F.max("promotion_flag").cast("bigint").alias("promotion_flag"),
        F.avg("delivery_days").alias("delivery_days"), *extra)


def fill_gaps(cells: DataFrame, keys: list[str], order: str, step_days: int, zeros: list[str], carried: list[str] = (),
              reach: tuple[int, int] | None = None, ahead: dict[str, str] | None = None) -> DataFrame:
    """Emit every missing period between the first and last one of a series.

    Each present row is stretched up to the period before the next present one, so no spine table has to be
    built and joined: the window that finds the next row is the only shuffle, and later windows over the same
    series reuse its partitioning. ``zeros`` become 0 in the new rows, other measures NULL; ``carried`` columns keep their value.
    With ``reach`` (after, before) only the periods that near to a present row are emitted, for a caller that keeps present
    rows and looks no further than that from them. ``ahead`` names columns that hold a measure's value of the next period, known
    before the rows are stretched, so the stretched rows need not be sorted for it; it is NULL in the last period.
    """
    ahead, w = ahead or {}, series_window(keys, order)
    last = F.coalesce(F.date_sub("_next", step_days), F.col(order))
    step = F.expr(f"INTERVAL {step_days} DAYS")
    slots = F.sequence(F.col(order), last, step)
    if reach:
        after, before = reach
        near = F.sequence(F.col(order), F.least(last, F.date_add(order, after * step_days)), step)
        again = F.greatest(F.date_add(order, (after + 1) * step_days), F.date_sub("_next", before * step_days))
        slots = F.concat(near, F.when(again <= last, F.sequence(again, last, step)).otherwise(F.array().cast("array<date>")))
    found = cells.withColumns({"_next": F.lead(order).over(w)} | {f"_{n}": F.lead(c).over(w) for n, c in ahead.items()})
    filled = found.withColumn("_slot", F.explode(slots)).withColumn("_last", last)
    present = F.col("_slot") == F.col(order)
    measures = [c for c in cells.columns if c not in keys and c != order and c not in carried]
    return filled.select(
        *keys, F.col("_slot").alias(order), *carried,
        *[F.when(present, F.col(c)).otherwise(F.lit(0) if c in zeros else F.lit(None)).alias(c) for c in measures],
        *[F.when(F.col("_slot") < F.col("_last"), F.lit(0) if c in zeros else F.lit(None)).otherwise(F.col(f"_{n}")).alias(n)
          for n, c in ahead.items()])


def weekly_rollup(daily: DataFrame, keys: list[str] = SERIES, extra: list[Column] = (), items: DataFrame | None = None,
                  reach: tuple[int, int] | None = None, ahead: dict[str, str] | None = None) -> DataFrame:
    """Monday-labelled weekly panel; weeks without rows inside a series' span appear with zero sales.

    Columns of ``items`` (one row per item) join the weeks that have rows and are carried into the others, so the panel, many
    times as long where sales are sparse, is never moved for them.
    """
    cells, carried = weekly_cells(daily, keys, extra), []
    if items is not None:
        carried = [c for c in items.columns if c != "sku"]
        cells = cells.join(items, "sku", "left")
    return fill_gaps(cells, keys, "week", DAYS_PER_WEEK, ["units_sold", "delivered_qty", "promotion_flag"], carried, reach, ahead)


def first_seen(daily: DataFrame) -> DataFrame:
    """Launch date of each item over all channels and regions."""
    return daily.groupBy("sku").agg(F.min("date").alias("first_seen"))


def add_sku_age(weekly: DataFrame, items: DataFrame) -> DataFrame:
    """Weeks since the item's first week anywhere. ``items`` has one row per item with its ``first_seen``; coming
    from its own aggregate, it spares gathering a dominant item into one window partition."""
    return with_sku_age(weekly.join(items, "sku", "left"))


def with_sku_age(weekly: DataFrame) -> DataFrame:
    """``sku_age`` in place of the carried ``first_seen``."""
    return weekly.withColumn("sku_age", F.expr("datediff(week, trunc(first_seen, 'week')) div 7").cast("bigint")).drop("first_seen")


def lifecycle_stage(age: Column | str) -> Column:
    age = F.col(age) if isinstance(age, str) else age
    return (F.when(age <= GROWTH_UNTIL_WEEK, "Growth").when(age <= MATURE_UNTIL_WEEK, "Mature").otherwise("Decline"))


def lag_features(weekly: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Past-only lags, momentum and four-week statistics; the frame ends at the previous week."""
    w = series_window(keys)
    past = w.rowsBetween(-ROLLING_WEEKS, -1)
    full = F.count("units_sold").over(past) == ROLLING_WEEKS
    out = weekly.withColumns({
        "lag_1": F.lag("units_sold", 1).over(w),
        "lag_2": F.lag("units_sold", 2).over(w),
        "rolling_mean_4": F.when(full, F.avg("units_sold").over(past)),
        "rolling_std_4": F.when(full, F.stddev_samp("units_sold").over(past)),
    })
    return out.withColumn("momentum", F.col("lag_1") - F.col("lag_2"))


def next_week_target(weekly: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return weekly.withColumn(LABEL, F.lead("units_sold", 1).over(series_window(keys)))


def drop_incomplete(weekly: DataFrame, keep_early_history: bool = False) -> DataFrame:
    """Remove rows without a label and, unless early history is wanted, rows without full lags."""
    return weekly.dropna(subset=[LABEL] if keep_early_history else LAG_COLUMNS + [LABEL])


def labelled_weeks(daily: DataFrame, keep_early_history: bool = False, extra: list[Column] = (), items: DataFrame | None = None,
                   reach: tuple[int, int] | None = None) -> DataFrame:
    """Gap-filled panel with lags and label, trimmed to usable rows."""
    weekly = weekly_rollup(daily, SERIES, extra, items, reach, {LABEL: "units_sold"})
    lagged = lag_features(weekly)
    return drop_incomplete(lagged.select(*[c for c in lagged.columns if c != LABEL], LABEL), keep_early_history)


def labelled_runs(daily: DataFrame) -> DataFrame:
    """Series and weeks of ``labelled_weeks(daily, keep_early_history=True)`` as runs: ``week`` and the ``n_weeks`` from it on.

    A run goes from a week with rows up to the next one of its series, so there are no more runs than such weeks, however long
    the gaps. The last week of a series has no label, nor has the one before a week whose units are all missing.
    """
    w = series_window()
    cells = weekly_cells(daily).select(*SERIES, "week", F.lead("week").over(w).alias("_next"), F.lead("units_sold").over(w).alias("_units"))
    n = F.expr("datediff(_next, week) div 7") - F.col("_units").isNull().cast("int")
    return cells.select(*SERIES, "week", n.alias("n_weeks")).filter("n_weeks > 0")


def add_age_and_calendar(weekly: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """``items`` gives ``first_seen`` unless the panel carries it."""
    aged = with_sku_age(weekly) if items is None else add_sku_age(weekly, items)
    return holiday_flags(calendar_flags(aged.withColumn("lifecycle_stage", lifecycle_stage("sku_age"))))


def weekly_base(daily: DataFrame, keep_early_history: bool = False) -> DataFrame:
    """The 24-column base table."""
    return add_age_and_calendar(labelled_weeks(daily, keep_early_history, items=first_seen(daily))).select(*BASE_COLUMNS)


def recorded_base(daily: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``weekly_base(daily, keep_early_history=True)`` for weeks that have rows, with the columns of ``items`` and the
    number of observed days; series with a missing key are left out.

    Lags and label look ROLLING_WEEKS back and a week ahead, so only gaps' weeks that near are built.
    """
    # Days are bits of their week: repeated days count once, and a task combines its rows before they are moved.
    days = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.datediff("date", monday("date"))))).cast("bigint")
    weeks = labelled_weeks(daily.dropna(subset=SERIES), True, [days.alias("observed_days")], items, (1, ROLLING_WEEKS))
    attrs = [c for c in items.columns if c not in ("sku", "first_seen")]
    return add_age_and_calendar(weeks.filter("observed_days IS NOT NULL")).select(*BASE_COLUMNS, *attrs, "observed_days")
