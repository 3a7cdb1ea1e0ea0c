"""Daily-grain forecasting frames: completed daily panels, fixed-origin horizons and same-weekday history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators.rollup import fill_gaps, series_window
from tidepanel.operators.validate import count_if
from tidepanel.schema import DAY_KEYS, LABEL, SERIES, WEEK_KEYS

HORIZON_DAYS = 7
FIXED_LAGS = [7, 14, 28]
WEEKDAY_LAGS = list(range(7, 57, 7))
ROLLING_LAGS = [1, 7, 14, 28]
ROLLING_MEANS = [7, 28]


def complete_daily_panel(daily: DataFrame) -> DataFrame:
    """One row per series and calendar day of its span; days without a record count as zero sales."""
    recorded = daily.select(*DAY_KEYS, "units_sold", F.lit(1).alias("observed"))
    return fill_gaps(recorded, SERIES, "date", 1, ["units_sold", "observed"]).withColumnRenamed(
        "units_sold", "units_sold_daily")


def expand_horizon(weekly: DataFrame) -> DataFrame:
    """Seven target days per origin week, Monday to Sunday of the following week."""
    out = weekly.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(HORIZON_DAYS))))
    return out.withColumn("target_date", F.expr("date_add(week, 6 + horizon)"))


def day_lookups(daily: DataFrame, offsets: list[int], observed: bool = False) -> DataFrame:
    """(series, target_date, daily_<k>...) : sales k days before each date, for several k in one shuffle.

    Each recorded day is sent to the target dates that look back at it; the facts are never joined once per offset.
    """
    hits = F.explode(F.array(*[F.lit(k) for k in offsets])).alias("_k")
    sent = daily.select(*DAY_KEYS, "units_sold", hits).withColumn("target_date", F.expr("date_add(date, _k)"))
    cols = [F.sum(F.when(F.col("_k") == k, F.col("units_sold"))).alias(f"daily_lag_{k}") for k in offsets]
    if observed:
        cols += [F.max(F.when(F.col("_k") == k, 1.0)).alias(f"daily_lag_{k}_observed") for k in offsets]
    return sent.groupBy(*SERIES, "target_date").agg(*cols)


def look_back(rows: DataFrame, daily: DataFrame, offsets: list[int], observed: bool = False) -> DataFrame:
    """``rows`` with daily_<k>..., the sales k days before each ``target_date``, zero where nothing was recorded.

    Facts and rows are sorted once per series and every offset is a window frame of one day, so no fact is copied per offset.
    """
    columns = rows.columns
    facts = daily.select(*SERIES, F.unix_date("date").alias("_day"), "units_sold", F.lit(1.0).alias("_seen"))
    nothing = F.lit(None)
    both = facts.withColumn("_row", nothing).unionByName(rows.select(
        *SERIES, F.unix_date("target_date").alias("_day"), nothing.alias("units_sold"), nothing.alias("_seen"), F.struct(*columns).alias("_row")))
    w = Window.partitionBy(*SERIES).orderBy("_day")
    added = {f"daily_lag_{k}": F.coalesce(F.sum("units_sold").over(w.rangeBetween(-k, -k)), F.lit(0.0)) for k in offsets}
    if observed:
        added |= {f"daily_lag_{k}_observed": F.coalesce(F.max("_seen").over(w.rangeBetween(-k, -k)), F.lit(0.0)) for k in offsets}
    return both.select("_row", *[c.alias(n) for n, c in added.items()]).filter("_row IS NOT NULL").select("_row.*", *added)


def _calendar(day: str) -> dict[str, Column]:
    return {"target_dow": F.weekday(day), "target_month": F.month(day), "target_week_number": F.weekofyear(day)}


def fixed_origin_panel(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Daily targets of the next week with lags that end before the forecast origin."""
    last_known = F.expr("date_add(week, 6)")
    shortest = min(FIXED_LAGS)
    late = F.expr(f"date_sub(target_date, {shortest})") > last_known
    # As a filter the rule holds whichever columns are read afterwards.
    guard = F.when(late, F.raise_error(F.lit("a daily lag crosses the forecast origin")).cast("boolean")).otherwise(True)
    rows = expand_horizon(weekly).filter(guard)
    looked = look_back(rows, daily, [0, *FIXED_LAGS]).withColumnRenamed("daily_lag_0", "target_daily")
    return looked.withColumns(_calendar("target_date"))


def target_reconstruction(fixed: DataFrame) -> DataFrame:
    """Do the seven daily targets add up to the weekly label? Count of origins and mismatches."""
    weekly = fixed.groupBy(*WEEK_KEYS).agg(F.sum("target_daily").alias("_sum"), F.max(LABEL).alias("_label"))
    return weekly.agg(F.count(F.lit(1)).alias("n_origins"),
                      count_if(F.abs(F.col("_sum") - F.col("_label")) > 1e-6).alias("n_mismatched"))


def same_weekday_features(daily: DataFrame, fixed: DataFrame) -> DataFrame:
    """Eight same-weekday lags, whether each was recorded, and their summaries and shares."""
    lags = [f"daily_lag_{k}" for k in WEEKDAY_LAGS]
    out = look_back(fixed.drop(*[c for c in lags if c in fixed.columns]), daily, WEEKDAY_LAGS, observed=True)
    values = F.array(*[F.col(c) for c in lags])

    def mean(xs: Column, n: int) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / n

    ordered, mean8 = F.array_sort(values), mean(values, len(lags))
    spread = F.aggregate(F.transform(values, lambda v: (v - mean8) * (v - mean8)), F.lit(0.0), lambda a, v: a + v)

    def share(day: str, week: str) -> Column:
        return F.when(F.col(week) > 0, F.col(day) / F.col(week)).otherwise(0.0)

    shares = [share("daily_lag_7", "units_sold"), share("daily_lag_14", "lag_1"), share("daily_lag_21", "lag_2")]
    return out.withColumns({
        "same_dow_mean_4": mean(F.slice(values, 1, 4), 4),
        "same_dow_mean_8": mean8,
        "same_dow_median_8": (F.get(ordered, F.lit(3)) + F.get(ordered, F.lit(4))) / 2,
        "same_dow_std_8": F.sqrt(spread / (len(lags) - 1)),
        "last_week_share": shares[0],
        "same_dow_share_mean_3": (shares[0] + shares[1] + shares[2]) / 3,
    })


def rolling_panel(daily: DataFrame) -> DataFrame:
    """One-day-ahead rows on the completed panel: lags and trailing means that end yesterday."""
    w = series_window(order="date")
    cols = {f"daily_lag_{k}": F.lag("units_sold_daily", k).over(w) for k in ROLLING_LAGS}
    for n in ROLLING_MEANS:
        past = w.rowsBetween(-n, -1)
        cols[f"daily_rolling_mean_{n}"] = F.when(
            F.count("units_sold_daily").over(past) == n, F.avg("units_sold_daily").over(past))
    out = complete_daily_panel(daily).drop("observed").withColumns(cols).withColumns(_calendar("date"))
    out = out.withColumn("target_week", F.trunc("date", "week"))
    return out.withColumn("week", F.date_sub("target_week", 7)).dropna(subset=list(cols))


def daily_to_weekly(scored: DataFrame) -> DataFrame:
    """Sum the daily targets and forecasts of an origin to the week."""
    return scored.groupBy(*WEEK_KEYS).agg(F.sum("target_daily").alias("actual"), F.sum("prediction").alias("prediction"))


def compact_weekly(weekly: DataFrame) -> DataFrame:
    """Target-week calendar of every origin."""
    target = F.date_add("week", 7)
    return weekly.withColumns({"target_week": target, "target_week_number": F.weekofyear(target),
                               "target_month": F.month(target), "target_year": F.year(target)})
