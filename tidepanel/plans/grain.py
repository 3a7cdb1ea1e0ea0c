"""Daily-grain frames, seasonal decomposition and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import daily_grain as dg
from tidepanel.operators import encode, features, launch, ledger, rollup, seasonal
from tidepanel.plans import scoring
from tidepanel.plans.oracle_base import cte
from tidepanel.plans.registry import query
from tidepanel.schema import LABEL, SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage, stored
from tidepanel.sources import tables

KEY_SPEC = "sku:s channel:s region:s week:d"
_ORIGIN_COLS = ["units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", LABEL]

cte("day_panel", """
SELECT s.sku, s.channel, s.region, s.date, coalesce(d.units_sold, 0) AS units_sold_daily,
       CASE WHEN d.date IS NULL THEN 0 ELSE 1 END AS observed
FROM (SELECT sku, channel, region, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
             INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY sku, channel, region) s
LEFT JOIN daily d USING (sku, channel, region, date)
""")


@query("complete_daily_panel", """
SELECT sku, channel, region, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n_days, sum(observed) AS n_observed,
       sum(units_sold_daily) AS units, sum(units_sold_daily * day(date)) AS checksum FROM day_panel GROUP BY ALL""",
       "sku:s channel:s region:s month:d n_days:i n_observed:i units:f checksum:f")
def complete_daily_panel(spark, sf):
    """Whole panel, summed per series and month to keep the result comparable."""
    panel = dg.complete_daily_panel(tables.sales_daily(spark, sf))
    return panel.groupBy(*SERIES, F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("observed").alias("n_observed"), F.sum("units_sold_daily").alias("units"),
        F.sum(F.col("units_sold_daily") * F.dayofmonth("date")).alias("checksum"))


cte("horizons", """
SELECT b.sku, b.channel, b.region, b.week, b.units_sold, b.lag_1, b.lag_2, b.rolling_mean_4, b.rolling_std_4, b.target_next_week,
       h AS horizon, b.week + 6 + CAST(h AS INTEGER) AS target_date
FROM base b, (SELECT unnest(generate_series(1, 7)) AS h)
""")


def _lookup(k: int) -> str:
    return (f"LEFT JOIN (SELECT sku, channel, region, date + {k} AS target_date, units_sold AS u{k} FROM daily) d{k} "
            "USING (sku, channel, region, target_date)")


cte("fixed_origin", "SELECT h.*, " + ", ".join(f"coalesce(u{k}, 0) AS {'target_daily' if k == 0 else f'daily_lag_{k}'}"
                                             for k in [0, *dg.FIXED_LAGS])
    + ", isodow(target_date) - 1 AS target_dow, month(target_date) AS target_month, week(target_date) AS target_week_number FROM horizons h "
    + " ".join(_lookup(k) for k in [0, *dg.FIXED_LAGS]))
# One row per origin: the seven horizons folded into ordered checksums so that every value still counts.
_FOLD_COLS = ["target_daily", "daily_lag_7", "daily_lag_14", "daily_lag_28", "target_dow", "target_month", "target_week_number"]


def _fold_sql(source: str, cols: list[str]) -> str:
    return (f"SELECT sku, channel, region, week, count(*) AS n_horizons, max(target_date) AS last_target, "
            + ", ".join(f"sum({c} * horizon) AS {c}" for c in cols) + f" FROM {source} GROUP BY sku, channel, region, week")


def _fold(df, cols):
    return df.groupBy(*WEEK_KEYS).agg(
        F.count(F.lit(1)).alias("n_horizons"), F.max("target_date").alias("last_target"),
        *[F.sum((F.col(c) * F.col("horizon")).cast("double")).alias(c) for c in cols])


def _fold_spec(cols):
    return KEY_SPEC + " n_horizons:i last_target:d " + " ".join(f"{c}:f" for c in cols)


def _origins(daily):
    return rollup.labelled_weeks(daily).select(*WEEK_KEYS, *_ORIGIN_COLS)


@query("horizon_expand", _fold_sql("horizons", ["units_sold"]), _fold_spec(["units_sold"]))
def horizon_expand(spark, sf):
    return _fold(dg.expand_horizon(_origins(tables.sales_daily(spark, sf))), ["units_sold"])


@query("daily_lag_lookup", "SELECT sku, channel, region, target_date, " + ", ".join(f"sum(u) FILTER (k = {k}) AS daily_lag_{k}" for k in dg.FIXED_LAGS)
       + """ FROM (SELECT sku, channel, region, date + CAST(k AS INTEGER) AS target_date, k, units_sold AS u
                   FROM daily, (SELECT unnest([7, 14, 28]) AS k)) GROUP BY ALL""",
       "sku:s channel:s region:s target_date:d " + " ".join(f"daily_lag_{k}:f" for k in dg.FIXED_LAGS))
def daily_lag_lookup(spark, sf):
    return dg.day_lookups(tables.sales_daily(spark, sf), dg.FIXED_LAGS)


@query("fixed_origin_daily_panel", _fold_sql("fixed_origin", _FOLD_COLS), _fold_spec(_FOLD_COLS))
def fixed_origin_daily_panel(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    return _fold(dg.fixed_origin_panel(daily, _origins(daily)), _FOLD_COLS)


@query("target_reconstruction", """
SELECT count(*) AS n_origins, count(*) FILTER (abs(s - l) > 1e-6) AS n_mismatched
FROM (SELECT sum(target_daily) AS s, max(target_next_week) AS l FROM fixed_origin GROUP BY sku, channel, region, week)""",
       "n_origins:i n_mismatched:i")
def target_reconstruction(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return dg.target_reconstruction(dg.fixed_origin_panel(daily, _origins(daily)))


_L8 = [f"daily_lag_{k}" for k in dg.WEEKDAY_LAGS]
cte("weekday_rows", "SELECT f.* EXCLUDE (daily_lag_7, daily_lag_14, daily_lag_28), "
    + ", ".join(f"coalesce(u{k}, 0) AS daily_lag_{k}, CASE WHEN u{k} IS NULL THEN 0 ELSE 1 END AS daily_lag_{k}_observed" for k in dg.WEEKDAY_LAGS)
    + " FROM fixed_origin f " + " ".join(_lookup(k) for k in dg.WEEKDAY_LAGS))
_SHARE = "CASE WHEN {w} > 0 THEN {d} / {w} ELSE 0 END"
cte("weekday_stats", f"""
SELECT *, (daily_lag_7 + daily_lag_14 + daily_lag_21 + daily_lag_28) / 4 AS same_dow_mean_4, list_avg([{', '.join(_L8)}]) AS same_dow_mean_8,
       list_median([{', '.join(_L8)}]) AS same_dow_median_8, list_stddev_samp([{', '.join(_L8)}]) AS same_dow_std_8,
       {_SHARE.format(d='daily_lag_7', w='units_sold')} AS last_week_share,
       ({_SHARE.format(d='daily_lag_7', w='units_sold')} + {_SHARE.format(d='daily_lag_14', w='lag_1')}
        + {_SHARE.format(d='daily_lag_21', w='lag_2')}) / 3 AS same_dow_share_mean_3
FROM weekday_rows""")
_STAT_COLS = _L8 + [f"{c}_observed" for c in _L8] + ["same_dow_mean_4", "same_dow_mean_8", "same_dow_median_8", "same_dow_std_8",
                                                    "last_week_share", "same_dow_share_mean_3"]


@query("same_weekday_stats", _fold_sql("weekday_stats", _STAT_COLS), _fold_spec(_STAT_COLS))
def same_weekday_stats(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    return _fold(dg.same_weekday_features(daily, dg.fixed_origin_panel(daily, _origins(daily))), _STAT_COLS)


_ROLL_COLS = ["daily_lag_1", "daily_lag_7", "daily_lag_14", "daily_lag_28", "daily_rolling_mean_7", "daily_rolling_mean_28"]


@query("daily_rolling_features", "SELECT sku, channel, region, week, count(*) AS n_days, sum(units_sold_daily) AS units, "
       + ", ".join(f"sum({c} * (dow + 1)) AS {c}" for c in _ROLL_COLS) + """
FROM (SELECT *, isodow(date) - 1 AS dow, CAST(date_trunc('week', date) AS DATE) - 7 AS week,
        lag(units_sold_daily, 1) OVER s AS daily_lag_1, lag(units_sold_daily, 7) OVER s AS daily_lag_7,
        lag(units_sold_daily, 14) OVER s AS daily_lag_14, lag(units_sold_daily, 28) OVER s AS daily_lag_28,
        avg(units_sold_daily) OVER (s ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS daily_rolling_mean_7,
        avg(units_sold_daily) OVER (s ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS daily_rolling_mean_28
      FROM day_panel WINDOW s AS (PARTITION BY sku, channel, region ORDER BY date))
WHERE daily_lag_28 IS NOT NULL GROUP BY sku, channel, region, week""",
       KEY_SPEC + " n_days:i units:f " + " ".join(f"{c}:f" for c in _ROLL_COLS))
def daily_rolling_features(spark, sf):
    rows = dg.rolling_panel(tables.sales_daily(spark, sf))
    return rows.groupBy(*WEEK_KEYS).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("units_sold_daily").alias("units"),
        *[F.sum(F.col(c) * (F.col("target_dow") + 1)).alias(c) for c in _ROLL_COLS])


@query("daily_to_weekly_forecast", """
SELECT sku, channel, region, week, sum(target_daily) AS actual, sum(greatest(daily_lag_7, 0)) AS prediction
FROM fixed_origin GROUP BY ALL""", KEY_SPEC + " actual:f prediction:f")
def daily_to_weekly_forecast(spark, sf):
    daily = tables.sales_daily(spark, sf)
    fixed = dg.fixed_origin_panel(daily, _origins(daily)).withColumn("prediction", F.greatest("daily_lag_7", F.lit(0.0)))
    return dg.daily_to_weekly(fixed)


@query("compact_weekly_features", """
SELECT sku, channel, region, week, week + 7 AS target_week, week(week + 7) AS target_week_number, month(week + 7) AS target_month,
       year(week + 7) AS target_year FROM base""",
       KEY_SPEC + " target_week:d target_week_number:i target_month:i target_year:i")
def compact_weekly_features(spark, sf):
    return dg.compact_weekly(rollup.labelled_weeks(tables.sales_daily(spark, sf)).select(*WEEK_KEYS))


# ---------------------------------------------------------------- seasonality

def _decomposition(prefix: str, agg: str) -> None:
    cte(f"{prefix}_line", f"""
SELECT category, week, coalesce(v, pv + (nv - pv) * date_diff('day', pw, week) / date_diff('day', pw, nw)) AS value FROM (
  SELECT category, week, v, last_value(v IGNORE NULLS) OVER b AS pv, first_value(v IGNORE NULLS) OVER a AS nv,
         last_value(CASE WHEN v IS NOT NULL THEN week END IGNORE NULLS) OVER b AS pw,
         first_value(CASE WHEN v IS NOT NULL THEN week END IGNORE NULLS) OVER a AS nw
  FROM (SELECT s.category, s.week, c.v FROM (
          SELECT category, CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP), CAST(max(week) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week
          FROM labelled GROUP BY category) s
        LEFT JOIN (SELECT category, week, {agg}(units_sold) AS v FROM labelled GROUP BY ALL) c USING (category, week))
  WINDOW b AS (PARTITION BY category ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY category ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""")
    cte(f"{prefix}_trended", f"""
SELECT x.category, x.week, x.value, x.i, x.i % 52 AS phase, y.trend FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY week) - 1 AS i FROM {prefix}_line) x
LEFT JOIN (SELECT a.category, a.i, sum(b.value * CASE WHEN abs(b.i - a.i) = 26 THEN 0.5 ELSE 1 END) / 52 AS trend FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY week) - 1 AS i FROM {prefix}_line) a JOIN (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY week) - 1 AS i FROM {prefix}_line) b
    ON a.category = b.category AND b.i BETWEEN a.i - 26 AND a.i + 26 GROUP BY a.category, a.i HAVING count(*) = 53) y
ON x.category = y.category AND x.i = y.i
""")
    cte(f"{prefix}_parts", f"""
SELECT t.category, t.week, t.value, t.trend, t.phase, s.seasonal, t.value - t.trend - s.seasonal AS residual
FROM {prefix}_trended t JOIN (
  SELECT category, phase, m - avg(m) OVER (PARTITION BY category) AS seasonal
  FROM (SELECT category, phase, avg(value - trend) AS m FROM {prefix}_trended GROUP BY ALL)) s USING (category, phase)
""")
    cte(f"{prefix}_shares", f"""
SELECT category, count(*) AS n_weeks, var_pop(seasonal) / var_pop(value) AS seasonal_share, var_pop(trend) / var_pop(value) AS trend_share,
       var_pop(residual) / var_pop(value) AS resid_share FROM {prefix}_parts WHERE residual IS NOT NULL GROUP BY category
""")


_decomposition("season_sum", "sum")
_decomposition("season_mean", "avg")


def _labelled(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return features.attach_static_attrs(rollup.labelled_weeks(daily), daily)


@query("seasonal_decomposition", "SELECT * FROM season_sum_parts",
       "category:s week:d value:f trend:f phase:i seasonal:f residual:f")
def seasonal_decomposition(spark, sf):
    return seasonal.decompose(seasonal.category_series(_labelled(spark, sf)))


@query("variance_shares", "SELECT * FROM season_sum_shares", "category:s n_weeks:i seasonal_share:f trend_share:f resid_share:f")
def variance_shares(spark, sf):
    return seasonal.variance_shares(seasonal.decompose(seasonal.category_series(_labelled(spark, sf))))


@query("variance_robustness", """
SELECT a.category, a.skus_first, a.skus_last, s.seasonal_share AS seasonal_share_sum, s.trend_share AS trend_share_sum,
       m.seasonal_share AS seasonal_share_mean, m.trend_share AS trend_share_mean
FROM (SELECT category, arg_min(n, week) AS skus_first, arg_max(n, week) AS skus_last
      FROM (SELECT category, week, count(DISTINCT sku) AS n FROM labelled GROUP BY ALL) GROUP BY category) a
JOIN season_sum_shares s USING (category) JOIN season_mean_shares m USING (category)""",
       "category:s skus_first:i skus_last:i seasonal_share_sum:f trend_share_sum:f seasonal_share_mean:f trend_share_mean:f")
def variance_robustness(spark, sf):
    return seasonal.variance_robustness(cut_lineage(_labelled(spark, sf)))


# ---------------------------------------------------------------- encodings

_CODED = ["sku", "category", "segment", "brand", "channel", "region"]
TRAIN_UNTIL = "1996-01-01"


@query("train_vocab_codes", "SELECT l.sku, l.channel, l.region, " + ", ".join(f"coalesce(c_{c}.code, -1) AS {c}_code" for c in _CODED)
       + " FROM launches l " + " ".join(
           f"LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM launches "
           f"WHERE first_seen < DATE '{TRAIN_UNTIL}')) c_{c} ON l.{c} = c_{c}.v" for c in _CODED),
       "sku:s channel:s region:s " + " ".join(f"{c}_code:i" for c in _CODED))
def train_vocab_codes(spark, sf):
    records = cut_lineage(launch.seven_day_launch_records(stored(tables.launch_daily(spark, sf).select(*launch.RECORD_INPUTS))))
    codes = cut_lineage(encode.fit_codes(records.filter(F.col("first_seen") < F.lit(TRAIN_UNTIL).cast("date")), _CODED))
    return encode.apply_codes(records, codes, _CODED).select(*SERIES, *[f"{c}_code" for c in _CODED])


@query("ordered_target_encoding", """
SELECT r.sku, r.channel, r.region, r.week, (coalesce(c.s, 0) + p.m) / (coalesce(c.n, 0) + 1) AS category_encoded
FROM labelled r
LEFT JOIN (SELECT a.category, a.week, sum(b.s) AS s, sum(b.n) AS n FROM (SELECT DISTINCT category, week FROM labelled) a
           JOIN (SELECT category, week, sum(target_next_week) AS s, count(*) AS n FROM labelled GROUP BY ALL) b
           ON a.category = b.category AND b.week <= a.week - 14 GROUP BY a.category, a.week) c USING (category, week)
LEFT JOIN (SELECT a.week, sum(b.s) / sum(b.n) AS m FROM (SELECT DISTINCT week FROM labelled) a
           JOIN (SELECT week, sum(target_next_week) AS s, count(*) AS n FROM labelled GROUP BY ALL) b
           ON b.week <= a.week - 14 GROUP BY a.week) p USING (week)""", KEY_SPEC + " category_encoded:f")
def ordered_target_encoding(spark, sf):
    return encode.ordered_target_encoding(_labelled(spark, sf), "category", LABEL).select(*WEEK_KEYS, "category_encoded")


@query("embedding_lookup", f"""
SELECT l.sku, l.channel, l.region, coalesce(v.e0, m.a0) AS sku_emb_0, coalesce(v.e1, m.a1) AS sku_emb_1
FROM launches l LEFT JOIN (SELECT sku, avg(launch_units) AS e0, avg(observed_days) AS e1 FROM launches
  WHERE first_seen < DATE '{TRAIN_UNTIL}' GROUP BY sku) v USING (sku),
 (SELECT avg(e0) AS a0, avg(e1) AS a1 FROM (SELECT sku, avg(launch_units) AS e0, avg(observed_days) AS e1 FROM launches
  WHERE first_seen < DATE '{TRAIN_UNTIL}' GROUP BY sku)) m""", "sku:s channel:s region:s sku_emb_0:f sku_emb_1:f")
def embedding_lookup(spark, sf):
    """Vectors learned before the cutoff, looked up for every launch; later items fall back to the mean vector."""
    records = cut_lineage(launch.seven_day_launch_records(stored(tables.launch_daily(spark, sf).select(*launch.RECORD_INPUTS))))
    vectors = records.filter(F.col("first_seen") < F.lit(TRAIN_UNTIL).cast("date")).groupBy(F.col("sku").alias("entity")).agg(
        F.array(F.avg("launch_units"), F.avg("observed_days").cast("double")).alias("vector"))
    return encode.lookup_embeddings(records, vectors, "sku", 2).select(*SERIES, "sku_emb_0", "sku_emb_1")


@query("tuning_leaderboard", f"""
SELECT model_id AS candidate, WAPE AS pooled_wape, row_number() OVER (ORDER BY floor(WAPE * 1e12), model_id) AS position
FROM (SELECT model_id, {scoring.metrics_sql()} FROM cv_ledger WHERE fold_id <= 3 GROUP BY model_id)""",
       "candidate:s pooled_wape:f position:i")
def tuning_leaderboard(spark, sf):
    from tidepanel.operators.models import leaderboard
    development = scoring.cv_ledger(spark, sf).filter("fold_id <= 3")
    return leaderboard(ledger.score_ledger(development).select(F.col("model_id").alias("candidate"), F.col("WAPE").alias("pooled_wape")))
