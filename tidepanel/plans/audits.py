"""Validation reports and descriptive audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import audit, features, quantiles, rollup, validate
from tidepanel.plans.oracle_base import cte
from tidepanel.plans.registry import query
from tidepanel.schema import DAY_KEYS, SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage
from tidepanel.sources import tables

CHECK_SPEC = "check_:s passed:b n_failures:i detail:s"
METRIC_SPEC = "metric:s value:f"


def _report(df):
    """'check' is a reserved word in SQL."""
    return df.withColumnRenamed("check", "check_")


@query("duplicate_keys", """
SELECT count(*) AS n_rows, count(DISTINCT (sku, channel, region, date)) AS n_keys,
       count(*) - count(DISTINCT (sku, channel, region, date)) AS n_duplicates FROM sales_rows""",
       "n_rows:i n_keys:i n_duplicates:i")
def duplicate_keys(spark, sf):
    return validate.duplicate_rows(tables.sales_rows(spark, sf), DAY_KEYS)


@query("range_checks", """
SELECT 'rows ' || c || ' >= 0' AS check_, n = 0 AS passed, n AS n_failures, n || ' row(s)' AS detail FROM (
  SELECT 'units_sold' AS c, count(*) FILTER (units_sold < 0) AS n FROM sales_rows
  UNION ALL SELECT 'stock_available', count(*) FILTER (stock_available < 0) FROM sales_rows
  UNION ALL SELECT 'ship_lag_days', count(*) FILTER (ship_lag_days < 0) FROM sales_rows)
UNION ALL
SELECT 'rows ' || c || ' > 0', n = 0, n, n || ' row(s)' FROM (
  SELECT 'price_unit' AS c, count(*) FILTER (price_unit <= 0) AS n FROM sales_rows
  UNION ALL SELECT 'ship_lag_days', count(*) FILTER (ship_lag_days <= 0) FROM sales_rows)
""", CHECK_SPEC)
def range_checks(spark, sf):
    rows = tables.sales_rows(spark, sf)
    return _report(validate.check_ranges(rows, "rows", ["units_sold", "stock_available", "ship_lag_days"],
                                         ["price_unit", "ship_lag_days"]))


cte("rollup_check", """
SELECT 'weekly sums match daily rows' AS check_, bad = 0 AS passed, bad AS n_failures, bad || '/' || n || ' mismatched' AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (b.units_sold <> w.units_sold) AS bad
      FROM base b JOIN weekly w USING (sku, channel, region, week))
""")
cte("target_check", """
SELECT 'label is next week''s sales' AS check_, bad = 0 AS passed, bad AS n_failures, bad || '/' || n || ' mismatched' AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (b.target_next_week <> x.units_sold) AS bad
      FROM base b JOIN base x ON (b.sku, b.channel, b.region, b.week + 7) = (x.sku, x.channel, x.region, x.week))
""")
cte("lag_check", """
SELECT c || ' uses past weeks only' AS check_, bad = 0 AS passed, bad AS n_failures, bad || '/' || n || ' mismatched' AS detail
FROM (SELECT unnest(['lag_1', 'lag_2', 'rolling_mean_4', 'rolling_std_4', 'momentum']) AS c,
             unnest([l1, l2, rm, rs, mo]) AS bad, n
  FROM (SELECT count(*) AS n, count(*) FILTER (round(b.lag_1, 3) <> round(l.lag_1, 3)) AS l1,
               count(*) FILTER (round(b.lag_2, 3) <> round(l.lag_2, 3)) AS l2,
               count(*) FILTER (abs(b.rolling_mean_4 - l.rolling_mean_4) > 1e-6) AS rm,
               count(*) FILTER (abs(b.rolling_std_4 - l.rolling_std_4) > 1e-6) AS rs,
               count(*) FILTER (abs(b.momentum - l.momentum) > 1e-6) AS mo
        FROM base b JOIN lagged l USING (sku, channel, region, week)))
""")


@query("check_weekly_rollup", "SELECT * FROM rollup_check", CHECK_SPEC)
def check_weekly_rollup(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return _report(validate.check_weekly_rollup(daily, rollup.labelled_weeks(daily)))


@query("check_target_leakage", "SELECT * FROM target_check", CHECK_SPEC)
def check_target_leakage(spark, sf):
    return _report(validate.check_target(rollup.labelled_weeks(tables.sales_daily(spark, sf))))


@query("check_lag_rolling_leakage", "SELECT * FROM lag_check", CHECK_SPEC)
def check_lag_rolling_leakage(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    return _report(validate.check_lags(daily, rollup.labelled_weeks(daily)))


def _range_rows(table: str, cols: list[str], op: str, bad: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table} {c} {op} 0', count(*) FILTER ({c} {bad} 0) FROM {'daily' if table == 'daily' else 'base'}"
        for c in cols)


@query("run_all_checks", f"""
SELECT c AS check_, n = 0 AS passed, n AS n_failures, n || ' row(s)' AS detail FROM (
  SELECT 'unique sku-channel-region-date' AS c, count(*) - count(DISTINCT (sku, channel, region, date)) AS n FROM daily
  UNION ALL SELECT 'unique sku-channel-region-week', count(*) - count(DISTINCT (sku, channel, region, week)) FROM base
  UNION ALL {_range_rows('daily', ['units_sold', 'stock_available', 'delivered_qty'], '>=', '<')}
  UNION ALL {_range_rows('daily', ['price_unit'], '>', '<=')}
  UNION ALL {_range_rows('weekly', ['units_sold', 'stock_available', 'sku_age'], '>=', '<')}
  UNION ALL {_range_rows('weekly', ['price_unit'], '>', '<=')})
UNION ALL SELECT * FROM rollup_check UNION ALL SELECT * FROM target_check UNION ALL SELECT * FROM lag_check
""", CHECK_SPEC)
def run_all_checks(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    return _report(validate.run_all_checks(daily, cut_lineage(rollup.weekly_base(daily))))


@query("panel_completeness", """
SELECT sum(span) AS expected_days, sum(days) AS actual_days, sum(days) / sum(span) AS present_fraction
FROM (SELECT sku, channel, region, count(DISTINCT date) AS days, date_diff('day', min(date), max(date)) + 1 AS span
      FROM sales_rows GROUP BY ALL)""", "expected_days:i actual_days:i present_fraction:f")
def panel_completeness(spark, sf):
    return audit.panel_completeness(tables.sales_rows(spark, sf))


@query("grain_noise_cv", """
SELECT daily_cv, weekly_cv, daily_cv / weekly_cv AS ratio FROM
 (SELECT avg(cv) AS daily_cv FROM (SELECT CASE WHEN avg(units_sold) > 0 THEN stddev_samp(units_sold) / avg(units_sold) END AS cv
   FROM daily GROUP BY sku, channel, region)),
 (SELECT avg(cv) AS weekly_cv FROM (SELECT CASE WHEN avg(units_sold) > 0 THEN stddev_samp(units_sold) / avg(units_sold) END AS cv
   FROM base GROUP BY sku, channel, region))""", "daily_cv:f weekly_cv:f ratio:f")
def grain_noise_cv(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return audit.grain_noise(daily, rollup.labelled_weeks(daily))


cte("stock_moves", """
SELECT lead(stock_available) OVER w AS next_stock, greatest(0, stock_available + delivered_qty - units_sold) AS expected,
       date_diff('day', date, lead(date) OVER w) AS gap
FROM daily WINDOW w AS (PARTITION BY sku, region ORDER BY date, channel)
""")
cte("stock_shared", """
SELECT count(*) FILTER (c >= 2) AS multi, count(*) FILTER (c >= 2 AND s = 1) AS same
FROM (SELECT count(DISTINCT channel) AS c, count(DISTINCT stock_available) AS s FROM daily GROUP BY sku, region, date)
""")


@query("stock_transition_audit", """
SELECT unnest(['adjacent_row_n', 'adjacent_row_exact', 'same_date_n', 'same_date_exact', 'next_day_n', 'next_day_exact',
               'longer_gap_n', 'longer_gap_exact']) AS metric,
       unnest([count(*), count(*) FILTER (hit), count(*) FILTER (gap = 0), count(*) FILTER (gap = 0 AND hit),
               count(*) FILTER (gap = 1), count(*) FILTER (gap = 1 AND hit), count(*) FILTER (gap > 1),
               count(*) FILTER (gap > 1 AND hit)]) AS value
FROM (SELECT gap, abs(next_stock - expected) <= 1e-8 + 1e-5 * abs(expected) AS hit FROM stock_moves
      WHERE next_stock IS NOT NULL)
UNION ALL SELECT 'multi_channel_dates', multi FROM stock_shared
UNION ALL SELECT 'same_stock_dates', same FROM stock_shared""", METRIC_SPEC)
def stock_transition_audit(spark, sf):
    return audit.stock_transitions(tables.sales_daily(spark, sf))


cte("semantics", """
SELECT f.deliveries, f.stock_avg, f.stock_available, x.stock, x.n, x.pos
FROM features f LEFT JOIN (
  SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, avg(stock_available) AS stock,
         count(delivery_days) AS n, count(*) FILTER (delivered_qty > 0) AS pos
  FROM daily GROUP BY ALL) x USING (sku, channel, region, week)
""")


def _far(a: str, b: str) -> str:
    return f"count(*) FILTER (({a} IS NULL) <> ({b} IS NULL) OR abs({a} - {b}) > 1e-8 + 1e-5 * abs({b}))"


@query("enrichment_semantics_audit", f"""
SELECT 'delivered_qty_positive_rate' AS metric, avg(CASE WHEN delivered_qty > 0 THEN 1.0 ELSE 0.0 END) AS value FROM daily
UNION ALL SELECT 'delivery_days_null_rate', avg(CASE WHEN delivery_days IS NULL THEN 1.0 ELSE 0.0 END) FROM daily
UNION ALL SELECT 'deliveries_vs_row_count', count(*) FILTER (deliveries IS DISTINCT FROM n) FROM semantics
UNION ALL SELECT 'deliveries_vs_positive_days', count(*) FILTER (deliveries IS DISTINCT FROM pos) FROM semantics
UNION ALL SELECT 'stock_avg_vs_recomputed', {_far('stock_avg', 'stock')} FROM semantics
UNION ALL SELECT 'stock_available_vs_recomputed', {_far('stock_available', 'stock')} FROM semantics
UNION ALL SELECT 'stock_avg_vs_stock_available', {_far('stock_avg', 'stock_available')} FROM semantics
UNION ALL SELECT 'deliveries=' || coalesce(CAST(deliveries AS VARCHAR), 'none'), count(*) FROM semantics GROUP BY deliveries
""", METRIC_SPEC)
def enrichment_semantics_audit(spark, sf):
    daily = tables.sales_daily(spark, sf)
    base = rollup.labelled_weeks(daily).join(features.internal_aggregates(daily), WEEK_KEYS, "left")
    return audit.enrichment_semantics(daily, base)


_GRAIN_COLS = ["avg_temp", "event_score", "price_unit", "units_sold"]


@query("grain_violation_audit", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(v) AS n_groups, count(*) FILTER (v) AS n_varying, avg(s) AS mean_std, max(s) AS max_std
FROM (SELECT min({c}) <> max({c}) AS v, stddev_samp({c}) AS s FROM features GROUP BY region, week)""" for c in _GRAIN_COLS),
       "column_name:s n_groups:i n_varying:i mean_std:f max_std:f")
def grain_violation_audit(spark, sf):
    table = features.feature_table(tables.sales_daily(spark, sf))
    return audit.grain_violations(table, _GRAIN_COLS).withColumnRenamed("column", "column_name")


@query("promo_confounding_profile", """
SELECT 'price_by_promotion' AS profile, CAST(promotion_flag AS VARCHAR) AS level, avg(price_unit) AS value FROM base GROUP BY ALL
UNION ALL SELECT 'promotion_by_channel', channel, avg(promotion_flag) FROM base GROUP BY ALL
UNION ALL SELECT 'promotion_by_summer', CAST(is_summer AS VARCHAR), avg(promotion_flag) FROM base GROUP BY ALL
UNION ALL SELECT 'naive_uplift', 'all', avg(units_sold) FILTER (promotion_flag = 1) / avg(units_sold) FILTER (promotion_flag = 0) - 1
  FROM base""", "profile:s level:s value:f")
def promo_confounding_profile(spark, sf):
    return audit.promo_profile(cut_lineage(rollup.weekly_base(tables.sales_daily(spark, sf))))


@query("eda_profile", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_null, avg({c}) AS mean, stddev_samp({c}) AS std,
       min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75 FROM daily""" for c in audit.AUDITED_MEASURES),
       "column_name:s n:i n_null:i mean:f std:f min:f max:f p25:f p50:f p75:f")
def eda_profile(spark, sf):
    return audit.describe(tables.sales_daily(spark, sf)).withColumnRenamed("column", "column_name")


@query("eda_groups", """
SELECT 'promo_rate_by_category' AS profile, category AS level, avg(promotion_flag) AS value FROM daily GROUP BY category
UNION ALL SELECT 'units_by_channel', channel, sum(units_sold) FROM daily GROUP BY channel
UNION ALL SELECT 'series', 'all', count(DISTINCT (sku, channel, region)) FROM daily""", "profile:s level:s value:f")
def eda_groups(spark, sf):
    return audit.group_profile(tables.sales_daily(spark, sf))


@query("rollup_conservation", """
SELECT 'daily_units' AS metric, sum(units_sold) AS value FROM daily
UNION ALL SELECT 'weekly_units', sum(units_sold) FROM weekly
UNION ALL SELECT 'weeks_not_monday', count(*) FILTER (isodow(week) <> 1) FROM weekly
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (sku, channel, region, week)) FROM weekly
UNION ALL SELECT 'n_series', count(DISTINCT (sku, channel, region)) FROM weekly
UNION ALL SELECT 'min_weeks', min(n) FROM (SELECT count(*) AS n FROM weekly GROUP BY sku, channel, region)
UNION ALL SELECT 'max_weeks', max(n) FROM (SELECT count(*) AS n FROM weekly GROUP BY sku, channel, region)
""", METRIC_SPEC)
def rollup_conservation(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return audit.rollup_conservation(daily, rollup.weekly_rollup(daily))


@query("total_sales_trend", """
SELECT date, units, CASE WHEN row_number() OVER (ORDER BY date) >= 7
       THEN avg(units) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS trend
FROM (SELECT date, sum(units_sold) AS units FROM daily GROUP BY date)""", "date:d units:f trend:f")
def total_sales_trend(spark, sf):
    return audit.total_sales_trend(tables.sales_daily(spark, sf))


@query("date_range_filter", """
SELECT sku, channel, region, date, units_sold,
       date >= (SELECT CAST(date_trunc('week', min(date)) AS DATE) + 7 FROM daily WHERE date BETWEEN DATE '2001-07-25' AND DATE '2001-09-30')
         AS full_week
FROM daily WHERE date BETWEEN DATE '2001-07-25' AND DATE '2001-09-30'""",
       "sku:s channel:s region:s date:d units_sold:f full_week:b")
def date_range_filter(spark, sf):
    rows = tables.sales_daily(spark, sf).filter(
        F.col("date").between(F.lit("2001-07-25").cast("date"), F.lit("2001-09-30").cast("date")))
    start = rows.agg(F.next_day(F.min("date"), "MON")).scalar()
    return rows.select(*SERIES, "date", "units_sold", (F.col("date") >= start).alias("full_week"))


# ---------------------------------------------------------------- batches against history

cte("history_rows", "SELECT * FROM sales_rows WHERE date < DATE '2001-10-01'")
cte("batch_rows", """
SELECT *, 'batch_' || CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS batch_file
FROM sales_rows WHERE date >= DATE '2001-10-01'""")
cte("broken_rows", "SELECT b.* FROM batch_rows b, (SELECT unnest([1, 2, 3]) AS k)")


def _ks(col: str, new: str) -> str:
    return f"""
SELECT '{col}' AS column_name, max(abs(ca / na - cb / nb)) AS ks FROM (
  SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb
  FROM (SELECT v, count(*) FILTER (s = 'a')::DOUBLE AS a, count(*) FILTER (s = 'b')::DOUBLE AS b FROM (
          SELECT {col} AS v, 'a' AS s FROM history_rows UNION ALL SELECT {col}, 'b' FROM {new}) GROUP BY v))"""


for _new in ("batch_rows", "broken_rows"):
    cte(f"ks_{_new}", "\nUNION ALL\n".join(_ks(c, _new) for c in audit.AUDITED_MEASURES))


@query("ks_two_sample", "SELECT * FROM ks_batch_rows", "column_name:s ks:f")
def ks_two_sample(spark, sf):
    return quantiles.ks_distance(tables.history_rows(spark, sf), tables.batch_rows(spark, sf),
                                 audit.AUDITED_MEASURES).withColumnRenamed("column", "column_name")


def _parts(rows: str) -> str:
    return f"""SELECT avg(n) AS r, avg(u) AS u FROM (SELECT count(*) AS n, sum(units_sold) AS u FROM {rows}
               GROUP BY sku, channel, region, date_trunc('week', date))"""


@query("level_shift_decomposition", f"""
SELECT unnest(['rows', 'units', 'units_per_row']) AS metric, unnest([a.r, a.u, a.u / a.r]) AS reference,
       unnest([b.r, b.u, b.u / b.r]) AS new_value,
       unnest([b.r / a.r, b.u / a.u, (b.u / b.r) / (a.u / a.r)]) AS ratio
FROM ({_parts("(SELECT * FROM history_rows WHERE date BETWEEN DATE '2001-07-30' AND DATE '2001-09-30')")}) a,
     ({_parts("(SELECT * FROM broken_rows WHERE date >= DATE '2001-10-08')")}) b
""", "metric:s reference:f new_value:f ratio:f")
def level_shift_decomposition(spark, sf):
    reference = tables.history_rows(spark, sf).filter(F.col("date") >= F.lit("2001-07-30").cast("date"))
    new = audit.full_weeks(tables.batch_rows(spark, sf, copies=3))
    return audit.level_shift(reference, new).withColumnRenamed("new", "new_value")


def _contract(new: str) -> str:
    def side(rows: str) -> str:
        return f"""
  SELECT x.*, y.*, z.* FROM
   (SELECT sum(n - 1) AS dup, max(n) AS max_n FROM (SELECT count(*) AS n FROM {rows} GROUP BY sku, channel, region, date)) x,
   (SELECT avg(d) / (SELECT date_diff('day', min(date), max(date)) + 1 FROM {rows}) AS cover
    FROM (SELECT count(DISTINCT date) AS d FROM {rows} GROUP BY sku, channel, region)) y,
   (SELECT min(date) AS lo, max(date) AS hi, count(DISTINCT date) AS nd, count(DISTINCT sku) AS nsku,
           avg(promotion_flag) AS pr,
           avg(units_sold) FILTER (promotion_flag = 1) / avg(units_sold) FILTER (promotion_flag = 0) AS lift,
           {', '.join(f'avg({c}) AS m_{c}' for c in audit.AUDITED_MEASURES)} FROM {rows}) z"""

    def weeks(rows: str, q: float) -> str:
        return f"""(WITH c AS (SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, sum(units_sold) AS u
                    FROM {rows} GROUP BY ALL),
                  s AS (SELECT sku, channel, region, CAST(unnest(generate_series(CAST(min(week) AS TIMESTAMP),
                          CAST(max(week) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM c GROUP BY sku, channel, region)
                  SELECT quantile_cont(coalesce(u, 0), {q}) FROM s LEFT JOIN c USING (sku, channel, region, week))"""

    per_row = "\nUNION ALL ".join(
        f"SELECT '{c} per row', h.m_{c}, b.m_{c}, (SELECT ks FROM ks_{new} WHERE column_name = '{c}'), "
        f"(SELECT ks < 0.2 FROM ks_{new} WHERE column_name = '{c}') FROM h, b" for c in audit.AUDITED_MEASURES)
    return f"""
SELECT * FROM (WITH h AS ({side('history_rows')}), b AS ({side(new)}),
w AS (SELECT {weeks('history_rows', 0.99)} AS hw, {weeks(f"(SELECT * FROM {new} WHERE date >= DATE '2001-10-08')", 0.5)} AS bw)
SELECT 'columns and types' AS check_, 14 AS history_value, 14 AS batch_value, NULL AS statistic, true AS consistent
UNION ALL SELECT 'items in batch', h.nsku, b.nsku, NULL,
  (SELECT count(*) FROM (SELECT DISTINCT sku FROM history_rows) f FULL JOIN (SELECT DISTINCT sku FROM {new}) g
   ON f.sku = g.sku WHERE f.sku IS NULL OR g.sku IS NULL) = 0 FROM h, b
UNION ALL SELECT 'date range continues', date_diff('day', h.hi, b.lo), b.nd, date_diff('day', b.lo, b.hi) + 1,
  b.lo > h.hi AND b.nd = date_diff('day', b.lo, b.hi) + 1 FROM h, b
UNION ALL SELECT 'duplicate series-day rows', h.dup, b.dup, NULL, h.dup = 0 AND b.dup = 0 FROM h, b
UNION ALL SELECT 'rows per series-day', h.max_n, b.max_n, NULL, b.max_n <= h.max_n FROM h, b
UNION ALL SELECT 'share of calendar days with a row', h.cover, b.cover, NULL, abs(b.cover - h.cover) < 0.1 FROM h, b
UNION ALL {per_row}
UNION ALL SELECT 'promotion rate per row', h.pr, b.pr, NULL, abs(b.pr - h.pr) < 0.1 FROM h, b
UNION ALL SELECT 'units per row, promo over no promo', h.lift, b.lift, NULL, coalesce(abs(b.lift - h.lift) < 0.25, false) FROM h, b
UNION ALL SELECT 'weekly units per series', hw, bw, NULL, bw <= hw FROM w)"""


AUDIT_SPEC = "check_:s history_value:f batch_value:f statistic:f consistent:b"


def _arrivals(spark, sf, copies=1):
    """History and batches as the audit would find them: written tables."""
    return cut_lineage(tables.history_rows(spark, sf)), cut_lineage(tables.batch_rows(spark, sf, copies))


@query("contract_audit", _contract("batch_rows"), AUDIT_SPEC)
def contract_audit(spark, sf):
    return _report(audit.contract_audit(*_arrivals(spark, sf)))


@query("contract_audit_broken", _contract("broken_rows"), AUDIT_SPEC)
def contract_audit_broken(spark, sf):
    return _report(audit.contract_audit(*_arrivals(spark, sf, copies=3)))
