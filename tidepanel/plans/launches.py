"""Cold start: launch records, donors, analogs and their scores, with parts as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import features, launch, resample, rollup
from tidepanel.plans.oracle_base import BASE_SPEC, cte
from tidepanel.plans.registry import query
from tidepanel.plans.scoring import metrics_sql
from tidepanel.schema import SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage, stored
from tidepanel.sources import tables

HELD_OUT = 5
METHODS = {"category_mean": "pred_category_mean", "analog": "pred_zero_analog"}
METRIC_SPEC = "MAE:f RMSE:f WAPE:f SMAPE:f"

cte("seen", "SELECT sku, min(date) AS first_seen, min(category) AS category, min(segment) AS segment, min(brand) AS brand FROM launch_daily GROUP BY sku")
cte("reserve", "SELECT * FROM seen ORDER BY first_seen DESC, sku DESC LIMIT 5")
cte("launch_week_rows", """
SELECT d.sku, d.channel, d.region, w AS week, sum(units_sold) AS launch_units, count(DISTINCT date) AS observed_days,
       any_value(s.category) AS category, any_value(s.segment) AS segment, any_value(s.brand) AS brand, first_seen,
       w + 7 AS label_available_at, month(w) AS month, week(w) AS week_number, year(w) AS year
FROM launch_daily d JOIN (SELECT *, CAST(date_trunc('week', first_seen) AS DATE) AS w FROM seen) s USING (sku)
WHERE d.date BETWEEN w AND w + 6 AND w + 7 <= (SELECT max(date) + 1 FROM launch_daily)
GROUP BY d.sku, d.channel, d.region, w, first_seen
""")
cte("launches", """
SELECT d.sku, d.channel, d.region, first_seen AS week, sum(units_sold) AS launch_units, count(DISTINCT date) AS observed_days,
       any_value(s.category) AS category, any_value(s.segment) AS segment, any_value(s.brand) AS brand, first_seen,
       first_seen AS launch_window_start, first_seen + 7 AS label_available_at, month(first_seen) AS month,
       week(first_seen) AS week_number, year(first_seen) AS year
FROM launch_daily d JOIN seen s USING (sku)
WHERE d.date >= first_seen AND d.date < first_seen + 7 AND first_seen + 7 <= (SELECT max(date) + 1 FROM launch_daily)
GROUP BY d.sku, d.channel, d.region, first_seen
""")
cte("donor_rows", "SELECT * FROM launches ANTI JOIN reserve USING (sku)")
RECORD_SPEC = ("sku:s channel:s region:s week:d launch_units:f observed_days:i category:s segment:s brand:s first_seen:d "
               "label_available_at:d month:i week_number:i year:i")
SERIES_SPEC = "sku:s channel:s region:s"


def _launch_daily(spark, sf):
    return tables.launch_daily(spark, sf)


def _daily_and_reserve(spark, sf):
    """Daily facts and the held-out list. Both are read by several branches, so they are materialised once."""
    daily = stored(_launch_daily(spark, sf))
    return daily, cut_lineage(launch.latest_items(features.item_table(daily), HELD_OUT))


def _records_and_reserve(spark, sf):
    """Launch records and the held-out list, materialised, from one table of items."""
    daily = stored(_launch_daily(spark, sf).select(*launch.RECORD_INPUTS))
    items = cut_lineage(features.item_table(daily))
    return cut_lineage(launch.seven_day_launch_records(daily, items)), cut_lineage(launch.latest_items(items, HELD_OUT))


@query("first_seen", "SELECT sku, first_seen FROM seen", "sku:s first_seen:d")
def first_seen(spark, sf):
    return rollup.first_seen(_launch_daily(spark, sf))


@query("launch_timeline", """
SELECT * FROM (
 (SELECT 'earliest' AS side, row_number() OVER (ORDER BY first_seen, sku) AS position, sku, first_seen FROM seen QUALIFY position <= 5)
 UNION ALL
 (SELECT 'latest', row_number() OVER (ORDER BY first_seen DESC, sku DESC) AS position, sku, first_seen FROM seen QUALIFY position <= 5))
""", "side:s position:i sku:s first_seen:d")
def launch_timeline(spark, sf):
    return launch.launch_edges(rollup.first_seen(_launch_daily(spark, sf)), HELD_OUT)


@query("launch_week_records", "SELECT * FROM launch_week_rows", RECORD_SPEC)
def launch_week_records(spark, sf):
    return launch.launch_week_records(stored(_launch_daily(spark, sf).select(*launch.RECORD_INPUTS)))


@query("seven_day_launch_records", "SELECT * FROM launches", RECORD_SPEC + " launch_window_start:d")
def seven_day_launch_records(spark, sf):
    return launch.seven_day_launch_records(stored(_launch_daily(spark, sf).select(*launch.RECORD_INPUTS)))


@query("observed_days_join", """
SELECT sku, channel, region, week, units_sold, observed_days FROM weekly JOIN (
  SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, count(DISTINCT date) AS observed_days
  FROM sales_rows GROUP BY ALL) USING (sku, channel, region, week)""", SERIES_SPEC + " week:d units_sold:f observed_days:i")
def observed_days_join(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return launch.observed_days(daily, rollup.weekly_rollup(daily).select(*WEEK_KEYS, "units_sold"))


@query("early_history_table", """
SELECT e.*, a.category, a.segment, a.brand, o.observed_days FROM early e JOIN attrs a USING (sku) JOIN (
  SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, count(DISTINCT date) AS observed_days
  FROM daily GROUP BY ALL) o USING (sku, channel, region, week)""",
       BASE_SPEC + " category:s segment:s brand:s observed_days:i")
def early_history_table(spark, sf):
    return launch.early_history_table(tables.sales_daily(spark, sf))


@query("launch_week_recover", """
SELECT sku, min(week - 7 * sku_age::INTEGER) AS launch_week, min(week - 7 * sku_age::INTEGER) = max(week - 7 * sku_age::INTEGER) AS consistent
FROM launch_early GROUP BY sku""", "sku:s launch_week:d consistent:b")
def launch_week_recover(spark, sf):
    return launch.launch_week_of(rollup.weekly_base(_launch_daily(spark, sf), keep_early_history=True))


@query("launch_history_gaps", """
SELECT sku_age, count(*) AS n, count(DISTINCT sku) AS n_skus, count(*) FILTER (lag_1 IS NULL) AS missing_lag_1,
       count(*) FILTER (rolling_mean_4 IS NULL) AS missing_rolling_4, count(*) FILTER (observed_days < 7) AS partial_weeks
FROM launch_early JOIN (
  SELECT sku, channel, region, CAST(date_trunc('week', date) AS DATE) AS week, count(DISTINCT date) AS observed_days
  FROM launch_daily GROUP BY ALL) USING (sku, channel, region, week)
WHERE sku_age BETWEEN 0 AND 3 GROUP BY sku_age""",
       "sku_age:i n:i n_skus:i missing_lag_1:i missing_rolling_4:i partial_weeks:i")
def launch_history_gaps(spark, sf):
    return launch.history_gaps(launch.early_history_table(_launch_daily(spark, sf)))


@query("age_bucket", "SELECT least(sku_age, 24) AS age_bucket, count(*) AS n, sum(units_sold) AS units FROM base GROUP BY ALL",
       "age_bucket:i n:i units:f")
def age_bucket(spark, sf):
    base = rollup.weekly_base(tables.sales_daily(spark, sf))
    return base.groupBy(launch.age_bucket().alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("units_sold").alias("units"))


cte("pools", """
SELECT t.sku, t.cutoff, count(d.sku) AS donors, count(DISTINCT d.sku) AS donor_items, avg(d.launch_units) AS donor_mean,
       max(d.label_available_at) AS train_label_available_max
FROM (SELECT DISTINCT sku, week AS cutoff FROM launches) t
LEFT JOIN donor_rows d ON d.label_available_at <= t.cutoff AND d.sku <> t.sku GROUP BY t.sku, t.cutoff
""")


@query("eligible_donors", "SELECT * FROM pools",
       "sku:s cutoff:d donors:i donor_items:i donor_mean:f train_label_available_max:d")
def eligible_donors(spark, sf):
    return launch.eligible_donors(*_records_and_reserve(spark, sf))


cte("eligibility", """
SELECT p.sku, p.cutoff, p.donor_items AS prior_train_skus, n AS evaluation_rows,
       CASE WHEN p.sku IN (SELECT sku FROM reserve) THEN 'reserved_existing_test' WHEN p.donor_items >= 10 THEN 'eligible'
            ELSE 'insufficient_prior_launches' END AS status
FROM pools p JOIN (SELECT sku, count(*) AS n FROM launches GROUP BY sku) USING (sku)
""")


@query("chronological_eligibility", "SELECT * FROM eligibility",
       "sku:s cutoff:d prior_train_skus:i evaluation_rows:i status:s")
def chronological_eligibility(spark, sf):
    return launch.chronological_eligibility(*_records_and_reserve(spark, sf))


cte("hier", """
SELECT sku, channel, region, week, launch_units,
  CASE WHEN n1 > 0 THEN m1 WHEN n2 > 0 THEN m2 WHEN n3 > 0 THEN m3 ELSE m4 END AS pred_category_mean,
  CASE WHEN n1 > 0 THEN 'category_channel_region' WHEN n2 > 0 THEN 'category' WHEN n3 > 0 THEN 'channel_region'
       WHEN n4 > 0 THEN 'global' END AS baseline_level,
  CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 WHEN n3 > 0 THEN n3 WHEN n4 > 0 THEN n4 END AS baseline_donors
FROM (SELECT t.sku, t.channel, t.region, t.week, t.launch_units,
        count(d.sku) FILTER (d.category = t.category AND d.channel = t.channel AND d.region = t.region) AS n1,
        avg(d.launch_units) FILTER (d.category = t.category AND d.channel = t.channel AND d.region = t.region) AS m1,
        count(d.sku) FILTER (d.category = t.category) AS n2, avg(d.launch_units) FILTER (d.category = t.category) AS m2,
        count(d.sku) FILTER (d.channel = t.channel AND d.region = t.region) AS n3,
        avg(d.launch_units) FILTER (d.channel = t.channel AND d.region = t.region) AS m3,
        count(d.sku) AS n4, avg(d.launch_units) AS m4
      FROM launches t LEFT JOIN donor_rows d ON d.label_available_at <= t.week GROUP BY ALL)
""")


@query("hierarchical_mean", "SELECT * FROM hier",
       SERIES_SPEC + " week:d launch_units:f pred_category_mean:f baseline_level:s baseline_donors:i")
def hierarchical_mean(spark, sf):
    return launch.hierarchical_mean(*_records_and_reserve(spark, sf)).select(
        *WEEK_KEYS, "launch_units", "pred_category_mean", "baseline_level", "baseline_donors")


cte("meta_analog", """
SELECT sku, channel, region, week, launch_units, d_units AS pred_zero_analog, d_sku AS analog_sku,
       d_label AS analog_label_available_at, score AS match_score
FROM (SELECT t.*, d.sku AS d_sku, d.launch_units AS d_units, d.label_available_at AS d_label,
        CASE WHEN d.sku IS NULL THEN NULL ELSE 4 * (d.category = t.category)::INTEGER + 2 * (d.segment = t.segment)::INTEGER
          + (d.brand = t.brand)::INTEGER END AS score, d.week AS d_week
      FROM launches t LEFT JOIN donor_rows d ON d.channel = t.channel AND d.region = t.region AND d.label_available_at <= t.week)
QUALIFY row_number() OVER (PARTITION BY sku, channel, region ORDER BY score DESC, d_week DESC, d_sku) = 1
""")


@query("analog_metadata", "SELECT * FROM meta_analog",
       SERIES_SPEC + " week:d launch_units:f pred_zero_analog:f analog_sku:s analog_label_available_at:d match_score:f")
def analog_metadata(spark, sf):
    out = launch.analog_metadata(*_records_and_reserve(spark, sf))
    return out.select(*WEEK_KEYS, "launch_units", "pred_zero_analog", "analog_sku", "analog_label_available_at",
                      F.col("match_score").cast("double").alias("match_score"))


cte("item_attrs", "SELECT sku, min(category) AS category, min(segment) AS segment, min(pack_type) AS pack_type, avg(price_unit) AS price_unit, min(date) AS first_seen FROM launch_daily GROUP BY sku")


@query("analog_tiered", """
SELECT t.sku, c.sku AS analog_sku,
       CASE WHEN (c.category, c.segment, c.pack_type) = (t.category, t.segment, t.pack_type) THEN 0
            WHEN (c.category, c.pack_type) = (t.category, t.pack_type) THEN 1 WHEN c.category = t.category THEN 2 ELSE 3 END AS tier,
       abs(c.price_unit - t.price_unit) AS price_gap
FROM item_attrs t JOIN item_attrs c ON c.first_seen < t.first_seen
WHERE t.sku IN (SELECT sku FROM reserve) AND c.sku NOT IN (SELECT sku FROM reserve)
QUALIFY row_number() OVER (PARTITION BY t.sku ORDER BY tier, price_gap, c.sku) = 1""", "sku:s analog_sku:s tier:i price_gap:f")
def analog_tiered(spark, sf):
    daily, held_out = _daily_and_reserve(spark, sf)
    attrs = daily.groupBy("sku").agg(
        F.min("category").alias("category"), F.min("segment").alias("segment"), F.min("pack_type").alias("pack_type"),
        F.avg("price_unit").alias("price_unit"), F.min("date").alias("first_seen"))
    return launch.analog_tiered(cut_lineage(attrs), held_out)


cte("launch_analogs", """
SELECT t.sku, c.sku AS analog_sku, t.cutoff,
       CASE WHEN (c.category, c.segment) = (t.category, t.segment) THEN 0 WHEN c.category = t.category THEN 1 ELSE 2 END AS tier,
       abs(c.price_unit - t.price_unit) AS price_gap
FROM (SELECT r.sku, r.category, r.segment, CAST(date_trunc('week', r.first_seen) AS DATE) AS cutoff, avg(d.price_unit) AS price_unit
      FROM reserve r JOIN launch_daily d ON d.sku = r.sku AND d.date = r.first_seen GROUP BY ALL) t
JOIN LATERAL (SELECT sku, min(category) AS category, min(segment) AS segment, avg(price_unit) AS price_unit FROM launch_daily
      WHERE date < t.cutoff AND sku NOT IN (SELECT sku FROM reserve) GROUP BY sku) c ON true
QUALIFY row_number() OVER (PARTITION BY t.sku ORDER BY tier, price_gap, c.sku) = 1
""")


@query("analog_launch", "SELECT * FROM launch_analogs", "sku:s analog_sku:s cutoff:d tier:i price_gap:f")
def analog_launch(spark, sf):
    return launch.analog_launch(*_daily_and_reserve(spark, sf))


cte("trajectory", """
SELECT p.sku, p.channel, p.region, p.week, p.sku_age, p.units_sold, p.target_next_week, a.analog_sku,
       CASE WHEN d.week + 14 <= a.cutoff THEN d.target_next_week END AS pred_analog
FROM launch_early p JOIN launch_analogs a USING (sku)
LEFT JOIN launch_early d ON (d.sku, d.channel, d.region, d.sku_age) = (a.analog_sku, p.channel, p.region, p.sku_age)
""")


def _trajectory(spark, sf):
    daily, held_out = _daily_and_reserve(spark, sf)
    # Only the days of targets and analogs are stretched to weeks: no other item meets a target.
    analogs = cut_lineage(launch.analog_launch(daily, held_out))
    asked = analogs.select(F.explode(F.array("sku", "analog_sku")).alias("sku")).distinct()
    panel = rollup.weekly_base(daily.join(F.broadcast(asked), "sku", "left_semi"), keep_early_history=True)
    return launch.analog_trajectory(panel, analogs)


@query("analog_trajectory", "SELECT * FROM trajectory",
       SERIES_SPEC + " week:d sku_age:i units_sold:f target_next_week:f analog_sku:s pred_analog:f")
def analog_trajectory(spark, sf):
    return _trajectory(spark, sf).select(*WEEK_KEYS, "sku_age", "units_sold", "target_next_week", "analog_sku", "pred_analog")


@query("label_available", """
SELECT r.sku, CAST(date_trunc('week', r.first_seen) AS DATE) AS cutoff, count(*) AS train_rows, count(DISTINCT p.sku) AS train_skus,
       max(p.week) + 14 AS train_label_available_max
FROM reserve r JOIN launch_early p ON p.week + 14 <= CAST(date_trunc('week', r.first_seen) AS DATE)
WHERE p.sku NOT IN (SELECT sku FROM reserve) GROUP BY ALL""",
       "sku:s cutoff:d train_rows:i train_skus:i train_label_available_max:d")
def label_available(spark, sf):
    daily, held_out = _daily_and_reserve(spark, sf)
    return launch.training_pool_sizes(rollup.labelled_runs(daily), held_out)


def _wide_sql(rows: str, by: str, actual: str, models: dict[str, str]) -> str:
    shared = " AND ".join(f"{c} IS NOT NULL" for c in models.values())
    return "\nUNION ALL\n".join(f"""
SELECT {by}, '{m}' AS model, count(*) FILTER ({shared}) AS n, count(*) AS available_n,
       count(*) FILTER ({shared}) / count(*) AS coverage, {metrics_sql(actual, f'(CASE WHEN {shared} THEN {c} END)')}
FROM {rows} GROUP BY ALL""" for m, c in models.items())


_AGE_MODELS = {"naive": "units_sold", "analog": "pred_analog"}


@query("scores_by_age", f"""
{_wide_sql('trajectory', 'CAST(least(sku_age, 24) AS VARCHAR) AS bucket', 'target_next_week', _AGE_MODELS)}
UNION ALL
{_wide_sql('trajectory', "CASE WHEN sku_age < 4 THEN 'age 0-3' WHEN sku_age < 12 THEN 'age 4-11' ELSE 'age 12+' END AS bucket",
           'target_next_week', _AGE_MODELS)}""", f"bucket:s model:s n:i available_n:i coverage:f {METRIC_SPEC}")
def scores_by_age(spark, sf):
    return launch.scores_by_age(_trajectory(spark, sf), _AGE_MODELS)


cte("launch_preds", """
SELECT h.*, m.pred_zero_analog, e.status FROM hier h JOIN meta_analog m USING (sku, channel, region) JOIN eligibility e USING (sku)
""")


def launch_predictions(spark, sf):
    """Category mean and metadata analog for every launch, with its eligibility status."""
    records, held_out = _records_and_reserve(spark, sf)
    means = launch.hierarchical_mean(records, held_out).select(
        *WEEK_KEYS, "launch_units", "pred_category_mean", "baseline_level", "baseline_donors")
    analogs = launch.analog_metadata(records, held_out).select(*SERIES, "pred_zero_analog")
    status = launch.chronological_eligibility(records, held_out).select("sku", "status")
    return means.join(analogs, SERIES).join(status, "sku")


@query("cold_start_scores", f"""
{_wide_sql("(SELECT * FROM launch_preds WHERE status = 'eligible')", "'all' AS scope", 'launch_units', METHODS)}
UNION ALL
{_wide_sql("(SELECT * FROM launch_preds WHERE status = 'eligible')", "sku AS scope", 'launch_units', METHODS)}""",
       f"scope:s model:s n:i available_n:i coverage:f {METRIC_SPEC}")
def cold_start_scores(spark, sf):
    return launch.cold_start_scores(launch_predictions(spark, sf).filter("status = 'eligible'"), METHODS)


@query("fallback_level_summary", """
SELECT status AS cohort, baseline_level, count(*) AS n_rows, count(DISTINCT sku) AS n_skus, min(baseline_donors) AS min_donors,
       max(baseline_donors) AS max_donors FROM launch_preds WHERE status <> 'insufficient_prior_launches' GROUP BY ALL""",
       "cohort:s baseline_level:s n_rows:i n_skus:i min_donors:i max_donors:i")
def fallback_level_summary(spark, sf):
    preds = launch_predictions(spark, sf).filter("status <> 'insufficient_prior_launches'")
    return launch.fallback_summary(preds.withColumnRenamed("status", "cohort"))
