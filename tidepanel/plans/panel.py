"""Scans, weekly panel, features and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.calendar import calendar_flags, event_score, holiday_flags
from tidepanel.operators import features, rollup
from tidepanel.plans.oracle_base import BASE_SPEC, ENRICHED_SPEC, FEATURE_SPEC
from tidepanel.plans.registry import query
from tidepanel.schema import BASE_COLUMNS, DAILY_COLUMNS, WEEK_KEYS
from tidepanel.sources import tables

DAILY_SPEC = ("date:d sku:s brand:s segment:s category:s channel:s region:s pack_type:s price_unit:f promotion_flag:i "
              "delivery_days:f stock_available:f delivered_qty:f units_sold:f")
KEY_SPEC = "sku:s channel:s region:s week:d"


@query("scan_daily", "SELECT * FROM daily", DAILY_SPEC)
def scan_daily(spark, sf):
    return tables.sales_daily(spark, sf)


@query("fixed_projection", "SELECT * FROM base", BASE_SPEC)
def fixed_projection(spark, sf):
    base = rollup.weekly_base(tables.sales_daily(spark, sf))
    return base.select(*BASE_COLUMNS)


@query("clip_negative", """
SELECT sku, channel, region, date, greatest(units_sold, 0) AS units_sold, greatest(ship_lag_days, 0) AS ship_lag_days,
       CASE WHEN units_sold < 0 OR ship_lag_days < 0 THEN 1 ELSE 0 END AS was_negative
FROM sales_rows""", "sku:s channel:s region:s date:d units_sold:f ship_lag_days:i was_negative:i")
def clip_negative(spark, sf):
    from tidepanel.operators.validate import clip_negative as clip
    return clip(tables.sales_rows(spark, sf), ["units_sold", "ship_lag_days"]).select(
        "sku", "channel", "region", "date", "units_sold", "ship_lag_days", "was_negative")


@query("weekly_rollup", "SELECT * FROM weekly",
       KEY_SPEC + " units_sold:f delivered_qty:f price_unit:f stock_available:f promotion_flag:i delivery_days:f")
def weekly_rollup(spark, sf):
    return rollup.weekly_rollup(tables.sales_daily(spark, sf))


@query("sku_age", "SELECT sku, channel, region, week, sku_age FROM aged", KEY_SPEC + " sku_age:i")
def sku_age(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return rollup.add_sku_age(rollup.weekly_rollup(daily), rollup.first_seen(daily)).select(*WEEK_KEYS, "sku_age")


@query("lifecycle_stage", """
SELECT sku, channel, region, week, sku_age, lifecycle_stage FROM flagged""",
       KEY_SPEC + " sku_age:i lifecycle_stage:s")
def lifecycle_stage(spark, sf):
    daily = tables.sales_daily(spark, sf)
    aged = rollup.add_sku_age(rollup.weekly_rollup(daily), rollup.first_seen(daily))
    return aged.select(*WEEK_KEYS, "sku_age", rollup.lifecycle_stage("sku_age").alias("lifecycle_stage"))


@query("calendar_flags", """
SELECT sku, channel, region, week, week_number, month, year, is_summer, is_winter FROM flagged""",
       KEY_SPEC + " week_number:i month:i year:i is_summer:i is_winter:i")
def calendar_flags_query(spark, sf):
    weekly = rollup.weekly_rollup(tables.sales_daily(spark, sf)).select(*WEEK_KEYS)
    return calendar_flags(weekly)


@query("holiday_week_flags", """
SELECT sku, channel, region, week, is_holiday_week, is_holiday_peak FROM flagged""",
       KEY_SPEC + " is_holiday_week:i is_holiday_peak:i")
def holiday_week_flags(spark, sf):
    weekly = rollup.weekly_rollup(tables.sales_daily(spark, sf)).select(*WEEK_KEYS)
    return holiday_flags(weekly)


@query("lag_features", "SELECT sku, channel, region, week, lag_1, lag_2, momentum FROM lagged",
       KEY_SPEC + " lag_1:f lag_2:f momentum:f")
def lag_features(spark, sf):
    return rollup.lag_features(rollup.weekly_rollup(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "lag_1", "lag_2", "momentum")


@query("rolling_stats_4", "SELECT sku, channel, region, week, rolling_mean_4, rolling_std_4 FROM lagged",
       KEY_SPEC + " rolling_mean_4:f rolling_std_4:f")
def rolling_stats_4(spark, sf):
    return rollup.lag_features(rollup.weekly_rollup(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "rolling_mean_4", "rolling_std_4")


@query("target_next_week", "SELECT sku, channel, region, week, units_sold, target_next_week FROM lagged",
       KEY_SPEC + " units_sold:f target_next_week:f")
def target_next_week(spark, sf):
    return rollup.next_week_target(rollup.weekly_rollup(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "units_sold", "target_next_week")


@query("drop_incomplete_rows", """
SELECT f.sku, f.channel, f.region, f.week, f.target_next_week,
       CASE WHEN b.week IS NULL THEN 'early_only' ELSE 'full_history' END AS kept_by
FROM early f LEFT JOIN base b USING (sku, channel, region, week)""", KEY_SPEC + " target_next_week:f kept_by:s")
def drop_incomplete_rows(spark, sf):
    lagged = rollup.next_week_target(rollup.lag_features(rollup.weekly_rollup(tables.sales_daily(spark, sf))))
    early = rollup.drop_incomplete(lagged, keep_early_history=True)
    complete = F.col("rolling_std_4").isNotNull() & F.col("momentum").isNotNull()
    return early.select(*WEEK_KEYS, "target_next_week",
                        F.when(complete, "full_history").otherwise("early_only").alias("kept_by"))


@query("weekly_base", "SELECT * FROM base", BASE_SPEC)
def weekly_base(spark, sf):
    return rollup.weekly_base(tables.sales_daily(spark, sf))


@query("attach_static_attrs", "SELECT sku, channel, region, week, brand, segment, category FROM labelled",
       KEY_SPEC + " brand:s segment:s category:s")
def attach_static_attrs(spark, sf):
    daily = tables.sales_daily(spark, sf)
    keys = rollup.labelled_weeks(daily).select(*WEEK_KEYS)
    return features.attach_static_attrs(keys, daily)


@query("distinct_attrs", "SELECT * FROM attrs", "sku:s brand:s segment:s category:s")
def distinct_attrs(spark, sf):
    return tables.sales_daily(spark, sf).select("sku", "brand", "segment", "category").distinct()


@query("internal_aggregates", "SELECT * FROM internal", KEY_SPEC + " price_avg:f promo_rate:f stock_avg:f deliveries:i")
def internal_aggregates(spark, sf):
    return features.internal_aggregates(tables.sales_daily(spark, sf))


@query("context_features", "SELECT * FROM context",
       "region:s week:d avg_temp:f inflation_index:f school_in_session:i event_score:f")
def context_features(spark, sf):
    return features.context_features(rollup.labelled_weeks(tables.sales_daily(spark, sf)))


@query("event_proximity", "SELECT * FROM event_scores", "week:d event_score:f")
def event_proximity(spark, sf):
    weeks = rollup.labelled_weeks(tables.sales_daily(spark, sf)).select("week").distinct()
    return event_score(weeks)


@query("category_trend", "SELECT * FROM trend", "category:s region:s week:d category_trend:f")
def category_trend(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return features.category_trend(features.attach_static_attrs(rollup.labelled_weeks(daily), daily))


@query("enrichment_join", "SELECT * FROM enriched", ENRICHED_SPEC)
def enrichment_join(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return features.enrich(rollup.weekly_base(daily), daily)


def _labelled(spark, sf):
    daily = tables.sales_daily(spark, sf)
    return features.attach_static_attrs(rollup.labelled_weeks(daily), daily)


@query("price_index", "SELECT sku, channel, region, week, price_index FROM features", KEY_SPEC + " price_index:f")
def price_index(spark, sf):
    return features.add_price_index(_labelled(spark, sf)).select(*WEEK_KEYS, "price_index")


@query("promo_recency", "SELECT sku, channel, region, week, promo_recency FROM features", KEY_SPEC + " promo_recency:f")
def promo_recency(spark, sf):
    return features.add_promo_recency(rollup.labelled_weeks(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "promo_recency")


@query("rolling_promo_rate", "SELECT sku, channel, region, week, rolling_promo_rate FROM features",
       KEY_SPEC + " rolling_promo_rate:f")
def rolling_promo_rate(spark, sf):
    return features.add_rolling_promo_rate(rollup.labelled_weeks(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "rolling_promo_rate")


@query("cross_channel_share", "SELECT sku, channel, region, week, cross_channel_demand_share FROM features",
       KEY_SPEC + " cross_channel_demand_share:f")
def cross_channel_share(spark, sf):
    return features.add_cross_channel_share(rollup.labelled_weeks(tables.sales_daily(spark, sf))).select(
        *WEEK_KEYS, "cross_channel_demand_share")


@query("weekly_features", "SELECT * FROM features", FEATURE_SPEC)
def weekly_features(spark, sf):
    return features.feature_table(tables.sales_daily(spark, sf))
