"""Table contracts: key lists, column orders and declared types."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES = ["sku", "channel", "region"]
WEEK_KEYS = SERIES + ["week"]
DAY_KEYS = SERIES + ["date"]
STATIC_ATTRS = ["brand", "segment", "category"]
DAYS_PER_WEEK = 7

# Daily facts, one row per series and day.
DAILY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("sku", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("pack_type", T.StringType()),
    T.StructField("price_unit", T.DoubleType()),
    T.StructField("promotion_flag", T.IntegerType()),
    T.StructField("delivery_days", T.DoubleType()),
    T.StructField("stock_available", T.DoubleType()),
    T.StructField("delivered_qty", T.DoubleType()),
    T.StructField("units_sold", T.DoubleType()),
])
DAILY_COLUMNS = [f.name for f in DAILY_SCHEMA.fields]

# The 24 columns of the weekly base table, in contract order.
BASE_COLUMNS = [
    "sku", "week", "channel", "region", "units_sold", "stock_available", "promotion_flag",
    "price_unit", "delivery_days", "is_holiday_peak", "week_number", "month", "year",
    "is_holiday_week", "is_summer", "is_winter", "sku_age", "lifecycle_stage",
    "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "momentum", "target_next_week",
]

# Feature groups. Together they are every model input; the label and ``week`` are not inputs.
FEATURE_GROUPS = {
    "lag_rolling": ["units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "momentum"],
    "price": ["price_unit", "price_avg", "price_index"],
    "promotion": ["promotion_flag", "promo_rate", "promo_recency", "rolling_promo_rate"],
    "external_enrichment": ["avg_temp", "inflation_index", "school_in_session", "event_score", "category_trend"],
    "calendar_lifecycle": ["is_holiday_peak", "week_number", "month", "year", "is_holiday_week", "is_summer",
                           "is_winter", "sku_age", "lifecycle_stage"],
    "operational": ["stock_available", "stock_avg", "deliveries", "delivery_days", "cross_channel_demand_share"],
}
CATEGORICAL_COLS = ["sku", "channel", "region", "category", "segment", "brand", "lifecycle_stage"]
IDENTITY_FEATURES = ["sku", "channel", "region", "category", "segment", "brand"]
FEATURE_COLS = IDENTITY_FEATURES + [c for cols in FEATURE_GROUPS.values() for c in cols]
HISTORY_FEATURES = ["lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "momentum", "promo_recency",
                    "rolling_promo_rate"]
LABEL = "target_next_week"

ENRICHED_COLUMNS = BASE_COLUMNS + STATIC_ATTRS + [
    "price_avg", "promo_rate", "stock_avg", "deliveries",
    "avg_temp", "inflation_index", "school_in_session", "event_score", "category_trend",
]
FEATURE_TABLE_COLUMNS = ENRICHED_COLUMNS + [
    "price_index", "promo_recency", "rolling_promo_rate", "cross_channel_demand_share",
]
