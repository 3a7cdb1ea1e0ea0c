import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by, sales
from tidepanel.functions.calendar import easter, event_score, holiday_flags
from tidepanel.operators import features, rollup, validate
from tidepanel.schema import BASE_COLUMNS, FEATURE_TABLE_COLUMNS, WEEK_KEYS


def test_constant_series_has_contract_columns_and_first_lag(spark, daily):
    facts = daily(sales(units=[20.0] * 70))
    early = rollup.weekly_base(facts, keep_early_history=True)
    assert early.columns == BASE_COLUMNS
    got = rows_by(early, "sku_age")
    assert got[0].lag_1 is None and got[1].lag_1 == 140.0
    assert got[3].rolling_mean_4 is None and got[4].rolling_mean_4 == 140.0 and got[4].rolling_std_4 == 0.0
    assert min(rows_by(rollup.weekly_base(facts), "sku_age")) == 4


def test_weeks_without_rows_are_emitted(daily):
    facts = daily(sales(units=[5.0]) + sales(start="2022-01-24", units=[7.0], promo=1))
    got = rows_by(rollup.weekly_rollup(facts), "week")
    assert len(got) == 4
    hole = got[day("2022-01-10")]
    assert hole.units_sold == 0.0 and hole.promotion_flag == 0 and hole.price_unit is None


def test_weekly_promotion_is_any_day(daily):
    got = rollup.weekly_rollup(daily(sales(units=[1.0] * 14, promo={8}))).orderBy("week").collect()
    assert [r.promotion_flag for r in got] == [0, 1]


def test_age_counts_from_first_week_anywhere(daily):
    facts = daily(sales(units=[1.0] * 112) + sales(channel="c2", start="2022-01-17", units=[1.0] * 98))
    base = rollup.weekly_base(facts, keep_early_history=True).filter("channel = 'c2'")
    assert base.agg(F.min("sku_age")).first()[0] == 2


def test_stage_bounds(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 12, 13, 52, 53)], "a long")
    got = [r[0] for r in ages.orderBy("a").select(rollup.lifecycle_stage("a")).collect()]
    assert got == ["Growth", "Growth", "Mature", "Mature", "Decline"]


def test_future_sales_do_not_change_past_rows(daily):
    units = list(np.arange(84) % 9 + 1.0)
    changed = units[:56] + [9999.0] * 28
    cut = F.col("week") < F.lit("2022-02-14").cast("date")
    a = features.feature_table(daily(sales(units=units, promo={3, 20}))).filter(cut).orderBy("week").collect()
    b = features.feature_table(daily(sales(units=changed, promo={3, 20}))).filter(cut).orderBy("week").collect()
    assert a == b and len(a) > 1


def test_early_table_matches_hand_computed_statistics(daily):
    units = np.array([3, 8, 1, 9, 4, 7, 2], float)
    facts = daily([r for i, u in enumerate(units) for r in sales(start=str(day("2022-01-03") + dt.timedelta(weeks=i)), units=[u])])
    got = rollup.lag_features(rollup.weekly_rollup(facts)).orderBy("week").collect()
    assert got[5].rolling_mean_4 == pytest.approx(units[1:5].mean())
    assert got[5].rolling_std_4 == pytest.approx(units[1:5].std(ddof=1))
    assert got[5].momentum == units[4] - units[3]


def mondays(spark, *years):
    days = [(d,) for y in years for k in range(54) if (d := dt.date(y, 1, 1) + dt.timedelta(days=7 * k - dt.date(y, 1, 1).weekday())).year <= y]
    return spark.createDataFrame(days + [(None,)], "week date")


def test_easter_and_holiday_weeks(spark):
    known = ["1818-03-22", "1899-04-02", "1954-04-18", "1981-04-19", "2022-04-17", "2023-04-09", "2024-03-31", "2049-04-18", "2100-03-28", "2285-03-22"]
    years = spark.createDataFrame([(int(d[:4]),) for d in known], "y int")
    assert [str(r[0]) for r in years.orderBy("y").select(easter("y")).collect()] == known
    weeks = rows_by(holiday_flags(mondays(spark, 2022, 2100)), "week")
    assert weeks[day("2022-12-19")].is_holiday_peak == 1          # Christmas Eve to Sunday the 25th
    assert weeks[day("2022-06-13")].is_holiday_peak == 0 and weeks[day("2022-06-13")].is_holiday_week == 1  # sixty days after Easter
    assert weeks[day("2022-09-05")].is_holiday_week == 0 and weeks[None].is_holiday_week == 0
    assert weeks[day("2022-12-26")].is_holiday_peak == 1          # New Year's Day of the next year, too
    assert weeks[day("2100-12-20")].is_holiday_peak == 1


def test_event_score_decays_with_distance(spark):
    got = rows_by(event_score(mondays(spark, 2023, 2024)), "week")
    assert got[day("2023-05-01")].event_score == 1.0
    assert got[day("2023-05-08")].event_score == pytest.approx(1 - 5 / 7 * 0.15)
    assert got[day("2023-07-10")].event_score == 0.0 and got[None].event_score == 0.0
    assert got[day("2024-01-01")].event_score == pytest.approx(1 - 6 / 7 * 0.15)   # from the 26th of December


def test_promo_recency_and_rate(spark):
    flags = [0, 1, 0, 0, 1, 0]
    weeks = [(day("2022-01-03") + dt.timedelta(weeks=i), "A", "c", "r", f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(weeks, "week date, sku string, channel string, region string, promotion_flag int")
    got = features.add_rolling_promo_rate(features.add_promo_recency(df), 3).orderBy("week").collect()
    assert [r.promo_recency for r in got] == [None, 0, 1, 2, 0, 1]
    assert [round(r.rolling_promo_rate, 4) for r in got] == [0, 0.5, 0.3333, 0.3333, 0.3333, 0.3333]


def test_share_is_null_without_sales_and_sums_to_one(spark):
    df = spark.createDataFrame([("A", "c1", "r", 1, 3.0), ("A", "c2", "r", 1, 1.0), ("A", "c1", "r", 2, 0.0)],
                               "sku string, channel string, region string, week int, units_sold double")
    got = [r.cross_channel_demand_share for r in features.add_cross_channel_share(df).orderBy("week", "channel").collect()]
    assert got == [0.75, 0.25, None]


def test_changing_attribute_is_an_error(daily):
    facts = daily(sales(units=[1.0] * 3) + sales(start="2022-02-07", units=[1.0], category="other"))
    with pytest.raises(Exception, match="static per item"):
        features.item_table(facts).collect()


def test_feature_table_columns(daily):
    table = features.feature_table(daily(sales(units=[2.0] * 70) + sales(sku="B", units=[3.0] * 70, price=30)))
    assert table.columns == FEATURE_TABLE_COLUMNS
    first = table.filter("sku = 'A'").orderBy("week").first()
    assert first.price_index == 0.5 and first.deliveries == 7 and first.school_in_session == 1


def test_validation_report_has_17_rows_and_finds_damage(daily):
    facts = daily(sales(units=[float(i % 5) for i in range(84)]))
    weekly = rollup.weekly_base(facts)
    report = rows_by(validate.run_all_checks(facts, weekly), "check")
    assert len(report) == 17 and all(r.passed for r in report.values())
    broken = weekly.withColumn("lag_1", F.col("lag_1") + 1).withColumn("target_next_week", F.col("target_next_week") + 1)
    report = rows_by(validate.run_all_checks(facts.unionByName(facts.limit(1)), broken), "check")
    failed = {c for c, r in report.items() if not r.passed}
    assert failed >= {"unique sku-channel-region-date", "lag_1 uses past weeks only", "label is next week's sales"}


def test_duplicates_are_rows_minus_keys(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2 + [(3,)], "k int")
    assert validate.duplicate_rows(df, ["k"]).first().n_duplicates == 3


def test_clip_marks_touched_rows(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (1.0, -3.0), (1.0, 2.0)], "a double, b double")
    got = validate.clip_negative(df, ["a", "b"]).collect()
    assert [(r.a, r.b, r.was_negative) for r in got] == [(0.0, 2.0, 1), (1.0, 0.0, 1), (1.0, 2.0, 0)]
