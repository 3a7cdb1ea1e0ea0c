import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_by
from tidepanel.operators import features, launch
from tidepanel.plans import forecasts
from tidepanel.sources import tables


def order_tables(spark, folder, parts, lines):
    """Order tables of one customer; ``lines`` are (part, quantity, discount, day)."""
    when = dt.datetime(2000, 1, 3)
    rows = {
        "region": [(0, "ASIA")], "nation": [(0, "N", 0)], "customer": [(1, "C", 0, 0.0, "MACHINERY")],
        "orders": [(1, 1, "O", 1.0, when, "1")], "part": parts,
        "lineitem": [(1, p, 1, i + 1, q, 10.0 * q, d, 0.0, "N", "O", when + dt.timedelta(days=day))
                     for i, (p, q, d, day) in enumerate(lines)],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, tables.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


PARTS = [(1, "a", "Brand#12", "TIN", 10, 1.0), (1, "a", "Brand#13", "BOX", 40, 1.0), (2, "b", "Brand#21", "JAR", None, 1.0),
         (None, "c", "Brand#22", "JAR", 5, 1.0)]
LINES = [(1, 2.0, 0.1, 0), (1, 3.0, 0.0, 0), (2, 4.0, 0.0, 1), (None, 9.0, 0.0, 1), (3, 9.0, 0.0, 1)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_parts_count_each_line_once_per_row(spark, folder):
    found = rows_by(tables.launch_daily(spark, order_tables(spark, folder, PARTS, LINES)), "sku")
    assert set(found) == {"P1", "P2"}
    one, two = found["P1"], found["P2"]
    assert (one.units_sold, one.delivered_qty, one.price_unit, one.promotion_flag) == (10.0, 10.0, 10.0, 1)
    assert (one.brand, one.segment, one.category, one.pack_type, one.stock_available) == ("Brand#13", "S", "TIN", "BOX", 25.0)
    assert (two.units_sold, two.segment, two.stock_available, two.channel, two.region) == (4.0, "L", None, "Industrial", "ASIA")


def test_brand_attributes_equal_those_of_the_rows(spark, folder):
    path = order_tables(spark, folder, PARTS, LINES)
    rows = tables.sales_rows(spark, path)
    assert sorted(tables.sales_daily(spark, path).collect()) == sorted(tables.to_daily(rows).collect())


def test_no_line_or_day_is_sorted(spark, folder):
    """a task's memory went into sorts of lines and days for joins and for extremes of texts."""
    path = order_tables(spark, folder, PARTS, LINES)
    days = tables.launch_daily(spark, path).select(*launch.RECORD_INPUTS)
    for df in (tables.sales_rows(spark, path), tables.sales_daily(spark, path).drop("pack_type")):
        assert "SortMergeJoin" not in plan(df) and "SortAggregate" not in plan(df)
    # The parts alone, before and after their shuffle.
    assert "SortMergeJoin" not in plan(days) and plan(days).count("SortAggregate") == 2
    facts = spark.createDataFrame([("A", "b", "s", "k", dt.date(2000, 1, 3))], "sku string, brand string, segment string, category string, date date")
    items = plan(features.item_table(facts))
    assert items.rindex("HashAggregate") > items.rindex("SortAggregate")   # the facts are reduced by a hash first


def test_items_still_have_static_attributes(spark):
    rows = [("A", "b", None, "k", dt.date(2000, 1, 5)), ("A", "b", "s", "k", dt.date(2000, 1, 3))]
    schema = "sku string, brand string, segment string, category string, date date"
    item = features.item_table(spark.createDataFrame(rows, schema)).collect()
    assert [(r.sku, r.first_seen, r.brand, r.segment, r.category) for r in item] == [("A", dt.date(2000, 1, 3), "b", "s", "k")]
    with pytest.raises(Exception, match="must be static per item: A"):
        features.item_table(spark.createDataFrame([*rows, ("A", "x", "s", "k", dt.date(2000, 1, 4))], schema)).collect()


def test_tasks_of_the_lines_follow_their_number(spark, folder, monkeypatch):
    """the lines of one task grew with the table."""
    path = order_tables(spark, folder, PARTS, LINES * 4)
    monkeypatch.setattr(tables, "LINES_PER_TASK", 2)
    lines, tasks = tables._placed_lines(spark, path)
    assert tasks == 10 and lines.select(F.spark_partition_id()).rdd.getNumPartitions() == 10


def test_feature_tables_read_the_lines_once(spark, folder, monkeypatch):
    """every branch of the feature table joined the order tables again."""
    path, seen = order_tables(spark, folder, PARTS, LINES), []
    monkeypatch.setattr(forecasts.features, "feature_table", lambda daily: seen.append(daily) or daily)
    forecasts._features(spark, path)
    assert all("stored-" in f for f in seen[0].inputFiles()) and "pack_type" not in seen[0].columns
