import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by, sales
from tidepanel.operators import arrivals, audit, daily_grain, features, rollup, seasonal
from tidepanel.schema import WEEK_KEYS
from tidepanel.sources import sinks, tables
from tidepanel.streaming import gate, recency
from tidepanel.streaming.sink import run_to_table


def two_items(n, start="2022-01-03", **kw):
    return sales(units=[float(5 + i % 7) for i in range(n)], start=start, promo={3, 40}, **kw) + \
        sales(sku="B", units=[float(3 + i % 5) for i in range(n)], start=start, price=20, promo={10}, **kw)


def test_tripled_rows_fail_the_audit(daily):
    history, batch = daily(two_items(140)), daily(two_items(28, "2022-05-23"))
    ok = rows_by(audit.contract_audit(history, batch), "check")
    assert len(ok) == 14 and ok["duplicate series-day rows"].consistent and ok["date range continues"].consistent
    tripled = batch.unionByName(batch).unionByName(batch)
    bad = rows_by(audit.contract_audit(history, tripled), "check")
    failed = {c for c, r in bad.items() if not r.consistent}
    assert {"duplicate series-day rows", "rows per series-day", "weekly units per series"} <= failed


def test_unknown_item_and_overlap_are_found(daily):
    history = daily(two_items(140))
    bad = rows_by(audit.contract_audit(history, daily(sales(sku="Z", units=[5.0] * 14, start="2022-05-16"))), "check")
    assert not bad["items in batch"].consistent and not bad["date range continues"].consistent


def test_rebuilt_history_and_new_origins(daily):
    history, batch = daily(two_items(140)), daily(two_items(21, "2022-05-23"))
    stored = features.feature_table(tables.to_daily(history))
    own = [c for c in stored.columns if c not in WEEK_KEYS + ["category_trend", "price_index"]]
    rebuilt = arrivals.rebuilt_features(tables.to_daily(arrivals.append_batches(history, batch)), arrivals.last_known_stats(stored))
    assert arrivals.column_parity(stored, rebuilt, own).filter("mismatches > 0").count() == 0
    lost = arrivals.column_parity(stored, rebuilt.filter("week <> date'2022-05-02'"), own).filter("mismatches > 0").collect()
    assert [r.column for r in lost] == ["(missing rows)"]
    panel = arrivals.batch_panel(history, batch, stored)
    assert sorted({str(r.week) for r in panel.collect()}) == ["2022-05-09", "2022-05-16", "2022-05-23", "2022-05-30"]
    frozen = rows_by(stored.filter("week = '2022-05-09'"), "sku")
    for r in panel.collect():
        assert r.category_trend == frozen[r.sku].category_trend


def test_replay_of_arrivals_keeps_features(daily):
    history, batch = daily(two_items(140)), daily(two_items(21, "2022-05-23"))
    tagged = batch.withColumn("batch_file", F.concat(F.lit("batch_"), F.trunc("date", "week").cast("string")))
    stored = features.feature_table(tables.to_daily(history))
    got = arrivals.arrival_replay(history, tagged, stored, ["units_sold", "lag_1", "promo_recency", "target_next_week"]).orderBy("batches_available").collect()
    assert [(r.scorable_origins, r.n_rows, r.feature_mismatches) for r in got] == [(2, 4, 0), (3, 6, 0), (4, 8, 0)]


def test_batch_scan_tags_files_and_needs_some(spark, daily, folder):
    for i in (1, 2):
        daily(sales(units=[float(i)])).coalesce(1).write.parquet(f"{folder}/stage{i}")
        part = glob.glob(f"{folder}/stage{i}/part-*.parquet")[0]
        with open(part, "rb") as src, open(f"{folder}/batch_{i}.parquet", "wb") as dst:
            dst.write(src.read())
    got = rows_by(sinks.scan_batches(spark, folder), "batch_file")
    assert got["batch_1.parquet"].units_sold == 1.0 and got["batch_2.parquet"].units_sold == 2.0
    with pytest.raises(FileNotFoundError):
        sinks.scan_batches(spark, folder, "nothing_*.parquet")


def test_report_marks_missing_values_and_csv_round_trip(spark, daily, folder):
    sinks.write_report(spark.createDataFrame([(day("2022-01-03"), None)], "week date, v double"), f"{folder}/r")
    text = open(glob.glob(f"{folder}/r/part-*.csv")[0]).read()
    assert "2022-01-03,N/A" in text
    facts = daily(sales(units=[1.0, 2.0]))
    facts.write.option("header", True).csv(f"{folder}/d")
    assert sorted(sinks.read_daily(spark, f"{folder}/d", "csv").collect()) == sorted(facts.collect())


def test_store_resumes_and_detects_damage(spark, folder):
    rows = [("A", "c", "r", day("2022-01-03") + dt.timedelta(weeks=i), float(i)) for i in range(4)]
    gold = spark.createDataFrame(rows, "sku string, channel string, region string, week date, target_next_week double")
    calls = []

    def predict():
        calls.append(1)
        return gold.select(*WEEK_KEYS, (F.col("target_next_week") + 1).alias("prediction"))

    store = sinks.LedgerStore(spark, folder, "sig")
    first = store.obtain(gold, "m", 1, predict)
    second = store.obtain(gold, "m", 1, predict)
    assert len(calls) == 1 and sorted(first.select(*WEEK_KEYS, "prediction").collect()) == sorted(second.select(*WEEK_KEYS, "prediction").collect())
    with pytest.raises(ValueError, match="actuals differ"):
        store.obtain(gold.withColumn("target_next_week", F.lit(7.0)), "m", 1, predict)
    gold.select(*WEEK_KEYS, F.col("target_next_week").alias("actual"), F.lit(0.0).alias("prediction")).write.mode("overwrite").parquet(store._part("m", 1))
    with pytest.raises(ValueError, match="checksum"):
        store.obtain(gold, "m", 1, predict)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "i int, s string, d double")
    a, b = sinks.fingerprint(df, "t").first(), sinks.fingerprint(df.orderBy(F.desc("i")), "t").first()
    assert a == b != sinks.fingerprint(df.withColumn("d", F.col("d") + 1), "t").first()
    doc = json.loads(sinks.manifest(sinks.fingerprint(df, "t"), seed=42).first().manifest)
    assert doc["inputs"][0]["n_rows"] == 2 and doc["seed"] == "42"


def test_daily_targets_rebuild_the_weekly_label(daily):
    facts = daily(two_items(84))
    base = rollup.labelled_weeks(facts)
    fixed = daily_grain.fixed_origin_panel(facts, base)
    got = daily_grain.target_reconstruction(fixed).first()
    assert got.n_origins == base.count() and got.n_mismatched == 0
    row = daily_grain.same_weekday_features(facts, fixed).filter("sku = 'A'").orderBy("week", "horizon").first()
    lags = [row[f"daily_lag_{k}"] for k in daily_grain.WEEKDAY_LAGS]
    assert row.same_dow_mean_8 == pytest.approx(sum(lags) / 8) and row.daily_lag_56_observed == 0.0
    again = daily_grain.rolling_panel(facts).filter("sku = 'A'").orderBy("date").first()
    assert again.date == day("2022-01-31") and again.daily_rolling_mean_7 == pytest.approx(8.0)


def test_decomposition_recovers_line_plus_season(spark):
    import math
    rows = [("k", day("2018-01-01") + dt.timedelta(weeks=i), "A", 50 + 0.1 * i + 10 * math.sin(2 * math.pi * i / 52)) for i in range(260) if i != 100]
    df = spark.createDataFrame(rows, "category string, week date, sku string, units_sold double")
    parts = seasonal.decompose(seasonal.category_series(df))
    assert parts.count() == 260
    worst = parts.agg(F.max(F.abs("residual"))).first()[0]
    shares = seasonal.variance_shares(parts).first()
    assert worst < 0.2 and shares.resid_share < 0.001 and shares.n_weeks == 208


def test_recency_state_survives_a_restart(spark, folder):
    flags = [0, 1, 0, 0, 1, 0]
    rows = [("A", "c", "r", day("2022-01-03") + dt.timedelta(weeks=i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "sku string, channel string, region string, week date, promotion_flag int")
    out = None
    for i, part in enumerate((df.filter("week < '2022-01-24'"), df.filter("week >= '2022-01-24'"))):
        part.coalesce(1).write.parquet(f"{folder}/in/d={i}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = run_to_table(recency.promo_recency_stream(stream), "t", f"{folder}/out")
    assert [r.promo_recency for r in out.orderBy("week").collect()] == [None, 0, 1, 2, 0, 1]


def test_gate_sets_broken_deliveries_aside(spark, daily, folder):
    history = daily(two_items(140))
    good, bad = daily(two_items(7, "2022-05-23")), daily(two_items(7, "2022-05-30") * 3)
    for i, df in enumerate((good, bad)):
        df.coalesce(1).write.parquet(f"{folder}/stage{i}")
        with open(glob.glob(f"{folder}/stage{i}/part-*.parquet")[0], "rb") as src, open(f"{folder}/batch_{i}.parquet", "wb") as dst:
            dst.write(src.read())
    allowed = {c for c in rows_by(audit.contract_audit(history, good), "check")} - {"duplicate series-day rows"}
    q = gate.gate_batches(spark, folder, history, f"{folder}/ok", f"{folder}/quarantine", f"{folder}/reports", f"{folder}/cp", allowed)
    q.awaitTermination()
    assert spark.read.parquet(f"{folder}/ok").count() == good.count()
    assert spark.read.parquet(f"{folder}/quarantine").count() == bad.count()
    assert spark.read.parquet(f"{folder}/reports").count() == 28


def test_manifest_sees_every_source_column(spark, monkeypatch):
    from tidepanel.plans import QUERIES, deliveries
    read, sf = tables.table, "/root/testdata/sf0.001"
    base = json.loads(QUERIES["run_manifest"](spark, sf).first().manifest)["inputs"]
    assert {x["table_name"] for x in base} == set(deliveries.SOURCES)
    changed = {"lineitem": "l_shipdate", "nation": "n_name"}
    monkeypatch.setattr(tables, "table", lambda spark, sf, t: read(spark, sf, t).withColumn(changed[t], F.lit(None).cast("string")) if t in changed else read(spark, sf, t))
    got = json.loads(QUERIES["run_manifest"](spark, sf).first().manifest)["inputs"]
    assert {x["table_name"] for x in got if x not in base} == set(changed)
