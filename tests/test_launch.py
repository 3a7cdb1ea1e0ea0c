import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by, sales
from tidepanel.operators import features, launch, rollup
from tidepanel.plans import launches
from tidepanel.schema import SERIES, WEEK_KEYS

RECORD_SCHEMA = ("sku string, channel string, region string, week date, launch_units double, category string, segment string, "
                 "brand string, first_seen date, label_available_at date")


def record(sku, first, units, channel="c", region="r", category="k", segment="s", brand="b"):
    d = day(first)
    return (sku, channel, region, d, float(units), category, segment, brand, d, d + dt.timedelta(days=7))


def held(spark, *skus):
    return spark.createDataFrame([(s, day("2022-06-01")) for s in skus], "sku string, first_seen date")


def test_midweek_launch_has_partial_week_and_full_seven_days(daily):
    facts = daily(sales(start="2022-01-05", units=[10.0] * 19))
    assert launch.launch_week_records(facts).first().launch_units == 50.0
    seven = launch.seven_day_launch_records(facts).first()
    assert (seven.launch_units, seven.observed_days) == (70.0, 7)


def test_unfinished_launch_windows_are_left_out(daily):
    assert launch.seven_day_launch_records(daily(sales(start="2022-01-05", units=[10.0] * 6))).count() == 0


def test_later_sales_never_reach_launch_records(daily):
    a = launch.seven_day_launch_records(daily(sales(units=[10.0] * 30))).collect()
    b = launch.seven_day_launch_records(daily(sales(units=[10.0] * 7 + [999.0] * 23))).collect()
    assert a == b


def attrs(spark):
    rows = [("T", "k", "s", "p", 10.0, day("2022-03-01")), ("late", "k", "s", "p", 10.0, day("2022-04-01")),
            ("same", "k", "s", "p", 14.0, day("2022-01-01")), ("cheap", "k", "x", "p", 10.0, day("2022-01-01")),
            ("other", "z", "s", "p", 10.0, day("2022-01-01"))]
    return spark.createDataFrame(rows, "sku string, category string, segment string, pack_type string, price_unit double, first_seen date")


def test_analog_prefers_tier_and_ignores_later_launches(spark):
    got = launch.analog_tiered(attrs(spark), held(spark, "T")).first()
    assert (got.analog_sku, got.tier, got.price_gap) == ("same", 0, 4.0)
    fallback = launch.analog_tiered(attrs(spark).filter("sku != 'same' AND sku != 'cheap'"), held(spark, "T")).first()
    assert (fallback.analog_sku, fallback.tier) == ("other", 3)


def test_analog_price_uses_days_before_the_cutoff_only(daily, spark):
    facts = daily(sales(sku="N", start="2022-01-03", units=[1.0] * 30, price=10) + sales(sku="N", start="2022-03-07", units=[1.0], price=500)
                  + sales(sku="M", start="2022-01-03", units=[1.0] * 30, price=40) + sales(sku="T", start="2022-02-09", units=[1.0] * 5, price=12))
    got = launch.analog_launch(facts, launch.latest_items(features.item_table(facts), 1)).first()
    assert (got.sku, got.analog_sku, got.price_gap, got.cutoff) == ("T", "N", 2.0, day("2022-02-07"))


def random_items(seed, n=150):
    """sku, category, segment, pack, price, first day; few values, so that prices, days and tiers tie, and some are missing."""
    r = np.random.default_rng(seed)
    pick = lambda *v: v[int(r.integers(len(v)))]
    return [(f"i{i:03d}", pick("k", "l", "m", None), pick("s", "t", None), pick("p", "q"), pick(None, *[float(x) for x in range(5, 30)] * 2),
             day("2022-01-03") + dt.timedelta(days=int(r.integers(90)))) for i in range(n)]


def nearest_by_hand(target, candidates, tiers):
    """Least (tier, gap, item) over all candidates, given as (item, keys, price)."""
    keys, price = target
    found = [(min(t for t, names in enumerate([*tiers, ()]) if all(keys[k] is not None and keys[k] == other[k] for k in names)), abs(p - price), sku)
             for sku, other, p in candidates if p is not None and price is not None]
    return min(found, default=None)


def test_tiered_analogs_against_all_pairs(spark):
    rows = random_items(1)
    frame = spark.createDataFrame(rows, "sku string, category string, segment string, pack_type string, price_unit double, first_seen date")
    out = {r[0] for r in rows[::3]}
    tiers = [(0, 1, 2), (0, 2), (0,)]
    want = {}
    for sku, *keys, price, first in rows:
        pool = [(r[0], r[1:4], r[4]) for r in rows if r[0] not in out and r[5] < first]
        if sku in out and (best := nearest_by_hand((keys, price), pool, tiers)):
            want[sku] = best
    got = launch.analog_tiered(frame, held(spark, *out)).collect()
    assert {r.sku: (r.tier, r.price_gap, r.analog_sku) for r in got} == want and len(want) > 30 and len(got) == len(want)
    assert launch.analog_tiered(frame, held(spark, *[r[0] for r in rows])).count() == 0


def test_launch_analogs_and_pools_against_all_pairs(daily, spark):
    """Prices change from day to day, so a candidate's mean depends on the cutoff."""
    r, rows, known = np.random.default_rng(2), [], {}
    for i in range(24):
        first = day("2022-01-03") + dt.timedelta(days=int(r.integers(60)))
        for d in sorted(r.choice(70, int(r.integers(1, 12)), replace=False)) if i % 3 else [0]:
            when, price = first + dt.timedelta(days=int(d)), int(r.integers(5, 40))
            rows += sales(sku=f"i{i:02d}", start=str(when), units=[1.0], price=price, category="kl"[i % 2], segment="st"[i // 2 % 2])
            known.setdefault(f"i{i:02d}", []).append((when, float(price)))
    facts = daily(rows)
    keys = {r.sku: (r.category, r.segment) for r in features.item_table(facts).collect()}
    first = {s: min(known[s]) for s in known}
    out = {s for s in known if int(s[1:]) % 3 == 0}
    held_out = spark.createDataFrame([(s, first[s][0]) for s in out], "sku string, first_seen date")
    want = {}
    for s in out:
        cutoff = first[s][0] - dt.timedelta(days=first[s][0].weekday())
        pool = [(c, keys[c], float(np.mean([p for d, p in known[c] if d < cutoff]))) for c in known if c not in out and min(known[c])[0] < cutoff]
        if best := nearest_by_hand((keys[s], first[s][1]), pool, [(0, 1), (0,)]):
            want[s] = (best[0], pytest.approx(best[1]), best[2], cutoff)
    got = launch.analog_launch(facts, held_out).collect()
    assert {r.sku: (r.tier, r.price_gap, r.analog_sku, r.cutoff) for r in got} == want and len(want) > 4

    panel = facts.select("sku", F.trunc("date", "week").alias("week")).distinct()
    weeks = {(s, d - dt.timedelta(days=d.weekday())) for s in known if s not in out for d, _ in known[s]}
    pools = {}
    for s in out:
        cutoff = first[s][0] - dt.timedelta(days=first[s][0].weekday())
        usable = [(c, w) for c, w in weeks if w + dt.timedelta(days=14) <= cutoff]
        if usable:
            pools[s] = (len(usable), len({c for c, _ in usable}), max(w for _, w in usable) + dt.timedelta(days=14))
    got = launch.training_pool_sizes(panel, held_out).collect()
    assert {r.sku: (r.train_rows, r.train_skus, r.train_label_available_max) for r in got} == pools and pools


def test_trajectory_is_frozen_at_the_cutoff(spark):
    rows = [(s, "c", "r", day(f) + dt.timedelta(weeks=a), a, 1.0, 10.0 * a) for s, f, n in (("N", "2022-01-03", 9), ("T", "2022-02-07", 9)) for a in range(n)]
    panel = spark.createDataFrame(rows, "sku string, channel string, region string, week date, sku_age long, units_sold double, target_next_week double")
    pairs = spark.createDataFrame([("T", "N", day("2022-02-07"))], "sku string, analog_sku string, cutoff date")
    got = [r.pred_analog for r in launch.analog_trajectory(panel, pairs).orderBy("sku_age").collect()]
    assert got == [0.0, 10.0, 20.0, 30.0] + [None] * 5     # labels of ages 0-3 were complete on 7 February
    pools = launch.training_pool_sizes(panel, spark.createDataFrame([("T", day("2022-02-09"))], "sku string, first_seen date")).first()
    assert (pools.train_rows, pools.train_skus) == (4, 1)


def random_records(n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        first = str(day("2022-01-01") + dt.timedelta(days=int(rng.integers(0, 90))))
        k, s, b = (str(rng.integers(0, m)) for m in (3, 2, 4))
        for c in sorted({str(rng.integers(0, 2)) for _ in range(2)}):
            rows.append(record(f"S{i:03d}", first, int(rng.integers(1, 50)), c, "r", k, s, b))
    return rows


def test_donor_pools_match_pairwise_brute_force(spark):
    rows = random_records()
    reserved = {"S003", "S017", "S050"}
    df, out = spark.createDataFrame(rows, RECORD_SCHEMA), held(spark, *reserved)
    donors = [r for r in rows if r[0] not in reserved]
    pool = rows_by(launch.eligible_donors(df, out), "sku")
    means = rows_by(launch.hierarchical_mean(df, out), "sku", "channel")
    analogs = rows_by(launch.analog_metadata(df, out), "sku", "channel")
    for r in rows:
        known = [d for d in donors if d[9] <= r[3]]
        assert pool[r[0]].donors == len(known) and pool[r[0]].donor_items == len({d[0] for d in known})
        tiers = [[d for d in known if (d[5], d[1], d[2]) == (r[5], r[1], r[2])], [d for d in known if d[5] == r[5]],
                 [d for d in known if (d[1], d[2]) == (r[1], r[2])], known]
        best = next((t for t in tiers if t), None)
        got = means[(r[0], r[1])]
        assert got.baseline_donors == (len(best) if best else None)
        if best:
            assert got.pred_category_mean == pytest.approx(np.mean([d[4] for d in best]))
        near = [d for d in known if (d[1], d[2]) == (r[1], r[2])]
        got = analogs[(r[0], r[1])]
        if near:
            want = min(near, key=lambda d: (-(4 * (d[5] == r[5]) + 2 * (d[6] == r[6]) + (d[7] == r[7])), -d[3].toordinal(), d[0]))
            assert (got.analog_sku, got.pred_zero_analog) == (want[0], want[4])
        else:
            assert got.analog_sku is None


def test_eligibility_ignores_outcomes(spark):
    rows = random_records(40)
    changed = [(*r[:4], r[4] * 100 + 7, *r[5:]) for r in rows]
    out = held(spark, "S001")
    a, b = (rows_by(launch.chronological_eligibility(spark.createDataFrame(x, RECORD_SCHEMA), out, 3), "sku") for x in (rows, changed))
    assert a == b and a["S001"].status == "reserved_existing_test"
    assert {r.status for r in a.values()} == {"reserved_existing_test", "eligible", "insufficient_prior_launches"}
    with pytest.raises(ValueError):
        launch.chronological_eligibility(spark.createDataFrame(rows, RECORD_SCHEMA), out, 0)


def test_scores_use_common_rows(spark):
    df = spark.createDataFrame([("A", 10.0, 8.0, 12.0), ("A", 10.0, None, 0.0), ("B", 20.0, 20.0, 10.0)],
                               "sku string, launch_units double, p double, q double")
    got = rows_by(launch.cold_start_scores(df, {"p": "p", "q": "q"}), "scope", "model")
    assert (got[("all", "q")].n, got[("all", "q")].available_n) == (2, 3)
    assert got[("all", "q")].WAPE == pytest.approx(12 / 30) and got[("A", "p")].WAPE == pytest.approx(0.2)


def test_launch_week_recovered_from_age(spark):
    rows = [("A", day("2022-01-31"), 4), ("A", day("2022-02-07"), 5), ("B", day("2022-01-31"), 4), ("B", day("2022-02-14"), 5)]
    got = rows_by(launch.launch_week_of(spark.createDataFrame(rows, "sku string, week date, sku_age long")), "sku")
    assert got["A"].launch_week == day("2022-01-03") and got["A"].consistent and not got["B"].consistent


def sparse_facts(daily, seed=5, n=40):
    """Few days per series over two years, with long and short gaps, repeated days and a week whose units are all missing."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        for c in ("c1", "c2"):
            for d in rng.integers(0, 700, int(rng.integers(1, 9))):
                rows += sales(f"S{i:02d}", c, "r", str(day("2022-01-05") + dt.timedelta(days=int(d))), [float(rng.integers(1, 9))] * int(rng.integers(1, 12)))
    rows += sales("M", start="2022-01-03", units=[2.0]) + [(*r[:-1], None) for r in sales("M", start="2022-02-14", units=[1.0])]
    return daily(rows + rows[:20])


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_early_history_builds_only_weeks_near_recorded_ones(daily):
    facts = sparse_facts(daily).cache()
    panel = rollup.next_week_target(rollup.lag_features(rollup.weekly_rollup(facts)))
    days = facts.groupBy(*SERIES, F.trunc("date", "week").alias("week")).agg(F.countDistinct("date").alias("observed_days"))
    ages = rollup.add_sku_age(panel.dropna(subset=["target_next_week"]), rollup.first_seen(facts)).join(days, WEEK_KEYS)
    columns = [*WEEK_KEYS, "sku_age", *rollup.LAG_COLUMNS, "target_next_week", "observed_days"]
    assert as_rows(launch.early_history_table(facts), *columns) == as_rows(ages, *columns)
    near = rollup.weekly_rollup(facts, reach=(1, rollup.ROLLING_WEEKS)).count()
    assert near <= 6 * days.count() and near < panel.count() / 2


def test_runs_are_the_labelled_weeks(daily, spark):
    facts = sparse_facts(daily).cache()
    panel, runs = rollup.labelled_weeks(facts, keep_early_history=True), rollup.labelled_runs(facts)
    week = F.explode(F.expr("sequence(week, date_add(week, CAST(7 * (n_weeks - 1) AS INT)), INTERVAL 7 DAYS)")).alias("week")
    assert as_rows(runs.select(*SERIES, week), *WEEK_KEYS) == as_rows(panel, *WEEK_KEYS) and runs.count() < panel.count() / 3
    held_out = spark.createDataFrame([("S03", day("2023-03-01")), ("S05", day("2023-11-01")), ("S07", day("2024-06-01"))], "sku string, first_seen date")
    pools = [as_rows(launch.training_pool_sizes(p, held_out), "sku", "cutoff", "train_rows", "train_skus", "train_label_available_max") for p in (panel, runs)]
    assert pools[0] == pools[1] and len(pools[0]) == 3


def test_panel_is_stretched_for_targets_and_analogs_only(spark, daily, monkeypatch):
    facts, seen = sparse_facts(daily).cache(), []
    monkeypatch.setattr(launches, "_launch_daily", lambda *_: facts)
    build = rollup.weekly_base
    monkeypatch.setattr(launches.rollup, "weekly_base", lambda d, **k: seen.append(d) or build(d, **k))
    got = launches._trajectory(spark, "")
    skus = {r.sku for r in seen[0].select("sku").distinct().collect()}
    held_out = launch.latest_items(features.item_table(facts), launches.HELD_OUT)
    want = launch.analog_trajectory(build(facts, keep_early_history=True), launch.analog_launch(facts, held_out))
    columns = [*WEEK_KEYS, "sku_age", "units_sold", "analog_sku", "pred_analog"]
    assert as_rows(got, *columns) == as_rows(want, *columns) and len(skus) <= 2 * launches.HELD_OUT


def test_age_and_label_do_not_sort_the_stretched_panel(daily):
    """What an item's launch week needs is known before weeks are added, so nothing is moved or sorted above them."""
    facts = sparse_facts(daily)
    found = launch.launch_week_of(rollup.weekly_base(facts, keep_early_history=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "Window" not in above and "Sort " not in above
    labels = rollup.next_week_target(rollup.weekly_rollup(facts)).dropna(subset=["target_next_week"])
    assert as_rows(rollup.labelled_weeks(facts, True), *WEEK_KEYS, "target_next_week") == as_rows(labels, *WEEK_KEYS, "target_next_week")
