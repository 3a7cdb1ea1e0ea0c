import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by
from tidepanel.functions.hashing import poisson_weight
from tidepanel.functions.numeric import (beta_cdf, chi2_sf, normal_sf2, stable, student_quantile, student_sf2)
from tidepanel.operators import ledger, quantiles, resample, splits, stats
from tidepanel.operators.identifiers import dense_ids
from tidepanel.schema import WEEK_KEYS

SCHEMA = "sku string, channel string, region string, week date, fold_id int, model_id string, actual double, prediction double"


def weeks(n, start="2022-01-03"):
    return [day(start) + dt.timedelta(weeks=i) for i in range(n)]


@pytest.fixture
def panel(spark):
    rows = [(s, "c", "r", w, float(i % 4 + 1), float((i + 1) % 4 + 1)) for s in "AB" for i, w in enumerate(weeks(40))]
    return spark.createDataFrame(rows, "sku string, channel string, region string, week date, units_sold double, target_next_week double")


@pytest.fixture
def calendar(panel):
    return splits.fold_calendar(panel, "2022-05-30", val_fold_weeks=4, final_test_weeks=6)


def test_folds_expand_and_leave_the_end_alone(calendar):
    got = calendar.orderBy("week").collect()
    assert [r.fold_id for r in got] == [0] * 22 + [1] * 4 + [2] * 4 + [3] * 4 + [None] * 6
    assert got[0].n_folds == 3 and sum(r.is_holdout for r in got) == 6
    long = splits.walk_forward_folds(calendar)
    sizes = rows_by(long.groupBy("fold_id", "role").count(), "fold_id", "role")
    assert [sizes[(f, "train")]["count"] for f in (1, 2, 3)] == [22, 26, 30]
    assert not long.join(calendar.filter("is_holdout"), "week").count()


def test_short_last_fold(panel):
    cal = splits.fold_calendar(panel, "2022-05-30", val_fold_weeks=5, final_test_weeks=6)
    assert [r["count"] for r in cal.filter("fold_id > 0").groupBy("fold_id").count().orderBy("fold_id").collect()] == [5, 5, 2]


@pytest.mark.parametrize("args, message", [(("2021-01-01", 4, 6), "before the first"), (("2022-05-30", 4, 40), "larger than")])
def test_bad_split_arguments(panel, args, message):
    with pytest.raises(Exception, match=message):
        splits.fold_calendar(panel, *args).collect()


def test_fold_rows_move_by_week(panel, calendar):
    per_week = splits.fold_rows(panel, calendar).groupBy("fold_id", "week").agg(F.countDistinct("role").alias("n"), F.count("*").alias("c"))
    assert per_week.filter("n != 1 OR c != 2").count() == 0
    assert all(r.ordered for r in splits.fold_summary(panel, calendar).collect())


def test_baselines_use_row_offsets(panel):
    got = ledger.add_baseline_predictions(panel.filter("sku = 'A'")).orderBy("week").collect()
    assert got[2].pred_moving_avg_4 is None and got[3].pred_moving_avg_4 == 2.5
    assert got[0].pred_naive == 1.0 and got[39].pred_seasonal_naive is None


def toy(spark, bad=None):
    """Two folds, two keys, three models; model c misses one prediction."""
    w = weeks(2)
    rows = []
    for fold, scale in ((1, 10.0), (2, 100.0)):
        for i, sku in enumerate("AB"):
            actual = scale * (i + 1)
            for model, p in (("a", actual * 1.1), ("b", actual + 5), ("c", None if (fold, sku) == (1, "B") else actual)):
                rows.append((sku, "c", "r", w[fold - 1], fold, model, actual, p))
    return spark.createDataFrame(rows, SCHEMA)


def test_macro_and_pooled_differ_and_ranks_need_equal_cohorts(spark):
    long = toy(spark)
    macro = rows_by(ledger.macro_scores(long), "model_id")
    pooled = rows_by(ledger.score_ledger(long), "model_id")
    assert macro["b"].WAPE == pytest.approx((10 / 30 + 10 / 300) / 2)
    assert pooled["b"].WAPE == pytest.approx(20 / 330) and macro["b"].WAPE != pooled["b"].WAPE
    assert macro["a"].rank == 1 and macro["b"].rank == 2 and macro["c"].rank is None
    assert macro["c"].coverage == 0.75 and macro["a"].cohort_hash == macro["b"].cohort_hash != macro["c"].cohort_hash
    assert pooled["a"].bias == pytest.approx(0.1)


def test_common_cohort_keeps_only_shared_keys(spark):
    scores = ledger.fold_scores(ledger.common_cohort(toy(spark), 3))
    assert {(r.model_id, r.fold_id): r.n_scored for r in scores.collect()} == {
        (m, f): n for m in "abc" for f, n in ((1, 1), (2, 2))}


def test_zero_actuals_make_the_macro_score_undefined(spark):
    long = toy(spark).withColumn("actual", F.when(F.col("fold_id") == 1, 0.0).otherwise(F.col("actual")))
    assert rows_by(ledger.macro_scores(long), "model_id")["a"].WAPE is None


def test_pairing_ignores_order_and_rejects_bad_keys(panel):
    gold = panel.filter("sku = 'A'")
    pred = gold.orderBy(F.desc("week")).select(*WEEK_KEYS, F.col("target_next_week").alias("prediction"))
    paired = ledger.prediction_rows(gold, pred, "m", 1)
    assert paired.filter("actual != prediction").count() == 0 and paired.count() == 40
    for wrong in (pred.limit(39), pred.unionByName(pred.limit(1))):
        with pytest.raises(Exception, match="keys"):
            ledger.prediction_rows(gold, wrong, "m", 1).count()
    with pytest.raises(Exception, match="infinite"):
        ledger.prediction_rows(gold, pred.withColumn("prediction", F.lit(float("inf"))), "m", 1).collect()


def test_bad_ledgers_are_reported(panel, calendar):
    good = ledger.cv_baseline_ledger(panel, calendar)
    models = list(ledger.BASELINES)

    def failed(df):
        return {r.check for r in ledger.validate_ledger(df, calendar, models).filter("NOT passed").collect()}

    assert failed(good) == set()
    one = good.filter("model_id = 'naive'").limit(1)
    assert "unique prediction keys" in failed(good.unionByName(one))
    assert "no holdout weeks" in failed(good.unionByName(one.withColumn("week", F.lit("2022-10-03").cast("date"))))
    assert "weeks inside their fold" in failed(good.withColumn("fold_id", F.lit(3)))
    assert "expected models" in failed(good.filter("model_id != 'naive'"))
    wrong = F.when((F.col("model_id") == "naive") & (F.col("sku") == "A"), 0.0).otherwise(F.col("actual"))
    assert "identical keys and actuals across models" in failed(good.withColumn("actual", wrong))


def test_label_needs_the_whole_next_week(spark):
    df = spark.createDataFrame([(day("2022-01-03"),)], "week date")
    for last, ok in (("2022-01-15", False), ("2022-01-16", True)):
        assert df.select(ledger.label_complete("week", F.lit(last).cast("date"))).first()[0] is ok


def test_exact_quantiles_and_ks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.lognormal(3, 2, 900), np.full(500, 7.0)]).round(3)
    b = rng.lognormal(3.2, 2, 700).round(3)
    A, B = (spark.createDataFrame([(float(v),) for v in x], "x double") for x in (a, b))
    got = quantiles.exact_quantiles(A, ["x"], {"q10": 0.1, "q50": 0.5, "q99": 0.99}).first()
    assert [got.q10, got.q50, got.q99] == pytest.approx(list(np.quantile(a, [0.1, 0.5, 0.99])))
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert quantiles.ks_distance(A, B, ["x"]).first().ks == pytest.approx(want)


def test_dense_ids_follow_sort_order(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in np.random.default_rng(1).permutation(500)], "k string")
    got = {r.k: r.id for r in dense_ids(df, ["k"], "id").collect()}
    assert got == {f"k{i:04d}": i + 1 for i in range(500)}


def test_cluster_bootstrap_brackets_the_point(spark):
    w = weeks(2)
    rows = [(s, "c", "r", d, 1, m, 100.0, 100.0 - e * k) for k, s in zip([1, 2] * 6, "ABCDEFGHIJKL") for d in w for m, e in (("a", 4.0), ("b", 20.0))]
    got = resample.cluster_bootstrap(spark.createDataFrame(rows, SCHEMA), "a", "b", WEEK_KEYS, reps=200).first()
    assert got.diff_b_minus_a == pytest.approx(0.24) and got.ci_low <= 0.24 <= got.ci_high
    assert got.n_series == 12 and got.n_boot == 200 and got.ci_excludes_0


def test_poisson_weights_follow_the_law(spark):
    drawn = [r.w for r in spark.range(40_000).select(poisson_weight(F.lit(42), "id").alias("w")).collect()]
    assert np.mean(drawn) == pytest.approx(1, abs=0.02) and np.var(drawn) == pytest.approx(1, abs=0.04)
    for k in range(5):
        assert np.mean(np.array(drawn) == k) == pytest.approx(np.exp(-1) / [1, 1, 2, 6, 24][k], abs=0.01)


def test_item_bootstrap_is_exact_for_proportional_errors(spark):
    df = spark.createDataFrame([("A", 100.0, 90.0, 80.0), ("A", 50.0, 45.0, 40.0), ("B", 200.0, 180.0, 160.0), ("B", 10.0, 9.0, 8.0)],
                               "sku string, launch_units double, p double, q double")
    got = resample.item_bootstrap(df, "p", {"p": "p", "q": "q"}, reps=100).first()
    assert [got.wape_difference, got.ci_low, got.ci_high] == pytest.approx([-0.1] * 3)


def test_block_bootstrap_of_constant_difference(spark):
    rows = [(w, 100.0, 10.0, 15.0) for w in weeks(9)]
    df = spark.createDataFrame(rows, "target_week date, actual_total double, new double, old double")
    got = resample.circular_block_bootstrap(df, "new", "old", reps=50, block_weeks=4).first()
    assert [got.point_difference, got.ci_low, got.ci_high, got.probability_challenger_better] == pytest.approx([-0.05, -0.05, -0.05, 1.0])


def test_tail_probabilities_against_known_values():
    assert student_quantile(0.975, 6) == pytest.approx(2.4469118511, abs=1e-8)
    assert student_sf2(2.0, 10) == pytest.approx(0.0733880348, abs=1e-8)
    assert normal_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9) and chi2_sf(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert beta_cdf(0.5, 2, 2) == pytest.approx(0.5)


def test_paired_tests_on_known_differences(spark):
    diffs = [0.1, 0.2, -0.05, 0.3, 0.15, 0.12, 0.08]
    rows = [(m, f, v) for f, d in enumerate(diffs, 1) for m, v in (("a", 1 + d), ("b", 1.0), ("c", 1 + d * 2))]
    got = rows_by(stats.paired_fold_tests(spark.createDataFrame(rows, "model_id string, fold_id int, WAPE double"), "a", ["b", "c"]), "challenger")
    d = np.array(diffs)
    assert got["b"].t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(7)))
    assert got["b"].wilcoxon_w == 1.0 and got["b"].wilcoxon_p == pytest.approx(2 * 2 / 128)
    assert got["b"].sign_p == pytest.approx(2 * 8 / 128) and got["b"].p_holm == pytest.approx(2 * got["b"].p_value)


def test_stable_rounds_and_renders(spark):
    got = stable(spark.createDataFrame([(1.23456749, day("2022-01-03"), 3)], "a double, b date, c int")).first()
    assert (got.a, got.b, got.c) == (1.234567, "2022-01-03", 3)


def test_a_repeated_evaluation_key_is_an_error(spark):
    rows = [("A", "c", "r", dt.date(2022, 1, 3), 5.0, 4.0), ("A", "c", "r", dt.date(2022, 1, 10), 6.0, 4.0)]
    schema = "sku string, channel string, region string, week date, target_units_next_week double, p double"
    schema = schema.replace("target_units_next_week", ledger.LABEL)
    assert ledger.build_ledger(spark.createDataFrame(rows, schema), {"m": "p"}).count() == 2
    with pytest.raises(Exception, match="more than once: A, c, r, 2022-01-03"):
        ledger.build_ledger(spark.createDataFrame(rows + rows[:1], schema), {"m": "p"}).count()


def test_side_by_side_keeps_order_and_raises(spark):
    from tidepanel.session import side_by_side
    assert side_by_side(spark, [lambda k=k: spark.range(k).count() for k in range(12)]) == list(range(12))
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_bootstrap_hashes_a_draw_once(spark):
    from tidepanel.operators import resample
    rows = [("a", 1.0, None), ("b", 2.0, 5.0), ("c", 4.0, 7.0), (None, 8.0, 1.0)]
    clusters = spark.createDataFrame(rows, "sku string, x double, y double")
    sums = resample.bootstrap_sums(clusters, ["sku"], ["x", "y"], 40, 42)
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    drawn = clusters.crossJoin(spark.range(1, 41).withColumnRenamed("id", "rep"))
    drawn = drawn.withColumn("w", poisson_weight(F.lit(42), "rep", "sku")).filter("w > 0")
    want = drawn.groupBy("rep").agg(F.sum(F.expr("w * x")).alias("x"), F.sum(F.expr("w * y")).alias("y"))
    # Also repetitions that draw nothing have no row, and sums without a value stay NULL.
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect()))
