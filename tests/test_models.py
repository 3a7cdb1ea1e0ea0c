import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by
from tidepanel.operators import encode, models, splits
from tidepanel.plans import QUERIES, forecasts
from tidepanel.schema import FEATURE_COLS, FEATURE_GROUPS, LABEL

COLS = ["sku", "channel", "units_sold", "lag_1"]
CATS = ["sku", "channel"]


@pytest.fixture(scope="module")
def learnable(spark):
    """Next week's sales are twice last week's lag plus an item effect."""
    rng = np.random.default_rng(2)
    rows = []
    for k, sku in enumerate("ABCD"):
        for c in ("x", "y"):
            for i in range(60):
                lag = float(rng.integers(0, 20))
                rows.append((sku, c, "r", day("2022-01-03") + dt.timedelta(weeks=i), float(rng.integers(0, 20)), lag, 2 * lag + 10 * k))
    return spark.createDataFrame(rows, "sku string, channel string, region string, week date, units_sold double, lag_1 double, target_next_week double")


def halves(df):
    cut = F.lit("2022-10-03").cast("date")
    return df.filter(F.col("week") < cut), df.filter(F.col("week") >= cut)


def mae(df, c="prediction"):
    return df.agg(F.avg(F.abs(F.col(c) - F.col(LABEL)))).first()[0]


@pytest.mark.parametrize("name", list(models.SPECS))
def test_pooled_models_learn_and_repeat(learnable, name):
    train, val = halves(learnable)
    spec = models.SPECS[name].sized(trees=40, depth=4)
    a = models.fit_predict(train, val, spec, COLS, LABEL, CATS)
    assert a.count() == val.count() and mae(a) < 0.7 * mae(a, "units_sold")
    b = models.fit_predict(train, val, spec, COLS, LABEL, CATS)
    key = ["sku", "channel", "week"]
    assert {tuple(r[k] for k in key): r.prediction for r in a.collect()} == {tuple(r[k] for k in key): r.prediction for r in b.collect()}


def test_unseen_items_are_scored(learnable):
    train, val = halves(learnable)
    for name in models.SPECS:
        out = models.fit_predict(train, val.withColumn("sku", F.lit("new")), models.SPECS[name].sized(trees=3, depth=3), COLS, LABEL, CATS)
        assert out.filter("prediction IS NULL").count() == 0


def test_codes_come_from_training_values_only(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "x")], "k string, j string")
    val = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, j string")
    codes = encode.fit_codes(train, ["k", "j"])
    got = rows_by(encode.apply_codes(val, codes, ["k", "j"]), "k")
    assert (got["a"].k_code, got["a"].j_code, got["c"].k_code, got["c"].j_code) == (0, 0, -1, -1)
    assert rows_by(encode.apply_codes(train, codes, ["k"]), "k")["b"].k_code == 1


def test_local_models_need_enough_rows(learnable):
    train, val = halves(learnable)
    few = train.filter("sku != 'D' OR week < '2022-02-01'")
    out = models.local_per_item(few, val, ["units_sold", "lag_1"])
    assert out.filter("sku = 'D' AND prediction IS NOT NULL").count() == 0
    assert mae(out.filter("sku != 'D'")) < 1.0


def test_embeddings_ignore_validation_rows(learnable):
    train, val = halves(learnable)
    dims = {"sku": 2, "channel": 2}
    a = models.fit_embeddings(train, dims, iterations=3)
    changed = learnable.withColumn(LABEL, F.when(F.col("week") >= F.lit("2022-10-03").cast("date"), 9999.0).otherwise(F.col(LABEL)))
    b = models.fit_embeddings(halves(changed)[0], dims, iterations=3)
    for e in dims:
        assert {r.entity: r.vector for r in a[e].collect()} == {r.entity: r.vector for r in b[e].collect()}
    out = models.with_embeddings(val.withColumn("sku", F.lit("unknown")), a, dims)
    mean = np.mean([r.vector for r in a["sku"].collect()], axis=0)
    assert out.first().sku_emb_0 == pytest.approx(mean[0], rel=1e-6)


def test_feature_groups_partition_the_inputs():
    reduced = models.without_groups()
    assert len(reduced) == 6 and len(FEATURE_COLS) == 38
    assert all(set(FEATURE_COLS) - set(cols) == set(FEATURE_GROUPS[g[len("without_"):]]) for g, cols in reduced.items())
    with pytest.raises(ValueError):
        models.without_groups([c for c in FEATURE_COLS if c != "lag_1"])


def test_cross_validation_ledger_pairs_every_key(learnable):
    calendar = splits.fold_calendar(learnable, "2022-08-01", val_fold_weeks=8, final_test_weeks=8)
    variants = {"mean": lambda train, val: val.select("sku", "channel", "region", "week").withColumn(
        "prediction", train.agg(F.avg(LABEL)).scalar())}
    out = models.run_cv(learnable, calendar, variants, folds=[1, 2])
    assert out.groupBy("fold_id").count().filter("count != 64").count() == 0 and out.filter("prediction IS NULL").count() == 0


def test_smoothing_follows_trend_and_season():
    t = np.arange(3 * 52 + 10)
    y = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 52)
    sse, ahead = models._smooth(y[:156], 0.3, 0.05, 0.2, 10)
    assert np.abs(ahead - y[156:]).max() < 8
    _, short = models._smooth(np.arange(40.0), 0.6, 0.2, 0.2, 3)
    assert short == pytest.approx([40, 41, 42], abs=2)


def test_ordered_means_use_completed_targets_only(spark):
    rows = [("a", day("2022-01-03") + dt.timedelta(weeks=i), float(v)) for i, v in enumerate([4, 8, 100, 6])]
    got = encode.ordered_target_encoding(spark.createDataFrame(rows, "k string, week date, y double"), "k", "y").orderBy("week").collect()
    assert [r.k_encoded for r in got] == [None, None, 4.0, 6.0]


def test_high_cardinality_columns_are_averaged_not_indexed(learnable, monkeypatch):
    monkeypatch.setattr(models, "MAX_INDEXED_LEVELS", 3)
    train, val = halves(learnable)
    spec = models.Spec("small", "gbt", "index", {"maxIter": 3, "maxDepth": 3, "seed": 1})
    model = models.fit(train, spec, COLS, LABEL, CATS)
    assert model.averaged == ["sku"] and model.indexed == ["channel"] and model.predict(val).filter("prediction IS NULL").count() == 0


def test_registered_models_run_whole(spark, learnable, monkeypatch):
    """Every fold and the published settings; the learner itself is left out."""
    calendar = splits.fold_calendar(learnable, "2022-08-01", val_fold_weeks=8, final_test_weeks=8)
    folds = calendar.agg(F.max("n_folds")).first()[0]
    due = splits.attach_folds(learnable, calendar).filter("fold_id > 0 AND NOT is_holdout").count()
    seen = []

    def record(train, val, spec, *rest):
        seen.append(spec)
        return val.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(models, "fit_predict", record)
    monkeypatch.setattr(forecasts, "_features", lambda spark, sf: learnable)
    monkeypatch.setattr(forecasts.scoring, "calendar", lambda base: calendar)
    for name, spec in models.SPECS.items():
        seen.clear()
        assert QUERIES[name](spark, "").count() == due and seen == [spec] * folds and folds > 1
    seen.clear()
    ledger = QUERIES["feature_ablation"](spark, "")
    assert ledger.count() == 6 and seen == [models.SPECS["global_gbt"]] * 7 * folds
    assert all(s.params["maxIter"] == 300 for n, s in models.SPECS.items() if s.family == "gbt")
    assert forecasts.LAUNCH_HELD_OUT == 5 and len(models.LOCAL_FEATURES) == 31


def test_encoding_does_not_depend_on_size(learnable):
    train, _ = halves(learnable)
    wide = train.crossJoin(learnable.sparkSession.range(70).withColumnRenamed("id", "n"))
    many = wide.withColumn("sku", F.concat("sku", F.col("n").cast("string"))).drop("n")
    for name in ("global_gbt", "global_rf"):
        spec = models.SPECS[name].sized(trees=1, depth=1)
        assert models.fit(train, spec, COLS, LABEL, CATS).inputs == models.fit(many, spec, COLS, LABEL, CATS).inputs
    with pytest.raises(ValueError, match="channel"):
        models.fit(many.withColumn("channel", F.col("sku")), models.SPECS["global_gbt"].sized(trees=1, depth=1), COLS, LABEL, CATS)


def test_encoders_alone_give_the_same_frame(learnable):
    train, val = halves(learnable)
    for name in ("global_gbt", "global_gbt_target", "global_rf"):
        spec = models.SPECS[name].sized(trees=1, depth=1)
        alone, fitted = models.fit_encoders(train, spec, COLS, LABEL, CATS), models.fit(train, spec, COLS, LABEL, CATS)
        assert alone.model is None and alone.inputs == fitted.inputs
        frames = [sorted(map(str, m.design(val).select("sku", "channel", "week", "features").collect())) for m in (alone, fitted)]
        assert frames[0] == frames[1]


@pytest.mark.parametrize("spec", [*models.SPECS.values(), models.CANDIDATES["enhanced_huber"][1]], ids=lambda s: s.name)
def test_learner_input_carries_no_joins(learnable, monkeypatch, capsys, spec):
    """Its plan goes to every task of a fit, and a boosted fit has thousands."""
    train, _ = halves(learnable)
    plans, learner = [], models._learner

    def spy(spec):
        def fit(data):
            capsys.readouterr()
            data.explain()
            plans.append((capsys.readouterr().out, data.count()))
            return learner(spec).fit(data)
        return type("Spy", (), {"fit": staticmethod(fit)})

    monkeypatch.setattr(models, "_learner", spy)
    models.fit(train, spec.sized(trees=2, depth=2), COLS, LABEL, CATS)
    (plan, rows), = plans
    assert "Scan ExistingRDD" in plan and "Join" not in plan and "Window" not in plan and rows == train.count()
