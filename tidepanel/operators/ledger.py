"""Baseline forecasts, the long prediction ledger, its validation and its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.hashing import hash_sum, key_text, md5_int
from tidepanel.functions.numeric import forecast_metrics, is_finite, named, ratio
from tidepanel.operators.rollup import series_window
from tidepanel.operators.splits import attach_folds, walk_forward_folds
from tidepanel.operators.validate import count_if, stack_checks
from tidepanel.schema import LABEL, WEEK_KEYS

SEASON_WEEKS = 52
MOVING_AVERAGE_WEEKS = 4
METRICS = ["MAE", "RMSE", "WAPE", "SMAPE"]
# Baseline ids and the columns that hold their forecasts.
BASELINES = {
    "naive": "pred_naive",
    "seasonal_naive": "pred_seasonal_naive",
    "moving_avg_4": "pred_moving_avg_4",
}
LEDGER_KEYS = ["model_id", "fold_id"] + WEEK_KEYS


def add_baseline_predictions(panel: DataFrame) -> DataFrame:
    """Persistence, same week last year and the mean of the last four weeks including the current one."""
    w = series_window()
    frame = w.rowsBetween(-(MOVING_AVERAGE_WEEKS - 1), 0)
    full = F.count("units_sold").over(frame) == MOVING_AVERAGE_WEEKS
    return panel.withColumns({
        "pred_naive": F.col("units_sold"),
        "pred_seasonal_naive": F.lag("units_sold", SEASON_WEEKS).over(w),
        "pred_moving_avg_4": F.when(full, F.avg("units_sold").over(frame)),
    })


def to_long(df: DataFrame, predictions: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per (row, model) from one prediction column per model."""
    items = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(c).cast("double").alias("prediction"))
                      for m, c in predictions.items()])
    return df.select(*keep, F.explode(items).alias("p")).select(*keep, "p.model_id", "p.prediction")


def cv_baseline_ledger(base: DataFrame, calendar: DataFrame) -> DataFrame:
    """Baselines on the trimmed table without the final test weeks, for the validation weeks of every fold."""
    cv = attach_folds(base, calendar).filter(~F.col("is_holdout"))
    scored = add_baseline_predictions(cv.select(*WEEK_KEYS, "units_sold", LABEL, "fold_id")).filter(F.col("fold_id") > 0)
    return to_long(scored.withColumnRenamed(LABEL, "actual"), BASELINES, WEEK_KEYS + ["fold_id", "actual"])


def label_complete(week: Column | str, last_date: Column) -> Column:
    """The label week (the seven days after the origin week) has been fully observed."""
    return F.date_add(week, 13) <= last_date


def build_ledger(eval_rows: DataFrame, predictions: dict[str, str], extra: list[str] = ()) -> DataFrame:
    """Holdout ledger: evaluation rows already paired by key with one column per model; a key that occurs twice is an error."""
    times = F.count(F.lit(1)).over(Window.partitionBy(*WEEK_KEYS))
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in WEEK_KEYS])
    problem = F.when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("evaluation key occurs more than once: "), key)))
    # As a filter the rule holds whichever columns are read afterwards.
    eval_rows = eval_rows.withColumn("_times", times).filter(F.coalesce(problem.cast("boolean"), F.lit(True))).drop("_times")
    return to_long(eval_rows.withColumnRenamed(LABEL, "actual"), predictions, WEEK_KEYS + ["actual", *extra])


def holdout_baseline_ledger(features: DataFrame, calendar: DataFrame, last_date: Column,
                            extra: list[str] = ()) -> DataFrame:
    """Baselines over the whole panel, scored on the final test weeks; each row knows if its label is complete."""
    rows = add_baseline_predictions(attach_folds(features, calendar)).filter(F.col("is_holdout"))
    rows = rows.withColumns({"label_week": F.date_add("week", 7), "label_complete": label_complete("week", last_date)})
    return build_ledger(rows, BASELINES, ["label_week", "label_complete", *extra])


# ---------------------------------------------------------------- pairing

def key_parity(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Full-outer pairing of two key sets: how many keys are in both, or only on one side."""
    joined = gold.select(*by, *keys, F.lit(1).alias("_g")).join(
        pred.select(*by, *keys, F.lit(1).alias("_p")), [*by, *keys], "full_outer")
    both, left, right = F.col("_g").isNotNull() & F.col("_p").isNotNull(), F.col("_p").isNull(), F.col("_g").isNull()
    counts = [count_if(both).alias("n_both"), count_if(left).alias("n_gold_only"), count_if(right).alias("n_pred_only")]
    return joined.groupBy(*by).agg(*counts) if by else joined.agg(*counts)


def prediction_rows(gold: DataFrame, pred: DataFrame, model_id: str, fold_id: int) -> DataFrame:
    """Pair actuals and predictions 1:1 by key, whatever their order; any difference in the keys is an error.

    A missing prediction value is kept (it counts against coverage), a missing prediction row is not.
    """
    def once(df: DataFrame, value: str, out: str) -> DataFrame:
        grouped = df.groupBy(*WEEK_KEYS).agg(F.count(F.lit(1)).alias(f"_n_{out}"), F.max(value).alias(out))
        return grouped

    joined = once(gold, LABEL, "actual").join(once(pred, "prediction", "prediction"), WEEK_KEYS, "full_outer")
    problem = (F.when(F.col("_n_actual").isNull() | F.col("_n_prediction").isNull(),
                      F.raise_error(F.lit("a prediction or a validation row has no counterpart of the same keys")))
               .when((F.col("_n_actual") > 1) | (F.col("_n_prediction") > 1),
                     F.raise_error(F.lit("a prediction or a validation row comes twice under the same keys")))
               .when(~is_finite("actual"), F.raise_error(F.lit("an actual is null, NaN or infinite")))
               .when(F.abs("prediction") == float("inf"), F.raise_error(F.lit("a prediction is infinite"))))
    # As a filter the rules hold whichever columns are read afterwards.
    return joined.filter(F.coalesce(problem.cast("boolean"), F.lit(True))).select(
        *WEEK_KEYS, "actual", "prediction", F.lit(model_id).alias("model_id"), F.lit(fold_id).alias("fold_id"))


# ---------------------------------------------------------------- scores

def finite_only(df: DataFrame) -> DataFrame:
    return df.filter(is_finite("prediction"))


def _masked() -> Column:
    return F.when(is_finite("prediction"), F.col("prediction"))


def score_ledger(ledger: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pooled scores per model: coverage, error metrics and signed bias, one aggregation."""
    p = _masked()
    scored_actual = F.sum(F.when(p.isNotNull(), F.col("actual")))
    return ledger.groupBy("model_id", *by).agg(
        F.count(p).alias("n_scored"), ratio(F.count(p), F.count(F.lit(1))).alias("coverage"),
        *named(forecast_metrics("actual", p)),
        ratio(F.sum(p) - scored_actual, scored_actual).alias("bias"))


def fold_scores(ledger: DataFrame) -> DataFrame:
    """Scores per model and fold, with an order-insensitive hash of the scored keys."""
    p = _masked()
    return ledger.groupBy("model_id", "fold_id").agg(
        F.count(F.lit(1)).alias("n_eligible"), F.count(p).alias("n_scored"),
        ratio(F.count(p), F.count(F.lit(1))).alias("coverage"),
        *named(forecast_metrics("actual", p)),
        hash_sum(F.when(p.isNotNull(), md5_int(key_text("fold_id", *WEEK_KEYS)))).alias("cohort_part"))


def cohort_hash(ledger: DataFrame) -> DataFrame:
    """Equal hash means the models were scored on exactly the same keys."""
    return finite_only(ledger).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_scored"), hash_sum(md5_int(key_text("fold_id", *WEEK_KEYS))).alias("cohort_hash"))


def _all_or_null(agg: Column, c: str) -> Column:
    """An undefined fold score makes the mean undefined instead of being skipped."""
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def macro_scores(ledger: DataFrame) -> DataFrame:
    """Unweighted mean over folds, spread of WAPE, and ranks only inside identical cohorts."""
    per_model = fold_scores(ledger).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n_eligible").alias("n_eligible"), F.sum("n_scored").alias("n_scored"),
        hash_sum(F.col("cohort_part")).alias("cohort_hash"),
        *[_all_or_null(F.avg(m), m).alias(m) for m in METRICS],
        _all_or_null(F.stddev_samp("WAPE"), "WAPE").alias("WAPE_std"))
    scored = per_model.withColumn("coverage", ratio(F.col("n_scored"), F.col("n_eligible")))
    return rank_in_cohort(scored)


def rank_in_cohort(scores: DataFrame) -> DataFrame:
    """Competition rank by WAPE among models with the same cohort; alone in its cohort, a model has no rank."""
    cohort = Window.partitionBy("cohort_hash")
    comparable = F.count(F.lit(1)).over(cohort) > 1
    return scores.withColumn("rank", F.when(
        comparable & F.col("WAPE").isNotNull(), F.rank().over(cohort.orderBy(F.col("WAPE").asc_nulls_last())).cast("double")))


def add_delta(scores: DataFrame, reference: str) -> DataFrame:
    """WAPE relative to a reference model, only where both have the same cohort."""
    ref = scores.filter(F.col("model_id") == reference).select(
        "cohort_hash", F.col("WAPE").alias("_ref"))
    return scores.join(ref, "cohort_hash", "left").withColumn("delta_WAPE", F.col("WAPE") - F.col("_ref")).drop("_ref")


def common_keys(ledger: DataFrame, n_models: int) -> DataFrame:
    """Keys for which every model has a prediction: one count per key instead of repeated set intersections."""
    return finite_only(ledger).groupBy("fold_id", *WEEK_KEYS).agg(
        F.countDistinct("model_id").alias("_models")).filter(F.col("_models") == n_models).drop("_models")


def common_cohort(ledger: DataFrame, n_models: int) -> DataFrame:
    return finite_only(ledger).join(common_keys(ledger, n_models), ["fold_id", *WEEK_KEYS], "left_semi")


def negative_audit(ledger: DataFrame) -> DataFrame:
    """Count, share and minimum of negative forecasts per model and fold."""
    neg = count_if(F.col("prediction") < 0)
    return ledger.groupBy("model_id", "fold_id").agg(
        neg.alias("n_negative"), ratio(neg, F.count("prediction")).alias("negative_share"),
        F.min("prediction").alias("min_prediction"))


def floor_predictions(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))


def pivot_scores(scores: DataFrame, index: str, models: list[str], value: str = "WAPE") -> DataFrame:
    """index x model matrix; the model list is given, so no extra pass is needed to find the columns."""
    return scores.groupBy(index).pivot("model_id", models).agg(F.max(value))


def weekly_error_totals(ledger: DataFrame) -> DataFrame:
    """Per target week and model: total actual and total absolute error over scored rows."""
    p = _masked()
    return ledger.groupBy(F.date_add("week", 7).alias("target_week"), "model_id").agg(
        F.sum(F.when(p.isNotNull(), F.col("actual"))).alias("actual_total"),
        F.sum(F.abs(p - F.col("actual"))).alias("abs_error"))


# ---------------------------------------------------------------- validation

def validate_ledger(ledger: DataFrame, calendar: DataFrame, models: list[str]) -> DataFrame:
    """Report of the ledger rules: unique keys, expected models, folds and weeks, identical keys and actuals."""
    per_key = ledger.groupBy(*LEDGER_KEYS).agg(F.count(F.lit(1)).alias("n"))
    dup = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
    weeks = F.broadcast(calendar.select("week", F.col("fold_id").alias("_own"), "is_holdout"))
    placed = ledger.join(weeks, "week", "left")
    place = placed.agg(count_if(F.col("is_holdout")).alias("holdout"),
                       count_if(~F.col("fold_id").eqNullSafe(F.col("_own")) & ~F.col("is_holdout")).alias("misplaced"))
    expected_models = ledger.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    found = ledger.select("model_id").distinct()
    model_diff = set_difference(found, expected_models, "model_id")
    folds = walk_forward_folds(calendar).select("fold_id").distinct()
    fold_diff = set_difference(ledger.select("fold_id").distinct(), folds, "fold_id")
    val_weeks = walk_forward_folds(calendar).filter("role = 'val'").select("fold_id", "week")
    week_pairs = ledger.select("fold_id", "week").distinct()
    missing_weeks = val_weeks.join(week_pairs, ["fold_id", "week"], "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    agreement = ledger.groupBy("fold_id", *WEEK_KEYS).agg(
        F.countDistinct("model_id").alias("m"), F.min("actual").alias("lo"), F.max("actual").alias("hi")).agg(
        count_if((F.col("m") != len(models)) | ~F.col("lo").eqNullSafe(F.col("hi"))).alias("bad"))

    def check(df: DataFrame, name: str, c: str = "bad") -> DataFrame:
        return stack_checks(df, [(name, F.col(c), F.concat(F.col(c).cast("string"), F.lit(" row(s)")))])

    parts = [check(dup, "unique prediction keys"), check(place, "no holdout weeks", "holdout"),
             check(place, "weeks inside their fold", "misplaced"), check(model_diff, "expected models"),
             check(fold_diff, "expected folds"), check(missing_weeks, "complete validation weeks"),
             check(agreement, "identical keys and actuals across models")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_difference(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Size of the symmetric difference of two sets, from one marked union."""
    marked = a.select(c).distinct().withColumn("_s", F.lit(1)).unionByName(
        b.select(c).distinct().withColumn("_s", F.lit(2)))
    sides = marked.groupBy(c).agg(F.sum("_s").alias("_s"))
    return sides.agg(count_if(F.col("_s") != 3).alias("bad"))
