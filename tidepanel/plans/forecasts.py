"""Fitted models with the published settings, on every fold."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidepanel.operators import features, launch, ledger, models, rollup, splits
from tidepanel.plans import scoring
from tidepanel.plans.registry import query
from tidepanel.schema import FEATURE_COLS, LABEL, WEEK_KEYS
from tidepanel.session import cut_lineage, side_by_side, stored
from tidepanel.sources import tables

LAUNCH_HELD_OUT = 5


def _sales_daily(spark, sf):
    """Daily facts without the text that no feature reads, materialised: several branches read them, the lines are read once."""
    return stored(tables.sales_daily(spark, sf).drop("pack_type"))


def _features(spark, sf, daily=None):
    return cut_lineage(features.feature_table(_sales_daily(spark, sf) if daily is None else daily))


def _cv_rows(spark, sf):
    """Rows of all cross-validation weeks with their fold, and the number of folds."""
    table = _features(spark, sf)
    calendar = scoring.calendar(table)
    n_folds = calendar.agg(F.max("n_folds")).first()[0] or 0
    if not n_folds:
        raise ValueError("the table is too short for a fold")
    return splits.attach_folds(table, calendar).filter(~F.col("is_holdout")).drop("n_folds", "is_holdout"), n_folds


def _by_fold(spark, sf, work):
    """``work`` of every fold's training and validation rows."""
    placed, n_folds = _cv_rows(spark, sf)

    def part(fold):
        return work(placed.filter(F.col("fold_id") < fold).drop("fold_id"), placed.filter(F.col("fold_id") == fold).drop("fold_id"))
    return models.stacked(side_by_side(spark, [partial(part, fold) for fold in range(1, n_folds + 1)]))


def _summary(scored):
    """Per week scores of the validation folds."""
    return scored.withColumnRenamed(LABEL, "actual").select(*WEEK_KEYS, "actual", "prediction")


# The frames do not depend on the learner, so none is fitted.
@query("model_frame_tree")
def model_frame_tree(spark, sf):
    def frame(train, val):
        model = models.fit_encoders(train, models.SPECS["global_gbt"])
        return model.design(val).select(*WEEK_KEYS, F.lit(len(model.inputs)).alias("n_inputs"), F.col("sku_mean"), F.col("lifecycle_stage_idx"))
    return _by_fold(spark, sf, frame)


@query("model_frame_target_enc")
def model_frame_target_enc(spark, sf):
    def frame(train, val):
        model = models.fit_encoders(train, models.SPECS["global_gbt_target"])
        return model.design(val).select(*WEEK_KEYS, "sku_mean", "category_mean", "lifecycle_stage_mean")
    return _by_fold(spark, sf, frame)


for _name in models.SPECS:
    @query(_name)
    def _pooled(spark, sf, _name=_name):
        return _summary(_by_fold(spark, sf, lambda train, val: models.fit_predict(train, val, models.SPECS[_name])))


@query("local_per_sku")
def local_per_sku(spark, sf):
    return _summary(_by_fold(spark, sf, models.local_per_item))


@query("holt_winters")
def holt_winters(spark, sf):
    return _summary(_by_fold(spark, sf, models.holt_winters))


@query("top_feature_importance")
def top_feature_importance(spark, sf):
    """Of the model fitted on all cross-validation weeks."""
    train, _ = _cv_rows(spark, sf)
    return models.top_importances(spark, models.fit(train.drop("fold_id"), models.SPECS["global_gbt"]))


@query("holdout_fit_once")
def holdout_fit_once(spark, sf):
    """All four pooled models once on the cross-validation weeks, scored with the baselines on the final weeks."""
    daily = _sales_daily(spark, sf)
    table = _features(spark, sf, daily)
    placed = splits.attach_folds(ledger.add_baseline_predictions(table), scoring.calendar(table))
    train = placed.filter(~F.col("is_holdout"))
    fitted = models.fit_models(train, list(models.SPECS.values()))
    last = daily.agg(F.max("date")).scalar()
    rows = placed.filter("is_holdout").filter(ledger.label_complete("week", last))
    predicted = models.predict_models(fitted, rows)
    columns = ledger.BASELINES | {n: f"pred_{n}" for n in fitted}
    return ledger.score_ledger(ledger.build_ledger(predicted, columns))


def _cv(spark, sf, variants):
    table = _features(spark, sf)
    return models.run_cv(table, scoring.calendar(table), variants)


@query("cv_ledger")
def cv_ledger(spark, sf):
    """Two pooled models and the per-item model on every fold."""
    variants = {n: models.pooled_variant(models.SPECS[n]) for n in ("global_gbt", "global_rf")} | {"local": models.local_variant()}
    return _cv(spark, sf, variants)


@query("feature_ablation")
def feature_ablation(spark, sf):
    spec = models.SPECS["global_gbt"]
    groups = models.without_groups()
    variants = {"global_gbt": models.pooled_variant(spec)} | {n: models.pooled_variant(spec, c) for n, c in groups.items()}
    return models.ablation(_cv(spark, sf, variants), "global_gbt", list(groups))


@query("entity_embeddings")
def entity_embeddings(spark, sf):
    """Of all cross-validation weeks."""
    train, _ = _cv_rows(spark, sf)
    out = None
    for entity, table in models.fit_embeddings(train).items():
        part = table.select(F.lit(entity).alias("kind"), "entity", F.posexplode("vector").alias("position", "value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("embedding_variant_scores")
def embedding_variant_scores(spark, sf):
    spec = models.SPECS["global_gbt"]
    variants = {"global_gbt": models.pooled_variant(spec), "gbt_embeddings": models.embedding_variant(spec)}
    return ledger.add_delta(ledger.macro_scores(_cv(spark, sf, variants)), "global_gbt")


def _launch_panel(spark, sf):
    daily = stored(tables.launch_daily(spark, sf))
    panel = cut_lineage(launch.early_history_table(daily))
    return panel, launch.latest_items(features.item_table(daily), LAUNCH_HELD_OUT)


# Only columns the early-history table has.
EARLY_FEATURES = [c for c in FEATURE_COLS if c in rollup.BASE_COLUMNS or c in ("brand", "segment", "category")]


@query("meta_learner")
def meta_learner(spark, sf):
    panel, held_out = _launch_panel(spark, sf)
    out = models.meta_learner(panel, held_out, models.SPECS["global_gbt"], EARLY_FEATURES)
    return out.select(*WEEK_KEYS, "sku_age", LABEL, "prediction", "train_cutoff")


@query("mature_model")
def mature_model(spark, sf):
    panel, held_out = _launch_panel(spark, sf)
    out = models.launch_model(panel, held_out, models.SPECS["global_gbt"], EARLY_FEATURES)
    return out.select(*WEEK_KEYS, "sku_age", LABEL, "prediction", "train_cutoff")


@query("zero_history_model")
def zero_history_model(spark, sf):
    daily = stored(tables.launch_daily(spark, sf).select(*launch.RECORD_INPUTS))
    items = cut_lineage(features.item_table(daily))
    records = launch.seven_day_launch_records(daily, items)
    held_out = launch.latest_items(items, 5)
    return models.zero_history(records, held_out, models.SPECS["global_gbt"]).select(
        *WEEK_KEYS, "launch_units", "pred_zero_model")


@query("tune_fixed_origin")
def tune_fixed_origin(spark, sf):
    from tidepanel.operators import daily_grain
    daily = _sales_daily(spark, sf)
    base = cut_lineage(rollup.labelled_weeks(daily))
    weekly = base.select(*WEEK_KEYS, "units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", LABEL)
    frame = daily_grain.same_weekday_features(daily, daily_grain.fixed_origin_panel(daily, weekly))
    return models.tune_fixed_origin(frame, scoring.calendar(base))


@query("grain_comparison")
def grain_comparison(spark, sf):
    daily = _sales_daily(spark, sf)
    table = _features(spark, sf, daily)
    calendar = scoring.calendar(table)
    folds = list(range(1, (calendar.agg(F.max("n_folds")).first()[0] or 0) + 1))
    return models.grain_comparison(daily, table, calendar, folds, models.SPECS["global_gbt"])
