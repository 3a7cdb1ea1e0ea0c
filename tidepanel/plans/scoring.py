"""Splits, baseline forecasts, the prediction ledger and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import features, ledger, rollup, splits
from tidepanel.plans.oracle_base import cte
from tidepanel.plans.registry import query
from tidepanel.schema import LABEL, SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage
from tidepanel.sources import tables

SPLIT = {"initial_train_end": "1999-12-31", "val_fold_weeks": 13, "final_test_weeks": 10}
MODELS = list(ledger.BASELINES)
KEY_SPEC = "sku:s channel:s region:s week:d"
METRIC_SPEC = "MAE:f RMSE:f WAPE:f SMAPE:f"

cte("cal", """
SELECT week, i AS week_idx, n - 10 - k AS cv_weeks, CAST(ceil((n - 10 - k) / 13.0) AS INTEGER) AS n_folds, i >= n - 10 AS is_holdout,
       CASE WHEN i >= n - 10 THEN NULL WHEN i < k THEN 0 ELSE (i - k) // 13 + 1 END AS fold_id
FROM (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS n,
             count(*) FILTER (week <= DATE '1999-12-31') OVER () AS k FROM (SELECT DISTINCT week FROM base))
""")
cte("folds", """
SELECT f.fold_id, CASE WHEN c.fold_id = f.fold_id THEN 'val' ELSE 'train' END AS role, c.week
FROM (SELECT DISTINCT fold_id FROM cal WHERE fold_id > 0) f JOIN cal c ON c.fold_id <= f.fold_id
""")


def _baselines(source: str) -> str:
    return f"""
SELECT *, units_sold AS pred_naive, lag(units_sold, 52) OVER s AS pred_seasonal_naive,
       CASE WHEN row_number() OVER s >= 4 THEN avg(units_sold) OVER (s ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END
         AS pred_moving_avg_4
FROM {source} WINDOW s AS (PARTITION BY sku, channel, region ORDER BY week)"""


_LONG = """
SELECT *, 'naive' AS model_id, pred_naive AS prediction, target_next_week AS actual FROM {t}
UNION ALL SELECT *, 'seasonal_naive', pred_seasonal_naive, target_next_week FROM {t}
UNION ALL SELECT *, 'moving_avg_4', pred_moving_avg_4, target_next_week FROM {t}"""
cte("cv_rows", "SELECT b.*, c.fold_id FROM base b JOIN cal c USING (week) WHERE NOT c.is_holdout")
cte("cv_preds", _baselines("cv_rows"))
cte("cv_ledger", f"SELECT * FROM ({_LONG.format(t='cv_preds')}) WHERE fold_id > 0")
cte("hold_preds", f"""
SELECT p.*, c.is_holdout, p.week + 7 AS label_week, p.week + 13 <= (SELECT max(date) FROM daily) AS label_complete
FROM ({_baselines('labelled')}) p JOIN cal c USING (week)""")
cte("hold_ledger", f"SELECT * FROM ({_LONG.format(t='hold_preds')}) WHERE is_holdout")


def metrics_sql(a: str = "actual", p: str = "prediction") -> str:
    return (f"avg(abs({a} - {p})) AS MAE, sqrt(avg(({a} - {p}) * ({a} - {p}))) AS RMSE, "
            f"sum(abs({a} - {p})) / nullif(sum(CASE WHEN {p} IS NOT NULL THEN abs({a}) END), 0) AS WAPE, "
            f"avg(2 * abs({a} - {p}) / (abs({a}) + abs({p}) + 1e-8)) AS SMAPE")


POOLED_SQL = (f"count(prediction) AS n_scored, count(prediction) / count(*) AS coverage, {metrics_sql()}, "
              "(sum(prediction) - sum(CASE WHEN prediction IS NOT NULL THEN actual END)) "
              "/ nullif(sum(CASE WHEN prediction IS NOT NULL THEN actual END), 0) AS bias")
POOLED_SPEC = f"model_id:s n_scored:i coverage:f {METRIC_SPEC} bias:f"


def base_table(spark, sf):
    """Trimmed weekly panel, materialised: the fold calendar and the rows both read it."""
    return cut_lineage(rollup.labelled_weeks(tables.sales_daily(spark, sf)))


def calendar(base):
    return splits.fold_calendar(base, **SPLIT)


def cv_ledger(spark, sf):
    base = base_table(spark, sf)
    return ledger.cv_baseline_ledger(base, calendar(base))


def holdout_ledger(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    base = cut_lineage(rollup.labelled_weeks(daily))
    labelled = features.attach_static_attrs(base, daily)
    last = daily.agg(F.max("date")).scalar()
    return ledger.holdout_baseline_ledger(labelled, calendar(base), last, ["category"])


@query("sorted_weeks", "SELECT week, week_idx FROM cal", "week:d week_idx:i")
def sorted_weeks(spark, sf):
    return splits.sorted_weeks(rollup.labelled_weeks(tables.sales_daily(spark, sf)))


@query("walk_forward_folds", """
SELECT fold_id, role, week FROM folds UNION ALL SELECT 0, 'test', week FROM cal WHERE is_holdout""",
       "fold_id:i role:s week:d")
def walk_forward_folds(spark, sf):
    cal = calendar(base_table(spark, sf))
    test = cal.filter("is_holdout").select(F.lit(0).alias("fold_id"), F.lit("test").alias("role"), "week")
    return splits.walk_forward_folds(cal).unionByName(test)


@query("fold_rows", """
SELECT fold_id, role, sku, channel, region, count(*) AS n_rows, sum(target_next_week) AS total_target
FROM base JOIN folds USING (week) GROUP BY ALL""",
       "fold_id:i role:s sku:s channel:s region:s n_rows:i total_target:f")
def fold_rows(spark, sf):
    base = base_table(spark, sf)
    return splits.fold_rows(base, calendar(base)).groupBy("fold_id", "role", *SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(LABEL).alias("total_target"))


@query("final_test_split", """
SELECT sku, channel, region, week, CASE WHEN is_holdout THEN 'test' ELSE 'cv' END AS side FROM base JOIN cal USING (week)""",
       KEY_SPEC + " side:s")
def final_test_split(spark, sf):
    base = base_table(spark, sf)
    return splits.final_test_split(base, calendar(base)).select(*WEEK_KEYS, "side")


@query("holdout_split", """
SELECT CASE WHEN is_holdout THEN 'test' ELSE 'cv' END AS side, count(*) AS n_rows, min(week) AS first_week, max(week) AS last_week
FROM base JOIN cal USING (week) GROUP BY ALL""", "side:s n_rows:i first_week:d last_week:d")
def holdout_split(spark, sf):
    base = base_table(spark, sf)
    return splits.final_test_split(base, calendar(base)).groupBy("side").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))


@query("fold_summary", """
SELECT fold_id, role, n_rows, n_weeks, first_week, last_week,
       max(last_week) FILTER (role = 'train') OVER (PARTITION BY fold_id)
         < min(first_week) FILTER (role = 'val') OVER (PARTITION BY fold_id) AS ordered
FROM (SELECT fold_id, role, count(*) AS n_rows, count(DISTINCT week) AS n_weeks, min(week) AS first_week, max(week) AS last_week
      FROM base JOIN folds USING (week) GROUP BY ALL)""",
       "fold_id:i role:s n_rows:i n_weeks:i first_week:d last_week:d ordered:b")
def fold_summary(spark, sf):
    base = base_table(spark, sf)
    return splits.fold_summary(base, calendar(base))


@query("exclude_keys", "SELECT sku, channel, region, week FROM base ANTI JOIN (SELECT * FROM cal WHERE is_holdout) h USING (week)",
       KEY_SPEC)
def exclude_keys(spark, sf):
    base = base_table(spark, sf)
    holdout = calendar(base).filter("is_holdout").select("week")
    return base.join(F.broadcast(holdout), "week", "left_anti").select(*WEEK_KEYS)


@query("restrict_to_keys", """
SELECT sku, channel, region, date, units_sold FROM daily d
WHERE EXISTS (SELECT 1 FROM base b WHERE (b.sku, b.channel, b.region) = (d.sku, d.channel, d.region)
              AND b.week = CAST(date_trunc('week', d.date) AS DATE))""", "sku:s channel:s region:s date:d units_sold:f")
def restrict_to_keys(spark, sf):
    daily = tables.sales_daily(spark, sf)
    keys = rollup.labelled_weeks(daily).select(*WEEK_KEYS)
    return (daily.withColumn("week", F.trunc("date", "week")).join(keys, WEEK_KEYS, "left_semi")
            .select(*SERIES, "date", "units_sold"))


for _name, _col in (("naive", "pred_naive"), ("seasonal_naive", "pred_seasonal_naive"),
                    ("moving_average", "pred_moving_avg_4")):
    @query(_name, f"SELECT sku, channel, region, week, {_col} AS prediction FROM cv_preds", KEY_SPEC + " prediction:f")
    def _baseline(spark, sf, _col=_col):
        base = base_table(spark, sf)
        cv = splits.attach_folds(base, calendar(base)).filter(~F.col("is_holdout"))
        return ledger.add_baseline_predictions(cv).select(*WEEK_KEYS, F.col(_col).alias("prediction"))


@query("baseline_predictions", f"SELECT * FROM ({_baselines('base')})",
       KEY_SPEC + " units_sold:f pred_naive:f pred_seasonal_naive:f pred_moving_avg_4:f")
def baseline_predictions(spark, sf):
    return ledger.add_baseline_predictions(rollup.labelled_weeks(tables.sales_daily(spark, sf)).select(*WEEK_KEYS, "units_sold"))


@query("build_ledger", "SELECT * FROM hold_ledger",
       KEY_SPEC + " category:s label_week:d label_complete:b actual:f model_id:s prediction:f")
def build_ledger(spark, sf):
    return holdout_ledger(spark, sf)


@query("cv_baseline_ledger", "SELECT * FROM cv_ledger", KEY_SPEC + " fold_id:i actual:f model_id:s prediction:f")
def cv_baseline_ledger(spark, sf):
    return cv_ledger(spark, sf)


@query("label_complete", "SELECT DISTINCT week, label_complete FROM hold_preds", "week:d label_complete:b")
def label_complete(spark, sf):
    daily = tables.sales_daily(spark, sf)
    last = daily.agg(F.max("date")).scalar()
    return rollup.labelled_weeks(daily).select("week").distinct().select(
        "week", ledger.label_complete("week", last).alias("label_complete"))


@query("label_audit", """
SELECT week, label_week, date_diff('day', label_week, least(label_week + 6, hi)) + 1 AS days_observed, label_complete, total_target
FROM (SELECT week, label_week, label_complete, sum(target_next_week) AS total_target FROM hold_preds WHERE is_holdout GROUP BY ALL),
     (SELECT max(date) AS hi FROM daily)""", "week:d label_week:d days_observed:i label_complete:b total_target:f")
def label_audit(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    base = cut_lineage(rollup.labelled_weeks(daily))
    last = daily.agg(F.max("date")).scalar()
    holdout = splits.attach_folds(base, calendar(base)).filter("is_holdout")
    return holdout.groupBy("week").agg(F.sum(LABEL).alias("total_target")).select(
        "week", F.date_add("week", 7).alias("label_week"),
        (F.datediff(F.least(F.date_add("week", 13), last), F.date_add("week", 7)) + 1).alias("days_observed"),
        ledger.label_complete("week", last).alias("label_complete"), "total_target")


@query("finite_predictions", "SELECT sku, channel, region, week, fold_id, model_id, prediction FROM cv_ledger WHERE prediction IS NOT NULL",
       KEY_SPEC + " fold_id:i model_id:s prediction:f")
def finite_predictions(spark, sf):
    return ledger.finite_only(cv_ledger(spark, sf)).select(*WEEK_KEYS, "fold_id", "model_id", "prediction")


@query("floor_predictions", """
SELECT sku, channel, region, week, fold_id, model_id, greatest(prediction, 0) AS prediction FROM cv_ledger
WHERE prediction IS NOT NULL""", KEY_SPEC + " fold_id:i model_id:s prediction:f")
def floor_predictions(spark, sf):
    return ledger.floor_predictions(ledger.finite_only(cv_ledger(spark, sf))).drop("actual")


@query("negative_prediction_audit", """
SELECT model_id, fold_id, count(*) FILTER (prediction < 0) AS n_negative,
       count(*) FILTER (prediction < 0) / nullif(count(prediction), 0) AS negative_share, min(prediction) AS min_prediction
FROM cv_ledger GROUP BY ALL""", "model_id:s fold_id:i n_negative:i negative_share:f min_prediction:f")
def negative_prediction_audit(spark, sf):
    return ledger.negative_audit(cv_ledger(spark, sf))


@query("key_parity_join", """
SELECT model_id, n AS n_both, (SELECT count(*) FROM cv_rows WHERE fold_id > 0) - n AS n_gold_only, 0 AS n_pred_only
FROM (SELECT model_id, count(*) AS n FROM cv_ledger WHERE prediction IS NOT NULL GROUP BY model_id)""",
       "model_id:s n_both:i n_gold_only:i n_pred_only:i")
def key_parity_join(spark, sf):
    base = base_table(spark, sf)
    long = ledger.cv_baseline_ledger(base, calendar(base))
    models = F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model_id")
    gold = splits.attach_folds(base, calendar(base)).filter(~F.col("is_holdout") & (F.col("fold_id") > 0))
    return ledger.key_parity(gold.select(models, *WEEK_KEYS), ledger.finite_only(long), WEEK_KEYS, ["model_id"])


@query("score_metrics", f"SELECT {metrics_sql()} FROM cv_ledger WHERE prediction IS NOT NULL", METRIC_SPEC)
def score_metrics(spark, sf):
    from tidepanel.functions.numeric import forecast_metrics, named
    return ledger.finite_only(cv_ledger(spark, sf)).agg(*named(forecast_metrics("actual", "prediction")))


@query("score_ledger_pooled", f"SELECT model_id, {POOLED_SQL} FROM hold_ledger WHERE label_complete GROUP BY model_id", POOLED_SPEC)
def score_ledger_pooled(spark, sf):
    return ledger.score_ledger(holdout_ledger(spark, sf).filter("label_complete"))


@query("score_ledger_by_category", f"SELECT model_id, category, {POOLED_SQL} FROM hold_ledger GROUP BY ALL",
       POOLED_SPEC + " category:s")
def score_ledger_by_category(spark, sf):
    return ledger.score_ledger(holdout_ledger(spark, sf), ["category"])


cte("fold_scored", f"""
SELECT model_id, fold_id, count(*) AS n_eligible, count(prediction) AS n_scored, count(prediction) / count(*) AS coverage,
       {metrics_sql()},
       sum(CASE WHEN prediction IS NOT NULL THEN CAST(('0x' || substr(md5(concat_ws('|', fold_id, sku, channel, region, week)), 1, 8)) AS BIGINT) END)
         AS cohort_part
FROM cv_ledger GROUP BY ALL
""")
cte("macro", """
SELECT *, n_scored / n_eligible AS coverage,
       CASE WHEN count(*) OVER (PARTITION BY cohort_hash) > 1 AND WAPE IS NOT NULL
            THEN rank() OVER (PARTITION BY cohort_hash ORDER BY WAPE NULLS LAST) END AS rank
FROM (SELECT model_id, count(*) AS n_folds, sum(n_eligible) AS n_eligible, sum(n_scored) AS n_scored, sum(cohort_part) AS cohort_hash,
        CASE WHEN count(MAE) = count(*) THEN avg(MAE) END AS MAE, CASE WHEN count(RMSE) = count(*) THEN avg(RMSE) END AS RMSE,
        CASE WHEN count(WAPE) = count(*) THEN avg(WAPE) END AS WAPE, CASE WHEN count(SMAPE) = count(*) THEN avg(SMAPE) END AS SMAPE,
        CASE WHEN count(WAPE) = count(*) THEN stddev_samp(WAPE) END AS WAPE_std
      FROM fold_scored GROUP BY model_id)
""")
MACRO_SPEC = (f"model_id:s n_folds:i n_eligible:i n_scored:i coverage:f cohort_hash:d {METRIC_SPEC} WAPE_std:f rank:f")


@query("fold_scores", "SELECT * FROM fold_scored",
       f"model_id:s fold_id:i n_eligible:i n_scored:i coverage:f {METRIC_SPEC} cohort_part:d")
def fold_scores(spark, sf):
    return ledger.fold_scores(cv_ledger(spark, sf))


@query("score_ledger_macro", """
SELECT m.*, m.WAPE - r.WAPE AS delta_WAPE FROM macro m LEFT JOIN (SELECT * FROM macro WHERE model_id = 'naive') r USING (cohort_hash)
""", MACRO_SPEC + " delta_WAPE:f")
def score_ledger_macro(spark, sf):
    return ledger.add_delta(ledger.macro_scores(cv_ledger(spark, sf)), "naive")


@query("baseline_scoreboard", "SELECT model_id, MAE, RMSE, WAPE, SMAPE FROM macro", f"model_id:s {METRIC_SPEC}")
def baseline_scoreboard(spark, sf):
    return ledger.macro_scores(cv_ledger(spark, sf)).select("model_id", *ledger.METRICS)


@query("model_rank", "SELECT model_id, cohort_hash, WAPE, rank FROM macro", "model_id:s cohort_hash:d WAPE:f rank:f")
def model_rank(spark, sf):
    return ledger.macro_scores(cv_ledger(spark, sf)).select("model_id", "cohort_hash", "WAPE", "rank")


@query("cohort_hash", "SELECT model_id, sum(n_scored) AS n_scored, sum(cohort_part) AS cohort_hash FROM fold_scored GROUP BY model_id",
       "model_id:s n_scored:i cohort_hash:d")
def cohort_hash(spark, sf):
    return ledger.cohort_hash(cv_ledger(spark, sf))


_COMMON = """
SELECT sku, channel, region, week, fold_id FROM cv_ledger WHERE model_id = 'naive' AND prediction IS NOT NULL
INTERSECT SELECT sku, channel, region, week, fold_id FROM cv_ledger WHERE model_id = 'seasonal_naive' AND prediction IS NOT NULL
INTERSECT SELECT sku, channel, region, week, fold_id FROM cv_ledger WHERE model_id = 'moving_avg_4' AND prediction IS NOT NULL"""


@query("common_keys", _COMMON, KEY_SPEC + " fold_id:i")
def common_keys(spark, sf):
    return ledger.common_keys(cv_ledger(spark, sf), len(MODELS))


@query("common_cohort_scores", f"""
SELECT model_id, fold_id, count(*) AS n_scored, {metrics_sql()}
FROM cv_ledger JOIN ({_COMMON}) k USING (sku, channel, region, week, fold_id) GROUP BY ALL""",
       f"model_id:s fold_id:i n_scored:i {METRIC_SPEC}")
def common_cohort_scores(spark, sf):
    return ledger.fold_scores(ledger.common_cohort(cv_ledger(spark, sf), len(MODELS))).select(
        "model_id", "fold_id", "n_scored", *ledger.METRICS)


@query("pivot_scores", f"""
SELECT week, max(WAPE) FILTER (model_id = 'naive') AS naive, max(WAPE) FILTER (model_id = 'seasonal_naive') AS seasonal_naive,
       max(WAPE) FILTER (model_id = 'moving_avg_4') AS moving_avg_4
FROM (SELECT model_id, week, {metrics_sql()} FROM hold_ledger GROUP BY ALL) GROUP BY week""",
       "week:d naive:f seasonal_naive:f moving_avg_4:f")
def pivot_scores(spark, sf):
    return ledger.pivot_scores(ledger.score_ledger(holdout_ledger(spark, sf), ["week"]), "week", MODELS)


@query("weekly_error_totals", """
SELECT week + 7 AS target_week, model_id, sum(CASE WHEN prediction IS NOT NULL THEN actual END) AS actual_total,
       sum(abs(prediction - actual)) AS abs_error FROM cv_ledger GROUP BY ALL""",
       "target_week:d model_id:s actual_total:f abs_error:f")
def weekly_error_totals(spark, sf):
    return ledger.weekly_error_totals(cv_ledger(spark, sf))


@query("ledger_validation", """
SELECT c AS check_, n = 0 AS passed, n AS n_failures, n || ' row(s)' AS detail FROM (
 SELECT 'unique prediction keys' AS c, count(*) - count(DISTINCT (model_id, fold_id, sku, channel, region, week)) AS n FROM cv_ledger
 UNION ALL SELECT 'no holdout weeks', count(*) FROM cv_ledger JOIN cal USING (week) WHERE is_holdout
 UNION ALL SELECT 'weeks inside their fold', count(*) FROM cv_ledger l JOIN cal c USING (week) WHERE l.fold_id <> c.fold_id
 UNION ALL SELECT 'expected models', 3 - count(DISTINCT model_id) FROM cv_ledger
 UNION ALL SELECT 'expected folds', (SELECT max(n_folds) FROM cal) - count(DISTINCT fold_id) FROM cv_ledger
 UNION ALL SELECT 'complete validation weeks', (SELECT count(*) FROM cal WHERE fold_id > 0) - count(DISTINCT week) FROM cv_ledger
 UNION ALL SELECT 'identical keys and actuals across models', count(*) FROM (
   SELECT count(DISTINCT model_id) AS m, count(DISTINCT actual) AS a FROM cv_ledger GROUP BY fold_id, sku, channel, region, week)
   WHERE m <> 3 OR a <> 1)""", "check_:s passed:b n_failures:i detail:s")
def ledger_validation(spark, sf):
    base = base_table(spark, sf)
    cal = calendar(base)
    return ledger.validate_ledger(cut_lineage(ledger.cv_baseline_ledger(base, cal)), cal, MODELS).withColumnRenamed("check", "check_")


@query("set_equality_checks", """
SELECT 'models' AS what, 3 AS n_expected, count(DISTINCT model_id) AS n_found, 3 - count(DISTINCT model_id) AS n_different FROM cv_ledger
UNION ALL SELECT 'folds', (SELECT max(n_folds) FROM cal), count(DISTINCT fold_id), (SELECT max(n_folds) FROM cal) - count(DISTINCT fold_id)
FROM cv_ledger""", "what:s n_expected:i n_found:i n_different:i")
def set_equality_checks(spark, sf):
    base = base_table(spark, sf)
    cal = calendar(base)
    long = cut_lineage(ledger.cv_baseline_ledger(base, cal))
    models = spark.createDataFrame([(m,) for m in MODELS], "v string")
    expected = {"models": models, "folds": splits.walk_forward_folds(cal).select(F.col("fold_id").alias("v")).distinct()}
    found = {"models": long.select(F.col("model_id").alias("v")).distinct(),
             "folds": long.select(F.col("fold_id").alias("v")).distinct()}
    out = None
    for what in expected:
        part = ledger.set_difference(expected[what], found[what], "v").select(
            F.lit(what).alias("what"), expected[what].agg(F.count(F.lit(1))).scalar().alias("n_expected"),
            found[what].agg(F.count(F.lit(1))).scalar().alias("n_found"), F.col("bad").alias("n_different"))
        out = part if out is None else out.unionByName(part)
    return out


@query("truncated_label_sensitivity", f"""
SELECT scope, model_id, {POOLED_SQL} FROM (
  SELECT 'truncated origins' AS scope, * FROM hold_ledger WHERE NOT label_complete
  UNION ALL SELECT 'all origins', * FROM hold_ledger
  UNION ALL SELECT 'complete origins', * FROM hold_ledger WHERE label_complete) GROUP BY scope, model_id""",
       "scope:s " + POOLED_SPEC)
def truncated_label_sensitivity(spark, sf):
    own = F.when(F.col("label_complete"), "complete origins").otherwise("truncated origins")
    scoped = holdout_ledger(spark, sf).withColumn("scope", F.explode(F.array(F.lit("all origins"), own)))
    return ledger.score_ledger(scoped, ["scope"])


@query("extrapolation_audit", """
SELECT (SELECT max(target_next_week) FROM hold_preds WHERE NOT is_holdout) AS largest_training_label,
       (SELECT min(actual) FROM hold_ledger WHERE label_complete) AS smallest_new_label,
       (SELECT max(prediction) FROM hold_ledger WHERE label_complete) AS largest_forecast""",
       "largest_training_label:f smallest_new_label:f largest_forecast:f")
def extrapolation_audit(spark, sf):
    base = base_table(spark, sf)
    train = splits.attach_folds(base, calendar(base)).filter(~F.col("is_holdout"))
    new = holdout_ledger(spark, sf).filter("label_complete")
    return new.agg(F.min("actual").alias("smallest_new_label"), F.max("prediction").alias("largest_forecast")).withColumn(
        "largest_training_label", train.agg(F.max(LABEL)).scalar())


@query("top_series", "SELECT sku, channel, region, sum(units_sold) AS units FROM base GROUP BY ALL ORDER BY units DESC, sku, channel, region LIMIT 5",
       "sku:s channel:s region:s units:f")
def top_series(spark, sf):
    return rollup.labelled_weeks(tables.sales_daily(spark, sf)).groupBy(*SERIES).agg(F.sum("units_sold").alias("units")).orderBy(
        F.desc("units"), *SERIES).limit(5)
