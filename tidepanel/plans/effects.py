"""Promotion effects, paired tests and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.hashing import POISSON_BOUNDS
from tidepanel.operators import causal, features, ledger, resample, rollup, stats
from tidepanel.plans import launches, scoring
from tidepanel.plans.oracle_base import cte
from tidepanel.plans.registry import query
from tidepanel.schema import SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage
from tidepanel.sources import tables

LAGS, LEADS = 4, 2


def _panel(spark, sf):
    return cut_lineage(causal.group_panel(rollup.labelled_weeks(tables.sales_daily(spark, sf))))


cte("panel", """
SELECT *, dense_rank() OVER (ORDER BY group_label) AS group_id, dense_rank() OVER (ORDER BY sku) AS cluster_id,
       dense_rank() OVER (ORDER BY week) - 1 AS time_id, ln(1 + units_sold) AS log_units
FROM (SELECT *, sku || '|' || channel || '|' || region AS group_label FROM labelled)
""")


@query("panel_ids", "SELECT sku, channel, region, week, group_label, group_id, cluster_id, time_id, log_units FROM panel",
       "sku:s channel:s region:s week:d group_label:s group_id:i cluster_id:i time_id:i log_units:f")
def panel_ids(spark, sf):
    return _panel(spark, sf).select(*WEEK_KEYS, "group_label", "group_id", "cluster_id", "time_id", "log_units")


_LAG_TERMS = [f"promo_lag_{k}" for k in range(1, LAGS + 1)]
_LEAD_TERMS = [f"promo_lead_{k}" for k in range(1, LEADS + 1)]
_TERMS = ["promo_current"] + _LAG_TERMS + _LEAD_TERMS
cte("lead_lags", f"""
SELECT * FROM (SELECT group_id, time_id, sku, log_units, price_unit, CAST(promotion_flag AS DOUBLE) AS promo_current,
  {', '.join(f'CAST(lag(promotion_flag, {k}) OVER g AS DOUBLE) AS promo_lag_{k}' for k in range(1, LAGS + 1))},
  {', '.join(f'CAST(lead(promotion_flag, {k}) OVER g AS DOUBLE) AS promo_lead_{k}' for k in range(1, LEADS + 1))}
  FROM panel WINDOW g AS (PARTITION BY group_id ORDER BY time_id))
WHERE {' AND '.join(f'{t} IS NOT NULL' for t in _TERMS)}
""")


@query("promo_leads_lags", f"SELECT group_id, time_id, {', '.join(_TERMS)} FROM lead_lags",
       "group_id:i time_id:i " + " ".join(f"{t}:f" for t in _TERMS))
def promo_leads_lags(spark, sf):
    design, terms = causal.lead_lag_panel(_panel(spark, sf), LAGS, LEADS)
    return design.select("group_id", "time_id", *terms)


# ---------------------------------------------------------------- SQL for two-way regressions
# Effects are removed by alternating demeaning in a recursive query, regressors by successive projection; both
# differ from the operators, which solve the period system and the normal equations.

STEPS = 40


def demeaned(name: str, source: str, by: str, entity: str, time: str, cluster: str, cols: dict[str, str], keep: str = "") -> None:
    extra = f", {keep}" if keep else ""
    first = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in cols.items())
    inner = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY b, e) AS {c}" for c in cols)
    outer = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY b, t) AS {c}" for c in cols)
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    cte(name, f"""
SELECT b, e, t, g{extra}, {', '.join(cols)} FROM (
  WITH RECURSIVE r AS (
    SELECT * FROM (SELECT 0 AS it, {by} AS b, {entity} AS e, {time} AS t, {cluster} AS g{extra}, {first} FROM {source}) WHERE {not_null}
    UNION ALL
    SELECT it, b, e, t, g{extra}, {outer} FROM (SELECT it + 1 AS it, b, e, t, g{extra}, {inner} FROM r WHERE it < {STEPS}))
  SELECT * FROM r WHERE it = {STEPS})""")


def projected(prefix: str, source: str, order: list[str], y: str, keep: str = "") -> str:
    """Chain of CTEs that removes all but the last regressor; returns the name of the last one."""
    extra = f", {keep}" if keep else ""
    current = source
    for i, control in enumerate(order[:-1]):
        rest = order[i + 1:] + [y]
        step = f"{prefix}_{i}"
        cte(step, "SELECT b, e, t, g" + extra + ", " + ", ".join(
            f"{v} - {control} * (sum({control} * {v}) OVER (PARTITION BY b) / sum({control} * {control}) OVER (PARTITION BY b)) AS {v}"
            for v in rest) + f" FROM {current}")
        current = step
    return current


def estimate(source: str, target: str, y: str, k: int) -> str:
    return f"""
SELECT c.b, c.coef, sqrt(c.n / (c.n - {k} - (c.ne + c.nt - 1)) * m.meat) / c.dd AS se, c.n AS n_obs, c.ng
FROM (SELECT b, sum({target} * {y}) / sum({target} * {target}) AS coef, sum({target} * {target}) AS dd, count(*) AS n,
             count(DISTINCT e) AS ne, count(DISTINCT t) AS nt, count(DISTINCT g) AS ng FROM {source} GROUP BY b) c
JOIN (SELECT b, sum(s * s) AS meat FROM (
        SELECT f.b, f.g, sum({target} * ({y} - coef * {target})) AS s
        FROM {source} f JOIN (SELECT b, sum({target} * {y}) / sum({target} * {target}) AS coef FROM {source} GROUP BY b) z ON f.b = z.b
        GROUP BY f.b, f.g) GROUP BY b) m ON c.b = m.b"""


_DESIGN = {"y": "log_units", "ch": "channel = 'Industrial'", "r1": "region = 'AMERICA'", "r2": "region = 'ASIA'",
           "r3": "region = 'EUROPE'", "r4": "region = 'MIDDLE EAST'", "price": "price_unit", "d": "promotion_flag"}
demeaned("twfe_all", "panel", "'all'", "sku", "week", "sku", _DESIGN)
demeaned("twfe_cat", "panel", "category", "sku", "week", "sku", _DESIGN)
_ALL = projected("twfe_all_p", "twfe_all", [c for c in _DESIGN if c != "y"], "y")
_CAT = projected("twfe_cat_p", "twfe_cat", [c for c in _DESIGN if c != "y"], "y")
demeaned("twfe_group", "panel", "'all'", "group_id", "time_id", "sku",
         {"y": "log_units", "price": "price_unit", "d": "promotion_flag"}, keep="promotion_flag, log_units")
_GROUP = projected("twfe_group_p", "twfe_group", ["price", "d"], "y", keep="promotion_flag, log_units")


def _effect_panel(spark, sf):
    daily = cut_lineage(tables.sales_daily(spark, sf))
    return cut_lineage(features.attach_static_attrs(rollup.labelled_weeks(daily), daily))


@query("twfe_promotion_effect", f"""
SELECT b AS scope, ng AS n_sku, n_obs, 100 * (exp(coef) - 1) AS uplift_pct, coef, se FROM ({estimate(_ALL, 'd', 'y', 7)})""",
       "scope:s n_sku:i n_obs:i uplift_pct:f coef:f se:f")
def twfe_promotion_effect(spark, sf):
    fits = causal.promotion_effect(_effect_panel(spark, sf), strict=False)
    return causal.uplift_table(spark, fits).select("scope", "n_sku", "n_obs", "uplift_pct", "coef", "se")


@query("uplift_summary")
def uplift_summary(spark, sf):
    return causal.uplift_table(spark, causal.promotion_effect(_effect_panel(spark, sf), strict=False)).select(
        "uplift_pct", "ci_low_pct", "ci_high_pct", "p_value", "n_obs")


@query("twfe_by_category", f"""
SELECT b AS category, ng AS n_sku, n_obs, 100 * (exp(coef) - 1) AS uplift_pct, coef, se FROM ({estimate(_CAT, 'd', 'y', 7)})""",
       "category:s n_sku:i n_obs:i uplift_pct:f coef:f se:f")
def twfe_by_category(spark, sf):
    fits = causal.promotion_effect(_effect_panel(spark, sf), by="category")
    return causal.uplift_table(spark, fits, "category").select("category", "n_sku", "n_obs", "uplift_pct", "coef", "se")


@query("parity_twfe", f"SELECT 'promotion_flag' AS term, coef, se, n_obs FROM ({estimate(_GROUP, 'd', 'y', 2)})",
       "term:s coef:f se:f n_obs:i")
def parity_twfe(spark, sf):
    fit = causal.parity_twfe(_panel(spark, sf), strict=False)
    return causal.fit_table(spark, fit).filter("term = 'promotion_flag'").select(
        "term", "coef", "se", F.lit(fit.n_obs).cast("bigint").alias("n_obs"))


@query("twfe_weights", f"""
SELECT count(*) AS n_obs, count(*) FILTER (promotion_flag = 1) AS n_treated_cells,
       count(*) FILTER (promotion_flag = 1 AND w > 0) AS n_positive_weights,
       count(*) FILTER (promotion_flag = 1 AND w < 0) AS n_negative_weights,
       100 * count(*) FILTER (promotion_flag = 1 AND w < 0) / count(*) FILTER (promotion_flag = 1) AS negative_weight_pct,
       coalesce(sum(w) FILTER (promotion_flag = 1 AND w > 0), 0) AS sum_positive_weights,
       coalesce(sum(w) FILTER (promotion_flag = 1 AND w < 0), 0) AS sum_negative_weights,
       sum(w) FILTER (promotion_flag = 1) AS sum_weights, min(w) FILTER (promotion_flag = 1) AS min_weight,
       max(w) FILTER (promotion_flag = 1) AS max_weight, sum(w * log_units) AS reconstructed_twfe_coef
FROM (SELECT *, d / (SELECT sum(d * promotion_flag) FROM {_GROUP}) AS w FROM {_GROUP})""",
       "n_obs:i n_treated_cells:i n_positive_weights:i n_negative_weights:i negative_weight_pct:f sum_positive_weights:f "
       "sum_negative_weights:f sum_weights:f min_weight:f max_weight:f reconstructed_twfe_coef:f")
def twfe_weights(spark, sf):
    return causal.weight_summary(cut_lineage(causal.twfe_weights(_panel(spark, sf))))


def _lag_chains() -> str:
    demeaned("lag_all", "lead_lags", "'all'", "group_id", "time_id", "sku", {"y": "log_units", **{t: t for t in _TERMS}})
    parts = []
    for t in _TERMS:
        last = projected(f"lag_{t}", "lag_all", [x for x in _TERMS if x != t] + [t], "y")
        parts.append(f"SELECT '{t}' AS term, coef, se FROM ({estimate(last, t, 'y', len(_TERMS))})")
    # With the other lags entered as differences to lag 1, the coefficient of lag 1 is the sum over the lags.
    cte("lag_sum_design", "SELECT b, e, t, g, y, promo_current, promo_lead_1, promo_lead_2, promo_lag_1, "
        + ", ".join(f"{t} - promo_lag_1 AS {t}" for t in _LAG_TERMS[1:]) + " FROM lag_all")
    last = projected("lag_sum", "lag_sum_design", [x for x in _TERMS if x != "promo_lag_1"] + ["promo_lag_1"], "y")
    parts.append(f"SELECT 'lag_sum' AS term, coef, se FROM ({estimate(last, 'promo_lag_1', 'y', len(_TERMS))})")
    return "\nUNION ALL\n".join(parts)


@query("distributed_lag", _lag_chains(), "term:s coef:f se:f")
def distributed_lag(spark, sf):
    fit = causal.distributed_lag(_panel(spark, sf), LAGS, LEADS, strict=False)
    return causal.distributed_lag_table(spark, fit, LAGS).select("term", "coef", "se")


@query("distributed_lag_tests")
def distributed_lag_tests(spark, sf):
    return causal.distributed_lag_tests(spark, causal.distributed_lag(_panel(spark, sf), LAGS, LEADS, strict=False), LAGS, LEADS)


# ---------------------------------------------------------------- switchers

cte("moves", """
SELECT *, CASE WHEN promotion_flag <> d_prev THEN 1 ELSE 0 END AS switched FROM (
  SELECT a.group_id, a.time_id, a.sku, a.promotion_flag, b.promotion_flag AS d_prev, a.log_units - b.log_units AS dy
  FROM panel a JOIN panel b ON a.group_id = b.group_id AND b.time_id = a.time_id - 1)
""")


@query("consecutive_period_join", "SELECT group_id, time_id, promotion_flag, d_prev, dy, switched FROM moves",
       "group_id:i time_id:i promotion_flag:i d_prev:i dy:f switched:i")
def consecutive_period_join(spark, sf):
    return causal.consecutive_periods(_panel(spark, sf)).select(
        "group_id", "time_id", "promotion_flag", "d_prev", "dy", "switched")


def _was_sql(source: str, by: str = "", weight: str = "1.0") -> str:
    sep = f"{by}, " if by else ""
    return f"""
SELECT {sep}specification, sum(e) / sum(ns) AS log_coef, sum(ns) AS switchers, sum(nt) AS stayers FROM (
  SELECT {sep}unnest(['all', CASE WHEN d_prev = 0 THEN 'switch_in' ELSE 'switch_out' END]) AS specification, ns, nt,
         CASE WHEN d_prev = 0 THEN 1 ELSE -1 END * (ys - ns * yt / nt) AS e
  FROM (SELECT {sep}time_id, d_prev, sum({weight}) FILTER (switched = 1) AS ns, sum({weight} * dy) FILTER (switched = 1) AS ys,
               sum({weight}) FILTER (switched = 0) AS nt, sum({weight} * dy) FILTER (switched = 0) AS yt
        FROM {source} GROUP BY {sep}time_id, d_prev) WHERE ns > 0 AND nt > 0) GROUP BY {sep}specification"""


@query("was_exact_match", f"SELECT *, 100 * (exp(log_coef) - 1) AS uplift_pct FROM ({_was_sql('moves')})",
       "specification:s log_coef:f switchers:i stayers:i uplift_pct:f")
def was_exact_match(spark, sf):
    return causal.was_exact_match(_panel(spark, sf))


def _draws(n: str, reps: int, positions: str, index: str) -> str:
    return f"""SELECT r.rep, {index} AS idx FROM (SELECT unnest(generate_series(1, {reps})) AS rep) r,
               (SELECT unnest(generate_series(0, ({n}) - 1)) AS j) p"""


def _hash(seed: int, *parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(parts)})), 1, 8)) AS BIGINT)"


def _weight(seed: int, *parts: str) -> str:
    """Poisson weight of mean 1 by the md5 of the parts."""
    steps = " ".join(f"WHEN h < '{bound}' THEN {k}" for k, bound in enumerate(POISSON_BOUNDS))
    return f"(SELECT CASE {steps} ELSE {len(POISSON_BOUNDS)} END::DOUBLE FROM (SELECT md5(concat_ws('|', {seed}, {', '.join(parts)})) AS h))"


def _weighted(source: str, reps: int, *keys: str) -> str:
    return f"""SELECT * FROM (SELECT s.*, rep, {_weight(42, 'rep', *keys)} AS w
               FROM {source} s, (SELECT unnest(generate_series(1, {reps})) AS rep)) WHERE w > 0"""


cte("was_draws", _weighted("(SELECT DISTINCT sku FROM moves)", 200, "sku"))


@query("was_bootstrap", f"""
SELECT specification, stddev_samp(log_coef) AS se, quantile_cont(log_coef, 0.025) AS ci_low, quantile_cont(log_coef, 0.975) AS ci_high,
       count(log_coef) AS reps FROM ({_was_sql('(SELECT * FROM moves JOIN was_draws USING (sku))', 'rep', 'w')}) GROUP BY specification""",
       "specification:s se:f ci_low:f ci_high:f reps:i")
def was_bootstrap(spark, sf):
    return causal.was_bootstrap(_panel(spark, sf), reps=200, seed=42)


# ---------------------------------------------------------------- paired tests and bootstraps

cte("fold_diffs", """
SELECT 'naive' AS reference, b.model_id AS challenger, a.fold_id, a.WAPE - b.WAPE AS diff
FROM fold_scored a JOIN fold_scored b ON a.fold_id = b.fold_id AND a.model_id = 'naive' AND b.model_id <> 'naive'
""")
# Student tail for an even number of degrees of freedom (7 folds -> 6): finite series in theta.
cte("fold_tests", """
SELECT *, 1 - sin(th) * (1 + pow(cos(th), 2) / 2 + 3 * pow(cos(th), 4) / 8) AS p_value FROM (
  SELECT *, atan(abs(t_stat) / sqrt(n_folds - 1)) AS th FROM (
    SELECT reference, challenger, count(*) AS n_folds, count(*) FILTER (diff > 0) AS n_positive, avg(diff) AS mean_diff,
           avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t_stat, stddev_samp(diff) / sqrt(count(*)) AS se
    FROM fold_diffs GROUP BY ALL))
""")
cte("rank_tests", """
SELECT challenger, least(plus, n * (n + 1) / 2 - plus) AS w, n,
  (SELECT count(*) FROM (SELECT unnest(generate_series(0, 127)) AS m) s
   WHERE list_sum(list_transform(range(1, 8), lambda i: CASE WHEN (s.m >> CAST(i - 1 AS INTEGER)) & 1 = 1 THEN i ELSE 0 END))
         <= least(plus, n * (n + 1) / 2 - plus)) AS low
FROM (SELECT challenger, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS plus
      FROM (SELECT challenger, diff, row_number() OVER (PARTITION BY challenger ORDER BY abs(diff)) AS rk FROM fold_diffs) GROUP BY challenger)
""")


@query("paired_fold_tests", """
SELECT t.reference, t.challenger, t.n_folds, t.n_positive, t.mean_diff, t.t_stat, t.p_value,
       t.mean_diff - 2.4469118511449692 * t.se AS ci_low, t.mean_diff + 2.4469118511449692 * t.se AS ci_high,
       r.w AS wilcoxon_w, least(1.0, 2.0 * r.low / 128) AS wilcoxon_p,
       least(1.0, 2.0 * (SELECT sum(factorial(t.n_folds::INTEGER) / factorial(j::INTEGER) / factorial((t.n_folds - j)::INTEGER))
                         FROM (SELECT unnest(generate_series(0, 7)) AS j) WHERE j <= least(t.n_positive, t.n_folds - t.n_positive)) / 128) AS sign_p,
       h.p_holm, h.p_holm <= 0.05 AS significant
FROM fold_tests t JOIN rank_tests r USING (challenger) JOIN (
  SELECT challenger, least(1.0, max((m - k + 1) * p_value) OVER (ORDER BY k)) AS p_holm FROM (
    SELECT challenger, p_value, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m FROM fold_tests)) h USING (challenger)""",
       "reference:s challenger:s n_folds:i n_positive:i mean_diff:f t_stat:f p_value:f ci_low:f ci_high:f wilcoxon_w:f wilcoxon_p:f "
       "sign_p:f p_holm:f significant:b")
def paired_fold_tests(spark, sf):
    scores = ledger.fold_scores(scoring.cv_ledger(spark, sf))
    return stats.paired_fold_tests(scores, "naive", ["seasonal_naive", "moving_avg_4"])


cte("series_errors", """
SELECT sku, channel, region, sum(actual) AS actual, sum(ea) AS err_a, sum(eb) AS err_b FROM (
  SELECT sku, channel, region, week, max(actual) AS actual, max(abs(prediction - actual)) FILTER (model_id = 'moving_avg_4') AS ea,
         max(abs(prediction - actual)) FILTER (model_id = 'naive') AS eb FROM hold_ledger WHERE label_complete GROUP BY ALL)
GROUP BY sku, channel, region""")
cte("series_boot", f"""
SELECT rep, (sum(w * err_b) - sum(w * err_a)) / nullif(sum(w * actual), 0) AS diff
FROM ({_weighted('series_errors', 2000, 'sku', 'channel', 'region')}) GROUP BY rep""")


@query("cluster_bootstrap", """
SELECT 'moving_avg_4' AS model_a, 'naive' AS model_b, p.*, q.*, ci_low > 0 OR ci_high < 0 AS ci_excludes_0 FROM
 (SELECT sum(err_a) / sum(actual) AS WAPE_a, sum(err_b) / sum(actual) AS WAPE_b, (sum(err_b) - sum(err_a)) / sum(actual) AS diff_b_minus_a,
         count(*) AS n_series FROM series_errors) p,
 (SELECT quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high, count(diff) AS n_boot FROM series_boot) q""",
       "model_a:s model_b:s WAPE_a:f WAPE_b:f diff_b_minus_a:f ci_low:f ci_high:f n_series:i n_boot:i ci_excludes_0:b")
def cluster_bootstrap(spark, sf):
    complete = scoring.holdout_ledger(spark, sf).filter("label_complete")
    return resample.cluster_bootstrap(complete, "moving_avg_4", "naive", WEEK_KEYS, reps=2000, seed=42)


cte("item_errors", """
SELECT sku, sum(abs(launch_units)) AS actual, sum(abs(launch_units - pred_category_mean)) AS em,
       sum(abs(launch_units - pred_zero_analog)) AS ea
FROM launch_preds WHERE status = 'eligible' AND pred_category_mean IS NOT NULL AND pred_zero_analog IS NOT NULL GROUP BY sku""")
cte("item_boot", f"""
SELECT rep, (sum(w * em) - sum(w * ea)) / sum(w * actual) AS diff
FROM ({_weighted('item_errors', 2000, 'sku')}) GROUP BY rep HAVING sum(w * actual) > 0""")


@query("sku_bootstrap", """
SELECT 'category_mean minus analog' AS comparison, p.*, q.* FROM
 (SELECT (sum(em) - sum(ea)) / sum(actual) AS wape_difference, count(*) AS n_skus FROM item_errors) p,
 (SELECT quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high, count(diff) AS valid_reps FROM item_boot) q""",
       "comparison:s wape_difference:f ci_low:f ci_high:f n_skus:i valid_reps:i")
def sku_bootstrap(spark, sf):
    preds = launches.launch_predictions(spark, sf).filter("status = 'eligible'")
    return resample.item_bootstrap(preds, "category_mean", launches.METHODS, reps=2000, seed=42)


cte("week_errors", """
SELECT row_number() OVER (ORDER BY week) - 1 AS idx, week, max(tot) AS actual, max(err) FILTER (model_id = 'moving_avg_4') AS ch,
       max(err) FILTER (model_id = 'naive') AS ba
FROM (SELECT week, model_id, sum(actual) AS tot, sum(abs(prediction - actual)) AS err FROM cv_ledger
      WHERE model_id <> 'seasonal_naive' GROUP BY ALL) GROUP BY week""")
cte("week_boot", f"""
SELECT rep, (sum(ch) - sum(ba)) / nullif(sum(actual), 0) AS diff
FROM ({_draws('SELECT count(*) FROM week_errors', 20000, '',
      '(' + _hash(42, 'r.rep', 'p.j // 4') + ' % (SELECT count(*) FROM week_errors) + p.j % 4) % (SELECT count(*) FROM week_errors)')}) d
JOIN week_errors USING (idx) GROUP BY rep""")


@query("circular_block_bootstrap", """
SELECT 'moving_avg_4' AS challenger, 'naive' AS baseline, 4 AS block_weeks, p.*, q.* FROM
 (SELECT (sum(ch) - sum(ba)) / sum(actual) AS point_difference FROM week_errors) p,
 (SELECT quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high,
         avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0.0 END) AS probability_challenger_better FROM week_boot) q""",
       "challenger:s baseline:s block_weeks:i point_difference:f ci_low:f ci_high:f probability_challenger_better:f")
def circular_block_bootstrap(spark, sf):
    totals = ledger.weekly_error_totals(scoring.cv_ledger(spark, sf).filter("model_id <> 'seasonal_naive'"))
    wide = totals.groupBy("target_week").pivot("model_id", ["naive", "moving_avg_4"]).agg(F.max("abs_error"))
    actual = totals.groupBy("target_week").agg(F.max("actual_total").alias("actual_total"))
    return resample.circular_block_bootstrap(wide.join(actual, "target_week"), "moving_avg_4", "naive")
