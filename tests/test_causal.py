import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day, rows_by
from tidepanel.operators import causal

SCHEMA = "sku string, channel string, region string, week date, units_sold double, promotion_flag int, price_unit double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def week(i):
    return day("2022-01-03") + dt.timedelta(weeks=i)


def made(groups, periods, effect, seed=0, missing=0.0, skus=None, lag=0.0):
    rng = np.random.default_rng(seed)
    skus = skus or groups
    rows = []
    for g in range(groups):
        promo = rng.integers(0, 2, periods)
        for t in range(periods):
            y = 1.0 + 0.3 * g + 0.05 * t + effect * promo[t] + (lag * promo[t - 1] if t else 0.0)
            if seed:
                y += rng.normal(0, 0.1)
            if rng.random() >= missing:
                rows.append((f"S{g % skus:02d}", f"c{g}", "r", week(t), float(np.expm1(y)), int(promo[t]), float(rng.uniform(1, 9))))
    return rows


def test_ids_are_numeric_sorted_and_shared(spark):
    got = causal.group_panel(frame(spark, made(3, 4, 0.4, skus=2))).collect()
    labels = sorted({r.group_label for r in got})
    assert all(r.group_id == labels.index(r.group_label) + 1 for r in got)
    assert {r.time_id for r in got} == {0, 1, 2, 3} and {r.cluster_id for r in got} == {1, 2}


@pytest.mark.parametrize("damage, message", [
    (lambda rows: rows + rows[:1], "duplicate"),
    (lambda rows: [(*rows[0][:5], 2, rows[0][6])] + rows[1:], "binary"),
    (lambda rows: rows[:1] + rows[2:], "gap"),
    (lambda rows: [(*rows[0][:4], None, *rows[0][5:])] + rows[1:], "missing values"),
    (lambda rows: [(None, *rows[0][1:])] + rows[1:], "missing values"),
])
def test_panel_preconditions(spark, damage, message):
    with pytest.raises(Exception, match=message):
        causal.group_panel(frame(spark, damage(made(3, 5, 0.4)))).count()


def test_weights_sum_to_one_and_rebuild_the_coefficient(spark):
    panel = causal.group_panel(frame(spark, made(4, 6, 0.4)))
    got = causal.weight_summary(causal.twfe_weights(panel, controls=[])).first()
    assert got.sum_weights == pytest.approx(1.0) and got.reconstructed_twfe_coef == pytest.approx(0.4)
    assert got.n_positive_weights + got.n_negative_weights <= got.n_treated_cells


def dummies(rows, entity, columns):
    """Least squares with explicit dummies, entity-clustered errors."""
    ents, times = sorted({entity(r) for r in rows}), sorted({r[3] for r in rows})
    d = np.zeros((len(rows), len(ents) + len(times) - 1))
    for i, r in enumerate(rows):
        d[i, ents.index(entity(r))] = 1
        if times.index(r[3]):
            d[i, len(ents) + times.index(r[3]) - 1] = 1
    y = np.log1p([r[4] for r in rows])
    m = np.eye(len(rows)) - d @ np.linalg.pinv(d)
    x, y = m @ np.array(columns, float).T, m @ y
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    meat = sum(np.outer(s, s) for s in (x[[r[0] == g for r in rows]].T @ e[[r[0] == g for r in rows]] for g in {r[0] for r in rows}))
    dof = len(rows) - x.shape[1] - d.shape[1]
    return b, np.sqrt(np.diag(inv @ meat @ inv) * len(rows) / dof), dof


def test_unbalanced_two_way_fit_matches_explicit_dummies(spark):
    rows = made(12, 15, 0.4, seed=5, missing=0.3, skus=5)
    fit = causal.parity_twfe(causal.group_panel(frame(spark, rows), strict=False))
    b, se, dof = dummies(rows, lambda r: (r[0], r[1]), [[r[5] for r in rows], [r[6] for r in rows]])
    assert fit.coef == pytest.approx(b, abs=1e-9) and np.sqrt(np.diag(fit.cov)) == pytest.approx(se, abs=1e-9) and fit.dof == dof


def test_grouped_fits_equal_separate_fits(spark):
    rows = made(10, 12, 0.3, seed=7, skus=6)
    df = frame(spark, rows).selectExpr("*", "CASE WHEN sku < 'S03' THEN 'a' ELSE 'b' END AS category")
    args = ("log", ["promotion_flag", "price_unit"], "sku", "week", "sku")
    df = df.selectExpr("*", "log1p(units_sold) AS log")
    both = causal.two_way_fit(df, *args, by="category")
    for k in "ab":
        alone = causal.two_way_fit(df.filter(f"category = '{k}'"), *args)[()]
        assert both[(k,)].coef == pytest.approx(alone.coef, abs=1e-9) and both[(k,)].cov == pytest.approx(alone.cov, abs=1e-12)
    summary = causal.uplift_summary(both[("a",)])
    assert summary["ci_low_pct"] < summary["uplift_pct"] < summary["ci_high_pct"]


def test_single_cluster_falls_back_to_robust_errors(spark):
    rows = made(4, 30, 0.3, seed=9, skus=1)
    fit = causal.two_way_fit(frame(spark, rows).selectExpr("*", "log1p(units_sold) AS log"), "log", ["promotion_flag"], "sku", "week", "sku")[()]
    assert fit.n_clusters == 1 and fit.se("promotion_flag") > 0


def test_a_category_that_cannot_be_estimated_leaves_the_others(spark):
    """One region only: its region column is left out. No promotion, or two rows: a row with the reason."""
    r, rows = np.random.default_rng(9), []
    for cat, regions, skus, n in (("full", ("r1", "r2"), 4, 20), ("one region", ("r1",), 4, 20), ("no promotion", ("r1", "r2"), 3, 15), ("tiny", ("r1",), 1, 2)):
        for k in range(skus):
            for region in regions:
                for t in range(n):
                    promo = 0 if cat == "no promotion" else int(r.integers(2)) if cat != "tiny" else t
                    rows.append((cat, f"{cat}{k}", "c", region, week(t), float(np.expm1(2 + 0.3 * promo + r.normal() / 10)), promo, float(r.integers(5, 9))))
    schema = "category string, sku string, channel string, region string, week date, units_sold double, promotion_flag int, price_unit double"
    df = spark.createDataFrame(rows, schema)
    got = {x.category: x for x in causal.uplift_table(spark, causal.promotion_effect(df, by="category"), "category").collect()}
    for cat in ("full", "one region"):
        alone = causal.promotion_effect(df.filter(F.col("category") == cat))[()]
        assert [got[cat].coef, got[cat].se] == pytest.approx([alone.value("promotion_flag"), alone.se("promotion_flag")]) and got[cat].error is None
    assert got["no promotion"].coef is None and "vary" in got["no promotion"].error and got["no promotion"].n_obs == 90
    assert got["tiny"].uplift_pct is None and got["tiny"].error
    with pytest.raises(ValueError, match="promotion_flag"):
        causal.promotion_effect(df.filter("category = 'no promotion'"))


def test_distributed_lag_recovers_known_effects(spark):
    panel = causal.group_panel(frame(spark, made(10, 20, 0.4, lag=0.1)))
    fit = causal.distributed_lag(panel, lags=1, leads=1)
    assert [fit.value(n) for n in ("promo_current", "promo_lag_1", "promo_lead_1")] == pytest.approx([0.4, 0.1, 0.0], abs=1e-8)
    design, terms = causal.lead_lag_panel(panel, 2, 1)
    assert design.count() == 10 * (20 - 3) and terms == ["promo_current", "promo_lag_1", "promo_lag_2", "promo_lead_1"]
    for bad in (-1, True, 1.5):
        with pytest.raises(ValueError):
            causal.lead_lag_panel(panel, bad, 1)


def test_switchers_against_stayers_brute_force(spark):
    rows = made(15, 8, 0.4, seed=11)
    got = rows_by(causal.was_exact_match(causal.group_panel(frame(spark, rows))), "specification")
    y = {(r[1], r[3]): (np.log1p(r[4]), r[5]) for r in rows}
    num, den = {"switch_in": 0.0, "switch_out": 0.0}, {"switch_in": 0, "switch_out": 0}
    for t in range(1, 8):
        for d in (0, 1):
            moves = [(y[(g, week(t))], y[(g, week(t - 1))]) for g in {r[1] for r in rows} if y[(g, week(t - 1))][1] == d]
            stay = [a[0] - b[0] for a, b in moves if a[1] == d]
            for a, b in moves:
                if a[1] != d and stay:
                    name = "switch_in" if d == 0 else "switch_out"
                    num[name] += (a[0] - b[0] - np.mean(stay)) * (1 if d == 0 else -1)
                    den[name] += 1
    assert got["all"].log_coef == pytest.approx(sum(num.values()) / sum(den.values()))
    for k in num:
        assert got[k].log_coef == pytest.approx(num[k] / den[k]) and got[k].switchers == den[k]


def test_a_promotion_in_every_week_has_no_estimate_and_ends_no_query(spark, monkeypatch):
    """Large tables have a promoted line in every week: the rows stay, without numbers."""
    from tidepanel.plans import effects
    rows = [(*r[:5], 1, r[6]) for r in made(6, 15, 0.4, seed=5, skus=3)]
    panel = frame(spark, rows)
    monkeypatch.setattr(effects, "_panel", lambda *_: causal.group_panel(panel))
    monkeypatch.setattr(effects, "_effect_panel", lambda *_: panel)
    got = effects.parity_twfe(spark, "").collect()
    assert [(r.term, r.coef, r.se, r.n_obs) for r in got] == [("promotion_flag", None, None, 90)]
    lag = rows_by(effects.distributed_lag(spark, ""), "term")
    assert len(lag) == 8 and all(r.coef is None and r.se is None for r in lag.values())
    assert [(r.hypothesis, r.wald, r.p_value, r.n_terms) for r in effects.distributed_lag_tests(spark, "").collect()] == [
        ("lags", None, None, 4), ("leads", None, None, 2)]
    for r in (effects.twfe_promotion_effect(spark, "").first(), effects.uplift_summary(spark, "").first()):
        assert r.n_obs == 90 and r.uplift_pct is None
