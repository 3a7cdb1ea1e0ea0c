"""Fixed-effects promotion estimates on the weekly panel.

Two-way effects are removed without building dummies. With entity means taken out, the period effects solve a linear
system of calendar size; conjugate gradients needs only products with that system. Cells meet by entity once, as one row with
calendar-sized arrays; a product is one pass over these rows that shuffles totals per period. The driver holds one small
vector per period, never panel rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import chi2_sf, normal_sf2, ratio, student_quantile, student_sf2
from tidepanel.operators.identifiers import dense_ids
from tidepanel.operators.resample import weighted
from tidepanel.operators.validate import count_if
from tidepanel.schema import SERIES
from tidepanel.session import cut_lineage

#: Relative residual at which the solver stops, and the largest that it may end with when its steps are used up.
TOLERANCE, ACCEPTED = 1e-12, 1e-9
MAX_STEPS = 200
#: Share of a column's spread that effects and earlier columns must leave for it to have a coefficient.
LEFT_OVER = 1e-10
EXPORT_COLUMNS = ["group_id", "time_id", "log_units", "promotion_flag", "price_unit", "cluster_id", "group_label", "sku"]


# ---------------------------------------------------------------- panel preparation

def group_panel(df: DataFrame, strict: bool = True) -> DataFrame:
    """Numeric group, cluster and period ids, group label and log units.

    With ``strict`` the panel raises on duplicate cells, non-binary treatment, missing values or a hole inside a
    group's observed range.
    """
    required = [*SERIES, "week", "units_sold", "promotion_flag"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    if strict:
        # As a filter, before the joins: a row with a missing key would not reach a later check.
        null_found = F.lit(False)
        for c in required:
            null_found = null_found | F.col(c).isNull()
        df = df.filter(F.when(null_found, F.raise_error(F.lit("a key, treatment or outcome of the panel has missing values"))
                              .cast("boolean")).otherwise(True))
    # Read by the three id tables and the panel itself.
    labelled = cut_lineage(df.withColumn("group_label", F.concat_ws("|", *SERIES)))
    groups = dense_ids(labelled.select("group_label").distinct(), ["group_label"], "group_id")
    items = dense_ids(labelled.select("sku").distinct(), ["sku"], "cluster_id")
    periods = dense_ids(labelled.select("week").distinct(), ["week"], "time_id", start=0)
    out = (labelled.join(groups, "group_label").join(items, "sku").join(F.broadcast(periods), "week")
           .withColumn("log_units", F.log1p("units_sold")))
    if not strict:
        return out
    before = F.lag("time_id").over(Window.partitionBy("group_id").orderBy("time_id"))
    checked = out.withColumn("_before", before)
    problem = (F.when(F.col("_before") == F.col("time_id"), F.raise_error(F.lit("duplicate (group_id, time_id) rows")))
               .when(~F.col("promotion_flag").isin(0, 1), F.raise_error(F.lit("promotion_flag must be binary")))
               .when(F.col("_before") < F.col("time_id") - 1, F.raise_error(F.lit("internal time gap in a group"))))
    return checked.filter(F.coalesce(problem.cast("boolean"), F.lit(True))).drop("_before")


def lead_lag_panel(panel: DataFrame, lags: int = 4, leads: int = 2) -> tuple[DataFrame, list[str]]:
    """Current, past and future promotion state per group; rows without the full span are dropped."""
    for name, v in (("lags", lags), ("leads", leads)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise ValueError(f"{name}: a whole number from 0 on is expected, not {v!r}")
    w = Window.partitionBy("group_id").orderBy("time_id")
    terms = {"promo_current": F.col("promotion_flag").cast("double")}
    terms |= {f"promo_lag_{k}": F.lag("promotion_flag", k).over(w).cast("double") for k in range(1, lags + 1)}
    terms |= {f"promo_lead_{k}": F.lead("promotion_flag", k).over(w).cast("double") for k in range(1, leads + 1)}
    return panel.withColumns(terms).dropna(subset=list(terms)), list(terms)


# ---------------------------------------------------------------- two-way effects

def _vector_table(spark, periods: list, values: np.ndarray, time: str, time_type, names: list[str]) -> DataFrame:
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(time, time_type)] + [T.StructField(n, T.DoubleType()) for n in names])
    return spark.createDataFrame([(p, *map(float, v)) for p, v in zip(periods, values)], schema)


def _entity_rows(df: DataFrame, cols: list[str], entity: str, time: str, periods: list) -> DataFrame:
    """One row per entity: arrays of its periods' numbers, row counts and column sums, each at most as long as the calendar."""
    spark = df.sparkSession
    numbers = _vector_table(spark, periods, np.arange(len(periods))[:, None], time, df.schema[time].dataType, ["_t"])
    cells = df.groupBy(entity, time).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in cols])
    cell = F.struct(F.col("_t").cast("int").alias("t"), "n", F.array(*cols).alias("y"))
    return cells.join(F.broadcast(numbers), time).groupBy(entity).agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(
        F.col("cells.t").alias("t"), F.col("cells.n").alias("n"), F.flatten(F.col("cells.y")).alias("y"))


def _free_totals(rows: DataFrame, k: int, values: np.ndarray | None, size: int) -> np.ndarray:
    """Per period the totals of k columns after removing entity means: of the rows' own sums, or of ``values`` per period.

    Each task adds up its entities' arrays and gives one row per period, so a call shuffles periods only.
    """
    sent = None if values is None else rows.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        total = np.zeros((size, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n = batch.column(0), batch.column(1).flatten().to_numpy()
            lengths = np.asarray(t.value_lengths())
            t, starts = t.flatten().to_numpy(), np.cumsum(lengths) - lengths
            x = batch.column(2).flatten().to_numpy().reshape(-1, k) if sent is None else n[:, None] * sent.value[t]
            mean = np.add.reduceat(x, starts) / np.add.reduceat(n, starts)[:, None]
            x = x - n[:, None] * np.repeat(mean, lengths, axis=0)
            for j in range(k):
                total[:, j] += np.bincount(t, x[:, j], size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *[pa.array(total[:, j]) for j in range(k)]],
                                         names=["t", *[f"v{j}" for j in range(k)]])

    names = [f"v{j}" for j in range(k)]
    parts = rows.mapInArrow(run, "t int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((size, k))
    for r in parts.groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["t"]] = [r[c] for c in names]
    if sent is not None:
        sent.unpersist()
    return out


def _period_effects(df: DataFrame, cols: list[str], entity: str, time: str) -> tuple[list, np.ndarray]:
    """Period effects of every column in a regression on entity and period effects, up to a constant.

    The cells are brought together by entity once; every solver step then runs over one row per entity.
    """
    periods = sorted(r[0] for r in df.select(time).distinct().collect())
    rows = cut_lineage(_entity_rows(df, cols, entity, time, periods))
    k, size = len(cols), len(periods)
    b = _free_totals(rows, k, None, size)
    x, r = np.zeros_like(b), b - b.mean(axis=0)
    d, rr = r.copy(), (r * r).sum(axis=0)
    stop = TOLERANCE ** 2 * np.maximum(rr, 1e-300)
    for _ in range(min(MAX_STEPS, 2 * len(periods))):
        if (rr <= stop).all():
            break
        ad = _free_totals(rows, k, d, size)
        curve = (d * ad).sum(axis=0)
        step = np.where(curve > 0, rr / np.where(curve > 0, curve, 1.0), 0.0)
        x, r = x + step * d, r - step * ad
        r = r - r.mean(axis=0)
        new = (r * r).sum(axis=0)
        d, rr = r + np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0) * d, new
    if (rr > stop * (ACCEPTED / TOLERANCE) ** 2).any():
        raise ArithmeticError(f"period effects did not converge: relative residual {np.sqrt((rr / stop).max()) * TOLERANCE:.1e}")
    return periods, x


def within_two_way(df: DataFrame, cols: list[str], entity: str, time: str) -> DataFrame:
    """Replace the columns by their residuals on entity and period effects."""
    periods, effects = _period_effects(df, cols, entity, time)
    names = [f"_g{i}" for i in range(len(cols))]
    vec = _vector_table(df.sparkSession, periods, effects, time, df.schema[time].dataType, names)
    shifted = df.join(F.broadcast(vec), time).withColumns({c: F.col(c) - F.col(g) for c, g in zip(cols, names)}).drop(*names)
    means = shifted.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    return shifted.join(means, entity).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(
        *[f"_m_{c}" for c in cols])


# ---------------------------------------------------------------- least squares from sums

def _gram_columns(cols: list[str]) -> list[Column]:
    return [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]


def _gram(row, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g


class Fit:
    """Coefficients and covariance of a small regression; plain numbers, no data."""

    def __init__(self, names, coef, cov, n_obs, dof, n_clusters):
        self.names, self.coef, self.cov = names, coef, cov
        self.n_obs, self.dof, self.n_clusters = n_obs, dof, n_clusters

    def value(self, name: str) -> float:
        return float(self.coef[self.names.index(name)])

    def se(self, name: str) -> float:
        i = self.names.index(name)
        return math.sqrt(self.cov[i, i])

    def combination(self, weights: dict[str, float]) -> tuple[float, float]:
        """Value and standard error of a linear combination."""
        w = np.array([weights.get(n, 0.0) for n in self.names])
        return float(w @ self.coef), math.sqrt(float(w @ self.cov @ w))

    def wald(self, names: list[str]) -> tuple[float, float]:
        """Joint test that the named coefficients are zero: statistic and chi-square p."""
        idx = [self.names.index(n) for n in names]
        b = self.coef[idx]
        if np.isnan(b).any() or np.isnan(self.cov[np.ix_(idx, idx)]).any():
            return math.nan, math.nan
        stat = float(b @ np.linalg.solve(self.cov[np.ix_(idx, idx)], b))
        return stat, chi2_sf(stat, len(idx))

    def rows(self) -> list[tuple]:
        out = []
        for n in self.names:
            c, s = self.value(n), self.se(n)
            t = c / s if s > 0 else float("nan")
            half = student_quantile(0.975, self.dof) * s
            out.append((n, c, s, t, student_sf2(t, self.dof) if s > 0 else None, c - half, c + half))
        return out


def _solve(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse of X'X from the joint Gram matrix [X y], on unit-scaled columns."""
    xx, xy = gram[:-1, :-1], gram[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    return inverse @ xy, inverse


def _identified(gram: np.ndarray, least: list[float]) -> list[int]:
    """Places of the columns that still vary beside the effects and the identified columns before them."""
    kept: list[int] = []
    for j, enough in enumerate(least):
        left = gram[j, j]
        if kept:
            left -= gram[j, kept] @ _solve(gram[np.ix_([*kept, j], [*kept, j])])[0]
        if left > enough:
            kept.append(j)
    return kept


def _score_sums(residual: DataFrame, names: list[str], fits: dict, by: list[str], cluster: str | None) -> dict:
    """Sum over clusters of the outer products of score sums, one k x k matrix per group.

    Scores are summed per cluster first, so a cluster holding a third of the rows is combined map-side.
    """
    spark = residual.sparkSession
    schema = ", ".join([f"{b} {residual.schema[b].dataType.simpleString()}" for b in by] + [f"b{i} double" for i in range(len(names))])
    coefs = spark.createDataFrame([(*key, *map(float, c)) for key, (c, _) in fits.items()], schema or None) if by else None
    if by:
        data = residual.join(F.broadcast(coefs), by)
        fitted = sum((F.col(f"b{i}") * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    else:
        data = residual
        fitted = sum((F.lit(float(v)) * F.col(n) for v, n in zip(fits[()][0], names)), F.lit(0.0))
    scored = data.withColumn("_e", F.col("_y") - fitted)
    scores = [(F.col(n) * F.col("_e")).alias(f"s{i}") for i, n in enumerate(names)]
    cols = [f"s{i}" for i in range(len(names))]
    if cluster is None:
        per = scored.select(*by, *scores)
    else:
        per = scored.select(*by, F.col(cluster).alias("_c"), *scores).groupBy(*by, "_c").agg(*[F.sum(c).alias(c) for c in cols])
    totals = per.groupBy(*by).agg(*_gram_columns(cols)).collect() if by else per.agg(*_gram_columns(cols)).collect()
    return {tuple(r[b] for b in by): _gram(r, len(cols)) for r in totals}


def two_way_fit(df: DataFrame, y: str, xs: list[str], entity: str, time: str, cluster: str, by: str | None = None, strict: bool = True) -> dict:
    """OLS with entity and period effects and clustered errors; with ``by``, one regression per value in the same jobs.

    Rows with a missing regressor are dropped. A group with a single cluster gets heteroskedasticity-robust errors. A column that
    does not vary beside the effects and the columns before it has no coefficient (NaN) in that group and ends no other group;
    without ``by`` it is an error unless ``strict`` is off. Too few rows for an error variance leave the covariance NaN.
    """
    keep = [c for c in dict.fromkeys([*([by] if by else []), entity, time, cluster])]
    data = df.select(*keep, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    keys = [by] if by else []
    entity_key, time_key = entity, time
    if by:
        # Separate regressions: effects of different groups must not be shared.
        data = data.withColumns({"_entity": F.struct(by, entity), "_time": F.struct(by, time)})
        entity_key, time_key = "_entity", "_time"
    data = cut_lineage(data)
    residual = cut_lineage(within_two_way(data, ["_y", *xs], entity_key, time_key))
    cols = [*xs, "_y"]
    counts = [F.count(F.lit(1)).alias("n"), F.countDistinct(entity_key).alias("ne"), F.countDistinct(time_key).alias("nt"),
              F.countDistinct(cluster).alias("nc")]
    aggs = _gram_columns(cols) + counts
    rows = (residual.groupBy(*keys).agg(*aggs) if keys else residual.agg(*aggs)).collect()
    info = {tuple(r[b] for b in keys): r for r in rows}
    # The sum of squares stands for the rounding of a constant.
    spreads = [(LEFT_OVER * F.var_pop(x) * F.count(F.lit(1)) + LEFT_OVER ** 2 * F.sum(F.col(x) * F.col(x))).alias(x) for x in xs]
    raw = (data.groupBy(*keys).agg(*spreads) if keys else data.agg(*spreads)).collect()
    # All groups are solved at once, so what rounding leaves follows the widest of them.
    rounding = {x: LEFT_OVER * max((r[x] or 0.0 for r in raw), default=0.0) for x in xs}
    least = {tuple(r[b] for b in keys): [(r[x] or 0.0) + rounding[x] for x in xs] for r in raw}
    kept, solved = {}, {}
    for key, r in info.items():
        gram = _gram(r, len(cols))
        kept[key] = _identified(gram, least[key])
        if strict and not by and len(kept[key]) < len(xs):
            raise ValueError(f"no variation left beside the effects in: {', '.join(x for i, x in enumerate(xs) if i not in kept[key])}")
        coef, inverse = np.zeros(len(xs)), np.zeros((len(xs), len(xs)))
        if kept[key]:
            coef[kept[key]], inverse[np.ix_(kept[key], kept[key])] = _solve(gram[np.ix_([*kept[key], len(xs)], [*kept[key], len(xs)])])
        solved[key] = coef, inverse
    clustered = {k: v for k, v in solved.items() if info[k]["nc"] > 1}
    single = {k: v for k, v in solved.items() if info[k]["nc"] <= 1}
    meat = _score_sums(residual, xs, clustered, keys, cluster) if clustered else {}
    if single:
        meat |= {k: m for k, m in _score_sums(residual, xs, single, keys, None).items() if k in single}
    fits = {}
    for key, r in info.items():
        coef, inverse = solved[key]
        dof = r["n"] - len(kept[key]) - (r["ne"] + r["nt"] - 1)
        cov = inverse @ meat[key] @ inverse * (r["n"] / dof if dof > 0 else np.nan)
        gone = [i for i in range(len(xs)) if i not in kept[key]]
        coef[gone] = cov[gone, :] = cov[:, gone] = np.nan
        fits[key] = Fit(xs, coef, cov, r["n"], dof, r["nc"])
    return fits


# ---------------------------------------------------------------- promotion estimates

def _dummies(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all but the first level of each column; the level lists are small dimensions."""
    names = []
    for c in cols:
        levels = sorted(r[c] for r in df.select(c).distinct().collect())
        for i, level in enumerate(levels[1:], 1):
            name = f"{c}_{i}"
            df = df.withColumn(name, (F.col(c) == level).cast("double"))
            names.append(name)
    return df, names


def promotion_effect(df: DataFrame, by: str | None = None, strict: bool = True) -> dict:
    """log(1 + units) on promotion, price and channel/region dummies with item and week effects."""
    design, dummies = _dummies(df.withColumn("_log", F.log1p("units_sold")), ["channel", "region"])
    return two_way_fit(design, "_log", [*dummies, "price_unit", "promotion_flag"], "sku", "week", "sku", by, strict)


FIT_SCHEMA = "term string, coef double, se double, t_stat double, p_value double, ci_low double, ci_high double"


def _known(rows: list[tuple]) -> list[tuple]:
    """Rows of a result; where a coefficient could not be estimated, its numbers are missing."""
    return [(name, None, *[None] * len(rest)) if math.isnan(value) else (name, value, *rest) for name, value, *rest in rows]


def fit_table(spark, fit: Fit) -> DataFrame:
    return spark.createDataFrame(_known(fit.rows()), FIT_SCHEMA)


def uplift_summary(fit: Fit, term: str = "promotion_flag") -> dict:
    """Log-linear coefficient as a percentage with its interval."""
    _, c, _, _, p, lo, hi = next(r for r in fit.rows() if r[0] == term)
    with np.errstate(over="ignore"):
        uplift, low, high = (float(np.expm1(x) * 100) for x in (c, lo, hi))
    return {"uplift_pct": uplift, "ci_low_pct": low, "ci_high_pct": high, "p_value": p, "n_obs": fit.n_obs}


def uplift_table(spark, fits: dict, key: str | None = None) -> DataFrame:
    """One row per regression; where the promotion has no estimate, ``error`` says why and the estimates are missing."""
    rows = []
    for k, f in sorted(fits.items()):
        coef, se, error = f.value("promotion_flag"), f.se("promotion_flag"), None
        if math.isnan(coef):
            error = "promotion_flag does not vary beside the effects"
        elif math.isnan(se):
            error = f"{f.n_obs} rows are too few for an error variance"
        found = (None,) * 4 if error else tuple(uplift_summary(f).values())[:4]
        rows.append((k[0] if k else "all", f.n_clusters, f.n_clusters > 1, *found, f.n_obs, None if error else coef, None if error else se, error))
    return spark.createDataFrame(rows, f"{key or 'scope'} string, n_sku long, entity_fe boolean, uplift_pct double, ci_low_pct double, "
                                       "ci_high_pct double, p_value double, n_obs long, coef double, se double, error string")


def parity_twfe(panel: DataFrame, strict: bool = True) -> Fit:
    """Promotion and price with group (series) and period effects, clustered by item."""
    return two_way_fit(panel, "log_units", ["promotion_flag", "price_unit"], "group_id", "time_id", "sku", strict=strict)[()]


def twfe_weights(panel: DataFrame, controls: list[str] = ("price_unit",)) -> DataFrame:
    """Treated-cell weights of the two-way estimate: residualised treatment over its product with treatment."""
    controls = list(controls)
    data = cut_lineage(panel.select(
        "group_id", "time_id", "log_units", F.col("promotion_flag").cast("double").alias("treated"),
        F.col("promotion_flag").cast("double").alias("_d"), *[F.col(c).cast("double").alias(c) for c in controls]).dropna())
    residual = within_two_way(data, ["_d", *controls], "group_id", "time_id")
    if controls:
        residual = cut_lineage(residual)
        gram = _gram(residual.agg(*_gram_columns([*controls, "_d"])).collect()[0], len(controls) + 1)
        coef, _ = _solve(gram)
        fitted = sum((F.lit(float(v)) * F.col(c) for v, c in zip(coef, controls)), F.lit(0.0))
        residual = residual.withColumn("_d", F.col("_d") - fitted)
    denominator = residual.agg(F.sum(F.col("_d") * F.col("treated"))).scalar()
    return residual.select("group_id", "time_id", "treated", "log_units", F.col("_d").alias("residualized_treatment"),
                           ratio(F.col("_d"), denominator).alias("_w")).withColumn(
        "twfe_weight", F.when(F.col("treated") == 1, F.col("_w")).otherwise(0.0))


def weight_summary(weights: DataFrame) -> DataFrame:
    """Signs and sums of the treated-cell weights, and the coefficient they reconstruct."""
    w, treated = F.col("twfe_weight"), F.col("treated") == 1
    pos, neg = treated & (w > 0), treated & (w < 0)
    return weights.agg(
        F.count(F.lit(1)).alias("n_obs"), count_if(treated).alias("n_treated_cells"),
        count_if(pos).alias("n_positive_weights"), count_if(neg).alias("n_negative_weights"),
        (100 * ratio(count_if(neg), count_if(treated))).alias("negative_weight_pct"),
        F.coalesce(F.sum(F.when(pos, w)), F.lit(0.0)).alias("sum_positive_weights"),
        F.coalesce(F.sum(F.when(neg, w)), F.lit(0.0)).alias("sum_negative_weights"),
        F.sum(F.when(treated, w)).alias("sum_weights"),
        F.min(F.when(treated, w)).alias("min_weight"), F.max(F.when(treated, w)).alias("max_weight"),
        F.sum(F.col("_w") * F.col("log_units")).alias("reconstructed_twfe_coef"))


def distributed_lag(panel: DataFrame, lags: int = 4, leads: int = 2, controls: list[str] = (), strict: bool = True) -> Fit:
    """Current, lagged and future promotion with group and period effects, clustered by item."""
    design, terms = lead_lag_panel(panel, lags, leads)
    return two_way_fit(design, "log_units", [*terms, *controls], "group_id", "time_id", "sku", strict=strict)[()]


def distributed_lag_table(spark, fit: Fit, lags: int = 4) -> DataFrame:
    """Coefficients plus the sum over the lags with its standard error (normal p)."""
    total, se = fit.combination({f"promo_lag_{k}": 1.0 for k in range(1, lags + 1)})
    z = total / se
    rows = fit.rows() + [("lag_sum", total, se, z, normal_sf2(z), total - 1.959963984540054 * se,
                          total + 1.959963984540054 * se)]
    return spark.createDataFrame(_known(rows), FIT_SCHEMA)


def distributed_lag_tests(spark, fit: Fit, lags: int = 4, leads: int = 2) -> DataFrame:
    """Joint tests: all lags zero (displacement), all leads zero (placebo)."""
    rows = [("lags", *fit.wald([f"promo_lag_{k}" for k in range(1, lags + 1)]), lags),
            ("leads", *fit.wald([f"promo_lead_{k}" for k in range(1, leads + 1)]), leads)]
    rows = [(name, None, None, n) if math.isnan(stat) else (name, stat, p, n) for name, stat, p, n in rows]
    return spark.createDataFrame(rows, "hypothesis string, wald double, p_value double, n_terms long")


# ---------------------------------------------------------------- switchers against stayers

def consecutive_periods(panel: DataFrame) -> DataFrame:
    """Each cell next to its group's previous period: change in outcome and treatment."""
    w = Window.partitionBy("group_id").orderBy("time_id")
    moved = panel.select("group_id", "time_id", "sku", "promotion_flag", "log_units",
                         F.lag("time_id").over(w).alias("_t"), F.lag("promotion_flag").over(w).alias("d_prev"),
                         (F.col("log_units") - F.lag("log_units").over(w)).alias("dy"))
    return moved.filter(F.col("_t") == F.col("time_id") - 1).drop("_t").withColumn(
        "switched", (F.col("promotion_flag") != F.col("d_prev")).cast("int"))


def _was_cells(moves: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per period and previous treatment: counts and summed changes of stayers and switchers."""
    s = F.col("switched") == 1
    return moves.groupBy(*by, "time_id", "d_prev").agg(
        F.sum(F.when(s, 1.0).otherwise(0.0)).alias("n_switch"), F.sum(F.when(s, F.col("dy")).otherwise(0.0)).alias("y_switch"),
        F.sum(F.when(s, 0.0).otherwise(1.0)).alias("n_stay"), F.sum(F.when(s, 0.0).otherwise(F.col("dy"))).alias("y_stay"))


def _was_estimate(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weighted switcher effect: change minus the same-period mean change of stayers with the same past treatment,
    over the size of the switch. Cells without stayers have no comparison and are left out."""
    usable = cells.filter((F.col("n_stay") > 0) & (F.col("n_switch") > 0))
    effect = F.col("y_switch") - F.col("n_switch") * F.col("y_stay") / F.col("n_stay")
    signed = F.when(F.col("d_prev") == 0, effect).otherwise(-effect)
    spec = F.explode(F.array(F.lit("all"), F.when(F.col("d_prev") == 0, "switch_in").otherwise("switch_out")))
    rows = usable.select(*by, spec.alias("specification"), signed.alias("e"), "n_switch", "n_stay")
    return rows.groupBy(*by, "specification").agg(
        ratio(F.sum("e"), F.sum("n_switch")).alias("log_coef"), F.sum("n_switch").alias("switchers"),
        F.sum("n_stay").alias("stayers"))


def was_exact_match(panel: DataFrame) -> DataFrame:
    out = _was_estimate(_was_cells(consecutive_periods(panel)))
    return out.withColumn("uplift_pct", 100 * F.expm1("log_coef")).withColumns(
        {"switchers": F.col("switchers").cast("bigint"), "stayers": F.col("stayers").cast("bigint")})


def was_bootstrap(panel: DataFrame, reps: int = 200, seed: int = 42) -> DataFrame:
    """Standard error of the switcher effect by resampling items with Poisson weights.

    An item is one row with its period cells; its weight is drawn beside them, so a task sends one row per repetition, period
    and previous treatment and no item is looked up.
    """
    measures = ["n_switch", "y_switch", "n_stay", "y_stay"]
    cells = _was_cells(consecutive_periods(panel), ["sku"])
    items = cut_lineage(cells.groupBy("sku").agg(F.collect_list(F.struct("time_id", "d_prev", *measures)).alias("cells")))
    drawn = weighted(items, ["sku"], reps, seed).select("rep", "w", F.explode("cells").alias("c")).select("rep", "w", "c.*")
    resampled = drawn.groupBy("rep", "time_id", "d_prev").agg(*[F.sum(F.col("w") * F.col(m)).alias(m) for m in measures])
    return _was_estimate(resampled, ["rep"]).groupBy("specification").agg(
        F.stddev_samp("log_coef").alias("se"), F.percentile("log_coef", F.lit(0.025)).alias("ci_low"),
        F.percentile("log_coef", F.lit(0.975)).alias("ci_high"), F.count("log_coef").alias("reps"))
