"""Pooled, local and launch-time forecasting models on MLlib.

Every fit is a job over the training rows, boosted trees of few enough rows in one task (``boosting``); the driver keeps fitted
trees, fold lists and settings only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.numeric import forecast_metrics, ratio
from tidepanel.operators import boosting, daily_grain, encode, launch, ledger, splits
from tidepanel.operators.identifiers import dense_ids
from tidepanel.schema import (CATEGORICAL_COLS, FEATURE_COLS, FEATURE_GROUPS, HISTORY_FEATURES, LABEL, SERIES, WEEK_KEYS)
from tidepanel.session import cut_lineage, side_by_side

# Published model settings.
SEED = 42
TREES = 300
LEARNING_RATE = 0.05
MIN_LEAF_ROWS = 20
DEPTH = {"global_gbt": 5, "global_gbt_l1": 6, "global_gbt_target": 6, "global_rf": 15}
EMBEDDING_DIMS = {"sku": 4, "channel": 2, "region": 2}
ZERO_HISTORY_FEATURES = ["category", "segment", "brand", "channel", "region", "month", "week_number", "year"]
MIN_LOCAL_ROWS = 20
SEASON, MIN_SERIES_POINTS, TOP_SERIES = 52, 30, 5
DEV_FOLDS = 3

# Missing numbers become a value outside the feature's range, so trees can split them off.
MISSING = -1.0
MISSING_BY_COLUMN = {"momentum": -1e6}
# Labels of an index are held on the driver and take a tree bin each, one more for unseen values. A column with more is
# an error: it belongs into the spec's ``averaged``.
MAX_INDEXED_LEVELS = 256
MEAN_PRIOR_ROWS = 1.0
# Training rows of one task, and tasks of one fit at most: a boosted fit is thousands of short jobs, so small tables must
# not be cut into as many tasks as there are cores.
ROWS_PER_TASK, MOST_TASKS = 1 << 16, 1 << 14
# Families whose learner keeps its binned rows itself; the others read their input once a step.
BINNING = ("gbt", "rf")


@dataclass(frozen=True)
class Spec:
    """One model: family (gbt, rf, huber, poisson), loss, size, and how categoricals are encoded, whatever their size.

    ``index``: labels are indexed, except for ``averaged`` columns, which have ordered means of earlier targets;
    ``codes``: every column has codes through a join; ``target``: every column has ordered means.
    """

    name: str
    family: str = "gbt"
    encoding: str = "index"
    params: dict = field(default_factory=dict)
    averaged: tuple[str, ...] = ("sku",)

    def sized(self, trees: int | None = None, depth: int | None = None) -> "Spec":
        """Same model with fewer trees or less depth, for trial runs."""
        params = dict(self.params)
        if trees is not None and self.family in ("gbt", "rf"):
            params["maxIter" if self.family == "gbt" else "numTrees"] = trees
        if depth is not None and self.family in ("gbt", "rf"):
            params["maxDepth"] = min(depth, params.get("maxDepth", depth))
        return replace(self, params=params)


def _gbt(name: str, loss: str = "squared", encoding: str = "index", **extra) -> Spec:
    params = {"lossType": loss, "maxIter": TREES, "stepSize": LEARNING_RATE, "maxDepth": DEPTH.get(name, 5),
              "minInstancesPerNode": MIN_LEAF_ROWS, "seed": SEED}
    return Spec(name, "gbt", encoding, params | extra)


SPECS = {
    "global_gbt": _gbt("global_gbt"),
    "global_gbt_l1": _gbt("global_gbt_l1", loss="absolute"),
    "global_gbt_target": _gbt("global_gbt_target", encoding="target"),
    "global_rf": Spec("global_rf", "rf", "codes", {
        "numTrees": TREES, "maxDepth": DEPTH["global_rf"], "minInstancesPerNode": MIN_LEAF_ROWS, "seed": SEED}),
}


# ---------------------------------------------------------------- frames and fitting

def _numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING_BY_COLUMN.get(c, MISSING))) for c in cols})


def target_means(train: DataFrame, column: str, label: str) -> DataFrame:
    """(column, mean) blended with the overall mean; a join table, however many values the column has."""
    overall = train.agg(F.avg(label)).scalar()
    return train.groupBy(column).agg(F.sum(label).alias("_s"), F.count(label).alias("_n")).withColumn("_o", overall).select(
        column, ((F.col("_s") + MEAN_PRIOR_ROWS * F.col("_o")) / (F.col("_n") + MEAN_PRIOR_ROWS)).alias(f"{column}_mean"))


class FittedModel:
    """A fitted regressor with the encoders learned from its training rows; without ``learn`` the encoders alone."""

    def __init__(self, spec: Spec, features: list[str], label: str, train: DataFrame, categorical: list[str], learn: bool = True):
        self.spec, self.features, self.label = spec, list(features), label
        cats = [c for c in categorical if c in features]
        self.numeric = [c for c in features if c not in cats]
        self.coded = cats if spec.encoding == "codes" else []
        self.averaged = [c for c in cats if spec.encoding == "target" or spec.encoding == "index" and c in spec.averaged]
        self.indexed = [c for c in cats if c not in self.coded and c not in self.averaged]
        if self.indexed:
            levels = train.agg(*[F.count_distinct(c).alias(c) for c in self.indexed]).first()
            if wide := [c for c in self.indexed if levels[c] + 1 > MAX_INDEXED_LEVELS]:
                raise ValueError(f"too many values for an index: {', '.join(wide)}")
        self.codes = cut_lineage(encode.fit_codes(train, self.coded)) if self.coded else None
        self.means = {c: cut_lineage(target_means(train, c, label)) for c in self.averaged}
        self.prior = train.agg(F.avg(label)).first()[0] if self.averaged else None
        stages = []
        if self.indexed:
            stages.append(StringIndexer(inputCols=self.indexed, outputCols=[f"{c}_idx" for c in self.indexed],
                                        handleInvalid="keep", stringOrderType="alphabetAsc"))
        self.inputs = (self.numeric + [f"{c}_idx" for c in self.indexed] + [f"{c}_code" for c in self.coded]
                       + [f"{c}_mean" for c in self.averaged])
        stages.append(VectorAssembler(inputCols=self.inputs, outputCol="features"))
        prepared = self._prepare(train, training=True)
        self.frame, self.model = Pipeline(stages=stages).fit(prepared), None
        if learn:
            self._learn(prepared, train)

    def _learn(self, prepared: DataFrame, train: DataFrame) -> None:
        # Rows reach the learner in one placement and order that follow the data, not the cores at hand or settings, so
        # equal input gives an equal model.
        tasks = min(MOST_TASKS, max(1, -(-train.count() // ROWS_PER_TASK)))
        keys = [c for c in (*SERIES, "week", "date", "horizon") if c in train.columns]
        placed = prepared.repartition(tasks, *keys).sortWithinPartitions(*keys)
        data = self.frame.transform(placed).select("features", F.col(self.label).cast("double").alias("label"))
        # Every job of a fit ships the plan of its input to each task, so the learner gets rows without the joins behind them.
        data = cut_lineage(data)
        if self.spec.family not in BINNING:
            data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.model = _learner(self.spec).fit(data)
        finally:
            data.unpersist()

    def _prepare(self, df: DataFrame, training: bool = False) -> DataFrame:
        out = _numeric(df, self.numeric)
        if self.coded:
            out = encode.apply_codes(out, self.codes, self.coded)
        for c in self.averaged:
            if training and "week" in df.columns:
                # Training rows only see targets that were complete before them. The lookup is built from the given
                # rows, not from the joins so far, or every column would replay all columns before it.
                earlier = encode.ordered_target_means(df, c, self.label, MEAN_PRIOR_ROWS)
                out = out.join(earlier.withColumnRenamed(f"{c}_encoded", f"{c}_mean"), [c, "week"], "left")
            else:
                out = out.join(self.means[c], c, "left")
            out = out.withColumn(f"{c}_mean", F.coalesce(f"{c}_mean", F.lit(float(self.prior))))
        return out

    def design(self, df: DataFrame) -> DataFrame:
        """Rows with their assembled feature vector."""
        return self.frame.transform(self._prepare(df))

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.design(df))
        return scored.select(*df.columns, "prediction")

    def importances(self) -> list[tuple[str, float]]:
        return [(n, float(v)) for n, v in zip(self.inputs, self.model.featureImportances.toArray())]

    def save(self, folder: str) -> None:
        self.frame.write().overwrite().save(f"{folder}/frame")
        self.model.write().overwrite().save(f"{folder}/model")


def _learner(spec: Spec):
    if spec.family == "gbt":
        return boosting.Boosting(maxBins=MAX_INDEXED_LEVELS, **spec.params)
    if spec.family == "rf":
        return RandomForestRegressor(maxBins=MAX_INDEXED_LEVELS, **spec.params)
    if spec.family == "huber":
        return LinearRegression(loss="huber", standardization=True, maxIter=50, **spec.params)
    if spec.family == "poisson":
        return GeneralizedLinearRegression(family="poisson", link="log", maxIter=25, regParam=1e-3, **spec.params)
    raise ValueError(f"unknown model family: {spec.family}")


def fit(train: DataFrame, spec: Spec, features: list[str] = FEATURE_COLS, label: str = LABEL,
        categorical: list[str] = CATEGORICAL_COLS) -> FittedModel:
    return FittedModel(spec, features, label, train, categorical)


def fit_encoders(train: DataFrame, spec: Spec, features: list[str] = FEATURE_COLS, label: str = LABEL,
                 categorical: list[str] = CATEGORICAL_COLS) -> FittedModel:
    """What ``design`` needs, without fitting the regressor."""
    return FittedModel(spec, features, label, train, categorical, learn=False)


def fit_predict(train: DataFrame, val: DataFrame, spec: Spec, features: list[str] = FEATURE_COLS, label: str = LABEL,
                categorical: list[str] = CATEGORICAL_COLS) -> DataFrame:
    return fit(train, spec, features, label, categorical).predict(val)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, by column name."""
    return reduce(DataFrame.unionByName, parts)


def fit_models(train: DataFrame, specs: list[Spec], features: list[str] = FEATURE_COLS) -> dict[str, FittedModel]:
    """Each model once on the same rows; every label must be there."""
    if train.filter(F.col(LABEL).isNull()).limit(1).count():
        raise ValueError("a training row has no label")
    fitted = side_by_side(train.sparkSession, [partial(fit, train, s, features) for s in specs])
    return {s.name: model for s, model in zip(specs, fitted)}


def predict_models(fitted: dict[str, FittedModel], df: DataFrame) -> DataFrame:
    """One ``pred_<name>`` column per model."""
    for name, model in fitted.items():
        df = model.predict(df).withColumnRenamed("prediction", f"pred_{name}")
    return df


def top_importances(spark, model: FittedModel, n: int = 15) -> DataFrame:
    rows = spark.createDataFrame(model.importances(), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(n)


# ---------------------------------------------------------------- one model per item

# Every numeric model input.
LOCAL_FEATURES = [c for c in FEATURE_COLS if c not in CATEGORICAL_COLS]


def local_per_item(train: DataFrame, val: DataFrame, features: list[str] = LOCAL_FEATURES, ridge: float = 1e-3) -> DataFrame:
    """Ridge regression per item from sums of products: one pass, and no item's rows are ever gathered.

    Items with fewer than MIN_LOCAL_ROWS training rows get no forecast.
    """
    xs = ["_one", *features]
    k = len(xs)

    def ready(df: DataFrame) -> DataFrame:
        return df.withColumn("_one", F.lit(1.0)).withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ready(train).groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(x) * F.col(LABEL)) for x in xs]).alias("xy"))

    def solve(batches):
        for pdf in batches:
            out = []
            for n, xx, xy in zip(pdf["n"], pdf["xx"], pdf["xy"]):
                if n < MIN_LOCAL_ROWS:
                    out.append(None)
                    continue
                g = np.zeros((k, k))
                for (i, j), v in zip(pairs, xx):
                    g[i, j] = g[j, i] = v
                d = np.sqrt(np.maximum(np.diag(g), 1e-12))
                reg = ridge * np.eye(k)
                reg[0, 0] = 0.0
                out.append((np.linalg.solve(g / np.outer(d, d) + reg, np.asarray(xy) / d) / d).tolist())
            yield pd.DataFrame({"sku": pdf["sku"], "coef": out})

    coefs = sums.mapInPandas(solve, "sku string, coef array<double>")
    scored = ready(val).join(coefs, "sku", "left")
    dot = F.aggregate(F.zip_with(F.array(*xs), F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return scored.withColumn("prediction", F.when(F.col("coef").isNotNull(), dot)).select(*val.columns, "prediction")


# ---------------------------------------------------------------- exponential smoothing on a few series

def _smooth(y: np.ndarray, a: float, b: float, g: float, steps: int) -> tuple[float, np.ndarray]:
    """Additive trend and season; without two full seasons the season stays at zero."""
    m = SEASON
    seasonal = len(y) >= 2 * m
    s = np.zeros(m)
    level, trend, start = y[0], 0.0, 1
    if seasonal:
        middle, trend = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
        line = middle + trend * (np.arange(m) - (m - 1) / 2)
        s, level, start = y[:m] - line, line[-1], m
    sse = 0.0
    for t in range(start, len(y)):
        i = t % m
        err = y[t] - (level + trend + s[i])
        sse += err * err
        new = level + trend + a * err
        trend += a * b * err
        level = new
        if seasonal:
            s[i] += g * (1 - a) * err
    ahead = [level + (h + 1) * trend + s[(len(y) + h) % m] for h in range(steps)]
    return sse, np.asarray(ahead)


GRID = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.05, 0.2) for g in (0.05, 0.2, 0.5)]


def holt_winters(train: DataFrame, val: DataFrame, n_series: int = TOP_SERIES) -> DataFrame:
    """Fixed-origin forecasts for the best-selling series. Each (series, parameter set) is one task row holding one
    series of calendar length; the set with the smallest in-sample error wins."""
    top = train.groupBy(*SERIES).agg(F.sum("units_sold").alias("_u")).orderBy(F.desc("_u"), *SERIES).limit(n_series)
    lines = train.join(F.broadcast(top.drop("_u")), SERIES, "left_semi").groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct("week", F.col("units_sold").cast("double").alias("y")))).alias("line"))
    lines = lines.filter(F.size("line") >= MIN_SERIES_POINTS).select(
        *SERIES, F.transform("line", lambda p: p["y"]).alias("y"), F.element_at("line", -1)["week"].alias("last"))
    horizon = val.join(F.broadcast(lines.select(*SERIES, "last")), SERIES).select(
        *WEEK_KEYS, LABEL, F.expr("datediff(week, last) div 7 + 1").alias("step"))
    steps = horizon.groupBy(*SERIES).agg(F.max("step").alias("steps"))
    grid = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abg", p)]) for p in GRID]))
    tasks = lines.join(F.broadcast(steps), SERIES).withColumn("p", grid).select(*SERIES, "y", "steps", "p.a", "p.b", "p.g")

    def run(batches):
        for pdf in batches:
            fits = [_smooth(np.asarray(y, float), a, b, g, int(n))
                    for y, a, b, g, n in zip(pdf["y"], pdf["a"], pdf["b"], pdf["g"], pdf["steps"])]
            out = pdf[[*SERIES, "a", "b", "g"]].copy()
            out["sse"] = [f[0] for f in fits]
            out["ahead"] = [f[1].tolist() for f in fits]
            yield out

    fitted = tasks.repartition(*SERIES, "a", "b", "g").mapInPandas(
        run, "sku string, channel string, region string, a double, b double, g double, sse double, ahead array<double>")
    best = fitted.groupBy(*SERIES).agg(F.min_by(F.struct("ahead", "a", "b", "g"), F.struct("sse", "a", "b", "g")).alias("best"))
    return horizon.join(F.broadcast(best), SERIES).select(
        *WEEK_KEYS, LABEL, F.get(F.col("best.ahead"), F.col("step").cast("int") - 1).alias("prediction"))


# ---------------------------------------------------------------- launch-time models

def _cutoffs(held_out: DataFrame) -> list:
    """Distinct launch Mondays of the short held-out list."""
    return sorted(r[0] for r in held_out.select(F.trunc("first_seen", "week")).distinct().collect())


def launch_model(panel: DataFrame, held_out: DataFrame, spec: Spec, features: list[str],
                 categorical: list[str] = CATEGORICAL_COLS) -> DataFrame:
    """Frozen at each launch Monday: fitted on labels known by then, without any held-out item."""
    held_out = cut_lineage(held_out)
    def at(cutoff) -> DataFrame:
        day = F.lit(cutoff)
        train = launch.label_known(panel, day, held_out)
        if not train.limit(1).count():
            raise ValueError(f"no training labels available before {cutoff}")
        now = held_out.filter(F.trunc("first_seen", "week") == day).select("sku")
        part = fit_predict(train, panel.join(now, "sku", "left_semi"), spec, features, LABEL, categorical)
        return part.withColumn("train_cutoff", day)

    return stacked(side_by_side(panel.sparkSession, [partial(at, c) for c in _cutoffs(held_out)]))


def meta_learner(panel: DataFrame, held_out: DataFrame, spec: Spec, features: list[str]) -> DataFrame:
    """Launch-time model without any history feature."""
    return launch_model(panel, held_out, spec, [c for c in features if c not in HISTORY_FEATURES])


def zero_history(records: DataFrame, held_out: DataFrame, spec: Spec) -> DataFrame:
    """Launch units from metadata and calendar alone, one fit per distinct launch day."""
    records, held_out = cut_lineage(records), cut_lineage(held_out)
    days = sorted(r[0] for r in records.join(held_out.select("sku"), "sku", "left_semi").select(
        "week").distinct().collect())
    donors = cut_lineage(records.join(held_out.select("sku"), "sku", "left_anti"))

    def at(day) -> DataFrame:
        train = donors.filter(F.col("label_available_at") <= F.lit(day))
        if not train.limit(1).count():
            raise ValueError(f"no completed training launches before {day}")
        now = records.filter(F.col("week") == F.lit(day)).join(held_out.select("sku"), "sku", "left_semi")
        return fit_predict(train, now, spec, ZERO_HISTORY_FEATURES, "launch_units",
                           ["category", "segment", "brand", "channel", "region"]).withColumnRenamed("prediction", "pred_zero_model")

    return stacked(side_by_side(records.sparkSession, [partial(at, d) for d in days]))


# ---------------------------------------------------------------- entity vectors

def fit_embeddings(train: DataFrame, dims: dict[str, int] = EMBEDDING_DIMS, label: str = LABEL, iterations: int = 8) -> dict:
    """Per entity a table (entity, vector), from factorising entity x other-keys mean labels of the training rows."""
    tables = {}
    for entity, dim in dims.items():
        others = [k for k in SERIES if k != entity]
        cells = train.groupBy(entity, *others).agg(F.avg(label).cast("float").alias("rating"))
        cells = cut_lineage(cells.withColumn("_cell", F.concat_ws("|", *others)))
        users = cut_lineage(dense_ids(cells.select(entity).distinct(), [entity], "user", 0))
        items = cut_lineage(dense_ids(cells.select("_cell").distinct(), ["_cell"], "item", 0))
        ratings = cells.join(users, entity).join(items, "_cell").select(
            F.col("user").cast("int"), F.col("item").cast("int"), "rating")
        als = ALS(rank=dim, maxIter=iterations, regParam=0.05, seed=SEED, userCol="user", itemCol="item", ratingCol="rating")
        factors = als.fit(ratings).userFactors
        tables[entity] = factors.join(users, factors["id"] == users["user"]).select(
            F.col(entity).alias("entity"), F.col("features").alias("vector"))
    return tables


def with_embeddings(df: DataFrame, tables: dict, dims: dict[str, int] = EMBEDDING_DIMS) -> DataFrame:
    for entity, table in tables.items():
        df = encode.lookup_embeddings(df, table, entity, dims[entity])
    return df


def embedding_columns(dims: dict[str, int] = EMBEDDING_DIMS) -> list[str]:
    return [f"{e}_emb_{i}" for e, d in dims.items() for i in range(d)]


# ---------------------------------------------------------------- cross-validation

Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def pooled_variant(spec: Spec, features: list[str] = FEATURE_COLS) -> Predictor:
    return lambda train, val: fit_predict(train, val, spec, features).select(*WEEK_KEYS, "prediction")


def embedding_variant(spec: Spec, features: list[str] = FEATURE_COLS) -> Predictor:
    def run(train: DataFrame, val: DataFrame) -> DataFrame:
        tables = fit_embeddings(train)
        return fit_predict(with_embeddings(train, tables), with_embeddings(val, tables), spec,
                           features + embedding_columns()).select(*WEEK_KEYS, "prediction")
    return run


def local_variant() -> Predictor:
    return lambda train, val: local_per_item(train, val).select(*WEEK_KEYS, "prediction")


def without_groups(features: list[str] = FEATURE_COLS) -> dict[str, list[str]]:
    """Feature list per removed group; the groups must cover every non-identity feature exactly once."""
    flat = [c for cols in FEATURE_GROUPS.values() for c in cols]
    identity = [c for c in features if c not in flat]
    if len(flat) != len(set(flat)) or set(flat) | set(identity) != set(features):
        raise ValueError("feature groups must be disjoint and cover all features")
    return {f"without_{g}": [c for c in features if c not in cols] for g, cols in FEATURE_GROUPS.items()}


def run_cv(features: DataFrame, calendar: DataFrame, variants: dict[str, Predictor], folds: list[int] | None = None,
           store=None) -> DataFrame:
    """Ledger of every variant on every fold. Fold frames are read from the materialised feature table; with a
    ``store``, finished (variant, fold) parts are restored instead of refitted."""
    placed = cut_lineage(splits.attach_folds(features, calendar).filter(~F.col("is_holdout")))
    if folds is None:
        folds = list(range(1, (calendar.agg(F.max("n_folds")).first()[0] or 0) + 1))
    def part(fold: int, name: str) -> DataFrame:
        train = placed.filter(F.col("fold_id") < fold).drop("fold_id", "n_folds", "is_holdout")
        val = placed.filter(F.col("fold_id") == fold).drop("fold_id", "n_folds", "is_holdout")
        if store is not None:
            return store.obtain(val, name, fold, lambda: variants[name](train, val))
        return cut_lineage(ledger.prediction_rows(val, variants[name](train, val), name, fold))

    return stacked(side_by_side(features.sparkSession, [partial(part, fold, name) for fold in folds for name in variants]))


def ablation(long: DataFrame, full: str, groups: list[str]) -> DataFrame:
    """Change of macro WAPE when a feature group is removed, worst first."""
    scores = ledger.macro_scores(long).select("model_id", "WAPE")
    reference = scores.filter(F.col("model_id") == full).agg(F.max("WAPE")).scalar()
    return scores.filter(F.col("model_id").isin(groups)).withColumn("_full", reference).select(
        F.expr("substring(model_id, length('without_') + 1)").alias("group_removed"), F.col("WAPE").alias("WAPE_without"),
        (F.col("WAPE") - F.col("_full")).alias("WAPE_increase"),
        (100 * ratio(F.col("WAPE") - F.col("_full"), F.col("_full"))).alias("pct_increase")).orderBy(F.desc("WAPE_increase"))


# ---------------------------------------------------------------- daily-grain tuning and comparison

DAILY_BASE = SERIES + ["units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "daily_lag_7", "daily_lag_14",
                       "daily_lag_28", "horizon", "target_dow", "target_month", "target_week_number"]
_WEEKDAY = [f"daily_lag_{k}" for k in daily_grain.WEEKDAY_LAGS]
DAILY_ENHANCED = ([c for c in DAILY_BASE if not c.startswith("daily_lag_")] + _WEEKDAY + [f"{c}_observed" for c in _WEEKDAY]
                  + ["same_dow_mean_4", "same_dow_mean_8", "same_dow_median_8", "same_dow_std_8", "last_week_share",
                     "same_dow_share_mean_3"])
DAILY_ROLLING = SERIES + ["daily_lag_1", "daily_lag_7", "daily_lag_14", "daily_lag_28", "daily_rolling_mean_7",
                          "daily_rolling_mean_28", "target_dow", "target_month", "target_week_number"]
COMPACT_WEEKLY = SERIES + ["units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "target_week_number",
                           "target_month", "target_year"]

# The nine tuning candidates as (feature set, model). Leaf limits are expressed as tree depth.
CANDIDATES = {
    "base_l2": ("base", _gbt("base_l2")),
    "enhanced_l2": ("enhanced", _gbt("enhanced_l2")),
    "enhanced_l1": ("enhanced", _gbt("enhanced_l1", loss="absolute")),
    "enhanced_huber": ("enhanced", Spec("enhanced_huber", "huber", "target")),
    "enhanced_poisson": ("enhanced", Spec("enhanced_poisson", "poisson", "target")),
    "enhanced_l1_small_leaves": ("enhanced", _gbt("enhanced_l1_small_leaves", loss="absolute", maxDepth=4,
                                                  minInstancesPerNode=40)),
    "enhanced_l1_flexible": ("enhanced", _gbt("enhanced_l1_flexible", loss="absolute", maxDepth=6, minInstancesPerNode=10)),
    "enhanced_l1_slow": ("enhanced", _gbt("enhanced_l1_slow", loss="absolute", maxIter=500, stepSize=0.03)),
    "enhanced_l2_flexible": ("enhanced", _gbt("enhanced_l2_flexible", maxDepth=6, minInstancesPerNode=10)),
}


def leaderboard(scores: DataFrame) -> DataFrame:
    """Candidates by pooled WAPE, then name; position 1 is the locked winner. One row per candidate."""
    order = Window.orderBy(F.floor(F.col("pooled_wape") * 1e12), "candidate")
    return scores.withColumn("position", F.row_number().over(order))


def _floored(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


def tune_fixed_origin(frame: DataFrame, calendar: DataFrame, candidates: dict = CANDIDATES, dev_folds: int = DEV_FOLDS) -> DataFrame:
    """Score every candidate on the first folds only, summed to weeks; later folds stay untouched."""
    placed = cut_lineage(splits.attach_folds(frame, calendar).filter(F.col("fold_id") <= dev_folds))

    def part(name: str, fold: int) -> DataFrame:
        features, spec = candidates[name]
        train, val = placed.filter(F.col("fold_id") < fold), placed.filter(F.col("fold_id") == fold)
        cols = DAILY_BASE if features == "base" else DAILY_ENHANCED
        scored = _floored(fit_predict(train, val, spec, cols, "target_daily", SERIES))
        return cut_lineage(daily_grain.daily_to_weekly(scored)).withColumns(
            {"candidate": F.lit(name), "feature_set": F.lit(features), "fold_id": F.lit(fold)})

    out = stacked(side_by_side(frame.sparkSession, [partial(part, name, fold) for name in candidates for fold in range(1, dev_folds + 1)]))
    err, total = F.abs(F.col("actual") - F.col("prediction")), F.abs("actual")
    per_fold = out.groupBy("candidate", "feature_set", "fold_id").agg(
        F.sum(err).alias("_e"), F.sum(total).alias("_a"), ratio(F.sum(err), F.sum(total)).alias("_w"))
    return leaderboard(per_fold.groupBy("candidate", "feature_set").agg(
        ratio(F.sum("_e"), F.sum("_a")).alias("pooled_wape"), F.avg("_w").alias("mean_fold_wape")))


def grain_comparison(daily: DataFrame, features: DataFrame, calendar: DataFrame, folds: list[int], spec: Spec) -> DataFrame:
    """Same folds, four grains: compact weekly, full weekly, daily fixed origin summed, daily one-day-ahead summed."""
    weekly = cut_lineage(splits.attach_folds(daily_grain.compact_weekly(features), calendar).filter(~F.col("is_holdout")))
    fixed = cut_lineage(splits.attach_folds(daily_grain.fixed_origin_panel(daily, features.select(
        *WEEK_KEYS, "units_sold", "lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", LABEL)), calendar).filter(~F.col("is_holdout")))
    keys = weekly.select(*WEEK_KEYS, "fold_id")
    rolling = cut_lineage(daily_grain.rolling_panel(daily).join(keys, WEEK_KEYS))

    def scores(table: DataFrame, fold: int, cols: list[str], label: str, cats: list[str]) -> DataFrame:
        train, val = table.filter(F.col("fold_id") < fold), table.filter(F.col("fold_id") == fold)
        return _floored(fit_predict(train, val, spec, cols, label, cats))

    grains = {
        "compact_weekly": lambda fold: scores(weekly, fold, COMPACT_WEEKLY, LABEL, SERIES).withColumnRenamed(LABEL, "actual"),
        "full_weekly": lambda fold: scores(weekly, fold, FEATURE_COLS, LABEL, CATEGORICAL_COLS).withColumnRenamed(LABEL, "actual"),
        "daily_then_sum": lambda fold: daily_grain.daily_to_weekly(scores(fixed, fold, DAILY_BASE, "target_daily", SERIES)),
        "daily_rolling": lambda fold: daily_grain.daily_to_weekly(scores(rolling, fold, DAILY_ROLLING, "units_sold_daily", SERIES)
                                                                  .withColumnRenamed("units_sold_daily", "target_daily")),
    }

    def row(fold: int, name: str) -> DataFrame:
        return grains[name](fold).agg(forecast_metrics("actual", "prediction")["WAPE"].alias("WAPE")).select(
            F.lit(name).alias("model_id"), F.lit(fold).alias("fold_id"), "WAPE")

    return stacked(side_by_side(daily.sparkSession, [partial(row, fold, name) for fold in folds for name in grains]))
