"""Cluster and block bootstraps on pre-aggregated error sums, with draws any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.hashing import draw_index, poisson_draw, weight_of
from tidepanel.functions.numeric import is_finite, ratio
from tidepanel.operators.identifiers import dense_ids
from tidepanel.schema import SERIES
from tidepanel.session import cut_lineage

LOW, HIGH = 0.025, 0.975


def numbered(clusters: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per key with its 0-based index, materialised: it is both drawn from and summed over."""
    sums = clusters.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return cut_lineage(dense_ids(sums, keys, "idx", start=0).select("idx", *measures))


def clustered(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per cluster with its summed measures, materialised: it gives the point and every repetition."""
    return cut_lineage(rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]))


def draws(clusters: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """Each cluster once per repetition, with ``rep`` and its Poisson weight ``w``, which is 0 where it is not drawn.

    Weights are hashes of (seed, repetition, cluster), so no draw is looked up, nothing is numbered, and a sum over the
    result combines where the clusters lie.
    """
    copies = clusters.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    return copies.withColumn("_draw", poisson_draw(F.lit(seed), "rep", *keys)).withColumn("w", weight_of(F.col("_draw"))).drop("_draw")


def weighted(clusters: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """Each cluster once per repetition that draws it."""
    return draws(clusters, keys, reps, seed).filter("w > 0")


def bootstrap_sums(clusters: DataFrame, keys: list[str], measures: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, measures) of ``reps`` Poisson resamples that draw a cluster; a task sends one row per repetition whatever its clusters.

    Undrawn clusters are left out of the sums, not of the rows: a filter would be moved below the hash and hash again.
    """
    sums = draws(clusters, keys, reps, seed).groupBy("rep").agg(
        *[F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(m))).alias(m) for m in measures], F.max("w").alias("_drawn"))
    return sums.filter("_drawn > 0").drop("_drawn")


def _interval(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Percentile interval; one row per repetition, so the exact percentile is cheap."""
    return diffs.groupBy(*by).agg(
        F.percentile("diff", F.lit(LOW)).alias("ci_low"), F.percentile("diff", F.lit(HIGH)).alias("ci_high"),
        F.count("diff").alias("valid_reps"), F.avg((F.col("diff") < 0).cast("int")).alias("share_below_zero"))


def paired_errors(ledger: DataFrame, model_a: str, model_b: str, keys: list[str]) -> DataFrame:
    """Per key: actual and both absolute errors; the models must cover identical keys with predictions."""
    err = F.abs(F.col("prediction") - F.col("actual"))
    pair = ledger.filter(F.col("model_id").isin(model_a, model_b)).groupBy(*keys).agg(
        F.max("actual").alias("actual"),
        F.max(F.when(F.col("model_id") == model_a, err)).alias("err_a"),
        F.max(F.when(F.col("model_id") == model_b, err)).alias("err_b"), F.count(F.lit(1)).alias("_n"))
    problem = F.when((F.col("_n") != 2) | F.col("err_a").isNull() | F.col("err_b").isNull(),
                     F.raise_error(F.lit("a key lacks one of both predictions or has one twice")))
    # As a filter the rule holds whichever columns are read afterwards.
    return pair.filter(F.coalesce(problem.cast("boolean"), F.lit(True))).drop("_n")


def cluster_bootstrap(ledger: DataFrame, model_a: str, model_b: str, keys: list[str], reps: int = 2000,
                      seed: int = 42, cluster: list[str] = SERIES) -> DataFrame:
    """Percentile interval of WAPE(b) - WAPE(a), resampling whole series."""
    measures = ["actual", "err_a", "err_b"]
    rows = clustered(paired_errors(ledger, model_a, model_b, keys), cluster, measures)
    sums = bootstrap_sums(rows, cluster, measures, reps, seed)
    diffs = sums.select(ratio(F.col("err_b") - F.col("err_a"), F.col("actual")).alias("diff"))
    point = rows.agg(
        ratio(F.sum("err_a"), F.sum("actual")).alias("WAPE_a"), ratio(F.sum("err_b"), F.sum("actual")).alias("WAPE_b"),
        F.count(F.lit(1)).alias("n_series"))
    point = point.withColumn("diff_b_minus_a", F.col("WAPE_b") - F.col("WAPE_a"))
    interval = _interval(diffs, []).select(F.struct("ci_low", "ci_high", "valid_reps"))
    return point.withColumn("_i", interval.scalar()).select(
        F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"), "WAPE_a", "WAPE_b", "diff_b_minus_a",
        "_i.ci_low", "_i.ci_high", "n_series", F.col("_i.valid_reps").alias("n_boot"),
        ((F.col("_i.ci_low") > 0) | (F.col("_i.ci_high") < 0)).alias("ci_excludes_0"))


def item_bootstrap(predictions: DataFrame, baseline: str, models: dict[str, str], actual: str = "launch_units",
                   reps: int = 2000, seed: int = 42) -> DataFrame:
    """Paired differences WAPE(baseline) - WAPE(other), resampling whole items; all-zero repetitions are dropped."""
    common = predictions.dropna(subset=list(models.values()))
    errors = common.select("sku", F.abs(F.col(actual)).alias("actual"),
                           *[F.abs(F.col(actual) - F.col(c)).alias(f"err_{m}") for m, c in models.items()])
    measures = ["actual"] + [f"err_{m}" for m in models]
    rows = clustered(errors, ["sku"], measures)
    others = [m for m in models if m != baseline]

    def differences(df: DataFrame) -> DataFrame:
        items = F.array(*[F.struct(F.lit(f"{baseline} minus {m}").alias("comparison"),
                                   ratio(F.col(f"err_{baseline}") - F.col(f"err_{m}"), F.col("actual")).alias("diff"))
                          for m in others])
        return df.select(F.explode(items).alias("d")).select("d.*")

    point = differences(rows.agg(*[F.sum(m).alias(m) for m in measures])).withColumnRenamed("diff", "wape_difference")
    sums = bootstrap_sums(rows, ["sku"], measures, reps, seed).filter("actual > 0")
    spread = _interval(differences(sums), ["comparison"])
    return point.join(spread, "comparison").withColumn("n_skus", rows.agg(F.count(F.lit(1))).scalar()).select(
        "comparison", "wape_difference", "ci_low", "ci_high", "n_skus", "valid_reps")


def circular_block_bootstrap(weekly: DataFrame, challenger: str, baseline: str, actual: str = "actual_total",
                             reps: int = 20_000, block_weeks: int = 4, seed: int = 42) -> DataFrame:
    """Paired WAPE difference, resampling contiguous week blocks that wrap around; one input row per week."""
    measures = [actual, challenger, baseline]
    rows = numbered(weekly, ["target_week"], measures)
    n = rows.agg(F.count(F.lit(1))).scalar()
    # Draw position p lies in block floor(p / block_weeks) at offset p mod block_weeks.
    position = rows.select(F.col("idx").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    block, offset = F.floor(F.col("p") / block_weeks), F.col("p") % block_weeks
    drawn = position.select("rep", F.pmod(draw_index(n, F.lit(seed), F.col("rep"), block) + offset, n).alias("idx"))
    sums = drawn.join(rows, "idx").groupBy("rep").agg(*[F.sum(m).alias(m) for m in measures])

    def diff(df: DataFrame) -> DataFrame:
        return df.select(ratio(F.col(challenger) - F.col(baseline), F.col(actual)).alias("diff"))

    point = diff(rows.agg(*[F.sum(m).alias(m) for m in measures])).withColumnRenamed("diff", "point_difference")
    spread = _interval(diff(sums), []).select(F.struct("ci_low", "ci_high", "share_below_zero"))
    return point.withColumn("_i", spread.scalar()).select(
        F.lit(challenger).alias("challenger"), F.lit(baseline).alias("baseline"), F.lit(block_weeks).alias("block_weeks"),
        "point_difference", "_i.ci_low", "_i.ci_high", F.col("_i.share_below_zero").alias("probability_challenger_better"))
