"""Paired comparisons over folds. Inputs are one row per fold, so the tests run on arrays of fold length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidepanel.functions.numeric import student_quantile, student_sf2

_TESTS = T.StructType([T.StructField(n, T.DoubleType()) for n in
                       ("t_stat", "p_value", "ci_low", "ci_high", "wilcoxon_w", "wilcoxon_p", "sign_p")])


def _signed_rank(diffs: list[float]) -> tuple[float, float]:
    """Wilcoxon signed-rank statistic and exact two-sided p over all sign patterns of the ranks."""
    kept = sorted((d for d in diffs if d != 0), key=abs)
    n = len(kept)
    if n == 0:
        return 0.0, 1.0
    ranks = [0.0] * n
    i = 0
    while i < n:
        j = i
        while j + 1 < n and abs(kept[j + 1]) == abs(kept[i]):
            j += 1
        for k in range(i, j + 1):
            ranks[k] = (i + j) / 2 + 1
        i = j + 1
    plus = sum(r for r, d in zip(ranks, kept) if d > 0)
    w = min(plus, sum(ranks) - plus)
    ways = {0.0: 1}
    for r in ranks:
        nxt = dict(ways)
        for total, count in ways.items():
            nxt[total + r] = nxt.get(total + r, 0) + count
        ways = nxt
    low = sum(c for total, c in ways.items() if total <= w + 1e-12)
    return w, min(1.0, 2.0 * low / 2 ** n)


@F.udf(_TESTS)
def _paired_tests(diffs):
    n = len(diffs)
    mean = sum(diffs) / n
    sd = math.sqrt(sum((d - mean) ** 2 for d in diffs) / (n - 1)) if n > 1 else 0.0
    w, wp = _signed_rank(diffs)
    k = sum(d > 0 for d in diffs)
    k = min(k, n - k)
    sign = min(1.0, 2.0 * sum(math.comb(n, j) for j in range(k + 1)) / 2 ** n)
    if sd == 0.0:
        return None, None, mean, mean, w, wp, sign
    se = sd / math.sqrt(n)
    t = mean / se
    half = student_quantile(0.975, n - 1) * se
    return t, student_sf2(t, n - 1), mean - half, mean + half, w, wp, sign


def holm(df: DataFrame, p: str = "p_value", m: str = "p_holm") -> DataFrame:
    """Step-down adjustment across the comparisons of one table."""
    w = Window.orderBy(p)
    stepped = df.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    run = F.max((F.col("_m") - F.col("_k") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn(m, F.least(run, F.lit(1.0))).drop("_k", "_m")


def paired_fold_tests(fold_scores: DataFrame, reference: str, challengers: list[str], metric: str = "WAPE") -> DataFrame:
    """reference - challenger per fold: paired t with interval, signed-rank, sign test and Holm-adjusted p."""
    wide = fold_scores.groupBy("fold_id").pivot("model_id", [reference, *challengers]).agg(F.max(metric))
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("challenger"), (F.col(reference) - F.col(c)).alias("diff"))
                                for c in challengers]))
    long = wide.select("fold_id", items.alias("d")).select("fold_id", "d.*").filter(F.col("diff").isNotNull())
    per = long.groupBy("challenger").agg(
        F.array_sort(F.collect_list(F.struct("fold_id", "diff"))).alias("_folds"), F.count("diff").alias("n_folds"),
        F.avg("diff").alias("mean_diff"), F.sum((F.col("diff") > 0).cast("int")).alias("n_positive"))
    tested = per.withColumn("_t", _paired_tests(F.transform("_folds", lambda s: s["diff"])))
    out = tested.select(F.lit(reference).alias("reference"), "challenger", "n_folds", "n_positive", "mean_diff", "_t.*")
    return holm(out).withColumn("significant", F.col("p_holm") <= 0.05)
