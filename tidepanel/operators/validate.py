"""Formal checks on the daily and weekly tables, each a DataFrame of (check, passed, n_failures, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.rollup import lag_features, next_week_target, weekly_rollup
from tidepanel.schema import DAY_KEYS, LABEL, WEEK_KEYS

LAG_TOLERANCE = 1e-6


def clip_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise negative quantities to zero and mark the rows touched."""
    touched = F.greatest(*[F.coalesce(F.when(F.col(c) < 0, 1), F.lit(0)) for c in columns]) if len(columns) > 1 \
        else F.coalesce(F.when(F.col(columns[0]) < 0, 1), F.lit(0))
    flagged = df.withColumn("was_negative", touched)
    return flagged.withColumns({c: F.greatest(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total rows minus distinct keys. Counting per key first keeps a heavily repeated key cheap."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def stack_checks(one_row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn a one-row table of failure counts into the report form."""
    items = F.array(*[F.struct(F.lit(n).alias("check"), (bad == 0).alias("passed"),
                               bad.cast("bigint").alias("n_failures"), detail.alias("detail"))
                      for n, bad, detail in checks])
    return one_row.select(F.explode(items).alias("r")).select("r.*")


def _rows_detail(bad: Column) -> Column:
    return F.concat(bad.cast("string"), F.lit(" row(s)"))


def _of_detail(bad: Column, total: str) -> Column:
    return F.concat(bad.cast("string"), F.lit("/"), F.col(total).cast("string"), F.lit(" mismatched"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = F.col("n_duplicates")
    return stack_checks(duplicate_rows(df, keys), [(f"unique {'-'.join(keys)}", bad, _rows_detail(bad))])


def check_ranges(df: DataFrame, table: str, non_negative: list[str], positive: list[str]) -> DataFrame:
    """All range checks of a table in one pass."""
    counts = df.agg(*[count_if(F.col(c) < 0).alias(f"neg_{c}") for c in non_negative],
                    *[count_if(F.col(c) <= 0).alias(f"pos_{c}") for c in positive])
    checks = [(f"{table} {c} >= 0", F.col(f"neg_{c}"), _rows_detail(F.col(f"neg_{c}"))) for c in non_negative]
    checks += [(f"{table} {c} > 0", F.col(f"pos_{c}"), _rows_detail(F.col(f"pos_{c}"))) for c in positive]
    return stack_checks(counts, checks)


def check_weekly_rollup(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Recompute weekly sales from the daily table and count differing weeks."""
    again = weekly_rollup(daily).select(*WEEK_KEYS, F.col("units_sold").alias("_again"))
    both = weekly.select(*WEEK_KEYS, "units_sold").join(again, WEEK_KEYS)
    counts = both.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("units_sold") != F.col("_again")).alias("bad"))
    return stack_checks(counts, [("weekly sums match daily rows", F.col("bad"), _of_detail(F.col("bad"), "n"))])


def check_target(weekly: DataFrame) -> DataFrame:
    """The label must be the sales of the series' next row, wherever both exist."""
    follow = next_week_target(weekly.withColumnRenamed(LABEL, "_stored"))
    usable = follow.filter(F.col("_stored").isNotNull() & F.col(LABEL).isNotNull())
    counts = usable.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_stored") != F.col(LABEL)).alias("bad"))
    return stack_checks(counts, [("label is next week's sales", F.col("bad"), _of_detail(F.col("bad"), "n"))])


def check_lags(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Every history feature must equal its recomputation from past weeks of the daily table."""
    cols = ["lag_1", "lag_2", "rolling_mean_4", "rolling_std_4", "momentum"]
    again = lag_features(weekly_rollup(daily)).select(*WEEK_KEYS, *[F.col(c).alias(f"_{c}") for c in cols])
    both = weekly.select(*WEEK_KEYS, *cols).join(again, WEEK_KEYS)

    def differs(c: str) -> Column:
        if c in ("lag_1", "lag_2"):
            return F.coalesce(F.round(c, 3) != F.round(f"_{c}", 3), F.lit(True))
        return F.abs(F.col(c) - F.col(f"_{c}")) > LAG_TOLERANCE

    counts = both.agg(F.count(F.lit(1)).alias("n"), *[count_if(differs(c)).alias(c) for c in cols])
    return stack_checks(counts, [(f"{c} uses past weeks only", F.col(c), _of_detail(F.col(c), "n")) for c in cols])


def run_all_checks(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """The 17-row validation report."""
    parts = [
        check_unique(daily, DAY_KEYS),
        check_unique(weekly, WEEK_KEYS),
        check_ranges(daily, "daily", ["units_sold", "stock_available", "delivered_qty"], ["price_unit"]),
        check_ranges(weekly, "weekly", ["units_sold", "stock_available", "sku_age"], ["price_unit"]),
        check_weekly_rollup(daily, weekly),
        check_target(weekly),
        check_lags(daily, weekly),
    ]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report
