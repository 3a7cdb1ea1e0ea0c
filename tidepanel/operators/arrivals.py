"""New batches: append, rebuild, carry forward what a batch cannot update, and prove that the past did not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidepanel.functions.numeric import ratio
from tidepanel.operators.features import (add_context, add_series_features, category_week_stats, item_table)
from tidepanel.operators.rollup import add_age_and_calendar, internal_columns, labelled_weeks
from tidepanel.operators.validate import count_if
from tidepanel.schema import DAILY_COLUMNS, FEATURE_TABLE_COLUMNS, LABEL, WEEK_KEYS
from tidepanel.session import cut_lineage
from tidepanel.sources.tables import to_daily

TOLERANCE = 1e-9
CARRIED = ["category_trend", "category_price"]


def append_batches(history: DataFrame, batches: DataFrame) -> DataFrame:
    """History and new rows on the contract columns."""
    return history.select(*DAILY_COLUMNS).unionByName(batches.select(*DAILY_COLUMNS))


def new_weeks(panel: DataFrame, known: DataFrame) -> DataFrame:
    return panel.select("week").distinct().subtract(known.select("week").distinct())


def carry_forward(df: DataFrame, columns: list[str], keys: list[str], order: str = "week") -> DataFrame:
    """Fill missing values with the last known one in the group."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def last_known_stats(features: DataFrame) -> DataFrame:
    """Category trend per region and category price of the last history week, the values frozen for new batches."""
    stats = category_week_stats(features)
    return stats.filter(F.col("week") == features.agg(F.max("week")).scalar()).select("category", "region", *CARRIED)


def rebuilt_features(daily: DataFrame, frozen: DataFrame) -> DataFrame:
    """Feature rows rebuilt from appended facts; cross-item columns come from the frozen history values."""
    base = cut_lineage(add_age_and_calendar(labelled_weeks(daily, extra=internal_columns()), item_table(daily)))
    priced = add_context(base).join(frozen, ["category", "region"], "left").withColumn(
        "price_index", ratio(F.col("price_unit"), F.col("category_price")))
    return add_series_features(priced).select(*FEATURE_TABLE_COLUMNS)


def column_parity(a: DataFrame, b: DataFrame, columns: list[str], keys: list[str] = WEEK_KEYS,
                  tol: float = TOLERANCE) -> DataFrame:
    """(column, rows_compared, mismatches) over the keys both tables have; numbers within tol, text exactly,
    a value on one side only always counts. The row ``(missing rows)`` counts the rows of ``a`` that ``b`` lacks."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_found"))
    both = left.join(right, keys, "left")
    found = F.col("_found").isNotNull()

    def differs(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if isinstance(a.schema[c].dataType, T.NumericType):
            return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tol, F.lit(False))
        return ~x.eqNullSafe(y)

    counts = both.agg(count_if(found).alias("_n"), count_if(~found).alias("_missing"), *[count_if(found & differs(c)).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit(name).alias("column"), F.col("_n").alias("rows_compared"), F.col(c).alias("mismatches"))
                      for name, c in [*zip(columns, columns), ("(missing rows)", "_missing")]])
    return counts.select(F.explode(items).alias("p")).select("p.*")


def batch_panel(history: DataFrame, batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Evaluation origins after a delivery: the last history origins with their label completed, plus every new one.

    ``stored`` is the feature table built from history alone.
    """
    stored = cut_lineage(stored)
    rebuilt = cut_lineage(rebuilt_features(to_daily(append_batches(history, batches)), last_known_stats(stored)))
    last_week = stored.agg(F.max("week")).scalar()
    last_rows = stored.filter(F.col("week") == last_week).drop(LABEL).join(rebuilt.select(*WEEK_KEYS, LABEL), WEEK_KEYS, "left")
    fresh = rebuilt.join(F.broadcast(new_weeks(rebuilt, stored)), "week", "left_semi")
    return last_rows.select(*FEATURE_TABLE_COLUMNS).unionByName(fresh.select(*FEATURE_TABLE_COLUMNS)).withColumn(
        "label_week", F.date_add("week", 7))


def arrival_replay(history: DataFrame, batches: DataFrame, stored: DataFrame, columns: list[str],
                   files: list[str] | None = None) -> DataFrame:
    """Rebuild after each file arrives; origins that were already scorable must equal the final build.

    ``files`` is the ordered list of batch files (file names, not data).
    """
    stored = cut_lineage(stored)
    history, batches = cut_lineage(history), cut_lineage(batches)
    if files is None:
        files = sorted(r[0] for r in batches.select("batch_file").distinct().collect())
    full = cut_lineage(batch_panel(history, batches, stored))
    out = None
    for i, name in enumerate(files, 1):
        available = batches.filter(F.col("batch_file") <= name)
        through = available.agg(F.max("date")).scalar()
        partial = cut_lineage(batch_panel(history, available, stored)).filter(F.date_add("label_week", 6) <= through)
        bad = column_parity(partial, full, columns).agg(F.sum("mismatches").alias("m"), F.max("rows_compared").alias("n"))
        row = bad.select(
            F.lit(i).alias("batches_available"), F.lit(name).alias("last_file"), through.alias("data_through"),
            partial.agg(F.countDistinct("week")).scalar().alias("scorable_origins"),
            F.col("n").alias("n_rows"), F.col("m").alias("feature_mismatches"))
        out = row if out is None else out.unionByName(row)
    return out
