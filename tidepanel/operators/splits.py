"""Time-ordered splits: whole weeks move together, folds expand, the last weeks stay untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

VAL_FOLD_WEEKS = 8
FINAL_TEST_WEEKS = 10


def sorted_weeks(df: DataFrame) -> DataFrame:
    """(week, week_idx) over the distinct weeks, 0-based. The global order runs over calendar weeks only."""
    return df.select("week").distinct().withColumn("week_idx", F.row_number().over(Window.orderBy("week")) - 1)


def fold_calendar(df: DataFrame, initial_train_end: str, val_fold_weeks: int = VAL_FOLD_WEEKS,
                  final_test_weeks: int = FINAL_TEST_WEEKS) -> DataFrame:
    """One row per week: (week, week_idx, fold_id, n_folds, is_holdout).

    fold_id is the fold that validates on the week (1-based), 0 for weeks that only ever train and NULL for the final
    test weeks. A week trains every fold with a larger id.
    """
    everything = Window.partitionBy()
    in_cv = F.col("week_idx") < F.col("_n") - final_test_weeks
    starts = in_cv & (F.col("week") <= F.lit(initial_train_end).cast("date"))
    weeks = sorted_weeks(df).withColumn("_n", F.count(F.lit(1)).over(everything))
    weeks = weeks.withColumn("_initial", F.sum(F.when(starts, 1).otherwise(0)).over(everything))
    problem = (F.when(F.col("_n") <= final_test_weeks,
                      F.raise_error(F.lit(f"a test of {final_test_weeks} weeks is larger than the whole panel")))
               .when(F.col("_initial") == 0,
                     F.raise_error(F.lit(f"training would end on {initial_train_end}, before the first week"))))
    cv_weeks = F.col("_n") - final_test_weeks - F.col("_initial")
    fold = F.floor((F.col("week_idx") - F.col("_initial")) / val_fold_weeks) + 1
    return weeks.select(
        F.coalesce(problem.cast("date"), "week").alias("week"), "week_idx",
        F.when(in_cv, F.greatest(fold, F.lit(0))).cast("int").alias("fold_id"),
        F.ceil(cv_weeks / val_fold_weeks).cast("int").alias("n_folds"),
        (~in_cv).alias("is_holdout"))


def walk_forward_folds(calendar: DataFrame) -> DataFrame:
    """(fold_id, role, week) with role train or val."""
    folds = F.explode(F.sequence(F.greatest("fold_id", F.lit(1)), F.col("n_folds")))
    cv = calendar.filter(~F.col("is_holdout") & (F.col("n_folds") > 0))
    return cv.select("week", F.col("fold_id").alias("_own"), folds.alias("fold_id")).select(
        "fold_id", F.when(F.col("_own") == F.col("fold_id"), "val").otherwise("train").alias("role"), "week")


def attach_folds(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows with their week's fold_id, n_folds and is_holdout. One calendar row per week, so it is broadcast."""
    return df.join(F.broadcast(calendar.drop("week_idx")), "week")


def fold_rows(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every row once per fold it belongs to, with its role.

    The training side is an inequality on weeks; since it only depends on the week, it is resolved on the calendar
    and the facts meet it through an equality.
    """
    return df.join(F.broadcast(walk_forward_folds(calendar)), "week")


def final_test_split(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return attach_folds(df, calendar).withColumn("side", F.when(F.col("is_holdout"), "test").otherwise("cv"))


def fold_summary(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows, weeks and date bounds per fold and role, and whether training ends before validation starts."""
    per_week = df.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    parts = walk_forward_folds(calendar).join(per_week, "week").groupBy("fold_id", "role").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_weeks"),
        F.min("week").alias("first_week"), F.max("week").alias("last_week"))
    other = Window.partitionBy("fold_id")
    train_end = F.max(F.when(F.col("role") == "train", F.col("last_week"))).over(other)
    val_start = F.min(F.when(F.col("role") == "val", F.col("first_week"))).over(other)
    return parts.withColumn("ordered", train_end < val_start)
