"""Event-time weekly totals and completed labels as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.streaming.sink import run_to_table

# Epoch day 0 was a Thursday; four days later windows start on Mondays.
MONDAY_OFFSET = "4 days"
LATENESS = "7 days"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Event files as a stream; the timestamp gets the type a watermark needs."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_totals(stream: DataFrame, keys: list[str], value: str, lateness: str = LATENESS) -> DataFrame:
    """Monday weeks per series, without gap filling; a week is emitted when no more rows can arrive for it."""
    week = F.window("ts", "7 days", "7 days", MONDAY_OFFSET)
    return (stream.withWatermark("ts", lateness).groupBy(week.alias("w"), *keys)
            .agg(F.sum(value).alias("units_sold"), F.count(F.lit(1)).alias("n_rows"))
            .select(*keys, F.to_date("w.start").alias("week"), "units_sold", "n_rows"))


def scorable_origins(stream: DataFrame, keys: list[str], value: str, lateness: str = "0 days") -> DataFrame:
    """An origin week with its label, emitted once the label week has fully passed."""
    return weekly_totals(stream, keys, value, lateness).select(
        *keys, F.date_sub("week", 7).alias("week"), F.col("units_sold").alias("label"))


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """First arrival of every key; repeats within the lateness bound are dropped and state is cleaned after it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def run_weekly_totals(spark: SparkSession, folder: str, keys: list[str], value: str) -> DataFrame:
    return run_to_table(weekly_totals(read_events(spark, folder), keys, value), "weekly_totals")


def run_scorable_origins(spark: SparkSession, folder: str, keys: list[str], value: str) -> DataFrame:
    return run_to_table(scorable_origins(read_events(spark, folder), keys, value), "scorable_origins")
