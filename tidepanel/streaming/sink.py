"""Run a streaming query over everything available and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidepanel.session import shared_folder


def run_to_table(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input in append mode into a Parquet table with an exactly-once checkpoint.

    Calling again with the same ``folder`` resumes from the checkpoint and only handles new input.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
