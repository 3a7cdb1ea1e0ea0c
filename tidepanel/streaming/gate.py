"""Quality gate for arriving batch files: audited against history, then accepted or set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators.audit import contract_audit


def gate_batches(spark: SparkSession, folder: str, history: DataFrame, accepted: str, quarantine: str, reports: str,
                 checkpoint: str, allowed_failures: set[str] = frozenset(), pattern: str = "batch_*.parquet"):
    """Start the gate over all files present. One file per micro-batch, so each delivery gets its own verdict.

    The verdict is one row per check, written next to the batch id; the rows go to ``accepted`` when every failed check
    is allowed, else to ``quarantine``. Outputs are keyed by batch id, so a replayed micro-batch overwrites itself.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    files = (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1)
             .parquet(folder))

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            report = contract_audit(history, batch).persist()
            failed = {r["check"] for r in report.filter(~F.col("consistent")).select("check").collect()}
            report.write.mode("overwrite").parquet(f"{reports}/batch_id={batch_id}")
            target = accepted if failed <= set(allowed_failures) else quarantine
            batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            report.unpersist()
        finally:
            batch.unpersist()

    return (files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
