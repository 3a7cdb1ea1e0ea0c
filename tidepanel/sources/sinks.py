"""Report tables, the batch-file source, the fold ledger store and content fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidepanel.functions.hashing import hash_sum, md5_int
from tidepanel.functions.numeric import is_finite
from tidepanel.operators.causal import EXPORT_COLUMNS
from tidepanel.operators.ledger import prediction_rows
from tidepanel.schema import DAILY_SCHEMA, WEEK_KEYS


def read_daily(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Daily facts under the declared schema; no inference pass over the files."""
    reader = spark.read.schema(DAILY_SCHEMA)
    if fmt == "csv":
        return reader.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return reader.format(fmt).load(path)


def scan_batches(spark: SparkSession, folder: str, pattern: str = "batch_*.parquet") -> DataFrame:
    """All weekly batch files of a folder; each row carries the name of its file, which orders arrival."""
    files = spark.read.option("pathGlobFilter", pattern)
    try:
        rows = files.parquet(folder)
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no {pattern} files found in {folder}") from e
        raise
    return rows.withColumn("date", F.to_date("date")).withColumn("batch_file", F.col("_metadata.file_name"))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report table in the order of its columns; in CSV missing values read N/A and dates are ISO."""
    df = df.orderBy(*[F.col(f"`{c}`") for c in df.columns])
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("nullValue", "N/A").option(
            "dateFormat", "yyyy-MM-dd").csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def export_group_panel(panel: DataFrame, path: str, fmt: str = "csv") -> None:
    """The columns an external weight check needs."""
    panel.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", True).format(fmt).save(path)


# ---------------------------------------------------------------- fingerprints

def _portable(df: DataFrame) -> list[Column]:
    """Columns as text any engine renders alike: doubles as scaled integers, dates in ISO form."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scaled = c.cast("double") * 1e6 + 0.5
            c = F.when(F.abs(scaled) < float(2 ** 53), F.floor(scaled).cast("string")).otherwise(scaled.cast("string"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        out.append(F.coalesce(c.cast("string"), F.lit("~")))
    return out


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-insensitive content hash, combined map-side."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), hash_sum(md5_int(*_portable(df))).alias("content_hash")).select(
        F.lit(name).alias("table_name"), "n_rows", "content_hash")


def quick_fingerprint(df: DataFrame) -> str:
    """Native hash for change detection inside one Spark version."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("h")).first()
    return f"{r['n']}-{(r['h'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def manifest(fingerprints: DataFrame, **facts) -> DataFrame:
    """One JSON document: input fingerprints plus the run's settings."""
    inputs = F.array_sort(F.collect_list(F.struct("table_name", "n_rows", "content_hash")))
    return fingerprints.agg(F.to_json(F.struct(inputs.alias("inputs"), *[
        F.lit(json.dumps(v, sort_keys=True, default=str)).alias(k) for k, v in facts.items()])).alias("manifest"))


# ---------------------------------------------------------------- fold ledger store

class LedgerStore:
    """Predictions per (signature, model, fold) as a partitioned table, so an interrupted run resumes.

    A partition counts only when its marker row holds the hash of what was written; restored rows are paired with the
    current gold rows again, so changed actuals cannot slip through.
    """

    def __init__(self, spark: SparkSession, path: str, signature: str):
        self.spark, self.path, self.signature = spark, path, signature

    def _part(self, model_id: str, fold_id: int) -> str:
        return f"{self.path}/ledger/signature={self.signature}/model_id={model_id}/fold_id={fold_id}"

    def _marker(self, model_id: str, fold_id: int) -> str:
        return f"{self.path}/marks/signature={self.signature}/model_id={model_id}/fold_id={fold_id}"

    def save(self, rows: DataFrame, model_id: str, fold_id: int) -> DataFrame:
        part = self._part(model_id, fold_id)
        rows.select(*WEEK_KEYS, "actual", "prediction").write.mode("overwrite").parquet(part)
        written = self.spark.read.parquet(part)
        self.spark.createDataFrame([(quick_fingerprint(written),)], "checksum string").coalesce(1).write.mode(
            "overwrite").parquet(self._marker(model_id, fold_id))
        return self._tag(written, model_id, fold_id)

    def load(self, gold: DataFrame, model_id: str, fold_id: int) -> DataFrame | None:
        """Stored rows for the current gold rows, None when absent; raises when damaged or out of date."""
        try:
            marker = self.spark.read.parquet(self._marker(model_id, fold_id)).first()
            stored = self.spark.read.parquet(self._part(model_id, fold_id))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if quick_fingerprint(stored) != marker["checksum"]:
            raise ValueError(f"{model_id}/{fold_id}: the stored rows do not have the checksum of their marker")
        paired = prediction_rows(gold, stored.select(*WEEK_KEYS, "prediction"), model_id, fold_id)
        old = stored.select(*WEEK_KEYS, F.col("actual").alias("_old"))
        if paired.join(old, WEEK_KEYS).filter(~F.col("actual").eqNullSafe(F.col("_old"))).limit(1).count():
            raise ValueError(f"{model_id}/{fold_id}: stored actuals differ from those of the panel")
        return paired

    def obtain(self, gold: DataFrame, model_id: str, fold_id: int, predict) -> DataFrame:
        """Restore the partition or compute and save it."""
        found = self.load(gold, model_id, fold_id)
        if found is not None:
            return found
        return self.save(prediction_rows(gold, predict(), model_id, fold_id), model_id, fold_id)

    def _tag(self, rows: DataFrame, model_id: str, fold_id: int) -> DataFrame:
        return rows.withColumns({"model_id": F.lit(model_id), "fold_id": F.lit(fold_id)})
