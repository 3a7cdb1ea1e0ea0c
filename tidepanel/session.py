"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def build_session(app: str = "tidepanel", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session with the settings the operators rely on (UTC dates, AQE with skew-join splitting)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where every task shares the
    driver's disk, may fall back to a temporary folder; anything else must be configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        fallback = tempfile.mkdtemp(prefix="tidepanel-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", fallback)
        return fallback
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


_FOLDER = Lock()

#: Independent jobs of one call that run at the same time, at most.
SIDE_BY_SIDE = 8


def side_by_side(spark: SparkSession, jobs: list[Callable[[], object]], at_once: int = SIDE_BY_SIDE) -> list:
    """Results of independent jobs in their order, started from a pool of bounded size; the first error is raised.

    A fit is a long chain of small jobs, so one after the other leaves most of a cluster idle. Each thread keeps its own job
    properties; nothing but the handles of results passes through the driver.
    """
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(at_once, len(jobs))) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def cut_lineage(df, eager: bool = True):
    """Checkpoint to the shared folder so a lost executor replays from storage, not from the source."""
    spark = df.sparkSession
    with _FOLDER:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


def stored(df):
    """The rows as Parquet in the shared folder: a wide table read by several branches, each of which needs few of its columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
