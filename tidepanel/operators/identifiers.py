"""Dense ids in sort order without sorting all keys in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.session import cut_lineage


def dense_ids(keys: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Number the rows of a distinct key table 1..n in the order of ``order``.

    Rows are range-partitioned by the order columns; each partition is numbered on its own and shifted by the sizes
    of the partitions before it (one row per partition). The placement is materialised first, so a replayed task
    cannot see different boundaries.
    """
    placed = cut_lineage(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (placed.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_offset") + F.col("_inside") + (start - 1)).cast("bigint"))
            .drop("_part", "_inside", "_offset"))
