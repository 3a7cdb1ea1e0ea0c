"""Plumbing of the operators: rows packed beside their results, tables cut from their lineage, and sizes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import shared_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc``: the whole row as a struct, ``text``: its text. Results beside them cannot clash with a column."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"), col(text).cast("string").alias("text"))


def unpacked(df: DataFrame, columns: list[str], text: str = "text", replaced: Column | None = None) -> DataFrame:
    """The original columns, with the text replaced where ``replaced`` is given."""
    get = F.col("doc").getField
    return df.select(*[(replaced if replaced is not None and c == text else get(c)).alias(c) for c in columns])


def materialise(df: DataFrame) -> DataFrame:
    """Writes Parquet to the shared folder and reads it back: lost executors replay from there, column by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing refers to any more; Spark deletes them once the driver has collected its garbage,
    which may otherwise happen long after the last read."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(df: DataFrame, keep: list[str], made: str, work: Callable[[pa.RecordBatch], dict[str, object]]) -> DataFrame:
    """Adds the columns of the DDL string ``made``, computed per Arrow batch by ``work``, to the columns ``keep``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(made)
    types = {f.name: f.type for f in to_arrow_schema(added)}
    schema = StructType([df.schema[c] for c in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [x if isinstance(x, pa.Array) and x.type == types[n] else pa.array(x, types[n]) for n, x in ((n, out[n]) for n in types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *types])

    return df.mapInArrow(run, schema)


def list_array(values: pa.Array, lengths) -> pa.ListArray:
    """A list column from its concatenated values and the length of each list."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def numbered(df: DataFrame, group: str, order: list[Column], weight: str | None = None) -> DataFrame:
    """Adds ``position`` (from 0, in ``order`` within ``group``), ``total`` (rows of the group) and, with ``weight``, ``before`` (the
    sum of the weights of earlier rows).

    Rows are range-partitioned by group and order, counted inside each partition and shifted by what the partitions before it hold,
    so a group with a third of all rows is spread over many tasks. Null is a group; equal rows get distinct positions. The
    placement is written first, so that a replayed task cannot see other boundaries.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType
    import numpy as np

    columns = df.columns
    keys = [col(group), *order, F.monotonically_increasing_id()]
    named = [f"_k{i}" for i in range(len(keys))]
    # Keys become columns first: ids by position must not change between the sampling of the ranges and the exchange.
    placed = df.select("*", *[k.alias(n) for k, n in zip(keys, named, strict=True)]).repartitionByRange(*named).sortWithinPartitions(*named)
    schema = StructType(placed.select(*[col(c) for c in columns]).schema.fields + [StructField(c, LongType()) for c in ("_part", "_inside", "_sum")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, row, total = TaskContext.get().partitionId(), (), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index(group))
            code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.r_[(key[0].as_py(),) != last, code[1:] != code[:-1]]
            starts = np.flatnonzero(first)
            n = len(code)
            w = np.zeros(n, np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(w) - w
            which = np.cumsum(first) - 1                    # -1: goes on with the group of the batch before
            base = np.where(which >= 0, starts[which] if len(starts) else 0, -row)
            low = np.where(which >= 0, sums[starts[which]] if len(starts) else 0, -total)
            inside, before = np.arange(n) - base, sums - low
            last, row, total = (key[-1].as_py(),), int(inside[-1]) + 1, int(before[-1] + w[-1])
            data = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*data, pa.array(np.full(n, part)), pa.array(inside), pa.array(before)], schema=pa.schema(
                [*(f.with_type(d.type) for f, d in zip(arrow, data)), *list(arrow)[-3:]]))

    from pyspark.sql import Window
    rows = materialise(placed.mapInArrow(run, schema))
    added = F.col("_sum") + (col(weight) if weight else F.lit(0))
    parts = rows.groupBy(col(group).alias("_g"), F.col("_part").alias("_p")).agg(
        (F.max("_inside") + 1).alias("_n"), F.max(added).alias("_w"))
    one = Window.partitionBy("_g").orderBy("_p")           # a row per group and range partition
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_weight"),
                         F.sum("_n").over(Window.partitionBy("_g")).alias("total"))
    out = rows.join(shift, (F.col("_part") == F.col("_p")) & col(group).eqNullSafe(F.col("_g")))
    return out.select(*[col(c) for c in columns], (F.col("_inside") + F.col("_rows")).alias("position"), "total",
                      *([(F.col("_sum") + F.col("_weight")).alias("before")] if weight else []))
