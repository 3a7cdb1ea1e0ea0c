"""Merkle manifest of a dataset: every row is a leaf, leaves of a group form a tree, and the groups' roots form the tree above.

Nodes are labelled with the interval of leaf ranks they cover. Levels are bucketed in storeys of ``LEVELS`` levels; one bucket
holds at most ``fanout ** LEVELS`` nodes and is worked on by one task. Going up, a bucket gives the node that covers it; going
down, a bucket is joined with the one whose interval contains it and takes over that node's path, so a join key has at most
one bucket's rows. Inside a bucket a node's parent is the one whose interval contains it, and its siblings are what is left of
the parent's interval without its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames
from tidepanel.llm.frames import col

LEVELS = 10
PATH = "array<struct<left:string,right:string>>"


def digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields in a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of all siblings in a row, level by level from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grow(digests: list[str], fanout: int, levels: int, alone: bool) -> list[tuple[list[int], list[int], list[str]]]:
    """(first rank, last rank, digest) of the nodes of each level, leaves first. A bucket that is ``alone`` ends at its only node."""
    n = len(digests)
    out = [(list(range(n)), list(range(n)), digests)]
    while len(out) <= levels and not (alone and len(out[-1][2]) == 1):
        lo, hi, d = out[-1]
        out.append((lo[::fanout], [hi[min(k + fanout, len(hi)) - 1] for k in range(0, len(hi), fanout)],
                    [_hash("".join(d[k:k + fanout])) for k in range(0, len(d), fanout)]))
    return out


def beside(below: tuple, above: tuple) -> list[tuple[str, str]]:
    """For each node of a level the digests of its siblings before and after it: the parent's interval without its own."""
    lo, _, d = below
    out = []
    for k, first in enumerate(lo):
        parent = bisect_right(above[0], first) - 1               # the interval that contains it
        a, b = bisect_left(lo, above[0][parent]), bisect_right(lo, above[1][parent])
        out.append(("".join(d[a:k]), "".join(d[k + 1:b])))
    return out


def _members(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, pa.Array]:
    """The members of a row's bucket by position, and their digests."""
    m = batch.column(batch.schema.get_field_index("members"))[i].values
    m = m.take(pa.array(np.argsort(m.field("position").to_numpy(), kind="stable")))
    return m, m.field("digest")


def _storey(nodes: DataFrame, fanout: int, levels: int, payload: list[str]) -> DataFrame:
    """``grp``, ``bucket``, ``n`` (nodes of the group on this storey's lowest level), ``members`` and their ``root``."""
    width = fanout ** levels
    buckets = nodes.groupBy("grp", F.floor(F.col("position") / width).cast("long").alias("bucket"), "n").agg(
        F.collect_list(F.struct("position", "digest", *payload)).alias("members"))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        n = batch.column(batch.schema.get_field_index("n")).to_pylist()
        return {"root": [grow(_members(batch, i)[1].to_pylist(), fanout, levels, n[i] <= width)[-1][2][0] for i in range(batch.num_rows)]}

    return frames.materialise(frames.map_rows(buckets, ["grp", "bucket", "n", "members"], "root string", work))


def _down(storey: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row per member of the storey's buckets with its path to the root: ``above`` has (grp, bucket, path, subroot, root)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    width = fanout ** levels
    a = above.select(F.col("grp").alias("_g"), F.col("bucket").alias("_b"), "path", "subroot", "root")
    rows = storey.drop("root").join(a, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b"))).drop("_g", "_b")
    member = rows.schema["members"].dataType.elementType
    given = ["grp", "path", "subroot", "root"]
    schema = StructType([rows.schema[c] for c in given] + list(member.fields) + StructType.fromDDL(f"local {PATH}").fields)
    arrow = to_arrow_schema(schema)
    pairs = arrow.field("local").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members, digests = _members(batch, i)
                n = len(members)
                alone = batch.column(batch.schema.get_field_index("n"))[i].as_py() <= width
                tree = grow(digests.to_pylist(), fanout, levels, alone)
                by_level = [(tree[k][0], beside(tree[k], tree[k + 1])) for k in range(len(tree) - 1)]
                left, right = [], []
                for r in range(n):
                    for lo, near in by_level:
                        x, y = near[bisect_right(lo, r) - 1]     # the ancestor whose interval contains the leaf
                        left.append(x)
                        right.append(y)
                local = frames.list_array(pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(pairs)),
                                          [len(by_level)] * n)
                again = pa.array(np.zeros(n, np.int64))
                data = [batch.column(batch.schema.get_field_index(c)).slice(i, 1).take(again) for c in given]
                data += [members.field(f.name) for f in member.fields] + [local]
                yield pa.RecordBatch.from_arrays(data, names=arrow.names)

    return rows.mapInArrow(run, schema).withColumn("path", F.concat("local", "path")).drop("local")


def _heights(n: int, width: int) -> int:
    """Storeys of a group of ``n`` leaves."""
    k = 1
    while n > width:
        n, k = -(-n // width), k + 1
    return k


def _up(nodes: DataFrame, fanout: int, levels: int, payload: list[str] = []) -> list[DataFrame]:
    """The storeys over ``nodes`` (grp, position, digest, n), lowest first; the driver knows the size of the largest group only."""
    width = fanout ** levels
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [_storey(nodes, fanout, levels, payload)]
    for _ in range(1, _heights(most, width)):
        last = out[-1].where(F.col("n") > width)
        out.append(_storey(last.select("grp", F.col("bucket").alias("position"), F.col("root").alias("digest"), F.ceil(F.col("n") / width).cast("long").alias("n")), fanout, levels, []))
    return out


def _tops(storeys: list[DataFrame], width: int) -> DataFrame:
    out = None
    for s in storeys:
        part = s.where(F.col("n") <= width).select("grp", F.col("root").alias("subroot"))
        out = part if out is None else out.unionByName(part)
    return out


def _paths(storeys: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Members of the lowest storey with their paths; ``tops``: (grp, path, subroot, root) of each group's own root."""
    width, below = fanout ** levels, None
    for s in reversed(storeys):
        # Groups that end at this storey start from the tree above, the others from the bucket that contains theirs.
        ends = s.where(F.col("n") <= width).select(F.col("grp").alias("_g"), "bucket")
        above = ends.join(tops, F.col("_g").eqNullSafe(F.col("grp"))).select("grp", "bucket", "path", "subroot", "root")
        if below is not None:
            above = above.unionByName(below.select("grp", F.col("position").alias("bucket"), "path", "subroot", "root"))
        below = _down(s, above, fanout, levels)
        if s is not storeys[0]:
            below = frames.materialise(below)
    return below


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, keep: dict[str, Column], fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``leaf``, ``subroot`` (of the row's group), ``root`` and ``path``: per level from the
    leaf to the root the digests of the siblings to the left and to the right, each joined without separator.

    A leaf is the digest of ``fields``. Leaves of a group ascend by ``order`` (null first), rows with equal values by their digest, so
    repeated rows are leaves of their own and the result does not depend on the order of input. Null is a group, the first; groups
    ascend bytewise. Null and empty texts differ. Texts of any length are hashed where they lie and don't move. An empty table
    has no leaf and gives no rows. Other columns may have any name.
    """
    width = fanout ** levels
    # Hashed once, where the rows lie; everything after it moves digests only.
    leaves = frames.materialise(docs.select(col(group).cast("string").alias("grp"), col(order).alias("ord"), digest([col(c) for c in fields]).alias("digest"),
                                            F.struct(*[c.alias(n) for n, c in keep.items()]).alias("row")))
    ranked = frames.numbered(leaves, "grp", [F.col("ord"), F.col("digest")])
    storeys = _up(ranked.withColumnRenamed("total", "n"), fanout, levels, ["row"])
    subroots = frames.materialise(_tops(storeys, width))
    # The tree above has a leaf per group; all belong to one group, which is ranked and bucketed like the others.
    ranked = frames.numbered(subroots.select(F.lit("").alias("all"), F.col("grp").alias("of"), F.col("subroot").alias("digest")), "all", [F.col("of")])
    upper = _up(ranked.select(F.col("all").alias("grp"), "position", "digest", F.col("total").alias("n"), "of"), fanout, levels, ["of"])
    root = _tops(upper, width).select("grp", F.array().cast(PATH).alias("path"), "subroot", F.col("subroot").alias("root"))
    tops = frames.materialise(_paths(upper, root, fanout, levels).select(F.col("of").alias("grp"), "path", F.col("digest").alias("subroot"), "root"))
    return _paths(storeys, tops, fanout, levels).select("row", F.col("digest").alias("leaf"), "subroot", "root", "path")
