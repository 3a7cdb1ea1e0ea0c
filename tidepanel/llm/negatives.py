"""Hard-negative mining over STR-packed R-trees.

Rows are range-partitioned by label, first component and id into slabs of bounded size; inside a slab each label's rows are sorted
and tiled component by component into leaves, so a slab is a small forest with one tree per label it holds. A node's minimum
bounding box gives, component by component, an interval of the inner products with an anchor. The search takes boxes by
their upper ends from a queue and leaves out those outside every score window and those strictly below the kth score found.

Anchors are sent to the slabs (for positives only to those that hold their label), never the rows to the anchors: a slab is built once per
search in one task, and the anchors stream through it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

LEAF = 128                 #: rows of a leaf
FANOUT = 16                #: leaves of an inner node
SLAB_ROWS = 1 << 18        #: rows of a slab, at most by about one half more (ranges are sampled)
SLAB_LEAST = 2048          #: smaller slabs are not made for the sake of parallel tasks
TILED = 3                  #: components that the tiling sorts by after the first
#: The largest squared length: the inner product of two such vectors fits a long.
LONGEST = float(2 ** 62)


@dataclass(frozen=True)
class Rules:
    """What is asked of an anchor; shares of a positive's score are in hundredths."""

    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90


def quantised(vector: Column, factor: int = 256) -> Column:
    """Integer components: floor(factor * x) as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def usable(vector: Column, factor: int = 256) -> Column:
    """Neither null nor with a null, non-finite or far too large component."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(factor)))
    length = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)      # null, NaN or infinite if any component is
    return F.coalesce(length < LONGEST, F.lit(False))


def _box(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v.min(axis=0), v.max(axis=0)


def _exact(q: np.ndarray) -> type:
    """The narrowest float in which every sum of products of two such vectors is exact, else int64."""
    longest = int((q.astype(object) ** 2).sum(axis=1).max()) if np.abs(q).max(initial=0) > 2 ** 26 else int((q * q).sum(axis=1).max(initial=0))
    return np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else np.int64


def tiles(v: np.ndarray, rows: np.ndarray, leaf: int, components: list[int]) -> Iterator[np.ndarray]:
    """Sort-tile-recursive packing: ``rows`` sorted by a component and cut into slices of equal size, each then by the next one."""
    parts = -(-len(rows) // leaf)
    if parts <= 1 or not components:
        for k in range(0, len(rows), leaf):
            yield rows[k:k + leaf]
        return
    rows = rows[np.argsort(v[rows, components[0]], kind="stable")]
    slices = max(1, round(parts ** (1 / len(components))))
    size = -(-parts // slices) * leaf
    for k in range(0, len(rows), size):
        yield from tiles(v, rows[k:k + size], leaf, components[1:])


def pack(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> list[tuple[int, np.ndarray]]:
    """(label, row numbers) of the leaves of a slab, whole leaves of a label in the order of its tiles."""
    by_id = np.lexsort((ids, labels))
    cuts = np.flatnonzero(np.r_[True, labels[by_id][1:] != labels[by_id][:-1], True])
    width = v.shape[1]
    components = list(range(1 if width > 1 else 0, min(width, 1 + TILED)))
    return [(int(labels[part[0]]), tile) for part in (by_id[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)) for tile in tiles(v, part, leaf, components)]


class Forest:
    """The packed leaves of a slab with their boxes, and inner nodes over up to FANOUT neighbouring leaves of one label."""

    def __init__(self, leaves: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids = [x[1] for x in leaves]
        self.vectors = [x[2] for x in leaves]
        self.labels = np.array([x[0] for x in leaves], np.int64)
        boxes = [_box(x[2]) for x in leaves]
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        starts = [0]
        for k in range(1, len(leaves)):
            if k - starts[-1] >= FANOUT or self.labels[k] != self.labels[k - 1]:
                starts.append(k)
        self.nodes = list(zip(starts, [*starts[1:], len(leaves)], strict=True))
        self.node_low = np.array([self.low[a:b].min(axis=0) for a, b in self.nodes])
        self.node_high = np.array([self.high[a:b].max(axis=0) for a, b in self.nodes])
        self.node_label = self.labels[starts]
        self.longest = np.concatenate([np.abs(self.low), np.abs(self.high)])
        self.as_type: dict = {}

    def typed(self, kind: type) -> tuple:
        """Vectors and boxes in a number type; each type is converted once."""
        if kind not in self.as_type:
            self.as_type[kind] = ([v.astype(kind) for v in self.vectors], *[x.astype(kind) for x in (self.low, self.high, self.node_low, self.node_high)])
        return self.as_type[kind]

    def intervals(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each row of ``q`` with any point of each box: per component the better end, summed."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def search(self, q: np.ndarray, kind: type, asks: list[tuple]) -> list[list[list[tuple[int, int]]]]:
        """For each ask (own id, label, whether the label is wanted or unwanted, windows of (low, high, k)): per window its first k
        (score, id), higher scores first, ties by smaller id."""
        vectors, low, high, node_low, node_high = self.typed(kind)
        q = q.astype(kind)
        node_least, node_most = self.intervals(q, node_low, node_high)
        least, most = self.intervals(q, low, high)
        return [self._one(q[i], vectors, node_least[i], node_most[i], least[i], most[i], *ask) for i, ask in enumerate(asks)]

    def _one(self, q, vectors, node_least, node_most, least, most, own, label, same, windows):
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        floors = [w[0] for w in windows]                        # the window's low end, then the kth score

        def wanted(a, b) -> bool:
            return any(b >= f and a <= w[1] for f, w in zip(floors, windows, strict=True))

        nodes = np.flatnonzero((self.node_label == label) == same)
        queue = [(-node_most[k], 0, int(k)) for k in nodes]
        heapq.heapify(queue)
        while queue:
            top, leaf, k = heapq.heappop(queue)
            if -top < min(floors, default=np.inf):
                break                                           # so is every box that is left
            if not wanted((least if leaf else node_least)[k], -top):
                continue
            if not leaf:
                for j in range(*self.nodes[k]):
                    if wanted(least[j], most[j]):
                        heapq.heappush(queue, (-most[j], 1, j))
                continue
            scores, ids = (vectors[k] @ q).astype(np.int64), self.ids[k]
            for x, (_, upper, size) in enumerate(windows):
                take = (scores >= floors[x]) & (scores <= upper) & (ids != own)
                if not take.any():
                    continue
                s, i = np.r_[found[x][0], scores[take]], np.r_[found[x][1], ids[take]]
                order = np.lexsort((i, -s))[:size]
                found[x] = s[order], i[order]
                if len(order) == size:
                    floors[x] = max(floors[x], int(s[order[-1]]))
        return [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i in found]


def _narrow(v: np.ndarray) -> bytes:
    """Little-endian components in the narrowest integer type that holds them."""
    for kind in ("<i2", "<i4"):
        if not len(v) or (v.min(initial=0) >= np.iinfo(kind).min and v.max(initial=0) <= np.iinfo(kind).max):
            return v.astype(kind).tobytes()
    return v.astype("<i8").tobytes()


def _wide(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    return np.frombuffer(data, f"<i{len(data) // (rows * width)}").astype(np.int64).reshape(rows, width)


INDEX = "slab int, leaf int, label long, width int, ids array<long>, vectors binary"


def build(rows: DataFrame, n_rows: int) -> DataFrame:
    """The packed leaves of ``rows`` (vec_id, label, q), written: ``slab``, ``leaf``, ``label``, ``width``, ``ids`` and ``vectors``.

    Vectors of several lengths are padded with zeros to the longest of their slab.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(INDEX)
    arrow = to_arrow_schema(schema)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    slabs = max(-(-n_rows // SLAB_ROWS), min(tasks, -(-n_rows // SLAB_LEAST)), 1)
    # Label, component and id: equal vectors are told apart by id, so a frequent one is spread like any other.
    placed = rows.select("label", F.get("q", F.lit(0)).alias("x"), "vec_id", "q").repartitionByRange(slabs, "label", "x", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, lists = [], [], []
        for b in batches:
            labels.append(b.column(0).to_numpy())
            ids.append(b.column(2).to_numpy())
            lists.append(b.column(3))
        if not ids:
            return
        ids, labels = np.concatenate(ids), np.concatenate(labels)
        sizes = np.concatenate([np.asarray(x.value_lengths()) for x in lists])
        flat = np.concatenate([x.flatten().to_numpy() for x in lists])
        width = int(sizes.max(initial=0))
        v = np.zeros((len(ids), width), np.int64)
        v[np.arange(width) < sizes[:, None]] = flat
        slab = TaskContext.get().partitionId()
        for k, (label, part) in enumerate(pack(ids, labels, v)):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (slab, k, label, width, ids[part].tolist(), _narrow(v[part])), arrow, strict=True)], schema=arrow)

    return frames.materialise(placed.mapInArrow(run, schema))


def anchors(index: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``: ``anchor`` (their place), ``anchor_id``, ``label``, ``width`` and ``vectors``."""
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        col = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("slab", "leaf", "width", "ids", "vectors")}
        out = []
        for slab, leaf, width, ids, data in zip(*col.values(), strict=True):
            v = _wide(data, len(ids), width)
            out.append([{"anchor": f"{slab}-{leaf}-{k}", "anchor_id": i, "vector": _narrow(v[k])} for k, i in enumerate(ids) if i % every == 0])
        return {"found": out}

    made = frames.map_rows(index, ["label", "width"], "found array<struct<anchor:string,anchor_id:long,vector:binary>>", work)
    return made.select("label", "width", F.explode("found").alias("f")).select("f.anchor", "f.anchor_id", "label", "width", F.col("f.vector").alias("vectors"))


WINDOWS = "array<struct<low:long,high:long,k:int>>"


def _search(index: DataFrame, asks: DataFrame, same: bool) -> DataFrame:
    """``anchor``, ``window`` (its place in the ask), ``score`` and ``id`` of the best rows of each slab.

    ``asks`` has slab, anchor, anchor_id, label, width, vectors and windows. The leaves of a slab come first in its task, then the asks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("anchor string, window int, score long, id long")
    arrow = to_arrow_schema(schema)
    columns = ["slab", "kind", "leaf", "anchor", "label", "width", "ids", "vectors", "windows"]
    null = F.lit(None)
    leaves = index.select("slab", F.lit(0).alias("kind"), "leaf", null.cast("string").alias("anchor"), "label", "width", "ids", "vectors", null.cast(WINDOWS).alias("windows"))
    rows = leaves.unionByName(asks.select("slab", F.lit(1).alias("kind"), null.cast("int").alias("leaf"), "anchor", "label", "width",
                                          F.array("anchor_id").alias("ids"), "vectors", "windows"))

    def answer(forest: Forest, kind: type | None, group: list) -> Iterator[pa.RecordBatch]:
        width = forest.low.shape[1]
        q = np.zeros((len(group), width), np.int64)
        over = 0
        for i, (_, _, w, _, data, _) in enumerate(group):
            full = _wide(data, 1, w)[0]
            q[i, :min(w, width)] = full[:width]                # components beyond either vector count as zero
            over = max(over, int((full.astype(object) ** 2).sum()) if np.abs(full).max(initial=0) > 2 ** 26 else int(full @ full))
        asked = np.float32 if over < 1 << 24 else np.float64 if over < 1 << 53 else np.int64
        kind = max(asked, kind, key=[np.float32, np.float64, np.int64].index)
        asks = [(ids[0], label, same, [(w["low"], w["high"], w["k"]) for w in windows]) for _, label, _, ids, _, windows in group]
        made = [(g[0], x, s, i) for g, per in zip(group, forest.search(q, kind, asks), strict=True) for x, pairs in enumerate(per) for s, i in pairs]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, leaves, forest, kind, group = None, [], None, None, []
        for batch in batches:
            for at, is_ask, _, anchor, label, width, ids, data, windows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != slab:
                    if group:
                        yield from answer(forest, kind, group)
                    slab, leaves, forest, group = at, [], None, []
                if not is_ask:
                    leaves.append((label, np.array(ids, np.int64), _wide(data, len(ids), width)))
                    continue
                if forest is None:
                    forest = Forest(leaves)
                    kind = max((_exact(x[2]) for x in leaves), key=[np.float32, np.float64, np.int64].index)
                    leaves = []
                group.append((anchor, label, width, ids, data, windows))
                if len(group) == 512:
                    yield from answer(forest, kind, group)
                    group = []
        if group:
            yield from answer(forest, kind, group)

    # A fixed number of tasks: slabs are small in bytes and dear in time, so they aren't to be put together by their bytes.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.select(*columns).repartition(tasks, "slab").sortWithinPartitions("slab", "kind", "leaf").mapInArrow(run, schema)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window over all slabs, with their ``rank``."""
    from pyspark.sql import Window
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, rules: Rules = Rules()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` has vec_id, label and ``vector`` of numbers; others are not read. Rows with a null vec_id, label or vector, a null or
    non-finite component, or a squared length of 2**62 or more after scaling (scores would not fit) take no part. Rows equal in
    all three count once; an anchor's other rows are those with another vec_id. Shorter vectors count as filled up with zeros,
    an empty one has score 0 with every row. Ties go by smaller vec_id. An anchor without a positive, and a positive without a
    negative in its window, give no row; a negative positive score has an empty window. An empty table gives no rows.
    """
    ready = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("vector")).alias("q"))
    ready = frames.materialise(ready.dropDuplicates())
    index = build(ready, ready.count())
    asking = frames.materialise(anchors(index, every))
    ends = F.lit(-(2 ** 63)).cast("long"), F.lit(2 ** 63 - 1).cast("long")
    window = lambda low, high, k: F.struct(low.alias("low"), high.alias("high"), F.lit(k).alias("k"))
    holds = index.select("slab", F.col("label").alias("_l")).distinct()
    near = asking.join(holds, F.col("label") == F.col("_l")).drop("_l").withColumn("windows", F.array(window(*ends, rules.positives)))
    positives = frames.materialise(_first(_search(index, near, True), rules.positives).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("_p")))
    # ceil and floor of the shares of the score, in decimals: exact for every long.
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    bounded = positives.withColumn("low", F.ceil(share(rules.least)).cast("long")).withColumn("high", F.floor(share(rules.most)).cast("long")).where("low <= high")
    windows = bounded.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("_p", window(F.col("low"), F.col("high"), rules.negatives).alias("w")))).alias("all"))
    slabs = index.agg(F.max("slab")).first()[0]
    far = asking.join(windows, "anchor").withColumn("windows", F.transform("all", lambda x: x["w"])).withColumn(
        "slab", F.explode(F.sequence(F.lit(0), F.lit(slabs or 0))))
    # A slab without a row of another label has no leaf to open and costs one look at its nodes.
    found = _first(_search(index, far.drop("all"), False), rules.negatives)
    places = windows.select("anchor", F.posexplode("all").alias("window", "a")).select("anchor", "window", F.col("a._p").alias("_p"))
    named = found.join(places, ["anchor", "window"]).join(positives, ["anchor", "_p"]).join(asking.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
