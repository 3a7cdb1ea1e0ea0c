"""N-gram Jaccard self-join by set-relation skipping.

A document's set holds its distinct shingles. Equal sets are one class. An inverted index is built over prefixes: of each
class the shingles that come first in one order of all shingles (frequent ones last, then by hash), as many as any similar set
must share one of. A list is cut into blocks of similar size and ordered by position; entries too far back in their own set
to reach the threshold with any size of the block are skipped. Prefixes are a little longer than needed to share one shingle,
so that linked sets share ``enough(n)`` of them. A narrow block gives its pairs, at most ``NARROW`` each; a wide block
names a leader and gives each member with it. Pairs that met in narrow blocks alone and too seldom cannot be linked.

Each set is first compared with the one that it met most often; sets that are in one component by then need no more. Other
pairs are compared one by one. Members of a wide block are compared with its whole group from the leader's answers alone:
with Ax = x - p and Dx = p - x of two sets x, y and leader p, |x & y| = |p| - |Dx| - |Dy| + |Dx & Dy| + |Ax & Ay|, so only
the differences travel, in tiles of bounded size. Every pair that shares enough prefix shingles is in one component,
compared, or in one tile, hence no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm import components, frames, words

SHINGLE, PERCENT = 5, 75
#: Shingles of at least so many documents count as frequent. Only the order of prefixes depends on it, not the result.
FREQUENT = 32
#: Bits of the tables that are broadcast, of frequent shingles and of sets in any pair. A bit shared by chance makes one more
#: shingle frequent, or sends one more set to the join that looks for it.
TABLE_BITS = 1 << 24
#: Prefix entries that meet in one task of the index, about.
PARTITION_ENTRIES = 600_000
#: Blocks of at most so many sets give their pairs.
NARROW = 16
TILE, TILE_ASKING = 512, 128
_CLASSES = words.byte_classes(words.SPACED, lower=True)


def shingle_sets(s: words.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, ascending; size and signature of each row's set.

    A row of fewer words, but not none, has the whole sequence as its only shingle.
    """
    h, rows = s.hashes(), len(s.first) - 1
    values, at = words.windows(h, s.first, size)
    row = np.searchsorted(s.first, at, "right") - 1
    counts = np.diff(s.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [words.rolling(h[s.first[r]:s.first[r + 1]], int(counts[r]))[0] for r in short]
        values, row = np.r_[values, np.array(whole, np.uint64)], np.r_[row, short]
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    n = np.bincount(row, minlength=rows).astype(np.int64)
    signature = np.zeros(rows, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        signature[some] = words.mix(np.add.reduceat(words.mix(values ^ np.uint64(0x5BF03635)), (np.cumsum(n) - n)[some]) + n[some].astype(np.uint64))
    return row, values, n, signature


def linked(inter, n_a, n_b, percent: int = PERCENT):
    return 100 * inter >= percent * (n_a + n_b - inter)


def least_overlap(n_a, n_b, percent: int = PERCENT):
    """Least overlap of sets of these sizes that are linked."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def enough(n):
    """Shingles that the prefixes of two linked sets share at least, by the smaller size."""
    return 1 + n // 20


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document (``doc_id``, ``key``: signature, ``n``) and, without an id, each shingle that several documents
    of a batch have, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures, sizes, hashes = [], [], []
            for s in words.slices(batch.column(1), _CLASSES):
                _, values, n, signature = shingle_sets(s)
                signatures.append(signature)
                sizes.append(n)
                hashes.append(values)
            values, counts = np.unique(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), return_counts=True)
            often = counts >= 4
            none = pa.nulls(int(often.sum()), pa.int64())
            key = np.concatenate([*signatures, values[often]]) if signatures else np.empty(0, np.uint64)
            n = np.concatenate([*sizes, counts[often]]) if sizes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0), none]), pa.array(_signed(key)), pa.array(n.astype(np.int64)),
                                              pa.array(np.r_[np.ones(batch.num_rows, bool), np.zeros(len(none), bool)])], names=["doc_id", "key", "n", "is_doc"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, is_doc boolean")


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit per value of ``key`` modulo the table's size, which is fixed whatever the input."""
    slot = F.pmod("key", F.lit(TABLE_BITS))
    bits = keys.groupBy((slot / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {TABLE_BITS}) % 32 as int))")).alias("bits"))
    table = np.zeros(TABLE_BITS // 32, np.uint32)
    for word, value in bits.toLocalIterator():
        table[word] = value
    return table


def _marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys % np.uint64(TABLE_BITS)).astype(np.int64)
    return (table[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def _entries(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """Prefix entries ``token``, ``sig`` and ``place`` (size in the upper 32 bits, position below) of every set; equal sets of a
    task give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in words.slices(batch.column(1), _CLASSES):
                row, values, n, signature = shingle_sets(s)
                fresh = np.zeros(len(n), bool)
                for r in np.flatnonzero(n).tolist():
                    if (key := int(signature[r])) not in seen:
                        seen.add(key)
                        fresh[r] = True
                late = _marked(frequent.value, values).astype(np.int64)
                order = np.argsort(row * 2 + late, kind="stable")
                row, values = row[order], values[order]
                position = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = (position < n[row] - -(-percent * n[row] // 100) + enough(n[row])) & fresh[row]
                row, values, position = row[keep], values[keep], position[keep]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(_signed(signature[row])), pa.array(n[row] << 32 | position)],
                                                 names=["token", "sig", "place"])

    return docs.mapInArrow(run, "token long, sig long, place long")


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def index_blocks(token, sig, n, pos, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """From the prefix entries of whole lists, for each block: leader, member, smaller size, whether the block is wide.

    Sets are ordered by signature everywhere, so a set leads the blocks that it comes first in. A set paired with itself stands
    for one of its shingles that is in any block.
    """
    order = np.lexsort((sig, token))
    token, sig, n, pos = (x[order] for x in (token, sig, n, pos))
    once = _first_of(token, sig)
    token, sig, n, pos = (x[once] for x in (token, sig, n, pos))
    starts = np.flatnonzero(_first_of(token)) if len(token) else np.empty(0, np.int64)
    several = np.repeat(np.diff(np.r_[starts, len(token)]) > 1, np.diff(np.r_[starts, len(token)]))
    token, sig, n, pos = (x[several] for x in (token, sig, n, pos))
    # Linked sizes differ by a factor of 100/percent at most; classes are a little wider, so they are in one block of two classes.
    kind = np.floor(np.log(n) / np.log(100 / percent * 1.005)).astype(np.int64)
    token, sig, n, pos = (np.r_[x, x] for x in (token, sig, n, pos))
    lower = np.r_[np.ones(len(kind), bool), np.zeros(len(kind), bool)]
    kind = np.r_[kind, kind - 1]
    for _ in range(2):  # skip by position, then by what is left
        if not len(token):
            break
        order = np.lexsort((sig, kind, token))
        token, sig, n, pos, kind, lower = (x[order] for x in (token, sig, n, pos, kind, lower))
        starts = np.flatnonzero(_first_of(token, kind))
        sizes = np.diff(np.r_[starts, len(token)])
        smallest = np.repeat(np.minimum.reduceat(n, starts), sizes)
        partner = np.maximum(smallest, -(-percent * n // 100))
        keep = (n - pos + enough(n) > least_overlap(n, partner, percent)) & np.repeat((sizes > 1) & np.logical_or.reduceat(lower, starts), sizes)
        token, sig, n, pos, kind, lower = (x[keep] for x in (token, sig, n, pos, kind, lower))
    none = np.empty(0, np.int64)
    if not len(token):
        return none, none, none, np.empty(0, bool)
    starts = np.flatnonzero(_first_of(token, kind))
    sizes = np.diff(np.r_[starts, len(token)])
    block, wide = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes > NARROW, sizes)
    firsts, seconds = [np.repeat(starts, sizes)[wide]], [np.flatnonzero(wide)]
    narrow = np.flatnonzero(~wide)
    for apart in range(1, NARROW):  # pairs of one class are counted in that class's own block only
        x, y = narrow[:-apart], narrow[apart:]
        pair = (block[x] == block[y]) & (lower[x] | lower[y])
        firsts.append(x[pair])
        seconds.append(y[pair])
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    differ = first != second
    order = np.lexsort((token, sig))
    own = order[_first_of(sig[order], token[order])]
    first, second = np.r_[first[differ], own], np.r_[second[differ], own]
    return sig[first], sig[second], np.minimum(n[first], n[second]), wide[first]


def _groups(entries: DataFrame, partitions: int, percent: int) -> DataFrame:
    """``leader``, ``member``, ``shared``, ``wide``: the pairs of sets that can be linked or share a wide block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            token, sig, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            rows = [pa.array(x) for x in index_blocks(token, sig, place >> 32, place & 0xFFFFFFFF, percent)]
            table = pa.Table.from_arrays(rows, names=["leader", "member", "least", "wide"])
            yield from table.to_batches(max_chunksize=1 << 17)

    found = entries.repartition(partitions, "token").mapInArrow(run, "leader long, member long, least long, wide boolean")
    # Summed before the shuffle by Spark; written, as it is read twice and the index is made once.
    found = frames.materialise(found.groupBy("leader", "member").agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.bool_or("wide").alias("wide")))
    # A set that is linked at all has enough shingles in blocks, whatever the other set's size.
    able = found.where(F.col("leader") == F.col("member")).where(F.col("shared") >= 1 + F.floor(F.ceil(F.col("least") * percent / 100) / 20)).select("member")
    pairs = found.where("leader != member").where(F.col("wide") | (F.col("shared") >= 1 + F.floor(F.col("least") / 20)))
    return pairs.join(able, "member").select("leader", "member", "shared", "wide")


def _set_of(blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint64)


def _sets(docs: DataFrame, live: DataFrame) -> DataFrame:
    """The ascending shingle hashes of the sets in ``live`` (``doc_id``, ``sig`` and more), as bytes.

    Tasks compute them where the texts lie and send those that a fixed-size table of signatures lets through.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(_bits(live.select(F.col("sig").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in words.slices(batch.column(1), _CLASSES):
                _, values, n, signature = shingle_sets(s)
                rows = np.flatnonzero((n > 0) & _marked(wanted.value, signature))
                cuts, raw = 8 * np.r_[0, np.cumsum(n)], values.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.low + rows)), pa.array(_signed(signature[rows])),
                                                  pa.array([raw[cuts[r]:cuts[r + 1]] for r in rows.tolist()], pa.binary())], names=["doc_id", "sig", "items"])

    return docs.mapInArrow(run, "doc_id long, sig long, items binary").join(live, ["doc_id", "sig"]).drop("doc_id")


def _differences(df: DataFrame, keep: list[str]) -> DataFrame:
    """The answer of ``items`` against ``leader_items``: sizes, overlap and, for ``tiled`` rows, both differences."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        mine, its, full = (batch.column(batch.schema.get_field_index(c)) for c in ("items", "leader_items", "tiled"))
        out = {k: [] for k in ("n", "n_leader", "overlap", "added", "dropped")}
        for a, b, tiled in zip(mine, its, full.to_pylist(), strict=True):
            a, b = _set_of(a), _set_of(b)
            place = np.searchsorted(b, a)
            place[place == len(b)] = 0
            both = b[place] == a
            gone = np.ones(len(b), bool)
            gone[place[both]] = False
            added, dropped = (a[~both].tobytes(), b[gone].tobytes()) if tiled else (b"", b"")
            for k, v in (("n", len(a)), ("n_leader", len(b)), ("overlap", int(both.sum())), ("added", added), ("dropped", dropped)):
                out[k].append(v)
        return out

    return frames.map_rows(df, keep, "n int, n_leader int, overlap int, added binary, dropped binary", work)


def _common(owners: int, of: np.ndarray, items: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many of the ascending ``asked`` each owner of ``items`` has."""
    if not len(asked) or not len(items):
        return np.zeros(owners, np.int64)
    place = np.searchsorted(asked, items)
    place[place == len(asked)] = 0
    return np.bincount(of[asked[place] == items], minlength=owners)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    sets = [_set_of(x) for x in column]
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def tile_links(table: pa.Table, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Links between the asking rows of a tile and those that answer: a spanning forest of the tile's components, so a tile
    gives fewer links than it has rows, whatever the number of pairs that are linked."""
    ask, rest = table.filter(table["asks"]), table.filter(table["answers"])
    (of_added, added), (of_dropped, dropped) = _flat(rest["added"]), _flat(rest["dropped"])
    n, gone = rest["n"].to_numpy().astype(np.int64), np.array([len(x.as_buffer()) // 8 for x in rest["dropped"]], np.int64)
    _, joined = np.unique(np.r_[rest["component"].to_numpy(), ask["component"].to_numpy()], return_inverse=True)
    nodes = rest["node"].to_numpy()
    a, b = [], []
    for x in range(ask.num_rows):
        mine, its = _set_of(ask["added"][x]), _set_of(ask["dropped"][x])
        n_x, n_p = ask["n"][x].as_py(), ask["n_leader"][x].as_py()
        overlap = n_p - len(its) - gone + _common(len(n), of_dropped, dropped, its) + _common(len(n), of_added, added, mine)
        theirs, own = joined[:len(n)], joined[len(n) + x]
        good = linked(overlap, n, n_x, percent) & (theirs != own)
        other, one = np.unique(theirs[good], return_index=True)
        found = nodes[good][one].tolist()
        a += [ask["node"][x].as_py()] * len(found)
        b += found
        joined[np.isin(joined, other)] = own
    return a, b


def _tiles(answers: DataFrame, percent: int) -> DataFrame:
    """Links between members of one group that are in different components, from their answers against the leader."""
    asks, wide = F.col("component") != F.col("leader_component"), answers
    tiles, askers = F.ceil(F.col("members") / TILE).cast("int"), F.ceil(F.col("asking") / TILE_ASKING).cast("int")
    part = F.pmod(F.xxhash64("node"), tiles).cast("int")
    asked_by = F.pmod(F.xxhash64(F.lit(1), "node"), askers).cast("int")
    shared = ["leader", "node", "component", "n", "n_leader", "added", "dropped"]
    one = (F.col("members") <= TILE) & (F.col("asking") <= TILE_ASKING)  # such a group is one tile and its rows ask from where they are
    rest = wide.select(*shared, (asks & one).alias("asks"), F.lit(True).alias("answers"), part.alias("tile"), F.explode(F.sequence(F.lit(0), askers - 1)).alias("asker"))
    ask = wide.where(asks & ~one).select(*shared, F.lit(True).alias("asks"), F.lit(False).alias("answers"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), asked_by.alias("asker"))

    def work(table):
        a, b = tile_links(table, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rest.unionByName(ask).groupBy("leader", "tile", "asker").applyInArrow(work, "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the least id that links lead to, itself included) of every row.

    Two documents link when their sets' Jaccard similarity is at least ``percent`` / 100. Null, empty and blank texts have an
    empty set and link with nothing; equal sets always link. A row without an id links with nothing and its component
    is null. Ids are integers; rows that share an id are one node.
    """
    spark = docs.sparkSession
    docs = docs.select(frames.col(doc_id).cast("long").alias("doc_id"), frames.col(text).cast("string").alias("text"))
    profile = frames.materialise(_profile(docs))
    rows = profile.where("is_doc").select("doc_id", F.col("key").alias("sig"), "n")
    entries_expected = (rows.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries_expected // PARTITION_ENTRIES) + 1)
    often = profile.where("not is_doc").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = spark.sparkContext.broadcast(_bits(often))
    some = docs.where("doc_id is not null and text is not null")
    groups = frames.materialise(_groups(_entries(some, frequent, percent), partitions, percent))
    frames.release(spark)      # the index is the largest shuffle and isn't read again

    classes = rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    best = groups.groupBy(F.col("member").alias("sig")).agg(F.max(F.struct("shared", "leader")).alias("best"))
    leaders = groups.select(F.col("leader").alias("sig")).distinct().withColumn("leads", F.lit(True))
    live = (best.select("sig", F.col("best.leader").alias("leader")).join(leaders, "sig", "full")
            .join(classes, "sig").select(F.col("rep").alias("doc_id"), "sig", F.col("rep").alias("node"), "leader", F.coalesce("leads", F.lit(False)).alias("leads")))
    live = frames.materialise(live)
    sets = frames.materialise(_sets(some, live))
    lead = sets.where("leads").select(F.col("sig").alias("leader"), F.col("node").alias("leader_node"), F.col("items").alias("leader_items"))

    first = _differences(sets.where("leader is not null").join(lead, "leader").withColumn("tiled", F.lit(False)), ["node", "leader_node"])
    links = frames.materialise(first.where(linked(F.col("overlap"), F.col("n"), F.col("n_leader"), percent)).select(F.col("node").alias("a"), F.col("leader_node").alias("b")))
    known = frames.materialise(components.components(links))

    # Pairs across components one by one; of wide groups with several components all members, in tiles.
    label = F.coalesce("component", "node")
    nodes = sets.select("sig", "node").join(known, "node", "left").select("sig", "node", label.alias("component"))
    pairs = frames.materialise(groups.withColumnRenamed("member", "sig").join(nodes, "sig").join(
        nodes.select(F.col("sig").alias("leader"), F.col("node").alias("leader_node"), F.col("component").alias("leader_component")), "leader"))
    apart = F.col("component") != F.col("leader_component")
    mixed = pairs.where(F.col("wide")).groupBy("leader").agg(F.count("*").alias("members"), F.count(F.when(apart, 1)).alias("asking")).where("asking > 0 and members > 1")
    tiled = F.col("wide") & F.col("members").isNotNull()
    asked = pairs.join(mixed, "leader", "left").withColumn("tiled", tiled).where("tiled or component != leader_component")
    keep = ["leader", "leader_node", "node", "component", "leader_component", "members", "asking", "tiled"]
    answers = frames.materialise(_differences(asked.join(sets.select("sig", "items"), "sig").join(lead.drop("leader_node"), "leader"), keep))
    found = linked(F.col("overlap"), F.col("n"), F.col("n_leader"), percent) & apart
    direct = answers.where(found).select(F.col("node").alias("a"), F.col("leader_node").alias("b"))
    across = frames.materialise(direct.unionByName(_tiles(answers.where("tiled"), percent)))
    merged = _relabelled(known, across)
    return (rows.join(classes, "sig", "left").join(merged, F.col("rep") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id")))


def _relabelled(known: DataFrame, across: DataFrame) -> DataFrame:
    """Components after the links found across them."""
    left = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    merged = components.components(across.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = frames.materialise(merged.select(F.col("node").alias("old"), F.col("component").alias("new")))
    nodes = known.unionByName(merged.select(F.col("old").alias("node"), F.col("old").alias("component"))).distinct()
    return nodes.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")) \
        .groupBy("node").agg(F.min("component").alias("component"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents whose id is the least of their component, and those without an id; of rows that share an id and a
    text one stays."""
    found = join(docs, doc_id, text, percent).select("doc_id", "component_id").distinct().where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    ident = frames.col(doc_id).cast("long")
    df = docs.select(F.struct(*[frames.col(c) for c in docs.columns]).alias("doc"), ident.alias("_id"))
    kept = df.where("_id is not null").join(found, F.col("_id") == F.col("_kept")).select("doc")
    kept = kept.select("doc", F.row_number().over(Window.partitionBy(F.col("doc").getField(doc_id), F.xxhash64(F.col("doc").getField(text))).orderBy(F.lit(1))).alias("_k")).where("_k = 1").select("doc")
    return frames.unpacked(kept.unionByName(df.where("_id is null").select("doc")), docs.columns)
