"""Substring dedup by level-wise doubling.

Every window of ``window`` words is represented, at a shorter length, by the least hash among its windows of that length.
Two equal windows have equal representatives, so a representative that occurs in one document only rules out all windows it
stands for. Levels go from about ``window / 2`` words to twice that; only windows whose representatives repeat at one length
are taken to the next, until none survive or the full length is reached. Longer repeats need no further level: each of
their words lies in a repeated window of the full length.

Documents are dealt to units of a few megabytes once; that one exchange serves all levels. A unit sends each distinct hash
with its least and greatest document, so a passage that all documents share costs one entry per unit, not one per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames, words

WINDOW = 13
UNIT_BYTES = 3 << 20
#: Hashes that meet in one reduction, about.
BUCKET_ENTRIES = 400_000
_CLASSES = words.byte_classes(words.SPACED, lower=False)


def level_sizes(window: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before; the last is ``window``."""
    sizes = [window]
    while sizes[0] > 8:
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of the ``n`` values from each place on."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:len(values) - (n - width)], values[n - width:]) if n > width else values


class _Unit:
    """Words, windows and documents of a unit's rows."""

    def __init__(self, ids: pa.ChunkedArray, text: pa.ChunkedArray, window: int):
        self.window = window
        known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        lanes, firsts, n = [[], []], [np.zeros(1, np.int64)], 0
        self.slices = []
        for s in words.slices(text, _CLASSES):
            for lane in (0, 1):
                lanes[lane].append(s.hashes(lane))
            firsts.append(s.first[1:] + n)
            n += len(s.starts)
            self.slices.append(s)
        self.lanes = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in lanes]
        self.first = np.concatenate(firsts)
        starts = words.window_starts(self.first, window)
        row = np.searchsorted(self.first, starts, "right") - 1
        self.starts, self.row = starts[known[row]], row[known[row]]

    def representatives(self, size: int) -> np.ndarray:
        """The least hash of ``size`` words inside each window that is left."""
        return _least(words.rolling(self.lanes[0], size), self.window - size + 1)[self.starts]

    def narrow(self, size: int, repeated: np.ndarray) -> None:
        """Keeps the windows whose representatives are among the sorted ``repeated`` ones."""
        found = self.representatives(size)
        place = np.searchsorted(repeated, found)
        place[place == len(repeated)] = 0
        left = repeated[place] == found if len(repeated) else np.zeros(len(found), bool)
        self.starts, self.row = self.starts[left], self.row[left]

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hash columns of each window left: its representative and zero, or at full length 96 bits of two independent hashes."""
        if size < self.window:
            found = self.representatives(size)
            return found, np.zeros(len(found), np.uint32)
        a, b = (words.rolling(lane, size)[self.starts] for lane in self.lanes)
        return a, (b >> np.uint64(32)).astype(np.uint32)


def _group(a: np.ndarray, b: np.ndarray, least: np.ndarray, greatest: np.ndarray):
    """Order of the rows, begin of each group of equal (a, b), and its extremes."""
    order = np.lexsort((b, a)) if b.any() else np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    if not len(a):
        return order, begin, least, greatest
    return order, begin, np.minimum.reduceat(least[order], begin), np.maximum.reduceat(greatest[order], begin)


_SENT = "unit int, bucket int, a binary, b binary, least binary, greatest binary"
_ANSWER = "unit int, a binary, b binary, least binary"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(blobs: list[bytes], counts: np.ndarray) -> np.ndarray:
    parts = [np.frombuffer(pa.decompress(x, 8 * int(n), codec="zstd", asbytes=True), np.int64) for x, n in zip(blobs, counts, strict=True) if n]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _send(unit: _Unit, number: int, size: int, buckets: int) -> pa.Table:
    """The unit's distinct hashes of a level, by bucket."""
    a, b = unit.keys(size)
    row = unit.row
    if len(a):  # neighbours often share their representative
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (row[1:] != row[:-1])
        a, b, row = a[fresh], b[fresh], row[fresh]
    doc = unit.ids[row]
    order, begin, least, greatest = _group(a, b, doc, doc)
    a, b = a[order][begin], b[order][begin]
    bucket = ((a >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    out = {n: [] for n in ("unit", "bucket", "a", "b", "least", "greatest")}
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = by[cuts[k]:cuts[k + 1]]
        out["unit"].append(number)
        out["bucket"].append(k)
        out["a"].append(a[part].tobytes())
        out["b"].append(b[part].tobytes() if size == unit.window else b"")
        out["least"].append(_pack(least[part]))
        out["greatest"].append(_pack(greatest[part] - least[part]))
    return pa.table({n: pa.array(v, pa.int32() if n in ("unit", "bucket") else pa.binary()) for n, v in out.items()})


def _answer(sent: pa.Table, last: bool) -> pa.Table:
    """For each unit, its hashes that occur in two documents; on the last level those that a document before also has."""
    unit = sent["unit"].to_numpy()
    blobs = {n: sent[n].to_pylist() for n in ("a", "b", "least", "greatest")}
    counts = np.array([len(x) // 8 for x in blobs["a"]], np.int64)
    a = np.frombuffer(b"".join(blobs["a"]), np.uint64)
    b = np.frombuffer(b"".join(blobs["b"]), np.uint32) if last else np.zeros(len(a), np.uint32)
    least = _unpack(blobs["least"], counts)
    greatest = least + _unpack(blobs["greatest"], counts)
    order, begin, low, high = _group(a, b, least, greatest)
    sizes = np.diff(np.r_[begin, len(a)])
    low, high = np.repeat(low, sizes), np.repeat(high, sizes)
    asked = greatest[order] > low if last else high > low
    order, low = order[asked], low[asked]
    of = np.repeat(np.arange(len(unit)), counts)[order]
    by = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[by], np.arange(len(unit) + 1))
    out = {n: [] for n in ("unit", "a", "b", "least")}
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = by[cuts[k]:cuts[k + 1]]
        out["unit"].append(int(unit[k]))
        out["a"].append(a[order[part]].tobytes())
        out["b"].append(b[order[part]].tobytes() if last else b"")
        out["least"].append(_pack(low[part]) if last else b"")
    return pa.table({n: pa.array(v, pa.int32() if n == "unit" else pa.binary()) for n, v in out.items()})


def _joined(answers: pa.Table, name: str, dtype=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(answers[name].to_pylist()), dtype)


def _removed(unit: _Unit, answers: pa.Table) -> np.ndarray:
    """Marks of the unit's words that lie in a window which a document before also has."""
    a, b = _joined(answers, "a"), _joined(answers, "b", np.uint32)
    least = _unpack(answers["least"].to_pylist(), np.array([len(x) // 8 for x in answers["a"].to_pylist()], np.int64))
    wa, wb = unit.keys(unit.window)
    # Answers and windows are ranked together, so that equality of both hashes is looked up at once.
    order, begin, _, _ = _group(np.r_[a, wa], np.r_[b, wb], np.zeros(len(a) + len(wa), np.int64), np.zeros(len(a) + len(wa), np.int64))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
    earliest = np.full(len(begin), np.iinfo(np.int64).max)
    earliest[group[:len(a)]] = least
    gone = earliest[group[len(a):]] < unit.ids[unit.row]
    return words.covered(unit.starts[gone], unit.window, len(unit.lanes[0]))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every row.

    A word goes if a window around it starts, with the same words, in a row with a smaller id; windows are judged on the
    input. Ids are integers. A row without an id neither loses words nor makes others lose any; rows that share an id
    don't either, among themselves. Null and empty texts have no words, and texts shorter than a window lose none.
    """
    total, = docs.agg(F.sum(F.octet_length(frames.col(text)))).first()
    total = total or 0
    units = max(1, -(-total // unit_bytes))
    buckets = max(1, total // 25 // BUCKET_ENTRIES)
    ident, body = frames.col(doc_id).cast("long"), frames.col(text).cast("string")
    dealt = docs.select(ident.alias("doc_id"), body.alias("text"), F.pmod(F.xxhash64(ident, F.octet_length(body)), F.lit(units)).cast("int").alias("unit"))
    sizes = level_sizes(window)

    def narrowed(table: pa.Table, past: pa.Table, upto: int) -> _Unit:
        unit = _Unit(table["doc_id"], table["text"], window)
        levels = past["level"].to_numpy()
        for k in range(upto):
            unit.narrow(sizes[k], np.sort(_joined(past.filter(pa.array(levels == k)), "a")))
        return unit

    def sender(level: int):
        def first(key, table):
            return _send(_Unit(table["doc_id"], table["text"], window), key[0].as_py(), sizes[level], buckets)

        def later(key, table, before):
            if not table.num_rows:
                return pa.table({n: pa.array([], t) for n, t in _types(_SENT).items()})
            return _send(narrowed(table, before, level), key[0].as_py(), sizes[level], buckets)

        return later if level else first

    def answerer(last: bool):
        return lambda table: _answer(table, last)

    past = None
    for level in range(len(sizes)):
        grouped = dealt.groupBy("unit")
        sent = grouped.cogroup(past.groupBy("unit")).applyInArrow(sender(level), _SENT) if level else grouped.applyInArrow(sender(0), _SENT)
        answer = sent.groupBy("bucket").applyInArrow(answerer(level == len(sizes) - 1), _ANSWER).select(F.lit(level).alias("level"), "unit", "a", "b", "least")
        past = past.unionByName(answer) if level else answer

    def finish(table, before):
        out = {"doc_id": table["doc_id"], "n_words": [], "n_removed": [], "kept": []}
        if table.num_rows:
            unit = narrowed(table, before, len(sizes) - 1)
            levels = before["level"].to_numpy()
            gone = _removed(unit, before.filter(pa.array(levels == len(sizes) - 1)))
            n = 0
            for s in unit.slices:
                stay = ~gone[n:n + len(s.starts)]
                n += len(s.starts)
                out["n_words"] += np.diff(s.first).tolist()
                for r in range(len(s.first) - 1):
                    low, high = int(s.first[r]), int(s.first[r + 1])
                    left = np.flatnonzero(stay[low:high]) + low
                    out["n_removed"].append(high - low - len(left))
                    out["kept"].append(b" ".join([s.raw[x:y].tobytes() for x, y in zip(s.starts[left].tolist(), s.ends[left].tolist(), strict=True)]).decode())
        return pa.table({"doc_id": out["doc_id"].cast(pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                         "n_removed": pa.array(out["n_removed"], pa.int64()), "kept": pa.array(out["kept"], pa.string())})

    return dealt.groupBy("unit").cogroup(past.groupBy("unit")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def _types(ddl: str) -> dict[str, pa.DataType]:
    return {n: pa.int32() if t == "int" else pa.binary() for n, t in (x.split() for x in ddl.split(", "))}
