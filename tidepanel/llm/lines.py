"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of all lines they share, short lines joined with their neighbours to runs
of the least weight that is deleted. A pair is always (first document that has the run, later document), so a run adds one pair
per later document, however many share it. The two line sequences, as hashes, are aligned with patience diff, with the longest common runs where no line is unique, and blocks of the alignment are deleted from the later document. Only hashes are
joined; texts move once, to have their lines cut.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames
from tidepanel.llm.quality import BLANKS

#: Aligned blocks of fewer words stay.
MIN_WORDS = 5
#: Of the hashes that find equal runs; what they find is compared.
_PRIME, _BASE = (1 << 61) - 1, 0x9E3779B97F4A7C1
#: Tells equal runs of one document apart.
_AGAIN = 0xC2B2AE3D27D4EB4F


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest increasing chain of lines that occur once in both ranges."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
    once = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and x in place]
    tops, chain, before = [], [], []
    for k, (i, _) in enumerate(once):
        pile = bisect_left(tops, i)
        if pile == len(tops):
            tops.append(i)
            chain.append(k)
        else:
            tops[pile], chain[pile] = i, k
        before.append(chain[pile - 1] if pile else -1)
    out, k = [], chain[-1] if chain else -1
    while k >= 0:
        out.append(once[k])
        k = before[k]
    return out[::-1]


def _prefixes(x: list[int]) -> list[int]:
    """Polynomial hashes of all beginnings."""
    return list(accumulate(x, lambda h, v: (h * _BASE + v) % _PRIME, initial=0))


def _runs(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of the longest common runs of both ranges: the first, then the next ones after it that are as long.

    What is left between them has shorter runs only, so a range is searched once per length.
    """
    common = set(a[a0:a1]) & set(b[b0:b1])
    if not common:
        return []
    in_a, in_b = _prefixes(a[a0:a1]), _prefixes(b[b0:b1])

    def windows(h: list[int], n: int) -> list[int]:
        power = pow(_BASE, n, _PRIME)
        return [(y - x * power) % _PRIME for x, y in zip(h, h[n:])]

    longest, above = 1, min(a1 - a0, b1 - b0) + 1
    while above - longest > 1:
        n = (longest + above) // 2
        if set(windows(in_a, n)).isdisjoint(windows(in_b, n)):
            above = n
        else:
            longest = n
    places: dict[int, list[int]] = {}
    for i, x in enumerate(windows(in_a, longest), a0):
        places.setdefault(x, []).append(i)
    out, i, j = [], a0, b0
    for k, x in enumerate(windows(in_b, longest), b0):
        if k < j or x not in places:
            continue
        at = bisect_left(places[x], i)
        if at < len(places[x]) and a[(m := places[x][at]):m + longest] == b[k:k + longest]:
            out += zip(range(m, m + longest), range(k, k + longest))
            i, j = m + longest, k + longest
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending in both: equal ends, unique common lines in order, and so on between them.

    A range without a unique common line is aligned by its longest common runs.
    """
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 < a1 and b0 < b1 and (chain := _anchors(a, b, a0, a1, b0, b1) or _runs(a, b, a0, a1, b0, b1)):
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
                todo.append((i + 1, k, j + 1, m))
            matched += chain
    return sorted(matched)


def blocks(matched: list[tuple[int, int]], weights: list[int], least: int = MIN_WORDS) -> list[int]:
    """Places of the later sequence in runs that are consecutive in both and weigh at least ``least``."""
    gone, run = [], []
    for k, (i, j) in enumerate(matched):
        if run and (i, j) != (matched[k - 1][0] + 1, matched[k - 1][1] + 1):
            gone += run if sum(weights[x] for x in run) >= least else []
            run = []
        run.append(j)
    return gone + (run if sum(weights[x] for x in run) >= least else [])


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (id and text hash) and the ``lines`` with a word: two independent hashes, line number, word count.

    Lines are compared without blanks at either end. Rows without an id or a text have no entry; equal rows have one.
    """
    body = frames.col(text).cast("string")
    df = docs.select(F.struct(frames.col(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("text")).alias("key"), body.alias("body"))
    df = df.where("key.id is not null and body is not null").select("key", F.explode(F.array(F.split("body", "\n", -1))).alias("raw"))

    def entry(line, number):
        line = F.btrim(line, F.lit(BLANKS))
        return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"), number.alias("no"),
                        F.size(F.split(line, "[\\x20\\x09-\\x0D]+", -1)).alias("words"))

    lines = F.filter(F.transform("raw", entry), lambda e: e["h"] != F.xxhash64(F.lit("")))
    return df.select("key", lines.alias("lines")).where(F.size("lines") > 0).dropDuplicates(["key"])


def run_hashes(h: np.ndarray, words: np.ndarray, lengths: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shortest runs of at least ``least`` words that start or end at each line, and their number per document.

    ``h`` and ``words`` are the lines of all documents one after the other, ``lengths`` the lines of each. Any line of a common
    block of that weight lies in such a run inside the block. The second, third, ... equal run of a document has its own hash.
    """
    h, n = h.astype(np.uint64), len(h)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    last, first = np.repeat(ends, lengths), np.repeat(ends - lengths, lengths)
    weight = np.r_[0, np.cumsum(words.astype(np.int64))]
    stop = np.searchsorted(weight, weight[:-1] + least)                           # runs from each line on
    start = np.searchsorted(weight, weight[1:] - least, "right") - 1              # runs up to each line
    forth, back = stop <= last, start >= first
    lo, hi = np.r_[np.arange(n)[forth], start[back]], np.r_[stop[forth], np.arange(1, n + 1)[back]]
    lo, hi = np.divmod(np.unique(lo * (n + 1) + hi), n + 1)                       # each place once
    of = doc[lo]
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1])]
    runs = (sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)
    order = np.lexsort((runs, of))
    new = np.r_[True, (runs[order][1:] != runs[order][:-1]) | (of[order][1:] != of[order][:-1])] if len(runs) else np.zeros(0, bool)
    nth = np.empty(len(runs), np.uint64)
    nth[order] = np.arange(len(runs)) - np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    return (runs + nth * np.uint64(_AGAIN)).astype(np.int64), np.bincount(of, minlength=len(lengths))


def overlaps(table: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Distinct pairs ``earlier``, ``later`` of keys, for each later document and the first holder of each of its runs.

    Runs, not lines: short lines that first stand apart in several documents may first stand together in yet another one. A run
    that a document holds twice leads to the first document that holds it twice as well.
    """
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        h, words = (batch.column(batch.schema.get_field_index(n)) for n in ("h", "words"))
        runs, lengths = run_hashes(h.flatten().to_numpy(), words.flatten().to_numpy(), h.value_lengths().to_numpy(), least)
        return {"runs": frames.list_array(pa.array(runs), lengths)}

    slim = table.select("key", "lines.h", "lines.words")
    held = frames.map_rows(slim, ["key"], "runs array<bigint>", work).select("key", F.explode("runs").alias("h"))
    shared = held.groupBy("h").agg(F.count("*").alias("df"), F.min("key").alias("earlier")).where("df > 1")
    return held.join(shared, "h").where("key.id > earlier.id").select("earlier", F.col("key").alias("later")).distinct()


def deletions(table: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``key`` and the numbers ``gone`` of its lines in aligned blocks, for documents that lose any."""
    slim = table.select("key", F.transform("lines", lambda e: e["g"]).alias("g"))
    later = table.select(F.col("key").alias("later"), F.transform("lines", lambda e: e["g"]).alias("later_g"),
                         F.transform("lines", lambda e: e["no"]).alias("no"), F.transform("lines", lambda e: e["words"]).alias("words"))
    pairs = overlaps(table, least).join(later, "later")
    pairs = pairs.join(slim.select(F.col("key").alias("earlier"), F.col("g").alias("earlier_g")), "earlier")

    def align(batch: pa.RecordBatch) -> dict[str, object]:
        a, b, no, weights = (batch.column(batch.schema.get_field_index(n)) for n in ("earlier_g", "later_g", "no", "words"))
        gone = []
        for x, y, n, w in zip(a, b, no, weights, strict=True):
            y, n = y.as_py(), n.as_py()
            gone.append([n[j] for j in blocks(patience(x.as_py(), y), w.as_py(), least)])
        return {"gone": gone}

    found = frames.map_rows(pairs.select("later", "earlier_g", "later_g", "no", "words"), ["later"], "gone array<int>", align)
    return (found.where(F.size("gone") > 0).groupBy(F.col("later").alias("key"))
            .agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``doc`` (the whole row), ``n_lines``, ``n_deleted``, ``cleaned``, ``emptied`` (lines were deleted, no word is left).

    Of two documents the one with the smaller id is the earlier. Rows without an id stay as they are, rows that share an id
    are not compared, a null text stays null, an empty table gives an empty one.
    """
    gone = deletions(frames.materialise(line_table(docs, doc_id, text)), least)
    body = F.col("text")
    df = frames.packed(docs, text).withColumn("key", F.struct(F.col("doc").getField(doc_id).cast("long").alias("id"), F.xxhash64(body).alias("text")))
    df = df.join(gone, df.key.eqNullSafe(gone.key), "left").drop("key")
    df = df.select("doc", "text", "gone", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    lines = F.col("lines")
    numbers = F.when(F.size("lines") > 0, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    cleaned = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n"))
    return df.select("doc", F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
                     F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_deleted"), cleaned.alias("cleaned")) \
        .withColumn("emptied", (F.col("n_deleted") > 0) & (F.translate("cleaned", BLANKS, "") == ""))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the deleted lines; those of which no word is left go."""
    return frames.unpacked(dedup(docs, doc_id, text, **options).where("not coalesce(emptied, false)"), docs.columns, text, F.col("cleaned"))
