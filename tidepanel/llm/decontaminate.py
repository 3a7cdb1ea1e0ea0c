"""Benchmark decontamination: a broadcast hash set of normalised test windows scanned over every document.

The test items are cut into windows on the driver, a bounded block of items at a time. A block is broadcast as sorted
window hashes with the place of each window in the normalised item text. Documents are scanned where they lie, without a
shuffle: window hashes are looked up column-wise and each hit is compared byte by byte. Items beyond one block are
scanned in further passes, each adding to the hits of the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames, words

WINDOW = 13
#: Bytes of item text per broadcast; a block's index takes about 40 times the number of its words.
BLOCK_BYTES = 4 << 20

_CLASSES = words.byte_classes(words.ALNUM_SEPARATORS, lower=True)
MADE = "n_words long, hits array<struct<first:int,last:int>>, items array<string>"


@dataclass
class Block:
    """Windows of a block of items. ``by_size``: sorted hashes, item numbers, first and last byte in ``text``."""

    ids: list[str]
    text: bytes
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def normalised(s: words.Words, low: int, high: int) -> bytes:
    """Words ``low`` to ``high`` of a slice, joined by one space."""
    return b" ".join(s.data[a:b].tobytes() for a, b in zip(s.starts[low:high], s.ends[low:high], strict=True))


def index(rows: list[tuple[str, str]], window: int = WINDOW) -> Block:
    """Cuts items into windows; an item shorter than a window is one window, one without words has none."""
    ids, parts, found, at = [], [], {}, 0
    for key, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        s = words.cut(raw, np.array([0, len(raw)]), _CLASSES)
        if n := len(s.starts):
            size = min(window, n)
            hashes, first = words.windows(s.hashes(), s.first, size)
            joined = normalised(s, 0, n)
            begin = at + np.r_[0, np.cumsum(s.ends - s.starts + 1)]
            found.setdefault(size, []).append((hashes, np.full(len(first), len(ids)), begin[first], begin[first + size] - 1))
            ids.append(key)
            parts.append(joined)
            at += len(joined) + 1
    by_size = {}
    for size, several in found.items():
        columns = [np.concatenate(c) for c in zip(*several, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        by_size[size] = tuple(c[order] for c in columns)
    return Block(ids, b" ".join(parts), by_size)


def _scan_slice(s: words.Words, block: Block) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Marks of the slice's words that lie in a verified window, and the items found per row."""
    hashes, row, marks, items = s.hashes(), s.row(), np.zeros(len(s.starts), bool), {}
    for size, (known, item, begin, end) in block.by_size.items():
        window, first = words.windows(hashes, s.first, size)
        place = np.searchsorted(known, window)
        place[place == len(known)] = 0
        for k in np.flatnonzero(known[place] == window):
            at, p = int(first[k]), int(place[k])
            joined = normalised(s, at, at + size)
            while p < len(known) and known[p] == window[k]:
                if block.text[begin[p]:end[p]] == joined:
                    marks[at:at + size] = True
                    items.setdefault(int(row[at]), set()).add(block.ids[item[p]])
                p += 1
    return marks, items


def _scan(df: DataFrame, keep: list[str], block, again: bool) -> DataFrame:
    """One pass; ``again`` adds to the hits of an earlier pass."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        known = block.value
        n_words = np.zeros(batch.num_rows, np.int64)
        runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        items: list[list[str]] = [[] for _ in range(batch.num_rows)]
        names = batch.schema.get_field_index
        for s in words.slices(batch.column(names("text")), _CLASSES):
            marks, found = _scan_slice(s, known)
            n_words[s.low:s.high] = np.diff(s.first)
            before = {}
            if again:
                for r in range(s.low, s.high):
                    if past := batch.column(names("hits"))[r].as_py():
                        before[r - s.low] = set(batch.column(names("items"))[r].as_py())
                        for run in past:
                            marks[s.first[r - s.low] + run["first"]:s.first[r - s.low] + run["last"] + 1] = True
            for r in {*found, *before}:
                inside = np.diff(np.r_[0, marks[s.first[r]:s.first[r + 1]].astype(np.int8), 0])
                runs[s.low + r] = [{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True)]
                items[s.low + r] = sorted(found.get(r, set()) | before.get(r, set()))
        return {"n_words": n_words, "hits": runs, "items": items}

    return frames.map_rows(df, keep, MADE, work)


def find(df: DataFrame, items: DataFrame, keep: list[str], item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``hits`` (runs of hit words, counted from 0) and ``items`` (sorted ids as text) to ``keep``.

    ``df`` has the column ``text``. Null and empty texts have no words and no hits. Items without words hit nothing;
    a null id is listed as ``null``; rows that share an id are one item. Without items nothing is hit.
    """
    spark = df.sparkSession
    items = items.select(F.coalesce(frames.col(item_id).cast("string"), F.lit("null")).alias("id"), frames.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    passes = [*keep] if "text" in keep else [*keep, "text"]
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(index([tuple(r) for r in part.collect()], window))
        if k:
            df = frames.materialise(df)
        df = _scan(df, keep if k == blocks - 1 else passes, block, k > 0)
    return df


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)


def contaminated(hit: Column | str = "n_hit", n: Column | str = "n_words", share: int = 20) -> Column:
    """True where at least one word in ``share`` is hit."""
    hit, n = (F.col(c) if isinstance(c, str) else c for c in (hit, n))
    return (hit > 0) & (share * hit >= n)


def remove_spans(df: DataFrame, keep: list[str]) -> DataFrame:
    """``cleaned``: the text without its hit runs, from the first letter of a run to its last; null stays null."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts, hits = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "hits"))
        cleaned = texts.to_pylist()
        for s in words.slices(texts, _CLASSES):
            for r in range(s.low, s.high):
                if runs := hits[r].as_py():
                    first, a, kept = s.first[r - s.low], int(s.offsets[r - s.low]), []
                    for run in runs:
                        kept.append(s.raw[a:s.starts[first + run["first"]]].tobytes())
                        a = int(s.ends[first + run["last"]])
                    kept.append(s.raw[a:s.offsets[r - s.low + 1]].tobytes())
                    cleaned[r] = b"".join(kept).decode()
        return {"cleaned": cleaned}

    return frames.map_rows(df, keep, "cleaned string", work)


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without contamination.

    ``documents`` drops each document with at least one hit word in twenty and leaves the others untouched; ``spans``
    keeps every document and cuts the hit runs out of its text. Columns and repeated rows stay.
    """
    df = frames.packed(docs, text)
    if mode == "documents":
        found = find(df, items, ["doc"], **options)
        return frames.unpacked(found.where(~contaminated(n_hit())), docs.columns)
    cut = remove_spans(find(df, items, ["doc", "text"], **options), ["doc"])
    return frames.unpacked(cut, docs.columns, text, F.col("cleaned"))
