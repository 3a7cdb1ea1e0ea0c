"""Language identification by prediction by partial matching (PPM).

Per language a context tree over bytes holds how often each byte follows each context of up to ``ORDER`` bytes. A byte costs
-log2 of its share in the longest context that has seen it, plus the escapes from the longer contexts that have not (escape
method C, without exclusions). The language with the shortest code wins. Counts are frozen after training, so the costs
of all byte strings seen in training are tabulated once; others take the escape and look one byte less back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepanel.llm import frames
from tidepanel.llm.words import mix

ORDER = 4
#: Training sample of a language: its documents of least hash, as many as fit in both bounds; texts are never cut.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1 << 20
#: More labels than this are refused: tables and training grow with their number.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_START = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20


class _Table:
    """Open addressing from codes to rows of a cost table; at most one slot in eight is taken."""

    def __init__(self, codes: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(np.ceil(np.log2(8 * max(1, len(codes)))))))
        self.codes = np.full(1 << (64 - int(self.bits)), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
        self.rows = np.zeros(len(self.codes), np.int32)
        left = np.arange(len(codes))
        slot = (mix(codes) >> self.bits).astype(np.int64)
        while len(left):
            free = self.codes[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[left], return_index=True)
            placed = np.zeros(len(left), bool)
            placed[one] = free[one]
            at = left[placed]
            self.codes[slot[at]], self.rows[slot[at]] = codes[at], at
            left = left[~placed]
            slot[left] = (slot[left] + 1) % len(self.codes)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where it is absent."""
        slot = (mix(codes) >> self.bits).astype(np.int64)
        seen = self.codes[slot]
        out = np.where(seen == codes, self.rows[slot], np.int32(-1))
        left = np.flatnonzero((seen != codes) & (seen != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.codes)
            seen = self.codes[slot[left]]
            hit = seen == codes[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


@dataclass
class Model:
    """``costs[k]``: bits of the last byte of each known string of k + 1 bytes, per language; ``escapes[k]``: bits of the
    escape from each known context of k + 1 bytes."""

    languages: list[str]
    codes: list[np.ndarray]
    costs: list[np.ndarray]
    escapes: list[np.ndarray]
    none: np.ndarray  #: escape from the empty context

    def tables(self) -> list[_Table]:
        return [_Table(c) for c in self.codes]


def codes_of(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each byte, as one integer; the first ``length - 1`` entries are meaningless."""
    out = np.zeros(len(data), np.uint64)
    for back in range(length):
        out[back:] |= data[:len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


def prepared(text: str) -> bytes:
    """Lower-cased bytes after a fixed start context."""
    return _START + text.lower().encode()


def count_grams(texts: list[str], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length 1 to ``order`` + 1: the byte strings that end inside a text, and how often."""
    parts = [prepared(t) for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(data)) - begin >= len(_START)
    return [np.unique(codes_of(data, k + 1)[inside], return_counts=True) for k in range(order + 1)]


def build(languages: list[str], grams: list[list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER) -> Model:
    """Cost tables from each language's counts."""
    some = len(languages)
    codes, costs, escapes = [], [], []
    for k in range(order + 1):
        known = np.unique(np.concatenate([g[k][0] for g in grams]))
        cost = np.zeros((len(known), some), np.float32)
        for x in range(some):
            values, counts = grams[x][k]
            c = np.zeros(len(known))
            c[np.searchsorted(known, values)] = counts
            context = known >> np.uint64(8)  # the bytes before the last
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(known) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(known)])
            total = np.repeat(np.add.reduceat(c, starts), sizes) if len(known) else c
            kinds = np.repeat(np.add.reduceat((c > 0).astype(float), starts), sizes) if len(known) else c
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                own = np.log2((total + kinds) / np.maximum(c, 1))
            if k:
                suffix = known & np.uint64((1 << (8 * k)) - 1)
                lower = costs[k - 1][np.searchsorted(codes[k - 1], suffix), x]
            else:
                lower = np.full(len(known), 8.0)
            cost[:, x] = np.where(c > 0, own, escape + lower)
            if k == 0:
                escapes.append(np.zeros(some)) if x == 0 else None
                escapes[0][x] = escape[0] if len(escape) else 0.0
            else:
                if x == 0:
                    escapes.append(np.zeros((len(codes[k - 1]), some), np.float32))
                at = np.searchsorted(codes[k - 1], context[starts])
                fits = (at < len(codes[k - 1]))
                fits[fits] = codes[k - 1][at[fits]] == context[starts][fits]
                escapes[k][at[fits], x] = escape[starts][fits]
        codes.append(known)
        costs.append(cost)
    return Model(languages, codes, costs, escapes[1:], np.asarray(escapes[0], np.float32))


def bits_of(model: Model, tables: list[_Table], texts: list[str]) -> np.ndarray:
    """Code length of each text under each language."""
    parts = [prepared(t) for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    at = np.flatnonzero(np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= len(_START))
    full = codes_of(data, len(tables))[at]
    cost = np.zeros((len(at), len(model.languages)), np.float32)
    left = np.arange(len(at))
    for k in range(len(tables) - 1, -1, -1):
        row = tables[k].find(full[left] & np.uint64((1 << (8 * (k + 1))) - 1))
        hit = row >= 0
        if hit.all() and k == len(tables) - 1:
            cost = model.costs[k][row]
            left = left[:0]
            break
        cost[left[hit]] += model.costs[k][row[hit]]
        left = left[~hit]
        if not len(left):
            break
        if k:
            context = tables[k - 1].find(full[left] >> np.uint64(8) & np.uint64((1 << (8 * k)) - 1))
            known = context >= 0
            cost[left[known]] += model.escapes[k - 1][context[known]]
        else:
            cost[left] += model.none + np.float32(8.0)
    lengths = sizes - len(_START)
    out = np.zeros((len(texts), len(model.languages)))
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.add.reduceat(cost.astype(np.float64), (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of the labelled rows of ``docs``; None without any. Counting runs in tasks, table by table, on the sample."""
    slim = docs.select(frames.col(text).cast("string").alias("text"), frames.col(lang).cast("string").alias("lang"), F.xxhash64(frames.col(order_by)).alias("h"))
    slim = slim.where("text is not null and lang is not null")
    # Ranks first, on hashes and lengths alone: each task keeps the best of its rows per label before anything moves.
    ranked = slim.select("lang", "h", F.octet_length("text").alias("bytes")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "bytes"))).where(F.col("k") <= sample_docs)
    total = F.sum("bytes").over(Window.partitionBy("lang").orderBy("k"))
    chosen = ranked.withColumn("total", total).where((F.col("total") <= sample_bytes) | (F.col("k") == 1)).select("lang", "h").distinct()
    labels = sorted(r.lang for r in chosen.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not labels:
        return None
    if len(labels) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    sample = slim.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text")

    def count(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in sorted(set(names)):
                for k, (codes, counts) in enumerate(count_grams([t for n, t in zip(names, texts, strict=True) if n == label])):
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), pa.string()), pa.array(np.full(len(codes), k, np.int32)),
                                                      pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "k", "code", "n"])

    rows = sample.mapInArrow(count, "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    names, lengths = np.array(table["lang"].to_pylist()), table["k"].to_numpy()
    codes, counts = table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    grams = []
    for label in labels:
        per = []
        for k in range(ORDER + 1):
            mine = (names == label) & (lengths == k)
            order = np.argsort(codes[mine])
            per.append((codes[mine][order], counts[mine][order]))
        grams.append(per)
    return build(labels, grams)


_MODELS: dict[str, tuple] = {}


def _ready(broadcast) -> tuple[Model, list[_Table]]:
    if broadcast.id not in _MODELS:
        _MODELS.clear()
        _MODELS[broadcast.id] = (broadcast.value, broadcast.value.tables())
    return _MODELS[broadcast.id]


class _Sent:
    """A broadcast model with a name that workers can tell apart."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.broadcast.value


def predict(df: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the posterior of the prediction under equal priors, 0 to 1) to ``keep``.

    ``df`` has the column ``text``. Null texts, texts without a letter and everything under no model are ``und`` with
    score 0. Ties go to the label that sorts first.
    """
    if model is None:
        return df.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = _Sent(df.sparkSession.sparkContext.broadcast(model))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        known, tables = _ready(sent)
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        todo = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        low, size = 0, 0
        for k, place in enumerate(todo):
            size += len(texts[place])
            if size >= _SLICE or k == len(todo) - 1:
                some = todo[low:k + 1]
                bits = bits_of(known, tables, [texts[p] for p in some])
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                scores[some] = 1.0 / np.exp2(-gap).sum(axis=1)
                for p, x in zip(some, best.tolist(), strict=True):
                    labels[p] = known.languages[x]
                low, size = k + 1, 0
        return {"lang_pred": labels, "score": scores}

    return frames.map_rows(df, keep, "lang_pred string, score double", work)
