"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary's byte strings resolves, column-wise, every pre-token that is
itself in the vocabulary; a slot's bytes are compared before it counts. Second tier: the other pre-tokens are merged one by
one with a heap of adjacent pairs over linked bytes, lowest rank and then leftmost first. Ranks are read on the driver
and broadcast (a tokenizer's vocabulary, of fixed size).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepanel.llm import frames
from tidepanel.llm.words import mix

#: Merged pre-tokens in each of the two generations that a worker remembers (about 150 bytes each).
REMEMBERED = 300_000
_SLICE = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes and the id, one per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; runs tile ``data`` without gaps."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    terms = np.multiply.accumulate(power)[np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)]
    terms *= _VALUES[data]
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def _equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each run of ``a`` equals the run of the same length of ``b``; lengths are positive."""
    if not len(lengths):
        return np.empty(0, bool)
    begin = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum()))
    return np.logical_and.reduceat(a[step + np.repeat(a_starts - begin, lengths)] == b[step + np.repeat(b_starts - begin, lengths)], begin)


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets, the largest bucket first tries displacements until
    all its keys meet free slots of a table that has exactly one slot per key."""

    def __init__(self, keys: np.ndarray, per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key_at = np.full(self.n, -1, np.int64)
        taken = np.zeros(self.n, bool)
        order = np.argsort(bucket, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(bucket, minlength=self.buckets))]
        for b in np.argsort(-np.diff(ends), kind="stable"):
            members = order[ends[b]:ends[b + 1]]
            if not len(members):
                break
            d = 0
            while True:
                trial = np.arange(d, d + 64 if len(members) > 1 else d + 4096, dtype=np.uint64)
                slots = (mix(keys[members][None, :] ^ mix(trial + np.uint64(1))[:, None]) % np.uint64(self.n)).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.shift[b], taken[slots[k]] = trial[k], True
                    self.key_at[slots[k]] = members
                    break
                d += len(trial)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        return (mix(keys ^ mix(self.shift[bucket] + np.uint64(1))) % np.uint64(self.n)).astype(np.int64)


def _splitter(pattern: str):
    """Text -> code points of each match, and the bytes of each code point.

    A pattern of ASCII literals, ``\\s``, ``\\S``, ``\\p{L}`` and ``\\p{N}`` sees only the class of a code point beyond ASCII. Such
    texts are mapped to one ASCII byte a code point (letter, number, white space, other), which ``re`` splits.
    """
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    if not plain.isascii() or "." in plain or regex.search(r"\\[^sS]", plain):
        find = regex.compile(pattern).findall

        def split_any(text: str) -> tuple[list[int], np.ndarray]:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            return [len(m) for m in find(text)], _utf8_sizes(points)

        return split_any
    find, classes = re.compile(plain.encode()).findall, _classes()

    def split(text: str) -> tuple[list[int], np.ndarray | None]:
        if text.isascii():
            return list(map(len, find(text.encode()))), None
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return list(map(len, find(classes[points].tobytes()))), _utf8_sizes(points)

    return split


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    return (1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> itself in ASCII, else ``a`` for letters, ``1`` for numbers, TAB for white space, ``!`` for the rest."""
    table = np.full(0x110000, ord("!"), np.uint8)
    table[:0x80] = np.arange(0x80)
    kinds = {"L": ord("a"), "N": ord("1"), "Z": ord("\t")}
    for c in range(0x80, 0x110000):
        if kind := kinds.get(unicodedata.category(chr(c))[0]):
            table[c] = kind
    table[0x85] = ord("\t")
    return table


class Codec:
    """Encoder and decoder of one vocabulary: its byte strings in a row, their lengths and their ids."""

    def __init__(self, data: bytes, lengths: np.ndarray, ids: np.ndarray, perfect: PerfectHash, pattern: str):
        self.data, self.lengths, self.ids, self.perfect = np.frombuffer(data, np.uint8), lengths, ids, perfect
        self.starts = np.cumsum(lengths) - lengths
        self.ranks = {data[a:a + n]: r for a, n, r in zip(self.starts.tolist(), lengths.tolist(), ids.tolist(), strict=True)}
        self.split = _splitter(pattern)
        self.word_of_id = np.zeros(int(ids.max()) + 1, np.int64)
        self.word_of_id[ids] = np.arange(len(ids))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merged(self, token: bytes) -> bytes:
        """Ids, as bytes, of a pre-token that isn't in the vocabulary; recent ones are remembered."""
        found = self.young.get(token)
        if found is None:
            found = self.old.get(token)
            if found is None:
                found = array("I", self.merge(token)).tobytes()
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[token] = found
        return found

    def merge(self, token: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost first, until no pair is in the vocabulary."""
        rank, n = self.ranks.get, len(token)
        wide = n.bit_length()
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it belongs to a part before
        before = list(range(-1, n))  # begin of the part that ends where this one begins
        heap = []
        for i in range(n - 1):
            r = rank(token[i:i + 2])
            if r is not None:
                heap.append((r << wide | i) << wide | (i + 2))
        heapq.heapify(heap)
        mask = (1 << wide) - 1
        while heap:
            x = heapq.heappop(heap)
            stop, i = x & mask, x >> wide & mask
            j = end[i]
            if not j or j >= stop or end[j] != stop:
                continue  # one of the pair has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = rank(token[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r << wide | i) << wide | end[stop])
            h = before[i]
            if h >= 0:
                r = rank(token[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r << wide | h) << wide | stop)
        ids, i = [], 0
        while i < n:
            ids.append(rank(token[i:end[i]]))
            i = end[i]
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        pieces = [self.split(t) for t in texts]
        raw = "".join(texts).encode()
        data = np.frombuffer(raw, np.uint8)
        first = np.r_[0, np.cumsum([len(p) for p, _ in pieces])].astype(np.int64)
        bounds = np.zeros(first[-1] + 1, np.int64)
        at = 0
        for k, (lengths, sizes) in enumerate(pieces):
            ends = np.cumsum(lengths, dtype=np.int64)
            if sizes is not None:
                ends = np.cumsum(sizes)[ends - 1]
            bounds[first[k] + 1:first[k + 1] + 1] = at + ends
            at += int(ends[-1]) if len(ends) else 0
        starts, lengths = bounds[:-1], np.diff(bounds)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes = _hash(data, starts, lengths)
        word = self.perfect.key_at[self.perfect.slots(hashes)]
        same = self.lengths[word] == lengths
        same[same] = _equal(data, starts[same], self.data, self.starts[word[same]], lengths[same])
        counts = np.ones(len(starts), np.int64)
        misses = np.flatnonzero(~same)
        _, alike, which = np.unique(hashes[misses], return_index=True, return_inverse=True)
        alike = misses[alike]
        if not ((lengths[alike[which]] == lengths[misses]).all() and _equal(data, starts[misses], data, starts[alike[which]], lengths[misses]).all()):
            alike, which = misses, np.arange(len(misses))  # two pre-tokens share a hash
        known = [self.merged(raw[a:b]) for a, b in zip(starts[alike].tolist(), bounds[alike + 1].tolist(), strict=True)]
        merged = [known[k] for k in which.tolist()]
        counts[misses] = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        place = np.r_[0, np.cumsum(counts)]
        out = np.empty(place[-1], np.uint32)
        out[place[:-1][same]] = self.ids[word[same]]
        if len(misses):
            n = counts[misses]
            flat = np.frombuffer(b"".join(merged), np.uint32)
            out[np.arange(len(flat)) + np.repeat(place[misses] - np.cumsum(n) + n, n)] = flat
        return out, np.diff(place[first])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        word = self.word_of_id[ids]
        sizes = self.lengths[word]
        shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
        raw = self.data[np.repeat(self.starts[word], sizes) + np.arange(len(shift)) - shift].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def vocabulary(ranks: dict[bytes, int], pattern: str) -> tuple:
    """What a codec is made of; the perfect hash is built once, on the driver."""
    words = list(ranks)
    data, lengths = b"".join(words), np.array([len(w) for w in words], np.int64)
    perfect = PerfectHash(_hash(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths, lengths))
    return data, lengths, np.array(list(ranks.values()), np.uint32), perfect, pattern


_CODECS: dict[int, Codec] = {}


def _codec(broadcast) -> Codec:
    """The worker's codec of a broadcast vocabulary; one is kept."""
    key = hash((broadcast.value[0], broadcast.value[4]))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*broadcast.value)
    return _CODECS[key]


def _batches(texts: list[str]):
    """Consecutive texts of about two million code points together."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE or k == len(texts) - 1:
            yield low, k + 1
            low, size = k + 1, 0


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (digests of the ids as little-endian 32-bit integers and
    of the bytes decoded from them) and, unless switched off, ``ids`` to the columns ``keep``.

    ``df`` has the column ``text``; a null text is encoded as an empty one: no ids. No special tokens are recognised.
    """
    broadcast = df.sparkSession.sparkContext.broadcast(vocabulary(ranks, pattern))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        codec = _codec(broadcast)
        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        all_ids, n_tokens, ids_sha, decoded_sha = [], [], [], []
        for low, high in _batches(texts):
            ids, counts = codec.encode(texts[low:high])
            little, ends = ids.astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(counts)]).tolist()
            ids_sha += [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            decoded_sha += [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, counts)]
            n_tokens.append(counts)
            if with_ids:
                all_ids.append(ids.astype(np.int32))
        n = np.concatenate(n_tokens) if n_tokens else np.empty(0, np.int64)
        out = {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
        if with_ids:
            out["ids"] = frames.list_array(pa.array(np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)), n)
        return out

    return frames.map_rows(df, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, work)


def decode(df: DataFrame, ranks: dict[bytes, int], keep: list[str]) -> DataFrame:
    """Adds ``bytes``, decoded from the column ``ids``, to ``keep``; null ids decode to no bytes."""
    broadcast = df.sparkSession.sparkContext.broadcast(vocabulary(ranks, "."))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        lists = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        counts = np.array([len(x or ()) for x in lists], np.int64)
        ids = np.fromiter((i for x in lists for i in x or ()), np.int64)
        return {"bytes": _codec(broadcast).decode(ids, counts)}

    return frames.map_rows(df, keep, "bytes binary", work)
