"""Words, word hashes and window hashes of whole text columns, computed column-wise inside tasks.

A slice holds a few megabytes of consecutive rows, or one longer row, so memory follows the slice and the longest
text, not the table. Separators are bytes below 0x80, hence splitting UTF-8 bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SEED = 20240229


def byte_classes(separators: bytes, lower: bool) -> np.ndarray:
    """Byte -> byte; separators become 0. Zero bytes that are no separators cannot be told apart, so NUL maps to 1."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1
    if lower:
        table[ord("A"):ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: Words of the contract: anything but blank and the control characters TAB to CR.
SPACED = bytes([0x20, *range(0x09, 0x0E)])
#: Words of the contamination rule: digits, letters a-z and everything beyond ASCII.
ALNUM_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and their inverses modulo 2**64, grown to the longest slice seen."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_LANES = [_Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD1342543DE82EF95 | 1)]
_VALUES = np.random.default_rng(_SEED).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[:, 0] = 0


@dataclass
class Words:
    """The words of rows ``low`` to ``high`` of a column."""

    low: int
    high: int
    data: np.ndarray      #: the slice's bytes after the class table (0: separator)
    raw: np.ndarray       #: the slice's bytes as they are
    offsets: np.ndarray   #: byte offsets of the rows in ``data``, one more than rows
    starts: np.ndarray    #: first byte of each word
    ends: np.ndarray      #: byte after each word
    first: np.ndarray     #: number of the first word of each row, one more than rows

    def row(self) -> np.ndarray:
        """Row of each word, counted from ``low``."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the lanes are independent."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        up, down = _LANES[lane].to(len(self.data))
        terms = _VALUES[lane][self.data]
        terms *= up[:len(terms)]
        return mix(np.add.reduceat(terms, self.starts) * down[self.starts])


def slices(column: pa.Array | pa.ChunkedArray, classes: np.ndarray, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Cuts a string column into slices of whole rows; null and empty texts have no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    bytes_ = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + slice_bytes, "right")) - 1)
        high = min(high, len(column))
        raw = bytes_[offsets[low]:offsets[high]]
        yield cut(raw, offsets[low:high + 1] - offsets[low], classes, low, high)
        low = high


def cut(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray, low: int = 0, high: int = 1) -> Words:
    """The words of the rows that ``offsets`` cuts ``raw`` into."""
    data = classes[raw]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0
    begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    both = edges[inside[edges] & inside[edges + 1]]  # a word ends where a row ends, whatever follows
    begins[both] = stops[both] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return Words(low, high, data, raw, offsets, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on, whatever row they are in."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= np.uint64(0xA24BAED4963EE407)
        total += hashes[k:n + k]
    return mix(total)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the words at which a window of ``size`` words of one row starts."""
    n = int(first[-1]) - size + 1 if len(first) else 0
    if n <= 0:
        return np.empty(0, np.int64)
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.flatnonzero(np.arange(n) + size <= row_end)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` consecutive words of one row, and the number of its first word."""
    starts = window_starts(first, size)
    return rolling(hashes, size)[starts], starts


def covered(starts: np.ndarray, sizes: np.ndarray | int, n: int) -> np.ndarray:
    """Marks of ``n`` words: True inside any run that begins at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:-1]) > 0
