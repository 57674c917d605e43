"""Byte-level text kernels in numpy, shared by the operators.

Every kernel works on a slice of an Arrow string column as one byte array plus
row offsets, so a batch costs a few vectorised passes and no Python object per
word.  Words are runs of bytes other than space and 0x09-0x0D, which is the
regular expression ``[^\\x20\\x09-\\x0D]+`` read as UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, wraps
from typing import Any

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text handled in one vectorised step; keeps temporaries in tens of MB.
SLICE_BYTES = 1 << 20

_libc = ctypes.CDLL(None)


def trim() -> None:
    """Gives memory that is free in this process back: workers stay alive between tasks, next to the JVM's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(rows: Callable[[Any], Iterator[Any]]) -> Callable[[Any], Iterator[Any]]:
    """A generator function over a task's batches that frees memory at its end."""

    @wraps(rows)
    def run(batches: Any) -> Iterator[Any]:
        try:
            yield from rows(batches)
        finally:
            trim()

    return run


_MULTIPLIERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and validity of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
        wide = np.int32
    else:
        column, wide = column.cast(pa.large_string()), np.int64
    valid = ~np.asarray(column.is_null())
    if not valid.all():
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0], valid


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < size:
        size = max(1 << 16, 1 << (size - 1).bit_length())
        tables = []
        for base in (_MULTIPLIERS[which], pow(_MULTIPLIERS[which], -1, 1 << 64)):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[which] = tuple(tables)
    return _powers[which]


@dataclass
class Chunks:
    """Byte spans as runs of 64-bit values, the last of each filled up with zeros."""

    values: np.ndarray
    place: np.ndarray  # of a value in its span
    first: np.ndarray  # values of span i: first[i]:first[i + 1]
    lengths: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Chunks:
        lengths = ends - starts
        counts = (lengths + 7) >> 3
        first = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        anywhere = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        place = np.arange(first[-1]) - np.repeat(first[:-1], counts)
        left = np.repeat(lengths, counts) - 8 * place
        values = anywhere[np.repeat(starts, counts) + 8 * place].astype(U64, copy=False)
        short = np.flatnonzero(left < 8)
        values[short] &= (U64(1) << (8 * left[short]).astype(U64)) - U64(1)
        return cls(values, place, first, lengths)

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of each span: its values, each mixed with a key of its place, added up and mixed with the length.

        Every place has a key of its own, and mixing is not linear, so no
        arrangement of bytes cancels out as it can in a polynomial modulo 2**64.
        """
        salt = (which * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
        most = int(self.place.max()) + 1 if len(self.place) else 1
        keys = mix64(np.arange(1, most + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(salt))
        mixed = mix64(mix64(self.values ^ keys[self.place]) + keys[self.place])
        some = np.flatnonzero(self.lengths)
        out = np.zeros(len(self.lengths), U64)
        if len(some):
            out[some] = np.add.reduceat(mixed, self.first[some])
        return mix64(out ^ (self.lengths.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(salt)))

    def differ(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which pairs of spans, given by number, hold different bytes."""
        out = self.lengths[one] != self.lengths[other]
        same = np.flatnonzero(~out)
        a, b = self.first[one[same]], self.first[other[same]]
        counts = self.first[one[same] + 1] - a
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        wrong = self.values[np.repeat(a, counts) + at] != self.values[np.repeat(b, counts) + at]
        out[np.repeat(same, counts)[wrong]] = True
        return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``."""
    return Chunks.of(data, starts, ends).hashes(which)


@dataclass
class Words:
    """Words of a run of rows: byte spans, and per row the range of its words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # word range of row i: rows[i]:rows[i + 1]

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks.of(self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return self.chunks.hashes(which)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


class Rolling:
    """Hashes of windows of any number of words, rolled from one running polynomial in the hashes of the words."""

    def __init__(self, word_hash: np.ndarray, rows: np.ndarray, which: int = 0) -> None:
        self.rows, self.n = rows, len(word_hash)
        forward, self.backward = _power_tables(which, self.n + 1)
        self.running = np.zeros(self.n + 1, U64)
        np.cumsum(word_hash * forward[: self.n], out=self.running[1:])
        self.left = np.repeat(rows[1:], np.diff(rows)) - np.arange(self.n)  # words from here to the end of the row

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start indices of the windows of ``size`` words inside one row, and a hash of each."""
        starts = np.flatnonzero(self.left >= size)
        return starts, mix64((self.running[starts + size] - self.running[starts]) * self.backward[starts])


def window_hashes(word_hash: np.ndarray, rows: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return Rolling(word_hash, rows, which).windows(size)


def salt_by_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that differ between rows, for equality inside a row only."""
    return mix64(keys + row.astype(U64) * U64(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks keys that occur more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = ordered[1:] == ordered[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def cover(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Marks the words inside windows of ``size`` words at ``starts``."""
    edge = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + size, minlength=n_words + 1)
    return np.cumsum(edge[:-1]) > 0


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets."""
    running = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]
