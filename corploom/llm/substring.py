"""Substring deduplication with a count-min prefilter.

A window is a fixed number of consecutive words of one document.  A word goes
when a window covers it whose word sequence also starts in a document with a
smaller id; windows are judged on the input.

Texts shuffle once, each compressed, into blocks of a few MB by a hash of the id,
and three passes read that one shuffle:

1. Each block marks the count-min cells of its windows.  Its partial sketch is
   kept sparse, cut by range of cells and coded in about log2(cells a mark) + 3
   bits a window and row of the sketch, however short a message is; the task of a range merges the partial
   sketches of all blocks and returns to each block which of its cells were
   marked twice or more.  A count is never under the true one, so no repeated
   window is lost.  The sketch has a fixed number of cells per window of the
   whole corpus, so it is as selective on any amount of data, and no task holds
   more than one range.
2. Windows whose cells are marked twice in every row are estimated repeated.
   Each block sends their exact 128-bit keys, one a distinct window with its
   smallest id there, to the task of a key range, which finds the smallest id
   overall and returns one bit a key: whether another block has a smaller one.
3. Each block applies those bits and removes the covered words.

A window that a third of all documents share costs one entry a block.

Blocks and ranges meet in one message each, so both grow with the corpus, blocks
from `block_bytes` to `most_block_bytes` and ranges from 2**`cell_bits` to
2**`most_cell_bits` cells: at 1 TB, 30,000 blocks and 20,000 ranges exchange
messages of some 280 windows, together 0.9 bytes for each byte of text.


Cases: a null or empty text has no words, and is returned with none; texts
shorter than a window lose nothing; rows with one id do not affect each other;
a null id counts as the largest; rows with one id and one length share a block;
a very long text is a block of its own, in memory of about fifteen times its
bytes; an empty table gives an empty result; other
columns, whatever their names, pass through `drop_repeated_passages` unchanged
but for the text and, if named, its length.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps
from inspect import signature
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corploom.llm import blocks, shared

U64 = np.uint64
_NO_ID = np.iinfo(np.int64).max
_SALTS = (0x8B72E3C1F4A6D905, 0x3D4F1A9E6C8B2705)
MESSAGE = "block int, kind int, part int, payload binary"


@dataclass(frozen=True)
class SubstringParameters:
    window: int = 13
    block_bytes: int = 8 << 20
    most_block_bytes: int = 32 << 20
    cells_per_window: int = 8
    bytes_per_word: int = 6
    cell_bits: int = 24  # of one range of the sketch: a cell is one byte while it is merged
    most_cell_bits: int = 26


@dataclass(frozen=True)
class _Layout:
    size: int
    blocks: int
    ranges: int
    cell_bits: int

    @classmethod
    def of(cls, total: int, least_blocks: int, p: SubstringParameters) -> _Layout:
        size, bits = p.block_bytes, p.cell_bits
        while total // size > 8192 and 2 * size <= p.most_block_bytes:
            size *= 2
        cells = total // p.bytes_per_word * p.cells_per_window
        while cells >> bits > 4096 and bits < p.most_cell_bits:
            bits += 1
        return cls(p.window, max(least_blocks, -(-total // size)), max(1, -(-cells >> bits)), bits)


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned values as an Elias-Fano code: low bits as they are, high bits as gaps in unary."""
    n = len(values)
    base = int(values[0])
    values = values - values[0]
    b = max(0, (int(values[-1]) + 1).bit_length() - n.bit_length())
    unary = np.zeros(n + (int(values[-1]) >> b) + 1, np.uint8)
    unary[(values >> values.dtype.type(b)).astype(np.int64) + np.arange(n)] = 1
    low = np.empty((b, n), np.uint8)
    for k in range(b):
        low[k] = values >> values.dtype.type(k) & values.dtype.type(1)
    return struct.pack("<IBQ", n, b, base) + np.packbits(low.ravel()).tobytes() + np.packbits(unary).tobytes()


def _expand(blob: bytes, kind: type = np.uint32) -> np.ndarray:
    n, b, base = struct.unpack_from("<IBQ", blob)
    at = 13 + (n * b + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at)))[:n] - np.arange(n)
    out = high.astype(kind) << kind(b)
    low = np.unpackbits(np.frombuffer(blob, np.uint8, at - 13, 13), count=n * b).reshape(b, n)
    for k in range(b):
        out |= low[k].astype(kind) << kind(k)
    return out + kind(base)


def _flags(marks: np.ndarray) -> bytes:
    """Bits, compressed where that is shorter."""
    raw = np.packbits(marks).tobytes()
    packed = _pack(raw)
    return b"\1" + packed if len(packed) < len(raw) else b"\0" + raw


def _read_flags(blob: bytes, n: int) -> np.ndarray:
    raw = _unpack(blob[1:]) if blob[0] else blob[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n)


def _marks(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a message, and which of them its block marked twice or more."""
    (size,) = struct.unpack_from("<I", blob)
    cells = _expand(blob[4 : 4 + size])
    return cells, _read_flags(blob[4 + size :], len(cells))


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _tidied(group: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one group that frees memory at its end; its parameters stay visible to Spark."""

    @wraps(group)
    def run(*args: Any) -> pa.Table:
        try:
            return group(*args)
        finally:
            blocks.trim()

    run.__signature__ = signature(group)
    return run


def _unpacked(packed: pa.ChunkedArray) -> pa.Array:
    """Texts as bytes, from a column of compressed ones."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x.as_buffer()) if x.is_valid else b"" for x in packed], pa.binary())


class _Windows:
    """All windows of one block: exact keys, sketch cells, and where they start."""

    def __init__(self, packed: pa.ChunkedArray, lay: _Layout) -> None:
        self.data, self.offsets, _ = blocks.utf8(_unpacked(packed))
        self.cell_bits, size = lay.cell_bits, lay.size
        self.words, firsts, seconds, starts, rows, base = [], [], [], [], [], 0
        for i, j in blocks.row_slices(self.offsets):
            words = blocks.split_words(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i])
            at, first = blocks.window_hashes(words.hashes(0), words.rows, size)
            _, second = blocks.window_hashes(words.hashes(1), words.rows, size, 1)
            del words.chunks  # four times the size of the words themselves
            self.words.append((i, base, words))
            firsts.append(first)
            seconds.append(second)
            starts.append(at + base)
            rows.append(words.row_of_word()[at] + i)
            base += len(words.starts)
        self.n_words = base
        none = np.zeros(0, np.int64)
        self.first = np.concatenate([none.astype(U64), *firsts])
        self.second = np.concatenate([none.astype(U64), *seconds])
        self.start = np.concatenate([none, *starts])
        self.row = np.concatenate([none, *rows])

    def cells(self, row: int, ranges: int) -> np.ndarray:
        """Cell of each window in one row of the sketch: range number, then the cell inside it."""
        h = blocks.mix64(self.first ^ U64(_SALTS[row]))
        return ((((h >> U64(40)) * U64(ranges)) >> U64(24)) << U64(self.cell_bits)) | (h & U64((1 << self.cell_bits) - 1))


def _by_range(sorted_cells: np.ndarray, lay: _Layout) -> Iterator[tuple[int, int, int]]:
    edges = np.searchsorted(sorted_cells, np.arange(lay.ranges + 1, dtype=U64) << U64(lay.cell_bits))
    for r in range(lay.ranges):
        if edges[r + 1] > edges[r]:
            yield r, edges[r], edges[r + 1]


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "kind", "part", "payload"), columns, kinds)})


@_tidied
def _sketch(block: pa.Table, text_at: int, lay: _Layout) -> pa.Table:
    """Pass 1: the sparse partial sketch of a block, by row and range."""
    w = _Windows(block.column(text_at), lay)
    number = block.column(0)[0].as_py()
    out = []
    for row in range(len(_SALTS)):
        cells = np.sort(w.cells(row, lay.ranges))
        if not len(cells):
            continue
        first = np.ones(len(cells), bool)
        first[1:] = cells[1:] != cells[:-1]
        at = np.flatnonzero(first)
        twice = np.diff(at, append=len(cells)) > 1
        cells = cells[at]
        own = (cells & U64((1 << lay.cell_bits) - 1)).astype(np.uint32)
        for r, i, j in _by_range(cells, lay):
            code = _squeeze(own[i:j])
            out.append((number, row, row * lay.ranges + r, struct.pack("<I", len(code)) + code + _flags(twice[i:j])))
    return _table(out)


@_tidied
def _merge_sketch(parts: pa.Table, cell_bits: int) -> pa.Table:
    """The counts of one range over all blocks, and back to each block its cells counted twice or more."""
    counts = np.zeros(1 << cell_bits, np.uint8)
    rows = parts.to_pydict()
    for blob in rows["payload"]:
        cells, twice = _marks(blob)
        counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
    out = []
    for block, kind, part, blob in zip(*(rows[k] for k in ("block", "kind", "part", "payload"))):
        cells, _ = _marks(blob)
        again = cells[counts[cells] >= 2]
        if len(again):
            out.append((block, kind, part, _squeeze(again)))
    return _table(out)


class _Candidates:
    """Windows of a block estimated repeated, grouped by exact key in key order."""

    def __init__(self, w: _Windows, ids: np.ndarray, answers: list[tuple[int, int, bytes]], lay: _Layout) -> None:
        maybe = np.ones(len(w.first), bool)
        for row in range(len(_SALTS)):
            mine = sorted((part - row * lay.ranges, blob) for kind, part, blob in answers if kind == row)
            again = [(U64(r) << U64(lay.cell_bits)) | _expand(blob).astype(U64) for r, blob in mine]
            again = np.concatenate(again) if again else np.zeros(0, U64)
            at = np.flatnonzero(maybe)
            cells = w.cells(row, lay.ranges)[at]
            where = np.searchsorted(again, cells)
            hit = where < len(again)
            hit[hit] = again[where[hit]] == cells[hit]
            maybe[at[~hit]] = False
        at = np.flatnonzero(maybe)
        order = np.lexsort((w.second[at], w.first[at]))
        self.at = at[order]
        self.first, self.second = w.first[self.at], w.second[self.at]
        self.ids = ids[w.row[self.at]]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.begin = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.ids, self.begin) if len(self.begin) else np.zeros(0, np.int64)

    def key_ranges(self, ranges: int) -> Iterator[tuple[int, int, int]]:
        """Runs of distinct keys by range of the first half."""
        number = ((self.first[self.begin] >> U64(40)) * U64(ranges)) >> U64(24)
        edges = np.searchsorted(number, np.arange(ranges + 1, dtype=U64))
        for r in range(ranges):
            if edges[r + 1] > edges[r]:
                yield r, edges[r], edges[r + 1]


def _ids(block: pa.Table, at: int) -> np.ndarray:
    return pc.fill_null(block.column(at).cast(pa.int64()), _NO_ID).to_numpy()


def _answers(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(*(table.column(k).to_pylist() for k in ("kind", "part", "payload"))))


@_tidied
def _exact_keys(block: pa.Table, answers: pa.Table, id_at: int, text_at: int, lay: _Layout) -> pa.Table:
    """Pass 2: exact keys of the windows estimated repeated, each with the smallest id in this block."""
    if not block.num_rows or not answers.num_rows:
        return _table([])
    c = _Candidates(_Windows(block.column(text_at), lay), _ids(block, id_at), _answers(answers), lay)
    first, second = c.first[c.begin], c.second[c.begin]
    number = block.column(0)[0].as_py()
    out = []
    for r, i, j in c.key_ranges(lay.ranges):
        planes = c.least[i:j].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        code = _squeeze(first[i:j])
        out.append((number, len(_SALTS), r, struct.pack("<II", j - i, len(code)) + code + second[i:j].tobytes() + _pack(planes)))
    return _table(out)


@_tidied
def _least_ids(parts: pa.Table) -> pa.Table:
    """For each block and key of one range: does another block hold a smaller id?"""
    rows = parts.to_pydict()
    firsts, seconds, ids, sizes = [], [], [], []
    for blob in rows["payload"]:
        n, size = struct.unpack_from("<II", blob)
        firsts.append(_expand(blob[8 : 8 + size], U64))
        seconds.append(np.frombuffer(blob, U64, n, 8 + size))
        ids.append(np.frombuffer(_unpack(blob[8 + size + 8 * n :]), np.uint8).reshape(8, n).T.copy().view("<i8").ravel())
        sizes.append(n)
    first, second, least = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(ids)
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    a, b = first[order], second[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    overall = np.minimum.reduceat(least[order], begin)
    smaller = np.empty(len(order), bool)
    smaller[order] = overall[np.cumsum(new) - 1] < least[order]
    out, at = [], 0
    for block, kind, part, n in zip(rows["block"], rows["kind"], rows["part"], sizes):
        out.append((block, kind, part, _pack(np.packbits(smaller[at : at + n]).tobytes())))
        at += n
    return _table(out)


def _removed_words(block: pa.Table, answers: pa.Table, id_at: int, text_at: int, lay: _Layout) -> tuple[_Windows, np.ndarray]:
    """Pass 3: the windows of a block, and which of its words go."""
    w = _Windows(block.column(text_at), lay)
    told = _answers(answers)
    c = _Candidates(w, _ids(block, id_at), told, lay)
    elsewhere = np.zeros(len(c.begin), bool)
    bits = {part: blob for kind, part, blob in told if kind == len(_SALTS)}
    for r, i, j in c.key_ranges(lay.ranges):
        elsewhere[i:j] = np.unpackbits(np.frombuffer(_unpack(bits[r]), np.uint8), count=j - i).astype(bool)
    gone = elsewhere[c.group] | (c.ids > c.least[c.group])
    return w, blocks.cover(w.n_words, w.start[c.at[gone]], lay.size)


def _kept_texts(w: _Windows, removed: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Kept words of each row joined by one space, word counts and removed counts."""
    texts, counts, gone = [], [], []
    for _, base, words in w.words:
        keep = ~removed[base : base + len(words.starts)]
        starts, ends = words.starts[keep], words.ends[keep]
        lengths = ends - starts + 1  # a word and a space
        placed = np.concatenate([[0], np.cumsum(lengths)])
        source = np.repeat(starts - placed[:-1], lengths) + np.arange(placed[-1])
        joined = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
        joined[placed[1:] - 1] = 0x20
        out = joined.tobytes()
        before = np.concatenate([[0], np.cumsum(keep)])[words.rows]
        for i, j in zip(placed[before[:-1]].tolist(), placed[before[1:]].tolist()):
            texts.append(out[i : max(j - 1, i)])
        counts.append(words.counts)
        gone.append(blocks.sum_by_row(~keep, words.rows))
    none = [np.zeros(0, np.int64)]
    return pa.array(texts, pa.binary()).cast(pa.string()), np.concatenate(none + counts), np.concatenate(none + gone)


def drop_repeated_passages(
    docs: DataFrame, p: SubstringParameters | None = None, *, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, counts: bool = False
) -> DataFrame:
    """Every row with its text reduced to the kept words; with ``counts`` also n_words and n_removed."""
    p = p or SubstringParameters()
    shared.bound_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()[0]
    lay = _Layout.of(total, shared.shuffle_parts(docs.sparkSession), p)
    n_blocks = lay.blocks
    names = docs.columns
    id_at, text_at = names.index(id_column) + 1, names.index(text_column) + 1
    length_at = names.index(length_column) + 1 if length_column else None
    block = F.pmod(F.xxhash64(docs[id_column], F.octet_length(docs[text_column])), F.lit(n_blocks)).cast("int")
    keyed = docs.select(block.alias("__block"), *(docs[c] for c in names))
    slim = T.StructType([T.StructField(f.name, T.BinaryType()) if k == text_at else f for k, f in enumerate(keyed.schema)])

    @blocks.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            packed = pa.array([squeeze(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary())
            columns = [packed if k == text_at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=slim.names)

    placed = keyed.mapInArrow(pack, slim).repartition(n_blocks, "__block")
    by_block = placed.groupBy("__block")

    partial = by_block.applyInArrow(lambda t: _sketch(t, text_at, lay), MESSAGE)
    merged = partial.groupBy("part").applyInArrow(lambda t: _merge_sketch(t, lay.cell_bits), MESSAGE)
    keys = by_block.cogroup(merged.groupBy("block")).applyInArrow(lambda t, a: _exact_keys(t, a, id_at, text_at, lay), MESSAGE)
    least = keys.groupBy("part").applyInArrow(_least_ids, MESSAGE)
    extra = ", n_words long, n_removed long" if counts else ""
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + extra

    @_tidied
    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if not t.num_rows:
            columns = {n: t.column(k + 1) for k, n in enumerate(names)}
            return pa.table(columns | ({"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64())} if counts else {}))
        w, removed = _removed_words(t, answers, id_at, text_at, lay)
        text, n_words, n_removed = _kept_texts(w, removed)
        columns = [t.column(k + 1) for k in range(len(names))]
        columns[text_at - 1] = text
        if length_at:
            columns[length_at - 1] = pc.utf8_length(text).cast(t.schema.field(length_at).type)
        if counts:
            columns += [pa.array(n_words), pa.array(n_removed)]
        return pa.Table.from_arrays(columns, names=[*names, *(["n_words", "n_removed"] if counts else [])])

    return by_block.cogroup(merged.union(least).groupBy("block")).applyInArrow(finish, schema)
