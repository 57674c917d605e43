"""Quality rules: base counts and repetition coverage of whole texts.

Repetition coverage rolls the hashes of the n-grams of all lengths from one
running polynomial in numpy and measures the share of word characters that lie
inside n-grams, or on lines, that the same text holds more than once.

The limits are those published for repeated n-grams of five to ten words and
for characters on repeated lines with the Gopher models (Rae et al. 2021,
"Scaling Language Models: Methods, Analysis & Insights from Training Gopher",
table A1).  They act far below the base rule, which needs repeats of three words
to cover half a text.

Cases: a null text counts as one without words and fails the base rule, as does
any text under 50 words; an empty table gives an empty result; repeated rows
and ties are judged row by row; a text longer than a slice of `blocks` is
measured whole, in memory of about fifty times its bytes; extra columns pass through `drop_low_quality`
untouched whatever their names, and `quality_rules` returns only its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corploom.llm import blocks, shared

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
)


@dataclass(frozen=True)
class RepetitionLimits:
    """Largest percentage of word characters inside repeated n-grams, by length, and on repeated lines."""

    ngrams: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 20
    min_words: int = 50
    repeat_percent: int = 50


def measure(text: pa.Array, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """The measures of each row of a string column."""
    data, offsets, _ = blocks.utf8(text)
    parts = [_measure_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits) for i, j in blocks.row_slices(offsets)]
    if not parts:
        parts = [_measure_rows(data, offsets, limits)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _measure_rows(data: np.ndarray, offsets: np.ndarray, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    words = blocks.split_words(data, offsets)
    row = words.row_of_word()
    code_points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
    chars = code_points[words.ends - 1] - code_points[words.starts] + 1 if len(words.starts) else np.zeros(0, np.int64)
    word_chars = blocks.sum_by_row(chars, words.rows)
    n_words = words.counts
    rolling = blocks.Rolling(words.hashes(), words.rows)

    def covered(size: int) -> np.ndarray:
        starts, keys = rolling.windows(size)
        again = blocks.repeated(blocks.salt_by_row(keys, row[starts]))
        return blocks.cover(len(row), starts[again], size)

    n_repeat = blocks.sum_by_row(covered(3), words.rows)
    dup_chars = np.stack([blocks.sum_by_row(chars * covered(n), words.rows) for n in limits.ngrams], axis=1)
    n_dup_lines, dup_line_chars = _lines(words, chars)
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_percent * n_words)
    most = np.array(list(limits.ngrams.values()))
    bad = (100 * dup_chars > most * word_chars[:, None]).any(axis=1) | (100 * dup_line_chars > limits.lines * word_chars)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": blocks.sum_by_row(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~(base_failed | bad),
        "dup_line_chars": dup_line_chars,
        "dup_ngram_chars": dup_chars,
    }


def _lines(words: blocks.Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word that equal an earlier line, and word characters on those."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    # Line spans: each row starts one, and each break ends one and starts another.
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    starts.sort()
    ends.sort()
    owner = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(words.starts, starts)
    last = np.searchsorted(words.starts, ends)
    some = (last > first) & (ends > starts)
    starts, ends, first, last = starts[some], ends[some], first[some], last[some]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    keys = blocks.salt_by_row(blocks.span_hashes(data, starts, ends), owner)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = ordered[1:] == ordered[:-1]
    running = np.concatenate([[0], np.cumsum(chars)])
    n = len(offsets) - 1
    line_chars = running[last] - running[first]
    return np.bincount(owner[later], minlength=n).astype(np.int64), np.bincount(owner[later], weights=line_chars[later], minlength=n).astype(np.int64)


def quality_rules(docs: DataFrame, limits: RepetitionLimits | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the base counts, the repetition measures and the verdict. Narrow: no shuffle."""
    limits = limits or RepetitionLimits()
    shared.bound_batches(docs.sparkSession)

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1), limits)
            many = m.pop("dup_ngram_chars")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(many) + 1, dtype=np.int32) * many.shape[1]), pa.array(many.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, m.values()), lists], names=["doc_id", *m, "dup_ngram_chars"])

    return docs.select(docs[id_column], docs[text_column]).mapInArrow(rows, SCHEMA)


def drop_low_quality(docs: DataFrame, limits: RepetitionLimits | None = None, *, text_column: str = "text") -> DataFrame:
    """The documents that pass, with all their columns. Narrow: no shuffle."""
    limits = limits or RepetitionLimits()
    shared.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_column)

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(at), limits)["kept"]))

    return docs.mapInArrow(rows, docs.schema)
