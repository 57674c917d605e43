"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from its code point.  A letter
n-gram binds the vectors of its letters, each permuted by its place, by
multiplication; a document bundles (adds) its n-gram vectors; a language's
prototype bundles the unit vectors of its documents.  The prediction is the
prototype with the greatest cosine.

N-grams are bound a few thousand at a time, so memory is bounded by a slice of
texts (or one long text, about 60 times its letters), not by the number of
different n-grams in it.

Learning adds up partial prototypes, a few kilobytes a language and task, in
two salted rounds, so a language that most documents have does not fill one
task.  The driver and the tasks of the prediction hold the prototypes, four
kilobytes a language; a label column that is none, with prototypes of more than
`most_prototype_bytes`, is refused.

Cases: a null text or one without letters is `und` with score 0 and teaches
nothing; rows with a null label teach nothing; with nothing to learn from, all
is `und`; equal texts, and so repeated rows, get equal predictions, and each
repeated row teaches; of equal cosines the first language by name wins; an empty table gives an empty
result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm import blocks
from corploom.llm.shared import bound_batches


@dataclass(frozen=True)
class ProfileParameters:
    dimensions: int = 1024
    letters: int = 3
    seed: int = 7
    grams_at_once: int = 4096
    most_prototype_bytes: int = 256 << 20


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # unit rows


#: A table with more cells than this for each one in use is not multiplied as a whole.
_SPARSE = 64

#: With more possible n-grams than this, those in use are found by sorting and not by a table.
_MOST_CODES = 1 << 22


@cache
def _letter_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=1 << 15)
def _letter_vector(letter: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, letter]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def _gram_vectors(grams: np.ndarray, p: ProfileParameters) -> np.ndarray:
    """Bound vectors of n-grams given as rows of letters."""
    letters, index = np.unique(grams, return_inverse=True)
    index = index.reshape(grams.shape)
    base = np.stack([_letter_vector(int(c), p.dimensions, p.seed) for c in letters])
    out = np.ones((len(grams), p.dimensions), np.int8)
    for place in range(p.letters):
        out *= np.roll(base, p.letters - 1 - place, axis=1)[index[:, place]]
    return out


def _bundle(vectors: np.ndarray, row: np.ndarray, gram: np.ndarray, count: np.ndarray, bound: np.ndarray) -> None:
    """Adds to each row's vector those of its n-grams, given by row, number of the n-gram and count, in order of rows."""
    wide = len(bound)
    step = max(1, (1 << 22) // wide)
    i = 0
    while i < len(row):
        low = int(row[i])
        j = int(np.searchsorted(row, low + step))
        span = int(row[j - 1]) - low + 1
        if span * wide <= _SPARSE * (j - i):
            table = np.zeros((span, wide), np.float32)
            table[row[i:j] - low, gram[i:j]] = count[i:j]
            vectors[low : low + span] += table @ bound
        else:
            for k in range(i, j, 4096):
                _bundle_few(vectors, *(x[k : min(k + 4096, j)] for x in (row, gram, count)), bound)
        i = j


def _bundle_few(vectors: np.ndarray, row: np.ndarray, gram: np.ndarray, count: np.ndarray, bound: np.ndarray) -> None:
    """The same where rows have few of the n-grams: the first of each row, then the second, and longer rows by themselves."""
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    lengths = np.diff(begins, append=len(row))
    for i, size in zip(begins[lengths > 16].tolist(), lengths[lengths > 16].tolist()):
        vectors[row[i]] += count[i : i + size].astype(np.float32) @ bound[gram[i : i + size]]
    for k in range(16):
        at = begins[(lengths > k) & (lengths <= 16)] + k
        for i in range(0, len(at), 512):
            some = at[i : i + 512]
            vectors[row[some]] += bound[gram[some]] * count[some, None].astype(np.float32)


def _number_grams(line: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """A number for the n-gram at each of the given places, in order of its letters, and how many numbers there are."""
    seen = np.zeros(int(line.max(initial=0)) + 1, bool)
    seen[line] = True
    code = (np.cumsum(seen) - 1)[line]
    wide = int(np.count_nonzero(seen))
    key, most = np.zeros(len(first), np.int64), 1
    for k in range(size):
        if most * wide >> 63:
            different, key = np.unique(key, return_inverse=True)
            most = len(different)
        key *= wide
        key += code[first + k]
        most *= wide
    if most > _MOST_CODES:
        different, key = np.unique(key, return_inverse=True)
        return key, len(different)
    seen = np.zeros(most, bool)
    seen[key] = True
    return (np.cumsum(seen) - 1)[key], int(np.count_nonzero(seen))


def document_vectors(data: np.ndarray, offsets: np.ndarray, p: ProfileParameters) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of each row, and which rows have a letter."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = _letter_table()[points]
    # Two marks stand between rows, so no n-gram spans them.
    row = np.repeat(np.arange(n), np.diff(starts))
    at = np.arange(len(letter)) + 2 * (row + 1)
    line = np.zeros(len(letter) + 2 * (n + 1), np.uint32)
    owner = np.zeros(len(line), np.int64)
    line[at], owner[at] = letter, row
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)  # one mark for each run that is no letter
    line, owner = line[keep], owner[keep]
    some = np.zeros(n, bool)
    some[row[letter != 0]] = True
    size = p.letters
    windows = np.lib.stride_tricks.sliding_window_view(line, size) if len(line) >= size else np.zeros((0, size), np.uint32)
    inner = (windows[:, 1 : size - 1] != 0).all(axis=1) & (windows[:, 0] | windows[:, -1] != 0) if size > 2 else (windows != 0).any(axis=1)
    first = np.flatnonzero(inner)
    owners = owner[first + size // 2]
    index, different = _number_grams(line, first, size)
    sample = np.empty(different, np.int64)
    sample[index] = first
    # Occurrences by some n-grams at a time, by row, by n-gram.
    part, gram = np.divmod(index, p.grams_at_once)
    cells = (part * n + owners) * p.grams_at_once + gram
    del index, owners, part, gram
    cells.sort()
    begins = np.flatnonzero(np.diff(cells, prepend=-1))
    count = np.diff(begins, append=len(cells))
    cells = cells[begins]
    vectors = np.zeros((n, p.dimensions), np.float32)
    for base in range(0, different, p.grams_at_once):
        i, j = np.searchsorted(cells, [base * n, (base + p.grams_at_once) * n])
        row, gram = np.divmod(cells[i:j] - base * n, p.grams_at_once)
        grams = _gram_vectors(windows[sample[base : base + p.grams_at_once]], p).astype(np.float32)
        _bundle(vectors, row, gram, count[i:j], grams)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    np.divide(vectors, length, out=vectors, where=length > 0)
    return vectors, some


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets, _ = blocks.utf8(column)
    for i, j in blocks.row_slices(offsets, 2 << 20):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _add_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py()) for v in group.column("vector")], axis=0)
        return pa.table({k: group.column(k)[:1] for k in ("lang", "salt")} | {"vector": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(*keys).applyInArrow(add, "lang string, salt int, vector binary")


def learn(docs: DataFrame, p: ProfileParameters | None = None, *, text_column: str = "text", label_column: str = "lang") -> Prototypes:
    """Prototypes of all labels from all given rows."""
    p = p or ProfileParameters()
    bound_batches(docs.sparkSession)

    @blocks.tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for i, j, data, offsets in _slices(batch.column(0)):
                vectors, some = document_vectors(data, offsets, p)
                own = labels[i:j]
                for label in set(own[some].tolist()):
                    part = vectors[some & (own == label)].sum(axis=0, dtype=np.float64)
                    sums[label] = sums[label] + part if label in sums else part
        if sums:
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([salt] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "salt", "vector"]
            )

    labelled = docs.where(docs[label_column].isNotNull() & docs[text_column].isNotNull()).select(docs[text_column], docs[label_column])
    parts = labelled.mapInArrow(partial, "lang string, salt int, vector binary")
    summed = _add_up(_add_up(parts, ["lang", "salt"]), ["lang"]).select("lang", "vector")
    most = p.most_prototype_bytes // (4 * p.dimensions)
    rows = sorted(summed.limit(most + 1).collect(), key=lambda r: r.lang)
    if len(rows) > most:
        raise ValueError(f"more than {most} languages, so more than {p.most_prototype_bytes} bytes of prototypes")
    vectors = np.array([np.frombuffer(r.vector) for r in rows]).reshape(len(rows), p.dimensions)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Prototypes([r.lang for r in rows], vectors.astype(np.float32))


def identify(docs: DataFrame, prototypes: Prototypes, p: ProfileParameters | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, from 0 to 1) of every row, from its text alone."""
    p = p or ProfileParameters()
    bound_batches(docs.sparkSession)
    names = np.array([*prototypes.languages, "und"], object)
    shared = docs.sparkSession.sparkContext.broadcast(prototypes.vectors)

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            for i, j, data, offsets in _slices(batch.column(1)):
                vectors, some = document_vectors(data, offsets, p)
                if len(names) > 1:
                    near = vectors @ shared.value.T
                    best[i:j][some] = near.argmax(axis=1)[some]
                    score[i:j][some] = near.max(axis=1)[some].clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_column].cast("long"), docs[text_column]).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def fold(id_column: Column) -> Column:
    """Remainder by 3 of the CRC-32 of an id written as text; 1 is held out."""
    return F.crc32(id_column.cast("string")) % 3
