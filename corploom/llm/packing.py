"""Packing tokenized documents into fixed-length sequences by bounded-space online best-fit.

Each task offers its pieces to a fixed number of open sequences, held in a
bitset keyed by free space: the lowest set bit at or above a piece's length is
the tightest sequence that takes it.  When a new sequence would exceed the
number allowed, the fullest open one closes first.  Placement is final as soon
as it is made, so rows stream out, nothing shuffles, and memory does not depend
on the size of the input; a sequence never spans tasks, so a task that is run
again replaces all of its sequences together.

Where the order of the rows carries a schedule, `in_order` keeps it: sequences
are numbered by file and row instead of by task, since Spark deals splits to
tasks by size, and pieces are offered in row order.

Cases: a null or empty text is the end token alone; only a document over the
capacity is cut, into full pieces and a shorter last one; repeated rows are
packed each for itself; an empty table gives an empty result; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import array
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corploom.llm import blocks, shared

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

#: A word of ASCII or Latin letters and then punctuation: its pre-tokens are those two runs.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!\"#$%&()*+,\\-./:;=>?@\\[\\\\\\]^_`{|}~]*)")


_TRAILING = np.zeros(256, dtype=bool)
_TRAILING[list(b"!#$%&*,.:;?)")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _part_punctuation(words: blocks.Words) -> blocks.Words:
    """Words with up to four trailing ASCII marks as a unit of their own, where a letter or digit precedes them.

    There the pre-tokenizer cuts anyway, so ids stay the same and far fewer
    distinct units are left.
    """
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return words
    core = ends.copy()
    for _ in range(4):
        core -= (core - starts > 1) & _TRAILING[data[core - 1]]
    last, before = data[core - 1], data[np.maximum(core - 2, starts)]
    # Of U+00C0 to U+023F: all but the two signs, and the dotted capital I, whose lower case ends with a combining mark.
    latin = (last >= 0x80) & (((before >= 0xC4) & (before <= 0xC8) & ~((before == 0xC4) & (last == 0xB0))) | ((before == 0xC3) & (last != 0x97) & (last != 0xB7)))
    cut = (core < ends) & (_ALNUM[last] | latin)
    extra = np.concatenate([[0], np.cumsum(cut)])
    at = np.arange(len(starts)) + extra[:-1]
    new_starts, new_ends = np.empty(len(starts) + extra[-1], np.int64), np.empty(len(starts) + extra[-1], np.int64)
    new_starts[at], new_ends[at] = starts, np.where(cut, core, ends)
    new_starts[at[cut] + 1], new_ends[at[cut] + 1] = core[cut], ends[cut]
    return blocks.Words(data, words.offsets, new_starts, new_ends, words.rows + extra[words.rows])


def _distinct(words: blocks.Words) -> tuple[np.ndarray, np.ndarray]:
    """One word for each distinct run of bytes, and for every word which of them it equals; hashes propose, bytes decide."""
    _, which, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if not words.chunks.differ(np.arange(len(inverse)), which[inverse]).any():
        return which, inverse
    raw, seen = words.data.tobytes(), {}
    inverse = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(words.starts.tolist(), words.ends.tolist())), np.int64, len(inverse))
    return np.unique(inverse, return_index=True)[1], inverse


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


#: What this module knows of a tokenizer's rules: words are cut as these rules cut them.
_RULES = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _check_rules(described: dict, path: str) -> None:
    """Refuses a tokenizer whose ids of a text may be others than those of its words in a row."""
    parts = [(described.get(kind) or {}).get(name) for kind, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    added = [t["content"] for t in described["added_tokens"]]
    known = parts == list(_RULES.values()) and described["model"]["type"] == "BPE" and not described["model"]["dropout"]
    if not known or not all(t.startswith("<|") and not re.search(r"\s", t) for t in added):
        raise ValueError(f"{path}: its rules for normalising and cutting texts are not those that packing by words is built for")


class WordTokenizer:
    """Token ids of texts under a BPE whose tokens never span white space.

    Normalisation and pre-tokenization of such a tokenizer act inside runs of
    other characters, so a text's ids are its words' ids in a row.  Words are
    found and made unique in numpy; each distinct word goes once through the
    tokenizer, and its ids stay in a bounded cache.
    """

    def __init__(self, path: str, cache_words: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            _check_rules(json.load(file), path)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first = array.array("I"), array.array("q", [0])

    def _part(self, part: str) -> list[int]:
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self, words: list[bytes]) -> None:
        hard: list[int] = []
        ids: list[list[int] | None] = []
        for n, word in enumerate(words):
            text = word.decode("utf-8", "replace")
            m = _SIMPLE.fullmatch(text)
            if m:
                stem = m[1].lower() if text.isascii() else unicodedata.normalize("NFC", m[1]).lower()
                ids.append(self._part(stem) + (self._part(m[2]) if m[2] else []))
            else:
                hard.append(n)
                ids.append(None)
        if hard:
            texts = [words[n].decode("utf-8", "replace") for n in hard]
            for n, e in zip(hard, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids[n] = e.ids
        for word, own in zip(words, ids):
            self.known[word] = len(self.first) - 1
            self.flat.extend(own)
            self.first.append(len(self.flat))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and the offset of each row's first."""
        raw = data.tobytes()
        if b"<|" not in raw:  # else lowering could make a control string of a text that has none
            data = blocks.LOWER[data]
            raw = data.tobytes()
        words = _part_punctuation(blocks.split_words(data, offsets))
        if len(self.known) > self.cache_words:
            self._reset()
        which, inverse = _distinct(words)
        distinct = [raw[s:e] for s, e in zip(words.starts[which].tolist(), words.ends[which].tolist())]
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        known = self.known
        entry = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[inverse]
        first = np.frombuffer(self.first, np.int64)
        begin, count = first[entry], first[entry + 1] - first[entry]
        placed = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(begin - placed[:-1], count) + np.arange(placed[-1])
        ids = np.frombuffer(self.flat, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)
        del first
        return ids, placed[words.rows]


class BestFit:
    """Open sequences by free space; `place` gives the sequence and offset of a piece."""

    def __init__(self, capacity: int, open_bins: int, first_sequence: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first_sequence
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        sequence = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence, self.next = self.capacity, self.next, self.next + 1
        left = free - length
        if left:
            if self.count == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest >= left:  # the new one is the fullest: it closes at once
                    return sequence, self.capacity - free
                self._take(fullest)
            self.bins[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


#: Bits of a sequence's number below those of its file: the split of the file, and the sequence in the split.
_SPLIT_BITS, _NUMBER_BITS = 17, 26


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files as they are read, with no shuffle between."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def _by_part(path: str) -> list[str | int]:
    return [int(x) if x.isdecimal() else x for x in re.split(r"(\d+)", path)]


def _one_slash(path: str) -> str:
    """Local files are named file:/x in metadata and file:///x by the table."""
    return re.sub(":/+", ":/", path, count=1)


def _file_numbers(docs: DataFrame) -> dict[str, int]:
    files = sorted(docs.inputFiles(), key=_by_part)
    if len(files) >> (63 - _SPLIT_BITS - _NUMBER_BITS):
        raise ValueError(f"{len(files)} files are too many to number sequences by")
    return {_one_slash(path): n for n, path in enumerate(files)}


def _split_unit(docs: DataFrame) -> int:
    """Bytes that every split of a file but its last has at least."""
    conf = docs.sparkSession._jsparkSession.sessionState().conf()
    return max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))


def _runs(batch: pa.RecordBatch, files: dict[str, int], unit: int) -> Iterator[tuple[int, int, int]]:
    """First sequence number, first row and end of the rows of each split in a batch."""
    paths = batch.column(2).dictionary_encode()
    number = np.array([files[_one_slash(x)] for x in paths.dictionary.to_pylist()], np.int64)[paths.indices.to_numpy()]
    split = batch.column(3).to_numpy() // unit
    if split.max() >> _SPLIT_BITS:
        raise ValueError("a file has too many splits to number sequences by")
    first = (number << (_SPLIT_BITS + _NUMBER_BITS)) | (split << _NUMBER_BITS)
    cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
    for i, j in zip(cuts, cuts[1:]):
        yield int(first[i]), i, j


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, slice_bytes: int = 4 << 20,
    in_order: bool = False, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) and its place in a sequence.

    The tokenizer must be one whose tokens never span white space.  Pieces that
    arrive in one slice of `slice_bytes` of text are offered longest first.
    With `in_order` they are offered as they come, and sequence numbers follow
    file names and rows, or partitions and rows where `docs` is not a plain
    read of files; fewer `open_bins` then hold the order more tightly.
    """
    shared.bound_batches(docs.sparkSession)
    columns = [docs[id_column], docs[text_column]]
    files, unit = None, 1
    if in_order and _is_scan(docs):
        files, unit, at = _file_numbers(docs), _split_unit(docs), docs.metadataColumn("_metadata")
        columns += [at["file_path"].alias("__file"), at["file_block_start"].alias("__split")]

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << 36
        bins, current = BestFit(capacity, open_bins, first), first
        for batch in batches:
            if not batch.num_rows:
                continue
            for first, k, end in [(first, 0, batch.num_rows)] if files is None else _runs(batch, files, unit):
                if first != current:
                    bins, current = BestFit(capacity, open_bins, first), first
                data, offsets, _ = blocks.utf8(batch.column(1).slice(k, end - k))
                doc_ids = batch.column(0).slice(k, end - k).cast(pa.int64())
                for i, j in blocks.row_slices(offsets, slice_bytes):
                    yield _pack_rows(doc_ids.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tokenizer, bins, end_id, in_order)

    return docs.select(*columns).mapInArrow(rows, SCHEMA)


def _pack_rows(doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray, tokenizer: WordTokenizer, bins: BestFit, end_id: int, in_order: bool) -> pa.RecordBatch:
    ids, at = tokenizer.encode(data, offsets)
    n = len(at) - 1
    ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
    at = at + np.arange(n + 1)
    lengths = np.diff(at)
    pieces = -(-lengths // bins.capacity)
    owner = np.repeat(np.arange(n), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * bins.capacity
    length = np.minimum(lengths[owner] - start, bins.capacity)
    sequence, offset = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    sizes = length.tolist()
    for k in range(len(sizes)) if in_order else np.argsort(-length, kind="stable").tolist():
        sequence[k], offset[k] = bins.place(sizes[k])
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs, pa.array(sequence), pa.array(offset)],
        names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
    )
