"""Chat formatting with offset-aligned loss masks.

Turns are rendered into one string with a template of control tokens, the
string is encoded once with offsets, and the character spans of the turns to
learn from, sorted as they come, are intersected with the token spans by binary
search.  Control strings inside texts and roles are escaped reversibly, so the
template can be read back from the output.

A conversation is one row.  One with turn numbers over `part_turns` is several,
in `part` order, so a conversation that holds a third of all turns is rendered
and encoded in many tasks; since each turn begins with a control token that no
other token joins, the parts' ids in a row are those of the whole string.

Cases: null texts and roles are empty; a null turn number comes first; turns
with one number are ordered by role and text, and repeated rows stay; null
conversation ids form one conversation; an empty table gives an empty result;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm import blocks
from corploom.llm.shared import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

SCHEMA = (
    "conv_id long, part long, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>, "
    "token_starts array<int>, token_ends array<int>, loss_spans array<array<int>>"
)


def escape(text: str) -> str:
    r"""A text without control strings: ``<|`` and its escaped forms get one more backslash inside."""
    return _OPENS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def render(turns: list[tuple[str, str]], learn_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the sorted character spans of the texts to learn from."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role in learn_roles:
            spans.append((at, at + len(body)))
        at += len(body) + len(END) + 1
        pieces += (head, body, END, "\n")
    return "".join(pieces), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_spans(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens such that together they cover the string once.

    A tokenizer may leave white space out of a span, and gives each token of a
    character cut into several the whole character: a start here is the end so
    far, so only the first of those is not empty.
    """
    pairs = np.array(offsets, np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
    return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens overlap a span, and the parts of the spans under those tokens, by binary search."""
    on = np.zeros(len(starts), bool)
    under = []
    for begin, end in spans:
        if begin == end:
            under.append((begin, end))
            continue
        first, last = int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(starts, end, side="left"))
        on[first:last] = True
        low = max(begin, int(starts[first])) if first < last else end
        high = min(end, int(ends[last - 1])) if first < last else end
        under.append((low, high))
    return on, under


@dataclass(frozen=True)
class ChatParameters:
    learn_roles: frozenset[str] = frozenset({"assistant"})
    part_turns: int = 1024


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([START, END])
        _tokenizers[path] = t
    return _tokenizers[path]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, str]]]]:
    """Runs of rows of one (conv_id, part)."""
    key, turns = None, []
    for batch in batches:
        for conv, part, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if key != (conv, part):
                if key is not None:
                    yield key, turns
                key, turns = (conv, part), []
            turns.append((role or "", text or ""))
    if key is not None:
        yield key, turns


def _lists(rows: tuple[np.ndarray, ...]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32), pa.array(np.concatenate(rows)))


def _formatted_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, part, n_turns, formatted, ids, on, starts, ends, spans = zip(*rows)
    plain = [pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(n_turns, pa.int64()), pa.array(formatted)]
    pairs = pa.array([[list(s) for s in under] for under in spans], pa.list_(pa.list_(pa.int32())))
    names = ["conv_id", "part", "n_turns", "formatted", "input_ids", "loss_mask", "token_starts", "token_ends", "loss_spans"]
    return pa.RecordBatch.from_arrays([*plain, *map(_lists, (ids, on, starts, ends)), pairs], names=names)


def format_conversations(
    rows: DataFrame, tokenizer_path: str, p: ChatParameters | None = None, *,
    id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """One row per conversation part with its string, ids, token spans, loss mask and loss spans."""
    p = p or ChatParameters()
    bound_batches(rows.sparkSession)

    @blocks.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        held: list[tuple] = []
        chars = 0
        for (conv, part), turns in _groups(batches):
            formatted, spans = render(turns, p.learn_roles)
            e = tokenizer.encode(formatted, add_special_tokens=False)
            starts, ends = token_spans(e.offsets)
            on, under = mask(starts, ends, spans)
            held.append((conv, part, len(turns), formatted, np.array(e.ids, np.int32), on, starts.astype(np.int32), ends.astype(np.int32), under))
            chars += len(formatted)
            if chars > 1 << 20:
                yield _formatted_batch(held)
                held, chars = [], 0
        if held:
            yield _formatted_batch(held)

    turn = rows[turn_column].cast("long")
    part = F.floor(turn / p.part_turns).cast("long")
    keyed = rows.select(rows[id_column].cast("long").alias("conv_id"), part.alias("part"), rows[role_column].alias("role"), rows[text_column].alias("text"), turn.alias("turn"))
    placed = keyed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return placed.select("conv_id", "part", "role", "text").mapInArrow(encode, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts hold, read back from them in order.

    Parts stream through running digests, so the longest conversation needs no
    more memory than one part.
    """

    @blocks.tidy
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [pack(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), batch.column(3)], names=["conv_id", "part", "packed", "loss_spans"])

    @blocks.tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        state: list | None = None
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def finished(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            for conv, packed, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(finished(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = unpack(packed).decode()
                for role, said in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for begin, end in spans:
                    learnt = unescape(text[begin:end])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([*done, finished(state)])

    small = formatted.select("conv_id", "part", "formatted", "loss_spans").mapInArrow(shrink, "conv_id long, part long, packed binary, loss_spans array<array<int>>")
    placed = small.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
