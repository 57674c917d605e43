"""From files and rows to documents and read errors: pure Python, run in the tasks.

A file or source yields records in order.  A bad row yields an error record in
its place; what breaks the whole source yields one after the good rows before.
"""

from __future__ import annotations

import csv
import gzip
import json
from dataclasses import dataclass
from pathlib import Path
from sys import maxsize
from typing import Any, Callable, Iterable, Iterator, Mapping, TextIO

from corploom.document import Document, canonical_json
from corploom.errors import CorploomError, MissingTextFieldError, ReadError
from corploom.sources.options import ReadOptions

#: What a task emits: row number, text, source, position, lang, metadata, bad metadata, error level, error message.
Record = tuple[int, str | None, str, int | None, str | None, str | None, str | None, str | None, str | None]

_SET_FIELD = "set text_field= to the field that holds the text"
_READ_RAW = "or format='text', to take the file as one document as it is"


def metadata_json(metadata: Mapping[Any, Any]) -> tuple[str, str | None]:
    """Key-sorted JSON, or an empty object and why JSON cannot hold it."""
    if not metadata:
        return "{}", None
    try:
        return canonical_json(dict(metadata)), None
    except (TypeError, ValueError) as e:
        return "{}", str(e)


def missing_field(source: str, field: str, available: Iterable[Any], *, can_be_raw: bool) -> MissingTextFieldError:
    listed = ", ".join(map(str, available)) or "(none)"
    fixes = f"{_SET_FIELD}, {_READ_RAW}" if can_be_raw else _SET_FIELD
    return MissingTextFieldError(source, f"field {field!r} not found; available fields: {listed}; {fixes}")


@dataclass
class SourceParser:
    """Turns what one named source holds into records."""

    name: str
    options: ReadOptions
    can_be_raw: bool = False
    _seen_field: bool = False

    def document(self, text: str, position: int, lang: str | None = None, metadata: Mapping[Any, Any] | None = None) -> Record:
        own, bad = metadata_json(metadata or {})
        return position, text, self.name, position, lang or self.options.lang, own, bad, None, None

    def bad_row(self, position: int, message: str) -> Record:
        return position, None, self.name, position, None, None, None, "row", message

    def row(self, position: int, row: Any) -> Record:
        o = self.options
        if not isinstance(row, Mapping):
            return self.bad_row(position, f"expected an object/row, got {type(row).__name__}")
        if not self._seen_field and o.text_field not in row:
            raise missing_field(self.name, o.text_field, row, can_be_raw=self.can_be_raw)
        self._seen_field = True
        text = row.get(o.text_field)
        if text is None:
            return self.bad_row(position, f"missing or null field {o.text_field!r}")
        if not isinstance(text, str):
            return self.bad_row(position, f"field {o.text_field!r} is {type(text).__name__}, expected str")
        lang = row.get(o.lang_field) if o.lang_field else None
        if lang not in (None, "") and not isinstance(lang, str):
            return self.bad_row(position, f"field {o.lang_field!r} is {type(lang).__name__}, expected str")
        if o.metadata_fields == "all":
            chosen = {k: v for k, v in row.items() if k is not None and k != o.text_field}
        else:
            chosen = {k: row[k] for k in o.metadata_fields or () if k in row and k != o.text_field}
        return self.document(text, position, lang or None, chosen)

    def items(self, items: Iterable[Any]) -> Iterator[Record]:
        """Documents as they are, strings as texts, anything else as a row."""
        for n, item in enumerate(items):
            if isinstance(item, Document):
                own, bad = metadata_json(item.metadata)
                yield n, item.text, item.source, item.position, item.lang, own, bad, None, None
            elif isinstance(item, str):
                yield self.document(item, n)
            else:
                yield self.row(n, item)

    def guarded(self, records: Iterable[Record]) -> Iterator[Record]:
        """The records, then an error record if the whole source fails on the way."""
        last = -1
        try:
            for record in records:
                last = record[0]
                yield record
        except ReadError as e:
            yield last + 1, None, e.source, e.position, None, None, None, e.level, e.message
        except CorploomError:
            raise
        except Exception as e:  # noqa: BLE001 - an unreadable file is a result, not a crash
            yield last + 1, None, self.name, None, None, None, None, "file", f"{type(e).__name__}: {e}"


Parser = Callable[[Path, SourceParser], Iterator[Record]]


def open_text(path: Path, newline: str = "\n") -> TextIO:
    """Strict UTF-8 without its byte order mark, unpacked if the name ends in .gz; only newline ends a line."""
    opener = gzip.open if path.suffix.lower() == ".gz" else open
    return opener(path, mode="rt", newline=newline, encoding="utf-8-sig")


def parse_text(path: Path, source: SourceParser) -> Iterator[Record]:
    with open_text(path) as file:
        if source.options.unit == "file":
            yield source.document(file.read(), 0)
            return
        for n, line in enumerate(file):
            yield source.document(line[:-1].removesuffix("\r") if line.endswith("\n") else line, n)


def parse_jsonl(path: Path, source: SourceParser) -> Iterator[Record]:
    source.can_be_raw = True
    with open_text(path) as file:
        for n, line in enumerate(file):
            if not line.strip():
                continue
            try:
                value = json.loads(line)
            except json.JSONDecodeError as e:
                yield source.bad_row(n, f"invalid JSON: {e.msg}")
                continue
            yield source.row(n, value)


def parse_delimited(path: Path, source: SourceParser) -> Iterator[Record]:
    source.can_be_raw = True
    widest = min(maxsize, 2**31 - 1)
    if csv.field_size_limit() < widest:
        csv.field_size_limit(widest)
    delimiter = source.options.delimiter or {".tsv": "\t"}.get(path.suffix.lower(), ",")
    with open_text(path, newline="") as file:
        for n, row in enumerate(csv.DictReader(file, delimiter=delimiter)):
            yield source.row(n, row)


def parquet_columns(options: ReadOptions, available: list[str]) -> list[str]:
    """The columns that a read of these needs."""
    if options.metadata_fields == "all":
        return available
    own = {options.text_field, options.lang_field}.union(options.metadata_fields or ())
    return [c for c in available if c in own]


def parse_parquet(path: Path, source: SourceParser) -> Iterator[Record]:
    """Parquet by way of Python, for files that Spark's own reader leaves out or cannot read."""
    from pyarrow import parquet

    with open(path, "rb") as handle:
        file = parquet.ParquetFile(handle)
        names = list(file.schema_arrow.names)
        if source.options.text_field not in names:
            raise missing_field(source.name, source.options.text_field, names, can_be_raw=False)
        n = 0
        for batch in file.iter_batches(1024, columns=parquet_columns(source.options, names)):
            for row in batch.to_pylist():
                yield source.row(n, row)
                n += 1
