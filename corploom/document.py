"""Documents: the Python value, and the columns of the frames that hold many of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, Mapping, Optional

from pyspark.sql import Row

from corploom.errors import InvalidDocumentError
from corploom.functions import hashing

#: A document's place in iteration order is one number: that of its file or source, then that of its row.
ROW_BITS = 40

#: Columns of a frame of documents. `_ord` orders them; rows with `_err_level` are read errors instead.
COLUMNS = "_ord long, text string, source string, position long, lang string, metadata string, _bad string, _err_level string, _err_message string"
SAVED = ("id", "text", "source", "position", "content_hash", "lang", "metadata")


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


@dataclass(frozen=True, slots=True)
class Document:
    """A text as it was found and the place it was found at.

    Two identities follow from these: `id` from the place, `content_hash` from the text.
    """

    text: str
    source: str
    position: int
    lang: Optional[str] = None
    metadata: Mapping = field(hash=False, default_factory=dict)
    content_hash: str = field(init=False)
    id: str = field(init=False)

    def __post_init__(self):
        checks = (
            (isinstance(self.text, str), "text must be str"),
            (isinstance(self.source, str) and bool(self.source), "source must be a non-empty str"),
            (type(self.position) is not bool and isinstance(self.position, int) and self.position >= 0, "position must be a non-negative int"),
            (self.lang is None or isinstance(self.lang, str) and bool(self.lang), "lang must be None or a non-empty str"),
            (isinstance(self.metadata, Mapping), "metadata must be a mapping"),
        )
        for good, message in checks:
            if not good:
                raise InvalidDocumentError(message)
        put = lambda name, value: object.__setattr__(self, name, value)
        put("metadata", MappingProxyType(dict(self.metadata)))
        put("id", hashing.location_hash(self.source, self.position))
        put("content_hash", hashing.text_hash(self.text))


def from_row(row: Row) -> Document:
    return Document(row["text"], row["source"], row["position"], row["lang"], json.loads(row["metadata"] or "{}"))
