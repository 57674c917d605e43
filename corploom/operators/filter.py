"""filter: non-blank, long enough, and accepted by a predicate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.document import Document, from_row
from corploom.errors import ConfigurationError
from corploom.functions.batches import over_batches
from corploom.functions.text import chars, has_text
from corploom.operators.base import Made, StepContext, Tally, alive, drop_unless, made, name_of

Predicate = Callable[[Document], bool] | Column


@dataclass(frozen=True)
class Filter:
    """Blank texts always go. A Column predicate over text, source, position and lang stays in the JVM."""

    fn: Predicate | None = None
    min_chars: int = 0
    name = "filter"
    needs_prepass = False

    def __post_init__(self) -> None:
        if self.min_chars < 0:
            raise ConfigurationError(f"min_chars={self.min_chars} is negative")
        if not (self.fn is None or isinstance(self.fn, Column) or callable(self.fn)):
            raise ConfigurationError("a filter takes a Column or a function of a document")

    shuffles = False

    @property
    def needs_text(self) -> bool:
        return self.fn is not None

    def text_columns(self) -> dict[str, Made]:
        return {"_has_text": has_text, "_chars": chars}

    @property
    def reproducible(self) -> bool:
        return self.fn is None or isinstance(self.fn, Column)

    def parameters(self) -> dict[str, Any]:
        return {"fn": str(self.fn) if isinstance(self.fn, Column) else name_of(self.fn), "min_chars": self.min_chars}

    def mark(self, frame: DataFrame, context: StepContext) -> DataFrame:
        long_enough = made(frame, "_chars", chars) >= self.min_chars
        frame = drop_unless(frame, made(frame, "_has_text", has_text) & long_enough, context.number)
        if self.fn is None:
            return frame
        if isinstance(self.fn, Column):
            return drop_unless(frame, self.fn, context.number)
        # Only documents that passed so far reach the function: others come as null.
        row = F.when(alive(), F.struct("text", "source", "position", "lang", "metadata"))
        return drop_unless(frame, _accepted(self.fn)(row), context.number)

    def report(self, context: StepContext, tally: Tally) -> None:
        return None


def _accepted(fn: Callable[[Document], bool]) -> Any:
    def verdict(row: dict[str, Any] | None) -> bool:
        return row is not None and row["text"] is not None and bool(fn(from_row(row)))

    @F.arrow_udf("boolean")
    def accepted(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return over_batches(verdict, pa.bool_(), rows)

    return accepted
