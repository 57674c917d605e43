"""Streams: sources that can be turned into a frame of documents, and what a pass over one reports."""

from __future__ import annotations

import warnings
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.document import ROW_BITS, Document, from_row
from corploom.errors import MissingTextFieldError, ReadError, StreamConsumedError

_PACKAGE = str(Path(__file__).resolve().parent.parent)
#: Errors of a pass that are kept one by one; counts always cover all of them.
KEPT_ERRORS = 10_000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def warn(message: str, shown: set[str]) -> None:
    """A warning at the user's line, once among the passes that share ``shown``."""
    if message not in shown:
        shown.add(message)
        warnings.warn(message, skip_file_prefixes=(_PACKAGE,))


@dataclass
class PassReport:
    """What one pass learned besides its documents."""

    shown: set[str] = field(default_factory=set)
    errors: list[ReadError] = field(default_factory=list)
    error_rows: DataFrame | None = field(default=None, compare=False)
    errors_by_level: dict[str, int] = field(default_factory=dict)
    errors_by_source: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    info: dict[str, dict[str, Any]] = field(default_factory=dict)
    unpinned: list[str] = field(default_factory=list)
    policies: list[tuple[int, str]] = field(default_factory=list)  # first unit of a stream, and its on_error

    def policy_of(self, unit: int) -> str:
        return self.policies[bisect_right(self.policies, unit, key=lambda p: p[0]) - 1][1]


#: Makes the frame of one pass, given the session, the number of its first file or source, and the pass's
#: report; returns the frame and the number after its last.
MakeFrame = Callable[[SparkSession, int, PassReport], tuple[DataFrame, int]]


@dataclass(frozen=True)
class Traits:
    one_shot: bool = False
    reproducible: bool = True
    paths: tuple[Path, ...] = ()


class DocumentStream:
    """A lazy sequence of documents; `errors`, `skipped` and `info` are those of the last complete pass."""

    def __init__(self, make: MakeFrame, names: Callable[[], list[str]], on_error: str, traits: Traits | None = None) -> None:
        self._make, self._names = make, names
        self.on_error, self.traits = on_error, traits or Traits()
        self.config: Any = {}
        self.last_pass = PassReport()
        self._consumed = False

    def source_names(self) -> list[str]:
        return self._names()

    @property
    def errors(self) -> list[ReadError]:
        return self.last_pass.errors

    @property
    def error_rows(self) -> DataFrame | None:
        """All errors of the last complete pass, in order, where `errors` has the first ones only."""
        return self.last_pass.error_rows

    @property
    def skipped(self) -> list[str]:
        return self.last_pass.skipped

    @property
    def info(self) -> dict[str, dict[str, Any]]:
        return self.last_pass.info

    @property
    def reproducible(self) -> bool:
        return self.traits.reproducible and not self.last_pass.unpinned

    def frame(self, spark: SparkSession, first: int, report: PassReport) -> tuple[DataFrame, int]:
        """The frame of a new pass, errors included as rows of their own."""
        if self._consumed:
            raise StreamConsumedError("This stream holds an iterator, which was read already. Pass a list, or a function that gives a new iterator.")
        self._consumed = self.traits.one_shot
        report.policies.append((first, self.on_error))
        return self._make(spark, first, report)

    def settle(self, errors: DataFrame, report: PassReport) -> None:
        """Handles the error rows of a pass, each as the `on_error` of the stream it came from says."""
        unit = F.shiftright("_ord", ROW_BITS).alias("unit")
        first = F.min_by(F.struct("source", "position", "_err_level", "_err_message"), "_ord").alias("first")
        counts = errors.groupBy("source", "_err_level", unit).agg(F.count("*").alias("n"), F.min("_ord").alias("at"), first).orderBy("at").collect()
        by_level, by_source = Counter(), Counter()
        for r in counts:
            by_level[r["_err_level"]] += r.n
            by_source[r.source] += r.n
        report.errors_by_level, report.errors_by_source = dict(by_level), dict(by_source)
        listed = errors.orderBy("_ord")
        report.error_rows = listed.select("source", "position", F.col("_err_level").alias("level"), F.col("_err_message").alias("message"))
        for r in counts:
            if report.policy_of(r.unit) == "raise":
                raise _error(r.first)
        if not counts:
            return
        rows = listed.limit(KEPT_ERRORS).collect()
        report.errors = [_error(r) for r in rows]
        of_files = [e for e in report.errors if e.level == "file"]
        if len(of_files) < by_level["file"]:
            of_files = [_error(r) for r in listed.where("_err_level = 'file'").collect()]
        for r in counts:
            if report.policy_of(r.unit) != "warn":
                continue
            if r["_err_level"] == "file":
                for e in of_files:
                    if e.source == r.source:
                        warn(str(e), report.shown)
            else:
                warn(f"{r.source}: skipped {r.n} row(s); first: {_error(r.first)}", report.shown)

    def __iter__(self) -> Iterator[Document]:
        """One pass of its own."""
        report = PassReport()
        frame, _ = self.frame(session(), 0, report)
        self.settle(frame.where("_err_level is not null"), report)
        for row in frame.where("_err_level is null").orderBy("_ord").toLocalIterator():
            yield from_row(row)
        self.last_pass = report


def _error(row: Any) -> ReadError:
    if row["_err_level"] == "file" and " not found; available fields: " in row["_err_message"]:
        return MissingTextFieldError(row.source, row["_err_message"])
    return ReadError(row.source, row["_err_message"], row.position, row["_err_level"])
