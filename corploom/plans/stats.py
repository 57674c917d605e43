"""What a pass over a corpus contained, from one aggregate, and the fingerprint of its order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame

from corploom.plans import display


@dataclass(frozen=True, slots=True)
class Counts:
    documents: int = 0
    bytes: int = 0


@dataclass(frozen=True, slots=True)
class StepCounts:
    op: str
    docs_in: int
    bytes_in: int
    docs_out: int
    bytes_out: int


@dataclass(frozen=True, slots=True)
class CorpusStats:
    """Totals, counts by language and source, counts of the steps, and the fingerprint.

    Lengths are in characters, sizes in UTF-8 bytes; lengths of nothing are None.
    """

    fingerprint: str
    documents: int
    bytes: int
    chars: int
    length_mean: float | None
    length_min: int | None
    length_max: int | None
    by_source: dict[str, Counts]
    by_lang: dict[str, Counts]
    steps: tuple[StepCounts, ...]

    def __str__(self) -> str:
        return display.as_text(self)

    def _repr_html_(self) -> str:
        return display.as_html(self)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> CorpusStats:
        """The statistics that `to_dict` gave; KeyError or TypeError where something lacks."""
        counts = {k: {name: Counts(**c) for name, c in data[k].items()} for k in ("by_lang", "by_source")}
        plain = {k: data[k] for k in ("documents", "chars", "bytes", "length_min", "length_max", "length_mean", "fingerprint")}
        return cls(**plain, **counts, steps=tuple(StepCounts(**s) for s in data["steps"]))


def fingerprint(hashes: Iterable[str]) -> str:
    """One digest over content hashes in order: the same texts in another order give another one."""
    running = hashlib.blake2b(digest_size=16)
    for h in hashes:
        running.update(bytes.fromhex(h))
    return running.hexdigest()


def ordered_fingerprint(rows: DataFrame) -> str:
    """That of (_ord, content_hash) rows. They sort in parallel and reach the driver one partition at a time."""
    return fingerprint(r.content_hash for r in rows.select("_ord", "content_hash").orderBy("_ord").toLocalIterator(prefetchPartitions=True))
