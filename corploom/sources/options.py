"""Settings of a read, checked before anything is opened."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Any

from corploom.errors import ConfigurationError

UNITS, POLICIES = ("file", "line"), ("warn", "skip", "raise")


def _one_of(allowed: tuple[str, ...], value: object, setting: str) -> None:
    if value not in allowed:
        raise ConfigurationError(f"{setting} must be one of {', '.join(map(repr, allowed))}, got {value!r}")


@dataclass(frozen=True, slots=True)
class ReadOptions:
    on_error: str = "warn"
    # what a document is
    unit: str = "file"
    text_field: str = "text"
    lang_field: str | None = None
    lang: str | None = None
    metadata_fields: Sequence[str] | str | None = None
    # which files, and how they are written
    glob: str | None = None
    format: str | None = None
    delimiter: str | None = None
    # which part of a hub dataset
    revision: str | None = None
    config: str | None = None
    split: str = "train"

    def __post_init__(self) -> None:
        _one_of(UNITS, self.unit, "unit")
        _one_of(POLICIES, self.on_error, "on_error")
        if not (isinstance(self.text_field, str) and self.text_field):
            raise ConfigurationError("text_field needs a name")
        if self.lang is not None and not (isinstance(self.lang, str) and self.lang):
            raise ConfigurationError("lang needs a code, or None")
        fields = self.metadata_fields
        if isinstance(fields, str) and fields != "all":  # "src" must not be read as s, r and c
            raise ConfigurationError(f"metadata_fields={fields!r}: give a list of names, or 'all'")
        if fields is not None and not isinstance(fields, str):
            object.__setattr__(self, "metadata_fields", tuple(fields))

    def to_config(self) -> dict[str, Any]:
        """The settings as JSON has them."""
        fields = self.metadata_fields
        return asdict(self) | {"metadata_fields": list(fields) if isinstance(fields, tuple) else fields}
