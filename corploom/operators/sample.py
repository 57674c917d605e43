"""sample: documents whose hashed id falls below a fraction."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.errors import ConfigurationError
from corploom.functions import hashing
from corploom.operators.base import Made, StepContext, Tally, drop_unless, within


def selection(context: StepContext, seed: Any) -> Any:
    """The number in [0, 1] that decides over a document: of the seed, the step's place in the history, and the id."""
    return hashing.unit_value(f"{seed}:{context.step_index}:", hashing.document_id(F.col("source"), F.col("position")))


def check_budget(max_bytes: int | None) -> None:
    if max_bytes is not None and max_bytes < 0:
        raise ConfigurationError(f"a budget of {max_bytes} bytes: max_bytes cannot be negative")


@dataclass(frozen=True)
class Sample:
    fraction: float | None = None
    max_bytes: int | None = None
    seed: int = 0
    name = "sample"
    reproducible = True
    needs_text = shuffles = False

    def text_columns(self) -> dict[str, Made]:
        return {}

    def __post_init__(self) -> None:
        if (self.fraction is None) == (self.max_bytes is None):
            raise ConfigurationError("sample needs exactly one of fraction or max_bytes")
        if self.fraction is not None:
            within("fraction", self.fraction, 0, 1, closed=True)
        check_budget(self.max_bytes)

    @property
    def needs_prepass(self) -> bool:
        return self.max_bytes is not None

    def parameters(self) -> dict[str, Any]:
        return {"fraction": self.fraction, "max_bytes": self.max_bytes, "seed": self.seed}

    def resolve(self, bytes_by_lang: dict[str | None, int]) -> float:
        """The fraction of this pass; a budget over what is there keeps all."""
        if self.fraction is not None:
            return self.fraction
        total = sum(bytes_by_lang.values())
        return min(1.0, self.max_bytes / total) if total else 1.0

    def mark(self, frame: DataFrame, context: StepContext) -> DataFrame:
        fraction = self.resolve(context.bytes_by_lang)
        context.result = {"fraction": fraction, "target_bytes": self.max_bytes}
        return drop_unless(frame, selection(context, self.seed) < fraction, context.number)

    def report(self, context: StepContext, tally: Tally) -> dict[str, Any]:
        return context.result
