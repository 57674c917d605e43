"""Stateless steps over a streaming DataFrame.

filter, split and a fixed-fraction sample need nothing but the document, so
they run on a stream as they do on a table and pick the same documents.  Steps
that need the first of equals, or totals, need an order and an end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corploom.errors import ConfigurationError
from corploom.functions.batches import bound_batches
from corploom.operators.base import GONE, Step, StepContext
from corploom.operators.filter import Filter
from corploom.operators.sample import Sample
from corploom.operators.split import Split
from corploom.shipping import send_package


def select_stream(documents: DataFrame, steps: Sequence[Step], *, first_step: int = 1) -> DataFrame:
    """The documents (text, source, position, lang, metadata) of a stream that all steps keep.

    ``first_step`` is the place of the first step in the history: it is part of
    selection values, so a corpus with the same chain keeps the same documents.
    """
    for step in steps:
        if not isinstance(step, (Filter, Split, Sample)) or step.needs_prepass:
            raise ConfigurationError(f"{step.name} needs the whole corpus; only filter, split and a fixed-fraction sample run on a stream")
    send_package(documents.sparkSession)
    bound_batches(documents.sparkSession)
    frame = documents.withColumn(GONE, F.lit(None).cast("int"))
    for number, step in enumerate(steps, 1):
        frame = step.mark(frame, StepContext(number, first_step + number - 1, {}, set()))
    return frame.where(f"{GONE} is null").drop(GONE)


def append_stream(selected: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Appends a selected stream to a Parquet table, exactly once; with ``once``, what is there now."""
    writer = selected.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
