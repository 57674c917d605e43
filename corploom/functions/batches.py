"""Python over columns within bounds: small Arrow batches, small parts of them as Python values, free memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Text in one Arrow batch: several copies of a batch exist at a time, in the JVM and in Python.
BATCH_BYTES = 8 << 20
#: Rows of a batch that are Python values at a time.
_PART = 256

_libc = ctypes.CDLL(None)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to `BATCH_BYTES`, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    size = int(now[:-1] if scale else now) << scale
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trim() -> None:
    """Gives memory that is free in this process back: workers stay alive between tasks, next to the JVM's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mapped(fn: Callable[..., Any], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``fn`` of the values of each row, as a column; few rows are Python values at a time."""
    done = [pa.array(map(fn, *(c.slice(at, _PART).to_pylist() for c in columns)), kind) for at in range(0, len(columns[0]), _PART)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def over_batches(fn: Callable[..., Any], kind: pa.DataType, batches: Iterator[Any]) -> Iterator[pa.Array]:
    """`mapped` over the batches of a task, one column or a tuple of columns each."""
    try:
        for batch in batches:
            yield mapped(fn, kind, *(batch if isinstance(batch, tuple) else (batch,)))
    finally:
        trim()
