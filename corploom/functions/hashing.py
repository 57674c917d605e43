"""The BLAKE2b family, as Python functions and as Arrow functions on columns.

Spark SQL has no BLAKE2b, so where the very bits are part of a result (ids,
content hashes, selection values) an Arrow function computes them in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corploom.functions.batches import over_batches

VERSION = "blake2b-128-v1"


def utf8(text: str) -> bytes:
    """UTF-8, lone surrogates included."""
    return text.encode("utf-8", "surrogatepass")


def hex128(raw: bytes) -> str:
    return hashlib.blake2b(raw, digest_size=16).hexdigest()


def raw128(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def int64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big")


def unit(key: str) -> float:
    """A number in [0, 1] that depends on the key alone: 64 bits of a full-size digest."""
    return int.from_bytes(hashlib.blake2b(key.encode()).digest()[:8], "big") / 2**64


def text_hash(text: str) -> str:
    return hex128(utf8(text))


def location_hash(source: str, position: int) -> str:
    """Digest of the name's length, the name and the number; the length marks where the name ends."""
    return hex128(utf8(":".join((str(len(source)), source, str(position)))))


def _text_hash(text: str | None) -> str | None:
    return None if text is None else text_hash(text)


def _unit(prefix: str, key: str) -> float:
    return unit(prefix + key)


@F.arrow_udf(T.StringType())
def _text_hashes(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return over_batches(_text_hash, pa.string(), text)


@F.arrow_udf(T.StringType())
def _location_hashes(places: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return over_batches(location_hash, pa.string(), places)


@F.arrow_udf(T.DoubleType())
def _units(keys: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return over_batches(_unit, pa.float64(), keys)


def content_hash(text: Column) -> Column:
    return _text_hashes(text)


def document_id(source: Column, position: Column) -> Column:
    return _location_hashes(source, position)


def unit_value(prefix: str, key: Column) -> Column:
    """`unit(prefix + key)` of a column of strings."""
    return _units(F.lit(prefix), key)
