"""Column expressions with the text rules of the library, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDETERMINED = "und"
HUB_PREFIX = "hf:"

#: The characters that Python's `str.isspace` accepts.
SPACES = "\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def has_text(text: Column) -> Column:
    """Whether a character other than white space is there."""
    return text.rlike(f"[^{SPACES}]")


def chars(text: Column) -> Column:
    return F.length(text).cast("long")


def octets(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def source_group_of(source: str) -> str:
    return source.rsplit("/", 1)[0] if source.startswith(HUB_PREFIX) else source.split("/", 1)[0]


def source_group(source: Column) -> Column:
    """First path component; for a hub dataset all but the last."""
    hub = F.regexp_replace(source, "(?s)/[^/]*$", "")
    return F.when(source.startswith(HUB_PREFIX), hub).otherwise(F.substring_index(source, "/", 1))


def language(lang: Column) -> Column:
    """The language as reports name it."""
    return F.coalesce(lang, F.lit(UNDETERMINED))
