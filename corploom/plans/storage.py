"""Saved corpora: a directory with `corpus.parquet` (files in document order) and `manifest.json`."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.document import ROW_BITS
from corploom.errors import CorpusExistsError, IntegrityError, ManifestError, MetadataNotSerializableError, UnsafeDestinationError
from corploom.functions import hashing
from corploom.plans import manifest as manifests
from corploom.plans.stats import CorpusStats, ordered_fingerprint
from corploom.sources.stream import DocumentStream, PassReport, Traits, warn

if TYPE_CHECKING:
    from corploom.plans.corpus import Corpus

DATA, MANIFEST = "corpus.parquet", "manifest.json"
#: Rows of one file of a saved corpus, and bytes of its texts, about; a file holds whole order ranges and is one task.
ROWS_PER_FILE, BYTES_PER_FILE = 1_000_000, 64 << 20


def check_destination(destination: Path, sources: Sequence[Path], *, overwrite: bool) -> None:
    """Refuses to save into, over or around what is read, and over anything but a saved corpus."""
    target = destination.resolve()
    for source in sources:
        at = source.resolve()
        if at == target or at in target.parents or target in at.parents:
            raise UnsafeDestinationError(f"{destination} overlaps {source}, which is being read: save to another place")
    if not destination.exists():
        return
    if not overwrite:
        raise CorpusExistsError(f"there is a {destination} already; overwrite=True replaces it")
    held = {p.name for p in destination.iterdir()} if destination.is_dir() else set()
    if MANIFEST not in held or held - {DATA, MANIFEST}:
        raise UnsafeDestinationError(f"{destination} holds other things than a saved corpus, so it is not replaced")


@contextmanager
def replaced(path: Path) -> Iterator[Path]:
    """An empty directory beside ``path`` that takes its place at the end; on failure ``path`` is as it was."""
    above = path.parent
    above.mkdir(exist_ok=True, parents=True)
    fresh = Path(tempfile.mkdtemp(dir=above, prefix=f".{path.name}."))
    try:
        yield fresh
        if not path.exists():
            os.replace(fresh, path)
            return
        aside = Path(tempfile.mkdtemp(dir=above, prefix=f".{path.name}.old."))
        try:
            os.replace(path, aside / path.name)
            try:
                os.replace(fresh, path)
            except BaseException:
                os.replace(aside / path.name, path)
                raise
        except BaseException:
            aside.rmdir()
            raise
        try:
            shutil.rmtree(aside)
        except OSError as e:
            warn(f"Replaced {path}, but the old copy in {aside} could not be deleted ({e}); delete it by hand.", set())
    finally:
        shutil.rmtree(fresh, ignore_errors=True)


def save(corpus: Corpus, destination: Path, *, overwrite: bool) -> CorpusStats:
    check_destination(destination, corpus.source_paths(), overwrite=overwrite)
    done = corpus.run_pass()
    bad = done.rows.where("_gone is null and _bad is not null").orderBy("_ord").select("source", "position", "_bad").first()
    if bad:
        raise MetadataNotSerializableError(
            f"Document {hashing.location_hash(bad.source, bad.position)} ({bad.source}#{bad.position}): metadata is not JSON-serializable: {bad['_bad']}"
        )
    with replaced(destination) as directory:
        documents = done.documents()
        rows, size = done.counts_out
        files = max(1, -(-rows // ROWS_PER_FILE), min(rows, -(-size // BYTES_PER_FILE)))
        ordered = documents.repartitionByRange(files, "_ord").sortWithinPartitions("_ord")
        hashed = ordered.withColumn("id", hashing.document_id(F.col("source"), F.col("position"))).withColumn("content_hash", hashing.content_hash(F.col("text")))
        hashed.select("id", "text", "source", "position", "content_hash", "lang", "metadata").write.parquet(str(directory / DATA))
        stats = done.stats()
        size = sum(p.stat().st_size for p in (directory / DATA).rglob("*.parquet"))
        done.publish()
        text = manifests.written_form(corpus.provenance(), stats, {DATA: {"rows": stats.documents, "bytes": size}})
        (directory / MANIFEST).write_text(text, encoding="utf-8")
    return stats


def _in_order(path: Path) -> tuple[int, Path]:
    """Spark's number of a file, which has more than five digits beyond 100,000 files, then its path."""
    number = re.match(r"part-(\d+)", path.name)
    return int(number[1]) if number else -1, path


def open_saved(directory: Path, *, verify: bool) -> tuple[DocumentStream, manifests.Ancestor]:
    """A stream over a saved corpus, checked in every pass if ``verify`` is set, and its manifest."""
    described = directory / MANIFEST
    if not described.is_file():
        raise ManifestError(f"{described}: no manifest; is this a saved corpus?")
    saved = manifests.read_form(described.read_text(encoding="utf-8"), str(described))
    data = directory / DATA

    def make(spark: SparkSession, first: int, report: PassReport) -> tuple[DataFrame, int]:
        files = sorted((p for p in data.rglob("*.parquet") if p.is_file()), key=_in_order) if data.is_dir() else [data]
        units = spark.createDataFrame([(p.absolute().as_uri(), first + n) for n, p in enumerate(files)], "_path string, _unit long")
        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")
        rows = spark.read.parquet(*map(str, files)).withColumns({"_path": path, "_row": F.col("_metadata.row_index")}).join(F.broadcast(units), "_path")
        rows = rows.withColumn("_ord", F.expr(f"_unit * {1 << ROW_BITS}L + _row"))
        if verify:
            _verify(rows, saved)
        null = F.lit(None).cast("string")
        frame = rows.select("_ord", "text", "source", "position", "lang", "metadata", null.alias("_bad"), null.alias("_err_level"), null.alias("_err_message"))
        return frame, first + len(files)

    return DocumentStream(make, lambda: [str(data)], "raise", Traits(paths=(directory,))), saved


def _verify(rows: DataFrame, saved: manifests.Ancestor) -> None:
    """Ids and content hashes are recomputed in the tasks, and the fingerprint from them."""
    own_id = hashing.document_id(F.col("source"), F.col("position"))
    checked = rows.select("_ord", "source", "position", "id", F.col("content_hash").alias("stored"), hashing.content_hash(F.col("text")).alias("content_hash"), own_id.alias("own"))
    wrong = checked.where("id is distinct from own or stored is distinct from content_hash").orderBy("_ord").select("source", "position").first()
    if wrong:
        raise IntegrityError(f"{wrong.source}#{wrong.position}: stored id/content_hash do not match the text")
    # All stored hashes are right by now, so the fingerprint needs no second hashing of the texts.
    found = ordered_fingerprint(rows.select("_ord", "content_hash"))
    if found != saved.stats.fingerprint:
        raise IntegrityError(f"fingerprint {found} does not match the manifest's {saved.stats.fingerprint}")
