"""Registered queries over sources and sinks: files of every format made from the driver's tables, hubs, error policies."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.errors import ReadError
from corploom.plans.corpus import Corpus
from corploom.plans.tables import new_path
from corploom.queries import documents, kept, query
from corploom.sources import read
from corploom.sources.hub import DatasetRequest
from corploom.sources.reader import Reader


def _folder(spark: SparkSession, label: str) -> str:
    """A local path in the shared folder, as readers of files take them."""
    return new_path(spark, label).removeprefix("file://")


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _with_ids(corpus: Corpus) -> DataFrame:
    """doc_id (from the metadata), lang, bytes and text of what a pass keeps."""
    meta = F.from_json("metadata", "doc_id string")["doc_id"].cast("long").alias("doc_id")
    return corpus.to_df().select(meta, "lang", F.octet_length("text").cast("long").alias("bytes"), "text")


_ALL = "SELECT doc_id, lang, strlen(text)::BIGINT AS bytes, text FROM documents"


@query(_ALL)
def read_jsonl_gz_directory(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    _table(spark, sf).select("text", "lang", "doc_id").write.option("compression", "gzip").json(path)
    return _with_ids(Corpus(read(path, format="jsonl", glob="*.json.gz", lang_field="lang", metadata_fields=["doc_id"], on_error="raise")))


@query(_ALL)
def read_csv_directory(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "csv")
    plain = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _table(spark, sf).select("doc_id", "text", "lang").write.options(**plain).csv(path)
    return _with_ids(Corpus(read(path, glob="*.csv", lang_field="lang", metadata_fields=["doc_id"], on_error="raise")))


@query(_ALL)
def read_tsv_with_delimiter(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "tsv")
    plain = {"header": True, "quoteAll": True, "escape": '"', "sep": "\t", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _table(spark, sf).select("doc_id", "text", "lang").write.options(**plain).csv(path)
    return _with_ids(Corpus(read(path, format="csv", delimiter="\t", glob="*.csv", lang_field="lang", metadata_fields="all", on_error="raise")))


def _texts_by_lang(spark: SparkSession, sf: str) -> str:
    path = _folder(spark, "text")
    _table(spark, sf).select("lang", "text").write.partitionBy("lang").text(path)
    return path


_LINES = "SELECT coalesce(lang, 'und') AS lang, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"""SELECT 'lang=' || lang AS directory, count(*) AS documents, sum(strlen(line) - (ends_with(line, chr(13)))::INT)::BIGINT AS bytes
          FROM ({_LINES}) GROUP BY lang""")
def read_text_lines_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    done = Corpus(read(_texts_by_lang(spark, sf), unit="line", glob="*.txt", on_error="skip")).run_pass(fingerprint=False)
    return done.kept().groupBy(F.col("group").alias("directory")).agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))


@query("SELECT 'lang=' || coalesce(lang, 'und') AS directory, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def read_text_files_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    done = Corpus(read(_texts_by_lang(spark, sf), glob="*.txt", on_error="skip")).run_pass(fingerprint=False)
    return done.kept().groupBy(F.col("group").alias("directory")).agg(F.sum("bytes").alias("bytes"))


def _one_file_each(rows: DataFrame, path: str) -> None:
    """Writes each text to a file of its own. Tasks write them in Python: Spark starts a process or two for the permissions of each file."""
    Path(path).mkdir(parents=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                name = f"part-{task:05}-{n:07}"
                partial = f"{path}/.{name}.{uuid.uuid4().hex}"  # another attempt of this task may write the same file
                with open(partial, "wb") as file:
                    file.write((text.as_py() or "").encode() + b"\n")
                os.replace(partial, f"{path}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]})

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()


@query("SELECT strlen(text)::BIGINT + 1 AS bytes FROM documents WHERE lang = 'de'")
def read_raw_text_of_any_format(spark: SparkSession, sf: str) -> DataFrame:
    """One file a document, read as text because format= says so."""
    path = _folder(spark, "raw")
    _one_file_each(_table(spark, sf).where("lang = 'de'").select("text"), path)
    done = Corpus(read(path, format="text", glob="part-*", on_error="skip")).run_pass(fingerprint=False)
    return done.kept().where("bytes > 0").select("bytes")


def _damaged_lines(spark: SparkSession, sf: str) -> str:
    path = _folder(spark, "damaged")
    good = F.to_json(F.struct("text", "doc_id"), {"ignoreNullFields": "false"})
    no_text = F.to_json(F.struct(F.lit(None).cast("string").alias("text"), "doc_id"), {"ignoreNullFields": "false"})
    number = F.to_json(F.struct(F.lit(5).alias("text"), "doc_id"))
    at = F.col("doc_id")
    line = F.when(at % 7 == 0, F.concat(F.lit("no json "), at)).when(at % 11 == 0, no_text).when(at % 13 == 0, number).when(at % 17 == 0, F.lit("[1, 2]")).otherwise(good)
    _table(spark, sf).select(line).write.text(path)
    return path


@query("""SELECT CASE WHEN doc_id % 7 = 0 THEN 'invalid JSON' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'type' WHEN doc_id % 17 = 0 THEN 'no row' ELSE 'kept' END AS kind,
          count(*) AS n FROM documents GROUP BY 1""")
def row_errors_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    done = Corpus(read(_damaged_lines(spark, sf), format="jsonl", glob="*.txt", on_error="skip")).run_pass(fingerprint=False)
    message = F.col("_err_message")
    kind = F.when(message.isNull(), "kept").when(message.startswith("invalid JSON"), "invalid JSON").when(message.startswith("missing"), "missing")
    return done.rows.groupBy(kind.when(message.startswith("expected an object"), "no row").otherwise("type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) AS skipped FROM documents")
def skipped_rows_of_a_pass(spark: SparkSession, sf: str) -> DataFrame:
    corpus = Corpus(read(_damaged_lines(spark, sf), format="jsonl", glob="*.txt", on_error="skip"))
    corpus.run_pass(fingerprint=False).publish()
    return spark.createDataFrame([(corpus._stream.last_pass.errors_by_level.get("row", 0),)], "skipped long")


@query("SELECT count(*) > 0 AS raised FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0")
def raise_policy_stops_a_pass(spark: SparkSession, sf: str) -> DataFrame:
    try:
        Corpus(read(_damaged_lines(spark, sf), format="jsonl", glob="*.txt", on_error="raise")).run_pass(fingerprint=False)
        raised = False
    except ReadError:
        raised = True
    return spark.createDataFrame([(raised,)], "raised boolean")


class _TableHub:
    """A hub whose one dataset is a table."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def resolve_revision(self, dataset: str, revision: str | None) -> str:
        return revision or "0123abcd"

    def stream_rows(self, request: DatasetRequest) -> Iterable[dict[str, Any]]:
        return (r.asDict() for r in self.rows.toLocalIterator())


@query("SELECT item_id, text, 'hf:org/benchmark/default:train' AS source FROM benchmark")
def read_hub_dataset(spark: SparkSession, sf: str) -> DataFrame:
    hub = _TableHub(spark.read.parquet(f"{sf}/benchmark.parquet"))
    rows = Corpus(read("hf:org/benchmark", metadata_fields=["item_id"], reader=Reader(hub=hub))).to_df()
    return rows.select(F.from_json("metadata", "item_id long")["item_id"].alias("item_id"), "text", "source")


@query("SELECT count(*) AS documents, count(DISTINCT text) AS texts FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
def read_several_sources(spark: SparkSession, sf: str) -> DataFrame:
    paths = []
    for name in ("documents", "benchmark"):
        paths.append(_folder(spark, f"several-{name}"))
        spark.read.parquet(f"{sf}/{name}.parquet").select("text").write.parquet(paths[-1])
    done = Corpus(read(paths, on_error="skip")).run_pass()
    return done.kept().agg(F.count("*").alias("documents"), F.countDistinct("content_hash").alias("texts"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_exact_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).dedup(on_disk=True))


@query("""WITH d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
          SELECT doc_id, source FROM d WHERE length(text) >= 200 AND contains(text, 'e')""")
def filter_after_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).dedup().filter(F.col("text").contains("e"), min_chars=200))


@query("SELECT doc_id, source, strlen(text)::BIGINT AS bytes FROM documents WHERE length(text) >= 100 AND regexp_matches(text, '\\S')")
def load_without_verifying(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "trusted")
    documents(spark, sf).filter(min_chars=100).save(path)
    done = Corpus.load(path, verify=False).run_pass(fingerprint=False)
    return done.kept().select(F.col("position").alias("doc_id"), "source", "bytes")


@query("SELECT count(DISTINCT lang) AS langs, count(DISTINCT lang) AS sides, count(*) AS documents FROM documents")
def split_by_function_keeps_groups_whole(spark: SparkSession, sf: str) -> DataFrame:
    train, held = (side.run_pass(fingerprint=False).kept() for side in documents(spark, sf).split(validation=0.4, by=lambda d: d.lang or ""))
    both = [side.select("lang").distinct() for side in (train, held)]
    return spark.createDataFrame([(both[0].union(both[1]).distinct().count(), sum(b.count() for b in both), train.count() + held.count())], "langs long, sides long, documents long")
