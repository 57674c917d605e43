"""Registered queries over the driver's tables, one or more for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.document import Document
from corploom.functions import near
from corploom.functions.batches import bound_batches
from corploom.functions.text import SPACES
from corploom.operators.filter import Filter
from corploom.operators.mix import Balance, Mix
from corploom.operators.sample import Sample
from corploom.operators.split import Split
from corploom.plans.corpus import Corpus, Pass
from corploom.plans.tables import new_path
from corploom.sources import chain, from_table, read
from corploom.streaming.steps import append_stream, select_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(from_table(spark.read.parquet(f"{sf}/documents.parquet"), name="documents", source="source", position="doc_id", lang="lang"))


def benchmark(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(from_table(spark.read.parquet(f"{sf}/benchmark.parquet"), name="benchmark", position="item_id"))


def kept(corpus: Corpus) -> DataFrame:
    """(doc_id, source) of what one pass keeps."""
    return corpus.run_pass(fingerprint=False).kept().select(F.col("position").alias("doc_id"), "source")


WORDS = f"regexp_extract_all(lower(text), '[^{SPACES}]+')"


# statistics


@query("""SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, min(length(text))::BIGINT AS length_min,
          max(length(text))::BIGINT AS length_max, round(avg(length(text)), 6) AS length_mean FROM documents""")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = documents(spark, sf).stats()
    row = (s.documents, s.chars, s.bytes, s.length_min, s.length_max, round(s.length_mean or 0, 6))
    return spark.createDataFrame([row], "documents long, chars long, bytes long, length_min long, length_max long, length_mean double")


def _counts(done: Pass, key: str) -> DataFrame:
    name = F.coalesce(key, F.lit("und")).alias("key")
    return done.kept().groupBy(name).agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))


@query("SELECT coalesce(lang, 'und') AS key, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(documents(spark, sf).run_pass(fingerprint=False), "lang")


@query("SELECT split_part(source, '/', 1) AS key, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def stats_by_source_group(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(documents(spark, sf).run_pass(fingerprint=False), "group")


@query(f"""WITH f AS (SELECT * FROM documents WHERE length(text) >= 500 AND regexp_matches(text, '[^{SPACES}]')),
          d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)
          SELECT 1 AS step, 'filter' AS op, (SELECT count(*) FROM documents) AS docs_in, (SELECT count(*) FROM f) AS docs_out,
                 (SELECT sum(strlen(text))::BIGINT FROM f) AS bytes_out
          UNION ALL SELECT 2, 'dedup', (SELECT count(*) FROM f), (SELECT count(*) FROM d), (SELECT sum(strlen(text))::BIGINT FROM d)""")
def step_counts(spark: SparkSession, sf: str) -> DataFrame:
    steps = documents(spark, sf).filter(min_chars=500).dedup().stats().steps
    rows = [(n, s.op, s.docs_in, s.docs_out, s.bytes_out) for n, s in enumerate(steps) if n]
    return spark.createDataFrame(rows, "step int, op string, docs_in long, docs_out long, bytes_out long")


@query()
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(documents(spark, sf).stats().fingerprint,)], "fingerprint string")


@query()
def document_identities(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).to_df().select(F.col("position").alias("doc_id"), "id", "content_hash")


# filter


@query(f"SELECT doc_id, source FROM documents WHERE length(text) >= 100 AND regexp_matches(text, '[^{SPACES}]')")
def filter_blank_min_chars(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).filter(min_chars=100))


@query(f"SELECT doc_id, source FROM documents WHERE lang = 'de' AND contains(text, 'der') AND regexp_matches(text, '[^{SPACES}]')")
def filter_column_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).filter((F.col("lang") == "de") & F.col("text").contains("der")))


@query(f"SELECT doc_id, source FROM documents WHERE length(text) % 2 = 0 AND regexp_matches(text, '[^{SPACES}]')")
def filter_python_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).filter(lambda d: len(d.text) % 2 == 0))


# dedup


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_exact_first(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).dedup())


@query("""SELECT position AS doc_id, source FROM (SELECT 0 AS s, doc_id AS position, source, text FROM documents
          UNION ALL SELECT 1, item_id, 'benchmark', text FROM benchmark) QUALIFY row_number() OVER (PARTITION BY text ORDER BY s, position) = 1""")
def dedup_exact_across_sources(spark: SparkSession, sf: str) -> DataFrame:
    return kept(Corpus(chain([documents(spark, sf)._stream, benchmark(spark, sf)._stream])).dedup())


def _against(spark: SparkSession, sf: str) -> Corpus:
    """All documents against those of one source."""
    other = documents(spark, sf).filter(F.col("source") == "src3")
    return documents(spark, sf).dedup(against=other)


@query("""SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src3' AND regexp_matches(text, '\\S'))
          QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_against_exact(spark: SparkSession, sf: str) -> DataFrame:
    return kept(_against(spark, sf))


@query("SELECT count(*) AS removed_against FROM documents WHERE text IN (SELECT text FROM documents WHERE source = 'src3' AND regexp_matches(text, '\\S'))")
def removed_against_count(spark: SparkSession, sf: str) -> DataFrame:
    corpus = _against(spark, sf)
    corpus.stats()
    return spark.createDataFrame([(corpus.provenance().steps[1].selection["removed_against"],)], "removed_against long")


@query()
def near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).dedup(near=True))


@query()
def near_dedup_against(spark: SparkSession, sf: str) -> DataFrame:
    train, held = documents(spark, sf).split(validation=0.1, seed=3)
    return kept(train.dedup(near=True, against=held.dedup(near=True)))


@query(f"""WITH s AS (SELECT doc_id, array_to_string({WORDS}, ' ') AS norm, len({WORDS}) AS n FROM documents)
          SELECT min(doc_id) AS first_doc, count(*) AS documents FROM s WHERE n < 5 GROUP BY norm""")
def short_text_near_key(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = docs.select("doc_id", near.near_keys(F.col("text"), 0.75).alias("keys"))
    return keys.where(F.size("keys") == 1).groupBy("keys").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents")).drop("keys")


# sample, mix, split


@query("SELECT lang, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def prepass_bytes_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    corpus = documents(spark, sf).sample(max_bytes=10**6)
    corpus._prepare(set())
    return spark.createDataFrame(list(corpus._bytes_by_lang.items()), "lang string, bytes long")


@query("SELECT round(least(1, 1000000 / sum(strlen(text))), 12) AS fraction FROM documents")
def sample_budget_fraction(spark: SparkSession, sf: str) -> DataFrame:
    corpus = documents(spark, sf).sample(max_bytes=10**6)
    corpus.stats()
    return spark.createDataFrame([(round(corpus.provenance().steps[1].selection["fraction"], 12),)], "fraction double")


@query("SELECT 0::BIGINT AS none, count(*) AS everything FROM documents")
def sample_fraction_edges(spark: SparkSession, sf: str) -> DataFrame:
    none, all_ = (documents(spark, sf).sample(f).run_pass(fingerprint=False).counts_out[0] for f in (0.0, 1.0))
    return spark.createDataFrame([(none, all_)], "none long, everything long")


@query()
def sample_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).sample(0.3, seed=5))


_BYTES = "b AS (SELECT lang, sum(strlen(text))::DOUBLE AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING n > 0)"
_ALPHA = f"WITH {_BYTES}, s AS (SELECT lang, n, pow(n, 0.3) / sum(pow(n, 0.3)) OVER () AS share FROM b)"
_WEIGHTS = {"de": 1.0, "en": 2.0, "fr": 1.0}


def _available(spark: SparkSession, sf: str) -> Balance:
    corpus = documents(spark, sf).mix(alpha=0.3)
    corpus._prepare(set())
    return Balance(corpus._bytes_by_lang)


@query(f"{_ALPHA} SELECT lang, round(share, 9) AS share FROM s")
def mix_alpha_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = Mix(alpha=0.3).parts(_available(spark, sf))
    return spark.createDataFrame([(k, round(v, 9)) for k, v in shares.items()], "lang string, share double")


@query("SELECT * FROM (VALUES ('de', 0.25::DOUBLE), ('en', 0.5::DOUBLE), ('fr', 0.25::DOUBLE)) t(lang, share) WHERE lang IN (SELECT lang FROM documents)")
def mix_weight_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = Mix(weights=_WEIGHTS).parts(_available(spark, sf))
    return spark.createDataFrame(list(shares.items()), "lang string, share double")


@query(f"{_ALPHA} SELECT lang, round(least(1, share * (SELECT min(n / share) FROM s) / n), 9) AS keep FROM s")
def mix_keep_fractions(spark: SparkSession, sf: str) -> DataFrame:
    balance = _available(spark, sf)
    keep = balance.kept(Mix(alpha=0.3).parts(balance), None)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in keep.items()], "lang string, keep double")


@query("SELECT coalesce(lang, 'und') AS lang, count(*) AS dropped FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'en', 'fr') GROUP BY 1")
def mix_dropped_counts(spark: SparkSession, sf: str) -> DataFrame:
    corpus = documents(spark, sf).mix(_WEIGHTS)
    corpus.stats()
    return spark.createDataFrame(list(corpus.provenance().steps[1].selection["dropped"].items()), "lang string, dropped long")


@query()
def mix_by_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).mix(alpha=0.3, seed=42))


@query("SELECT count(*) AS documents, 0::BIGINT AS shared_texts FROM documents")
def split_is_partition(spark: SparkSession, sf: str) -> DataFrame:
    train, held = (side.run_pass().kept() for side in documents(spark, sf).split(validation=0.1))
    shared = train.select("content_hash").distinct().join(held.select("content_hash").distinct(), "content_hash").agg(F.count("*").alias("shared_texts"))
    total = train.union(held).agg(F.count("*").alias("documents"))
    return spark.createDataFrame([(total.first()[0], shared.first()[0])], "documents long, shared_texts long")


@query()
def split_train(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).split(validation=0.1)[0])


@query()
def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    return kept(documents(spark, sf).split(validation=0.1)[1])


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT source) AS sides FROM documents")
def split_by_source_keeps_sources_whole(spark: SparkSession, sf: str) -> DataFrame:
    train, held = (side.run_pass().kept().select("source").distinct() for side in documents(spark, sf).split(validation=0.3, by="source"))
    return spark.createDataFrame([(train.union(held).distinct().count(), train.count() + held.count())], "sources long, sides long")


# sources and sinks


@query("""SELECT 0 AS stream, doc_id AS position, strlen(text)::BIGINT AS bytes FROM documents
          UNION ALL SELECT 1, item_id, strlen(text)::BIGINT FROM benchmark""")
def chain_union_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = Corpus(chain([documents(spark, sf)._stream, benchmark(spark, sf)._stream])).run_pass(fingerprint=False).kept()
    return rows.select(F.when(F.col("source") == "benchmark", 1).otherwise(0).alias("stream"), "position", "bytes")


@query("SELECT doc_id - (SELECT min(doc_id) FROM documents) AS position, lang, strlen(text)::BIGINT AS bytes FROM documents")
def read_parquet_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """A position is a row of one file; of a table of several files, its ids say where that row stands in all of it."""
    path = Path(sf) / "documents.parquet"
    rows = Corpus(read(path, lang_field="lang", on_error="skip")).run_pass(fingerprint=False).kept()
    table = spark.read.parquet(str(path))
    file = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file")
    ids = table.select("doc_id", file, F.col("_metadata.row_index").alias("position"))
    found = rows.withColumn("file", F.substring_index("source", "/", -1)).join(ids, ["file", "position"])
    return found.select((F.col("doc_id") - F.lit(table.agg(F.min("doc_id")).first()[0])).alias("position"), "lang", "bytes")


@query("SELECT conv_id, turn, role, strlen(text)::BIGINT AS bytes FROM conversations WHERE text IS NOT NULL")
def read_parquet_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = Path(sf) / "conversations.parquet"
    rows = Corpus(read(path, metadata_fields=["conv_id", "turn", "role"], on_error="skip")).to_df()
    meta = F.from_json("metadata", "conv_id long, turn long, role string")
    return rows.select(meta.alias("m"), F.octet_length("text").cast("long").alias("bytes")).select("m.conv_id", "m.turn", "m.role", "bytes")


@query("SELECT item_id AS position, text FROM benchmark")
def read_iterable_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    def items():
        for r in spark.read.parquet(f"{sf}/benchmark.parquet").toLocalIterator():
            yield Document(r.text, "benchmark", r.item_id)

    return Corpus(read(items, name="benchmark")).to_df().select("position", "text")


@query("SELECT doc_id, source, coalesce(lang, '') AS lang, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def save_and_load(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "saved").removeprefix("file://")
    documents(spark, sf).dedup().save(path)
    rows = Corpus.load(path).to_df()
    return rows.select(F.col("position").alias("doc_id"), "source", F.coalesce("lang", F.lit("")).alias("lang"), "text")


# streams


@query(f"SELECT doc_id, source FROM documents WHERE length(text) >= 100 AND regexp_matches(text, '[^{SPACES}]')")
def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, [Filter(min_chars=100)])


@query()
def stream_split_and_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, [Split(0.1, 0, "content", "train"), Sample(0.5, seed=1)])


def _streamed(spark: SparkSession, sf: str, steps: list) -> DataFrame:
    path = Path(sf) / "documents.parquet"
    schema = spark.read.parquet(str(path)).schema
    # A stream reads directories: of a single file, its directory with a pattern for its name.
    source = spark.readStream.schema(schema)
    stream = source.parquet(str(path)) if path.is_dir() else source.option("pathGlobFilter", path.name).parquet(str(path.parent))
    docs = stream.select("text", "source", F.col("doc_id").alias("position"), "lang", F.lit("{}").alias("metadata"))
    out = new_path(spark, "stream")
    append_stream(select_stream(docs, steps), f"{out}/data", f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.schema("source string, position long").parquet(f"{out}/data").select(F.col("position").alias("doc_id"), "source")


