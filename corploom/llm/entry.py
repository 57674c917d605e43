"""Queries of this subpackage, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.llm import chat, language, minhash, mixing, packing, quality, queries_sql, sharding, substring, tiff, warc


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = minhash.near_duplicates(docs, minhash.NearParameters(words=2))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = substring.drop_repeated_passages(docs, counts=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return tiff.page_features(tiff.decode_pages(media, keep=("doc_id", "n_bytes")))


def op5_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = language.learn(docs.where(language.fold(F.col("doc_id")) != 1))
    held_out = F.coalesce(language.fold(F.col("doc_id")) == 1, F.lit(False))
    return language.identify(docs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_tiff_pages": op4_tiff_pages,
    "op5_language_profiles": op5_language_profiles,
    "op6_content_addressed_warc": op6_content_addressed_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_balanced_shards": op8_balanced_shards,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_minhash_components": op10_minhash_components,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": queries_sql.CHAT,
    "op2_substring_dedup": queries_sql.SUBSTRING,
    "op3_quality_rules": queries_sql.QUALITY,
    "op6_content_addressed_warc": queries_sql.WARC,
    "op9_pfair_mixing": queries_sql.MIXING,
    "op10_minhash_components": queries_sql.NEAR,
}
