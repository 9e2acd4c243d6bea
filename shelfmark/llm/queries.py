"""The operators over the whole given tables, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (counts, decontaminate, licenses, line_dedup, near_dedup, packing,
                           privacy, quality, repeats, sharding, spelling, warc, whitening)
from shelfmark.operators.common import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TOKEN_LIMIT, SHARDS = 2048, 24


def tokenizer(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    """Near-duplicates among all documents: 3-word shingles, similarity 0.85 or more."""
    out = near_dedup.components(_table(spark, base, "documents"), k=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query
def op2_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    """Winnowed test passages in all documents."""
    out = decontaminate.contamination(_table(spark, base, "documents"),
                                      _table(spark, base, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@_query
def op3_personal_data(spark: SparkSession, base: str) -> DataFrame:
    """Personal data and the terms that reveal it in all documents."""
    out = privacy.personal_data(_table(spark, base, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term")


@_query
def op4_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    """All documents as token sequences of at most 1024."""
    docs = _table(spark, base, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")))


@_query
def op5_repeated_passages(spark: SparkSession, base: str) -> DataFrame:
    """Passages of 50 words or more that all documents hold more than once."""
    return repeats.repeated_passages(_table(spark, base, "documents"))


@_query
def op6_sharding(spark: SparkSession, base: str) -> DataFrame:
    """All documents in 24 shards by id, and where a 25th would take them."""
    rows = sharding.assign(_table(spark, base, "documents"), sharding.regular_tree(SHARDS))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                       "grown_shard")


@_query
def op7_license_scan(spark: SparkSession, base: str) -> DataFrame:
    """License phrases and wordings in all documents."""
    return licenses.scan_licenses(_table(spark, base, "documents"))


@_query
def op8_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    """Rules with host verdicts on all documents."""
    docs = _table(spark, base, "documents").select("doc_id", "source", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@_query
def op9_token_counts(spark: SparkSession, base: str) -> DataFrame:
    """Tokens of all documents: a cold pass that fills this run's cache, and a warm one that finds
    every digest there."""
    docs, cache = _table(spark, base, "documents"), scratch(spark, "token-cache")
    counts.token_counts(docs, tokenizer("word_bpe_49k.json"), cache)
    out = counts.token_counts(docs, tokenizer("word_bpe_49k.json"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@_query
def op10_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    """All documents without the runs of lines that repeat earlier ones."""
    docs = _table(spark, base, "documents").select("doc_id", "text")
    out = line_dedup.without_repeats(docs)
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"),
                      F.col("_removed").alias("n_removed"))


@_query
def op11_web_archive(spark: SparkSession, base: str) -> DataFrame:
    """A WARC record of every page, written to a content-addressed archive and read back."""
    archive = scratch(spark, "archive")
    warc.write_archive(_table(spark, base, "pages"), archive)
    return warc.read_pages(spark, archive, with_payload=False).select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


@_query
def op12_spelling_variants(spark: SparkSession, base: str) -> DataFrame:
    """Words of all documents that are one edit apart, and the form each goes back to."""
    return spelling.spelling_forms(spelling.word_counts(_table(spark, base, "documents")))


@_query
def op13_whitening(spark: SparkSession, base: str) -> DataFrame:
    """All vectors on their 16 leading principal components, with unit variance."""
    return whitening.whitened(_table(spark, base, "embeddings"))
