"""Documents made ready for training, in stages that are each written and read again.

quality rules -> line dedup -> near-dedup -> benchmark decontamination -> packing
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from shelfmark.llm.queries import tokenizer
from shelfmark.llm.work import keep, with_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row with a key of its columns; rows that repeat each other share it."""
    return with_key(docs, *docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in `gone`, which is a written table."""
    return _keyed(docs).join(gone, ["_ka", "_kb"], "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules or their host's verdict reject."""
    judged = quality.judge(_keyed(docs).select("_ka", "_kb", "text", "source"))
    return _without(docs, keep(judged.filter("not kept").select("_ka", "_kb").distinct(),
                               "rejected"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the line chunks that repeat earlier ones; documents that lose all their text go."""
    cut = line_dedup.without_repeats(docs)
    return cut.filter((F.col("_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (5-word shingles, 0.8 or more): the one
    with the least id, once if rows repeat. Documents without words stay."""
    docs = docs.dropDuplicates()
    found = near_dedup.components(_keyed(docs).select(
        F.struct("doc_id", "_ka", "_kb").alias("id"), "text"), "id", "text")
    gone = found.filter(F.col("id") != F.col("component_id")).select("id._ka", "id._kb")
    return _without(docs, keep(gone.distinct(), "copies"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold ten words in a row of a benchmark item, or the whole of an item
    that is shorter."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_keyed(docs).select(
        F.struct("_ka", "_kb").alias("id"), "text"), items, "id")
    return _without(docs, keep(found.filter("contaminated").select("id._ka", "id._kb").distinct(),
                               "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage), ("line dedup", line_stage),
    ("near-dedup", near_stage), ("benchmark decontamination", leak_stage),
    ("best-fit packing", packing_stage)]
ORACLE_SQL: str | None = None  # signatures and token ids cannot be told in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
