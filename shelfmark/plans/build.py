"""Offline build: raw files to clean catalog, features and retrieval model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.cleaning import clean_catalog, fill_price
from shelfmark.operators.features import engineer
from shelfmark.operators.prices import update_prices
from shelfmark.operators.standardise import standardise
from shelfmark.plans.model_store import StoredModel, load_or_train
from shelfmark.sources.files import verify_rows, write_catalog


def build_catalog(raw: DataFrame, feed: DataFrame | None = None, order: str = "ingest_seq"
                  ) -> DataFrame:
    """Clean, price, standardise and add features; ids are assigned last."""
    cleaned, _, _ = clean_catalog(raw, order, ids=False)
    if feed is not None:
        cleaned = update_prices(cleaned, feed).drop("price_matched")
    standard = standardise(fill_price(cleaned).drop("course_id"), order)
    return engineer(standard)


def build(spark: SparkSession, raw: DataFrame, out: str, feed: DataFrame | None = None,
          order: str = "ingest_seq", **params) -> StoredModel:
    """Write catalog and model under `out`; each layer is read back from storage by the next."""
    rows = write_catalog(build_catalog(raw, feed, order), f"{out}/catalog")
    if not verify_rows(spark, f"{out}/catalog", rows):
        raise ValueError(f"{out}/catalog does not hold the {rows} rows that were written")
    courses = spark.read.parquet(f"{out}/catalog")
    return load_or_train(spark, courses, f"{out}/model", **params)
