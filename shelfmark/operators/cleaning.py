"""Cleaning steps and the full cleaning chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import columns as C
from shelfmark.operators.common import cut, dense_index


def drop_duplicate_titles(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """First row per title in ingest order; NULL titles count as equal.

    Titles meet by a 128-bit digest, of which one row per task and digest moves with its place in
    the order; the rows themselves are then kept or dropped by digest and place. Places are unique.
    """
    # NULL has digests of its own: hashes of a struct skip it, so the flag beside it tells.
    marked = df.withColumns({f"_d{i}": F.xxhash64(F.lit(i), "title", F.col("title").isNull())
                             for i in (0, 1)})
    first = marked.groupBy("_d0", "_d1").agg(F.min(F.struct(F.col(order).alias("at"))).alias("f"))
    same = (marked["_d0"] == first["_d0"]) & (marked["_d1"] == first["_d1"]) & marked[
        order].eqNullSafe(first["f.at"])
    return marked.join(first, same, "left_semi").drop("_d0", "_d1")


def clean_titles(df: DataFrame) -> DataFrame:
    """Cleaned titles longer than five characters."""
    return df.withColumn("title", C.clean_text("title")).filter(F.length("title") > 5)


def clean_descriptions(df: DataFrame) -> DataFrame:
    """Cleaned descriptions, the title where nothing is left."""
    text = C.clean_text("description")
    return df.withColumn("description", F.when(text == "", F.col("title")).otherwise(text))


def normalise_labels(df: DataFrame) -> DataFrame:
    """Category, level, rating, review count and price label."""
    rules = {"category": C.normal_category, "level": C.normal_level, "rating": C.clean_rating,
             "num_reviews": C.clean_reviews, "price": C.clean_price_label}
    return df.withColumns({c: rule(c) for c, rule in rules.items() if c in df.columns})


def fill_missing(df: DataFrame) -> DataFrame:
    """Defaults for the columns present, rows without a title out."""
    filled = df.fillna({c: v for c, v in K.CLEAN_DEFAULTS.items() if c in df.columns})
    return filled.filter(F.length("title") > 0)


def fill_price(df: DataFrame) -> DataFrame:
    """C11: fixed text for missing prices."""
    return df.fillna({"price": K.MISSING_PRICE})


def clean_catalog(df: DataFrame, order: str = "ingest_seq", ids: bool = True
                  ) -> tuple[DataFrame, Observation, Observation]:
    """The whole chain, with row counts observed before and after in the same pass.

    The observations fill when the result is first run, or right away with `ids`: numbering reads
    its input twice, so the cleaned rows are written once before it.
    """
    before, after = Observation(), Observation()
    out = df.observe(before, F.count(F.lit(1)).alias("rows"))
    for step in (lambda d: drop_duplicate_titles(d, order), clean_titles, clean_descriptions,
                 normalise_labels, fill_missing):
        out = out.transform(step)
    out = out.observe(after, F.count(F.lit(1)).alias("rows"))
    if ids:
        out = dense_index(cut(out.drop("course_id")), [order], "course_id", 1)
    return out, before, after


def cleaning_counts(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Rows before, after and removed, as a one-row table."""
    cleaned, _, _ = clean_catalog(df, order, ids=False)
    after = cleaned.select(F.count(F.lit(1)).alias("n")).scalar()
    return (df.agg(F.count(F.lit(1)).alias("rows_before"))
            .select("rows_before", after.alias("rows_after"),
                    (F.col("rows_before") - after).alias("rows_removed")))


def shuffled(df: DataFrame, key: str = "course_id", seed: int = K.SEED) -> DataFrame:
    """C14: repeatable shuffle; `position` is the place in the shuffled order."""
    keyed = df.withColumn("_key", C.shuffle_key(key, seed=seed))
    return dense_index(keyed, ["_key", key], "position").drop("_key")


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column its type, missing values and the row count, in one pass."""
    def gone(name: str) -> Column:
        floats = dict(df.dtypes)[name] in ("double", "float")
        return F.col(name).isNull() | (F.isnan(name) if floats else F.lit(False))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(gone(c)).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"),
                        F.col(c).alias("missing")) for c, t in df.dtypes]
    return (wide.select(F.col("_rows").alias("row_count"),
                        F.explode(F.array(*entries)).alias("e"))
            .select("e.*", "row_count"))


def category_count(df: DataFrame) -> DataFrame:
    """Distinct normalised categories."""
    return (df.select(C.normal_category("category").alias("category"))
            .agg(F.countDistinct("category").alias("n_categories")))
