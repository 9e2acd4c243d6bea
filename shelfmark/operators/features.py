"""Numeric catalog features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import columns as C
from shelfmark.operators.common import cut, dense_index, total_of
from shelfmark.operators.standardise import feature_text


def encode_columns(df: DataFrame) -> DataFrame:
    """I02-I04."""
    return df.withColumns({"platform_encoded": C.encode_platform("platform"),
                           "level_encoded": C.encode_level("level"),
                           "price_encoded": C.encode_price("price")})


def normalise_rating(df: DataFrame) -> DataFrame:
    """Rating over the greatest rating (5 when that is not positive)."""
    top = total_of(df, F.max("rating"))
    return df.withColumn("rating_normalized",
                         F.col("rating") / F.when(top > 0, top).otherwise(F.lit(5.0)))


def add_popularity(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """0.6 normalised rating + 0.4 normalised log review count."""
    top = total_of(df, F.max(F.log1p(F.coalesce("num_reviews", F.lit(0)))))
    logs = F.log1p(F.coalesce("num_reviews", F.lit(0)))
    df = normalise_rating(df).withColumn(
        "reviews_normalized", logs / F.when(top > 0, top).otherwise(F.lit(1.0)))
    score = F.lit(0.6) * F.col("rating_normalized") + F.lit(0.4) * F.col("reviews_normalized")
    return df.withColumn("popularity_score", score if digits is None
                         else C.half_even(score, digits))


def one_hot_categories(df: DataFrame, limit: int = 1000) -> DataFrame:
    """One 0/1 column per distinct category.

    A column per value needs the value list at planning time, so the list is checked: more than
    `limit` categories is an error; `category_vectors` takes any number.
    """
    found = [r[0] for r in df.select("category").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories: encode them as a vector instead")
    return df.withColumns({
        "cat_" + c.lower().replace(" ", "_"):
            F.coalesce((F.col("category") == c).cast("int"), F.lit(0))
        for c in sorted(x for x in found if x is not None)})


def category_index(df: DataFrame, column: str = "category") -> DataFrame:
    """(category, category_id): every category with its place in alphabetical order from 0,
    numbered over range partitions."""
    return dense_index(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column],
                       "category_id")


def category_vectors(df: DataFrame, column: str = "category", index: DataFrame | None = None
                     ) -> DataFrame:
    """`category_vector`, a sparse 0/1 vector with a place per category, for any number of
    them. A NULL category, or one that a given index does not hold, has no 1."""
    from pyspark.ml.feature import OneHotEncoder
    index = cut(category_index(df, column) if index is None else index)
    encoder = OneHotEncoder(inputCol="category_id", outputCol="category_vector", dropLast=True,
                            handleInvalid="keep")
    if index.isEmpty():
        raise ValueError("no category to encode")
    fitted = encoder.fit(index.withColumn("category_id", F.col("category_id").cast("double")))
    size = index.select(F.count(F.lit(1)).alias("n")).scalar()
    known = df.join(index, column, "left").withColumn(
        "category_id", F.coalesce("category_id", size).cast("double"))
    return fitted.transform(known).drop("category_id")


def engineer(df: DataFrame) -> DataFrame:
    """Combined text, codes, normalised rating, popularity."""
    df = df.withColumn("combined_text", feature_text(df))
    return add_popularity(encode_columns(df))


def feature_columns(df: DataFrame) -> list[str]:
    """Names of the numeric feature columns present."""
    wanted = K.FEATURE_COLUMNS + [c for c in df.columns if c.startswith("cat_")]
    return [c for c in wanted if c in df.columns]
