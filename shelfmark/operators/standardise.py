"""Catalog standardisation: aliases, ids, derived labels, retrieval texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import columns as C
from shelfmark.operators.common import dense_index, total_of


def add_aliases(df: DataFrame) -> DataFrame:
    """Copy an old column name to the standard one, unless that exists."""
    have = set(df.columns)
    return df.withColumns({new: F.col(old) for old, new in K.COLUMN_ALIASES
                           if old in have and new not in have})


def add_course_id(df: DataFrame, order: str | Column = "ingest_seq", start: int = 0,
                  replace: bool = False) -> DataFrame:
    """Dense ids in ingest order when the table has none."""
    if "course_id" in df.columns and not replace:
        return df
    return dense_index(df.drop("course_id"), [order], "course_id", start)


def add_defaults(df: DataFrame) -> DataFrame:
    """Category, level, price and platform for columns the source does not have."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if "category" not in have:
        new["category"] = C.category_from_title("title")
    if "level" not in have:
        new["level"] = (C.level_from_metadata("metadata") if "metadata" in have
                        else F.lit("All Levels"))
    if "price" not in have:
        new["price"] = F.lit("Free")
    if "platform" in have:
        new["platform"] = C.capitalise("platform")
    return df.withColumns(new) if new else df


def add_combined_text(df: DataFrame) -> DataFrame:
    """Lower-case retrieval text.

    An existing column is used only if it has no gap at all; otherwise every row is rebuilt. The
    gap test is a scalar subquery, so it costs one narrow scan and no join.
    """
    parts = [F.col(c) for c in ("title", "category", "level", "partner") if c in df.columns]
    built = F.concat_ws(" ", *parts)
    if "combined_text" in df.columns:
        gaps = total_of(df, F.bool_or(F.col("combined_text").isNull()))
        built = F.when(F.coalesce(gaps, F.lit(False)), built).otherwise(F.col("combined_text"))
    return df.withColumn("combined_text", F.lower(F.coalesce(built, F.lit(""))))


def standardise(df: DataFrame, order: str | Column = "ingest_seq") -> DataFrame:
    """Aliases, ids, defaults and retrieval text in the order a catalog load applies them."""
    return add_combined_text(add_defaults(add_course_id(add_aliases(df), order)))


def title_category_text(title: str | Column = "title_clean", category: str | Column = "category"
                        ) -> Column:
    """Title, one space, category, lower-cased; a missing side is empty."""
    empty = F.lit("")
    t = F.col(title) if isinstance(title, str) else title
    c = F.col(category) if isinstance(category, str) else category
    return F.lower(F.concat(F.coalesce(t, empty), F.lit(" "), F.coalesce(c, empty)))


def weighted_text(weight: int = 1, category: str = "category", title: str = "title") -> Column:
    """Category repeated `weight` times before the title."""
    empty = F.lit("")
    return F.concat(F.repeat(F.concat(F.coalesce(category, empty), F.lit(" ")), F.lit(weight)),
                    F.coalesce(title, empty))


def feature_text(df: DataFrame) -> Column:
    """Title, description, skills and category, cleaned for text features."""
    parts = [F.col(c) for c in ("title", "description", "skills", "category") if c in df.columns]
    return C.nlp_clean(F.concat_ws(" ", *parts))


def parse_scraped_at(df: DataFrame) -> DataFrame:
    """Timestamp when the column is there; unreadable text is NULL."""
    if "scraped_at" not in df.columns:
        return df
    return df.withColumn("scraped_at", F.try_to_timestamp(F.col("scraped_at").cast("string")))


def map_points(df: DataFrame) -> DataFrame:
    """One row per course for the cluster map, with defaults for columns that are missing. A
    course without a cluster or place has none."""
    def get(name: str, default) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)
    return df.select(
        get("course_id", 0).cast("bigint").alias("id"),
        F.substring(get("title", ""), 1, 50).alias("title"),
        get("category", "").alias("category"), get("cluster", 0).cast("int").alias("cluster"),
        get("x", 0.0).alias("x"), get("y", 0.0).alias("y"), get("rating", 0.0).alias("rating"),
        get("level", "All").alias("level"))


def bubbles(df: DataFrame) -> DataFrame:
    """Rating against popularity, bubble size by number of ratings."""
    return df.select("course_id", "category", "rating", "popularity_score",
                     (F.col("num_reviews") / F.lit(10.0)).alias("bubble_size"))


def display_user(df: DataFrame) -> DataFrame:
    """Day of registration and of the last visit."""
    return df.select("id", "username", F.substring("created_at", 1, 10).alias("created_day"),
                     F.coalesce(F.substring("last_login", 1, 10), F.lit("N/A"))
                     .alias("last_login_day"))


def display_course(df: DataFrame, chars: int = 100) -> DataFrame:
    """Stars, rating to one decimal, trimmed skills, shortened title."""
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    skills = F.col("skills") if "skills" in df.columns else F.lit(None).cast("string")
    return df.select("course_id", C.ellipsis("title", chars).alias("short_title"),
                     rating.cast("int").alias("stars"), C.half_even(rating, 1).alias("rating_1dp"),
                     C.split_skills(skills).alias("skill_list"))


def topic_labels(topic: str | Column) -> dict[str, Column]:
    """The three forms of a topic slug: label, search words, skill list."""
    t = F.col(topic) if isinstance(topic, str) else topic
    return {"topic_label": C.title_case(F.replace(t, F.lit("-"), F.lit(" "))),
            "search_query": F.replace(F.replace(t, F.lit("-"), F.lit(" ")), F.lit(" "),
                                      F.lit("+")),
            "skills": F.replace(t, F.lit("-"), F.lit(", "))}
