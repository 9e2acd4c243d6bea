"""Catalog lookups, listings and learning paths."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import columns as C
from shelfmark.operators.common import dense_index, first_per, total_of
from shelfmark.sources import positions

FILTER_COLUMNS = ("platform", "category", "level")
LEVEL_ORDER = {"Beginner": 1, "Intermediate": 2, "Advanced": 3, "All Levels": 2}


def contains_text(col: Column, text: str, literal: bool = False) -> Column:
    """Case-insensitive search. The text is a regular expression, lower-cased like the
    column; `literal` takes it as it is. NULL never matches."""
    low = F.lower(col)
    if literal:
        return F.coalesce(low.contains(text.lower()), F.lit(False))
    try:
        re.compile(text.lower())
    except re.error as e:
        raise ValueError(f"not a valid search pattern: {text!r} ({e})") from e
    return F.coalesce(low.rlike(text.lower()), F.lit(False))


def matches(col: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression, NULL is no match."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def filter_condition(filters: Mapping | None, apply_min_rating: bool = False) -> Column:
    """Conjunction of the given filters; an empty value is no filter.

    `min_rating` is accepted and ignored, as listings do, unless `apply_min_rating` is set.
    """
    filters = filters or {}
    parts = [F.col(c) == filters[c] for c in FILTER_COLUMNS if filters.get(c)]
    if filters.get("search"):
        parts.append(contains_text(F.col("title"), filters["search"]))
    if apply_min_rating and filters.get("min_rating"):
        parts.append(F.col("rating") >= float(filters["min_rating"]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_courses(courses: DataFrame, filters: Mapping | None = None,
                   apply_min_rating: bool = False) -> DataFrame:
    return courses.filter(filter_condition(filters, apply_min_rating))


def order_by_metric(courses: DataFrame, sort_by: str) -> list[Column]:
    """Metric descending, missing last, then id. An unknown metric keeps id order."""
    by_id = F.col("course_id").asc()
    return [F.col(sort_by).desc_nulls_last(), by_id] if sort_by in courses.columns else [by_id]


def listing_page(courses: DataFrame, page: int = 1, per_page: int = 12, sort_by: str = "rating",
                 filters: Mapping | None = None, apply_min_rating: bool = False) -> DataFrame:
    """One page of the filtered, sorted catalog (always descending)."""
    return (filter_courses(courses, filters, apply_min_rating)
            .orderBy(*order_by_metric(courses, sort_by))
            .offset((page - 1) * per_page).limit(per_page))


def listing_totals(courses: DataFrame, page: int = 1, per_page: int = 12,
                   filters: Mapping | None = None, apply_min_rating: bool = False) -> DataFrame:
    """Total, number of pages and current page of a listing."""
    return (filter_courses(courses, filters, apply_min_rating)
            .agg(F.count(F.lit(1)).alias("total"))
            .select("total", F.ceil(F.col("total") / F.lit(per_page)).cast("bigint")
                    .alias("pages"), F.lit(page).cast("bigint").alias("current_page")))


def popular(courses: DataFrame, n: int = 10, category: str | None = None) -> DataFrame:
    """Top n by popularity, by rating when there is no popularity."""
    metric = "popularity_score" if "popularity_score" in courses.columns else "rating"
    if category:
        courses = courses.filter(F.col("category") == category)
    return courses.orderBy(*order_by_metric(courses, metric)).limit(n)


def popular_per_category(courses: DataFrame, n: int, name: str = "rank") -> DataFrame:
    """G02 for every category at once."""
    metric = "popularity_score" if "popularity_score" in courses.columns else "rating"
    return first_per(courses.filter(F.col("category").isNotNull()), ["category"],
                     order_by_metric(courses, metric), n, name)


def find_courses(courses: DataFrame, wanted: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Courses by id; an id that does not exist is taken as a position in ingest order."""
    wanted = wanted.select("course_id").distinct()
    by_id = wanted.join(courses, "course_id").withColumn("requested_id", F.col("course_id"))
    unknown = wanted.join(courses, "course_id", "left_anti").select(
        F.col("course_id").alias("requested_id"))
    placed = dense_index(courses, [order], "_position")
    by_position = (placed.join(unknown, placed["_position"] == unknown["requested_id"])
                   .drop("_position"))
    return by_id.unionByName(by_position)


def find_stored_courses(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """D06 on a catalog written by `write_positions` in ingest order: ids by a join, and the others
    as places from the partitions that hold them, without sorting or writing anything."""
    wanted = wanted.select("course_id").distinct()
    courses = positions.stored_rows(spark, path).drop(positions.PART, "_pos")
    by_id = courses.join(wanted, "course_id", "left_semi").withColumn("requested_id",
                                                                      F.col("course_id"))
    unknown = wanted.join(courses, "course_id", "left_anti").select(
        F.col("course_id").alias(positions.POSITION))
    placed = positions.at_positions(spark, path, unknown).withColumnRenamed(positions.POSITION,
                                                                            "requested_id")
    return by_id.unionByName(placed)


def in_top_categories(courses: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n most frequent categories; the kept list has n rows."""
    top = (courses.filter(F.col("category").isNotNull()).groupBy("category").count()
           .orderBy(F.desc("count"), "category").limit(n).select("category"))
    return courses.join(F.broadcast(top), "category", "left_semi")


def platform_masks(df: DataFrame, platform: str = "platform") -> DataFrame:
    """D08."""
    low = F.lower(F.col(platform))
    return df.withColumns({"is_udemy": F.coalesce(low == "udemy", F.lit(False)),
                           "is_coursera": F.coalesce(low == "coursera", F.lit(False))})


def seed_courses(courses: DataFrame, patterns: Mapping[str, str], order: str = "ingest_seq"
                 ) -> DataFrame:
    """Per pattern the first course whose title matches, all patterns in one scan."""
    firsts = [F.min_by("course_id", F.when(matches("title", p), F.col(order))).alias(name)
              for name, p in patterns.items()]
    wide = courses.agg(*firsts)
    pairs = F.array(*[F.struct(F.lit(n).alias("seed"), F.col(n).alias("course_id"))
                      for n in patterns])
    return (wide.select(F.explode(pairs).alias("e")).select("e.*")
            .filter(F.col("course_id").isNotNull()))


def relevant_searches(scored: DataFrame, gate: float = 15.0) -> DataFrame:
    """Queries whose best score, in percent, is above the gate."""
    return (scored.groupBy("qid").agg(F.max("similarity_score").alias("best"))
            .filter(F.col("best") > gate))


def check_accounts(accounts: DataFrame) -> DataFrame:
    """Reason code per account row, NULL when it is acceptable."""
    reason = (F.when(F.coalesce(F.length("username"), F.lit(0)) < 3, F.lit("username_too_short"))
              .when(F.coalesce(F.length("password"), F.lit(0)) < 4, F.lit("password_too_short"))
              .when(~F.col("password").eqNullSafe(F.col("confirm")),
                    F.lit("confirmation_differs")))
    return accounts.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def best_per_level(courses: DataFrame) -> DataFrame:
    """G04 for every category at once: best rated course per level, steps over present levels."""
    best = first_per(courses.filter(F.col("level").isin(K.PATH_LEVELS)), ["category", "level"],
                     order_by_metric(courses, "rating"))
    return _with_steps(best, ["category"])


def learning_path(courses: DataFrame, category: str) -> DataFrame:
    """Beginner, Intermediate, Advanced steps over the categories matching a text."""
    hits = courses.filter(matches("category", category) & F.col("level").isin(K.PATH_LEVELS))
    best = first_per(hits, ["level"], order_by_metric(courses, "rating"))
    return _with_steps(best.withColumn("category", F.lit(category)), ["category"])


def _with_steps(best: DataFrame, keys: list[str]) -> DataFrame:
    order = C.code_of("level", LEVEL_ORDER, F.lit(2))
    numbered = first_per(best, keys, [order], len(K.PATH_LEVELS), "step")
    return numbered.select(
        "category", F.col("step").cast("int").alias("step"), "level", "course_id", "title",
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("duration_hours", F.lit(0.0)).alias("duration"))


def path_by_popularity(courses: DataFrame, queries: Mapping[str, str], n_steps: int = 3
                       ) -> DataFrame:
    """Per query the most popular course of each encoded level, first n levels.

    `queries` maps a name to a pattern for category or title; all are answered in one scan.
    """
    tagged = F.filter(F.array(*[
        F.when(matches("category", p) | matches("title", p), F.lit(name))
        for name, p in queries.items()]), lambda x: x.isNotNull())
    hits = courses.withColumn("query", F.explode(tagged))
    best = first_per(hits, ["query", "level_enc"], order_by_metric(courses, "popularity_score"))
    return first_per(best, ["query"], [F.col("level_enc").asc_nulls_last()], n_steps,
                     "step").select(
        "query", F.col("step").cast("int").alias("step"),
        F.concat(F.lit("Niveau "), F.col("level_enc").cast("string")).alias("stage"),
        "course_id", "title", F.col("instructor").alias("partner"),
        F.concat(F.col("duration_hours").cast("string"), F.lit("h")).alias("duration"),
        F.col("url").alias("link"))


def random_order_page(courses: DataFrame, users: DataFrame, n: int, seed: int = K.SEED
                      ) -> DataFrame:
    """A repeatable own page of n courses for users without any history.

    Each user starts at an own point of one shuffled catalog and takes the next n, so the work is
    n rows per user and the catalog is never multiplied by the users.
    """
    deck = dense_index(courses.select("course_id", C.shuffle_key("course_id", seed=seed)
                                      .alias("_key")), ["_key", "course_id"], "_slot")
    size = total_of(courses, F.count(F.lit(1)))
    start = F.floor(C.unit_hash("user_id", seed=seed) * size)
    picks = (users.select("user_id", size.alias("_n"), start.alias("_start"))
             .withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(
                 F.lit(n).cast("bigint"), F.col("_n")) - F.lit(1).cast("bigint"))))
             .filter(F.col("_n") > 0)
             .select("user_id", (F.col("_step") + 1).cast("int").alias("rank"),
                     F.pmod(F.col("_start") + F.col("_step"), F.col("_n")).alias("_slot")))
    return picks.join(deck, "_slot").select("user_id", "rank", "course_id")
