"""The given tables read as a catalog and its users.

`part` with its `lineitem` rows is a catalog with numbers, `documents` a catalog with texts (whole
texts, titles included), and `events` the interactions with either. Floats are rounded to six
decimals here already, so later ranks do not depend on the order of additions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.columns import r6
from shelfmark.operators.features import add_popularity
from shelfmark.operators.people import enrich_clicks
from shelfmark.operators.similarity import similar_edges
from shelfmark.operators.tfidf import TfidfModel, fit_tfidf

EDGE_K = 20


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{base}/{name}.parquet")


def _by_size(col: str):
    return (F.when(F.col(col) <= 12, F.lit("Beginner")).when(F.col(col) <= 25,
            F.lit("Intermediate")).when(F.col(col) <= 37, F.lit("Advanced"))
            .otherwise(F.lit("All Levels")))


def courses(spark: SparkSession, base: str) -> DataFrame:
    """Parts as courses: rating and review count come from the part's line items."""
    sold = (table(spark, base, "lineitem").groupBy("l_partkey")
            .agg(F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")))
    part = table(spark, base, "part")
    out = part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").select(
        F.col("p_partkey").alias("course_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("instructor"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("coursera")).otherwise(F.lit("udemy"))
        .alias("platform"), _by_size("p_size").alias("level"),
        F.least(F.lit(5.0), r6(F.col("q") / 10.0 + 2.0)).alias("rating"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("num_reviews"),
        F.col("p_size").cast("double").alias("duration_hours"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.concat(F.lit("/course/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_partkey").alias("ingest_seq"))
    return out.withColumn("level_enc", F.when(F.col("level") == "Beginner", 1).when(
        F.col("level") == "Intermediate", 2).when(F.col("level") == "Advanced", 3).otherwise(0))


def rated_courses(spark: SparkSession, base: str) -> DataFrame:
    """Courses with their popularity score."""
    return add_popularity(courses(spark, base)).drop("rating_normalized", "reviews_normalized")


def text_courses(spark: SparkSession, base: str) -> DataFrame:
    """Documents as courses; the title is the whole text."""
    level = F.col("doc_id") % 4
    return table(spark, base, "documents").select(
        F.col("doc_id").alias("course_id"), F.col("text").alias("title"),
        F.col("source").alias("category"), F.col("lang").alias("platform"),
        F.when(level == 0, F.lit("Beginner")).when(level == 1, F.lit("Intermediate"))
        .when(level == 2, F.lit("Advanced")).otherwise(F.lit("All Levels")).alias("level"),
        r6(F.lit(1.0) + (F.col("n_chars") % 41) / 10.0).alias("rating"),
        (F.col("n_chars") % 997).alias("num_reviews"),
        r6(F.col("n_chars") / 1000.0).alias("duration_hours"),
        F.col("doc_id").alias("ingest_seq"),
        F.lower(F.concat_ws(" ", "text", "source")).alias("combined_text"))


def courses_with_strangers(spark: SparkSession, base: str) -> DataFrame:
    """The text courses, and regions as courses whose names no text of them holds: they have no
    neighbour."""
    strangers = table(spark, base, "region").select(
        (F.col("r_regionkey") + 1_000_000_000).cast("bigint").alias("course_id"),
        F.col("r_name").alias("title"), F.lit("region").alias("category"),
        F.lit("none").alias("platform"), F.lit("All Levels").alias("level"),
        F.lit(0.0).alias("rating"))
    return text_courses(spark, base).select(strangers.columns).unionByName(strangers)


def rated_text_courses(spark: SparkSession, base: str) -> DataFrame:
    return add_popularity(text_courses(spark, base)).drop("rating_normalized",
                                                          "reviews_normalized")


def _events(spark: SparkSession, base: str, kind: str | None = None) -> DataFrame:
    e = table(spark, base, "events")
    return e.filter(F.col("event_type") == kind) if kind else e


def _stamp(col: str = "ts"):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def users(spark: SparkSession, base: str) -> DataFrame:
    """One account per user id that has signed up."""
    signup = F.col("event_type") == "signup"
    return (_events(spark, base).groupBy("user_id")
            .agg(F.min(F.when(signup, F.col("ts"))).alias("c"), F.max("ts").alias("l"))
            .filter(F.col("c").isNotNull())
            .select(F.col("user_id").alias("id"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                    _stamp("c").alias("created_at"), _stamp("l").alias("last_login")))


def _on_catalog(spark: SparkSession, base: str, kind: str, catalog: str) -> DataFrame:
    """Events of a kind, each on the course its id falls on."""
    n = table(spark, base, catalog).select(F.count(F.lit(1)).alias("n")).scalar()
    return _events(spark, base, kind).select(
        F.col("event_id").alias("id"), "user_id", (F.col("event_id") % n).alias("course_id"),
        _stamp().alias("timestamp"))


def clicks(spark: SparkSession, base: str, texts: bool = False) -> DataFrame:
    catalog = text_courses(spark, base) if texts else courses(spark, base)
    return enrich_clicks(_on_catalog(spark, base, "click", "documents" if texts else "part"),
                         catalog)


def searches(spark: SparkSession, base: str, texts: bool = False) -> DataFrame:
    """Views as searches for the viewed course's title."""
    catalog = text_courses(spark, base) if texts else courses(spark, base)
    seen = _on_catalog(spark, base, "view", "documents" if texts else "part")
    return seen.join(catalog.select("course_id", F.col("title").alias("query")), "course_id")


def favorites(spark: SparkSession, base: str) -> DataFrame:
    return _on_catalog(spark, base, "purchase", "part")


def labelled_courses(spark: SparkSession, base: str) -> DataFrame:
    """Text courses with the given labels of the vectors of the same id as clusters; courses without
    a vector have none."""
    lab = table(spark, base, "embeddings").select(F.col("vec_id").alias("course_id"),
                                                  F.col("label").alias("cluster"))
    return text_courses(spark, base).join(lab, "course_id", "left")


def points(spark: SparkSession, base: str) -> DataFrame:
    """The vectors with their given labels."""
    return table(spark, base, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("features"))


def text_queries(spark: SparkSession, base: str) -> DataFrame:
    """The benchmark passages as search texts."""
    return table(spark, base, "benchmark").select(F.col("item_id").alias("qid"),
                                                  F.col("text").alias("query"))


@lru_cache(maxsize=4)
def _model(app: str, spark: SparkSession, base: str) -> TfidfModel:
    model = fit_tfidf(text_courses(spark, base), stop_words=K.nlp_stop_words())
    return TfidfModel(model.vocab, model.weights.persist(), model.stop_words, model.bigrams,
                      model.small_vocab)


@lru_cache(maxsize=4)
def _edges(app: str, spark: SparkSession, base: str) -> DataFrame:
    return similar_edges(_model(app, spark, base).weights, EDGE_K).persist()


def text_model(spark: SparkSession, base: str) -> TfidfModel:
    """The retrieval model of the text courses, fitted once per session."""
    return _model(spark.sparkContext.applicationId, spark, base)


def text_edges(spark: SparkSession, base: str, asked: DataFrame | None = None) -> DataFrame:
    """The nearest texts of all text courses, kept for the session, or of the asked ones: by blocks, as
    all are matched, so that rows that repeat count once in both."""
    if asked is not None:
        return similar_edges(text_model(spark, base).weights, EDGE_K, strategy="blocks", asked=asked)
    return _edges(spark.sparkContext.applicationId, spark, base)
