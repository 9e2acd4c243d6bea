"""Price update from a scraped feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.columns import price_token


def price_lookup(feed: DataFrame, order: str = "seq") -> DataFrame:
    """Last price per (title, url) key; keys with an empty part are ignored.

    The feed is reduced to one row per key before it is joined, so repeated keys cost nothing.
    """
    keyed = feed.select(F.trim(F.lower(F.coalesce("title", F.lit("")))).alias("k_title"),
                        F.trim(F.coalesce("url", F.lit(""))).alias("k_url"),
                        F.struct(price_token("current_price").alias("p")).alias("price"),
                        F.col(order).alias("_o"))
    return (keyed.filter((F.col("k_title") != "") & (F.col("k_url") != ""))
            .groupBy("k_title", "k_url").agg(F.max_by("price", "_o").alias("_new")))


def update_prices(courses: DataFrame, feed: DataFrame, order: str = "seq",
                  source: str = "platform") -> DataFrame:
    """Matched Udemy rows take the feed's price even if it is NULL, Coursera rows a fixed text."""
    platform = F.lower(F.col(source))
    keyed = courses.withColumns({
        "k_title": F.when(platform == "udemy", F.trim(F.lower(F.coalesce("title", F.lit("nan"))))),
        "k_url": F.trim(F.coalesce("url", F.lit("nan")))})
    joined = keyed.join(price_lookup(feed, order), ["k_title", "k_url"], "left")
    matched = F.col("_new").isNotNull()
    price = (F.when(platform == "coursera", F.lit(K.COURSERA_PRICE))
             .when(matched, F.col("_new.p")).otherwise(F.col("price")))
    return (joined.withColumn("price_matched", matched).withColumn("price", price)
            .drop("k_title", "k_url", "_new"))
