"""Catalog statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.columns import half_even, level_label, r6
from shelfmark.operators.catalog import in_top_categories
from shelfmark.operators.common import exact_quantiles, total_of


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """rows per value, most frequent first; NULL is not counted."""
    out = (df.filter(F.col(col).isNotNull()).groupBy(col)
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col))
    return out.limit(n) if n else out


def share(df: DataFrame, col: str) -> DataFrame:
    """rows per value and percent of all rows, one decimal."""
    total = total_of(df, F.count(F.lit(1)))
    return value_counts(df, col).withColumn(
        "percent", half_even(F.col("n") * F.lit(100.0) / total, 1))


def mean_by(df: DataFrame, key: str, metric: str, name: str) -> DataFrame:
    """mean per group, missing values skipped."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(r6(F.avg(metric)).alias(name)))


def catalog_stats(df: DataFrame, free: Column | None = None,
                  dims: Sequence[str] = ("platform", "category", "level")) -> DataFrame:
    """totals and counts per platform, category and level in one pass.

    Rows are (dim, value, n, avg_rating, free_courses); `all` carries the totals. `free` says
    what counts as free; without it every course does.
    """
    is_free = F.lit(True) if free is None else free
    base = df.select(*dims, "rating", F.coalesce(is_free, F.lit(False)).alias("_free"))
    dim = F.lit("all")
    value = F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(dim)
        value = F.when(F.grouping(d) == 0, F.col(d)).otherwise(value)
    sets = base.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        dim.alias("dim"), value.alias("value"), F.count(F.lit(1)).alias("n"),
        half_even(F.avg("rating"), 2).alias("avg_rating"),
        F.count_if("_free").alias("free_courses"))
    total = F.col("dim") == "all"
    return (sets.filter(total | F.col("value").isNotNull())
            .select("dim", "value", "n", F.when(total, F.col("avg_rating")).alias("avg_rating"),
                    F.when(total, F.col("free_courses")).alias("free_courses")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """F10."""
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def describe_rating(df: DataFrame, col: str = "rating") -> DataFrame:
    """mean, median, sample deviation, min and max."""
    median = exact_quantiles(df, [], col, {"median": 0.5}).select("median").scalar()
    return df.agg(r6(F.avg(col)).alias("mean"), r6(F.stddev_samp(col)).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max")).select(
        "mean", r6(median).alias("median"), "std", "min", "max")


def histogram(df: DataFrame, col: str = "rating", bins: int = 20) -> DataFrame:
    """equal-width bins from min to max, the last one closed, empty bins kept."""
    low, high = total_of(df, F.min(col)), total_of(df, F.max(col))
    width = high - low
    pos = F.floor((F.col(col) - low) / width * F.lit(float(bins))) + F.lit(1)
    b = F.when(width > 0, F.least(pos, F.lit(bins).cast("bigint"))).otherwise(
        F.lit(bins // 2 + 1).cast("bigint"))
    counts = (df.filter(F.col(col).isNotNull()).select(b.alias("bin")).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("n")))
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    step = F.when(width > 0, width).otherwise(F.lit(1.0)) / F.lit(float(bins))
    left = F.when(width > 0, low).otherwise(low - F.lit(0.5))
    return edges.join(counts, "bin", "left").select(
        "bin", r6(left + (F.col("bin") - 1) * step).alias("bin_from"),
        r6(left + F.col("bin") * step).alias("bin_to"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def correlation(df: DataFrame, a: str = "rating", b: str = "popularity_score") -> DataFrame:
    """Pearson correlation over rows that have both values."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        r6(F.corr(a, b)).alias("correlation"))


def level_distribution(df: DataFrame, col: str = "level_enc") -> DataFrame:
    """F16: rows and percent per encoded level, with display labels."""
    total = total_of(df, F.count(F.lit(1)))
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .select(col, level_label(col).alias("label"), "n",
                    half_even(F.col("n") * F.lit(100.0) / total, 1).alias("percent")))


def duration_boxes(df: DataFrame, n: int = 10, key: str = "category",
                   value: str = "duration_hours") -> DataFrame:
    """box-plot figures of the n most frequent categories.

    Whiskers are the outermost values within 1.5 quartile ranges, the notch is the 95 % range of
    the median. The quartile table has at most n rows.
    """
    top = in_top_categories(df.select(key, value), n)
    quart = exact_quantiles(top, [key], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = top.filter(F.col(value).isNotNull()).join(F.broadcast(quart), key)
    v, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = ((v >= F.col("q1") - F.lit(1.5) * iqr) & (v <= F.col("q3") + F.lit(1.5) * iqr))
    out = rows.groupBy(key, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(value)).alias("mean"),
        F.min(F.when(inside & (v <= F.col("q1")), v)).alias("_low"),
        F.max(F.when(inside & (v >= F.col("q3")), v)).alias("_high"),
        F.count_if(~inside).alias("outliers"))
    notch = F.lit(1.57) * iqr / F.sqrt("n")
    return out.select(key, "n", r6("q1").alias("q1"), r6("median").alias("median"),
                      r6("q3").alias("q3"), "mean",
                      F.coalesce("_low", "q1").alias("whisker_low"),
                      F.coalesce("_high", "q3").alias("whisker_high"), "outliers",
                      r6(F.col("median") - notch).alias("notch_low"),
                      r6(F.col("median") + notch).alias("notch_high"))


def mean_duration_top(df: DataFrame, n: int = 5) -> DataFrame:
    """mean duration of the n most frequent categories."""
    return (df.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.count(F.lit(1)).alias("n"),
                 half_even(F.avg("duration_hours"), 1).alias("mean_duration"))
            .orderBy(F.desc("n"), "category").limit(n))


def home_figures(df: DataFrame, clicks: DataFrame | None = None) -> DataFrame:
    """course total, number of categories, mean rating; clicks per user when given."""
    agg = df.agg(F.count(F.lit(1)).alias("total_courses"),
                 F.countDistinct("category").alias("n_categories"),
                 half_even(F.avg("rating"), 1).alias("avg_rating"))
    if clicks is None:
        return agg
    n = total_of(clicks, F.count(F.lit(1)))
    return agg.withColumn("total_clicks", n)


def total_rows(df: DataFrame, name: str) -> DataFrame:
    """F09."""
    return df.agg(F.count(F.lit(1)).alias(name))
