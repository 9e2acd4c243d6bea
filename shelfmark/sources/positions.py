"""A stored table whose rows are found by their place in an order.

The rows are written once in range partitions, each a folder of its own, and beside them the place
at which every partition begins. A place is then looked up by reading the one partition that holds
it, and a page by reading the one or two it lies in, however deep it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, POSITION = "_part", "position"


def write_positions(df: DataFrame, order: Sequence[str | Column], path: str,
                    parts: int | None = None) -> None:
    """Write `df` with its places in a total order, counted from 0."""
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    # The sort is by partition first, as the writer would sort by it again otherwise.
    spread = spread.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = spread.withColumn("_pos", inside)
    spread.limit(0).write.parquet(f"{path}/columns")  # an empty table leaves no other file
    spread.write.partitionBy(PART).parquet(f"{path}/rows")
    rows = stored_rows(df.sparkSession, path)
    # One row per range partition: a single small window adds up their sizes.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    sizes.select(PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n").coalesce(
        1).write.parquet(f"{path}/starts")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with the partition and the place inside it."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/starts")


def row_count(spark: SparkSession, path: str) -> int:
    return _starts(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def at_positions(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The stored rows at the places in the column `position` of `wanted`, with that column. Only
    partitions that hold a wanted place are read; places beyond the end give no rows."""
    # One row per range partition as a sorted list: a place is located without a join of ranges.
    starts = _starts(spark, path).agg(F.array_sort(F.collect_list(F.struct("first", PART, "n")))
                                      .alias("v")).select("v").scalar()
    holds = F.filter("_starts", lambda s: (s["first"] <= F.col(POSITION)) & (
        F.col(POSITION) < s["first"] + s["n"]))
    found = (wanted.select(POSITION).distinct().withColumn("_starts", starts)
             .withColumn("_at", F.get(holds, F.lit(0)))
             .filter(F.col("_at").isNotNull())
             .select(POSITION, F.col(f"_at.{PART}").alias(PART),
                     (F.col(POSITION) - F.col("_at.first")).alias("_pos")))
    parts = [r[0] for r in found.select(PART).distinct().collect()]
    rows = stored_rows(spark, path).filter(F.col(PART).isin(parts))
    return rows.join(found, [PART, "_pos"]).drop(PART, "_pos")


def stored_page(spark: SparkSession, path: str, page: int = 1, per_page: int = 12) -> DataFrame:
    """The rows of one page with their places, read from the partitions that it lies in."""
    lo = (page - 1) * per_page
    hit = [r.asDict() for r in _starts(spark, path).filter(
        (F.col("first") < lo + per_page) & (F.col("first") + F.col("n") > lo)).collect()]
    here = F.lit(False)
    first = F.lit(None).cast("bigint")
    for r in hit:
        inside = F.col(PART) == r[PART]
        here |= inside & F.col("_pos").between(lo - r["first"], lo - r["first"] + per_page - 1)
        first = F.when(inside, F.lit(r["first"])).otherwise(first)
    rows = stored_rows(spark, path).filter(
        F.col(PART).isin([r[PART] for r in hit])).filter(here)
    return rows.withColumn(POSITION, F.col("_pos") + first).drop(PART, "_pos")
