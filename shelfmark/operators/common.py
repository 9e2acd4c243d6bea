"""Building blocks shared by the operators: lineage cuts, ranking, dense ids, exact quantiles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where none is set, a temporary folder is used with a local master only: there all executors
    share the driver's disk.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="shelfmark-")
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared folder, for one run's files."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def total_of(df: DataFrame, agg: Column) -> Column:
    """One-row aggregate as a scalar subquery: no join, no collect."""
    return df.select(agg.alias("v")).scalar()


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1,
              name: str | None = None) -> DataFrame:
    """First k rows per key. The rank limit is applied before the shuffle as well, so a hot key
    sends at most k rows per task."""
    col = name or "_rank"
    out = df.withColumn(col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(col) <= k)
    return out if name else out.drop(col)


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0
                ) -> DataFrame:
    """Gap-free position in the given total order.

    Range partitioning spreads the sort; each row's position in its own partition comes from the
    partition-local counter, and the sizes of the partitions before it are added by a broadcast
    of one row per partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    placed = (placed.withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_pid").count().select(
        "_pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    return (placed.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_pos") + F.col("_off") + F.lit(start))
            .drop("_mid", "_pid", "_pos", "_off"))


def full_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str
              ) -> DataFrame:
    """Position of every row within its key, for keys of any size.

    Rows are numbered over the whole table in (key, order), and each key's first number is
    subtracted, so the rows of a hot key stay spread over many tasks. The order must be total.
    """
    placed = dense_index(df, [*keys, *order], "_at")
    starts = placed.groupBy(*keys).agg(F.min("_at").alias("_start"))
    return (placed.join(starts, list(keys)).withColumn(name, F.col("_at") - F.col("_start") + 1)
            .drop("_at", "_start"))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    wanted: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, without holding a group in one task.

    Values are counted first (combined before the shuffle), the distinct values are range
    partitioned over the cluster, and running counts locate the two neighbours of each quantile.
    """
    groups = list(groups)
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
               .agg(F.count(F.lit(1)).alias("_n")))
    placed = cut(counted.repartitionByRange(*groups, value)
                 .withColumn("_pid", F.spark_partition_id()))
    keys = groups or [F.lit(0)]
    part = placed.groupBy(*groups, "_pid").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*groups, "_pid",
                       F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"),
                       F.sum("_m").over(Window.partitionBy(*keys)).alias("_total"))
    inside = (Window.partitionBy(*groups, "_pid").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    run = (placed.join(part, [*groups, "_pid"])
           .withColumn("_from", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0))))
    aggs = [F.max("_total").alias("_total")]
    for name, q in wanted.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_from") <= idx) & (idx < F.col("_from") + F.col("_n"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
    found = run.groupBy(*groups).agg(*aggs)
    cols = [F.col(g) for g in groups]
    for name, q in wanted.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*cols)
