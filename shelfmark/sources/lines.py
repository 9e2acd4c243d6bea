"""Quarantine of malformed catalog lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.columns import SPACE_RUN
from shelfmark.sources.folders import first_lines

MIN_FIELDS = 10
QUOTED = '"[^"]*"'


def line_fault(line: Column, csv_aware: bool = False) -> Column:
    """`repeated_price`, `too_few_fields` or NULL for a good line.

    Fields are cut at every comma; with `csv_aware` what stands in quotes is emptied first, so its
    commas do not count. A quote that is never closed quotes nothing.
    """
    text = F.regexp_replace(line, f"^{SPACE_RUN}|{SPACE_RUN}$", "")
    parts = F.split(F.regexp_replace(text, QUOTED, '""') if csv_aware else text, ",")
    filler = F.forall(F.slice(parts, 1, 5),
                      lambda p: F.trim(p).isin(K.MISSING_PRICE, K.COURSERA_PRICE))
    return (F.when(F.size(parts) < MIN_FIELDS, F.lit("too_few_fields"))
            .when(filler, F.lit("repeated_price")))


def mark_lines(lines: DataFrame, col: str = "value", headers: Sequence[str] = (),
               csv_aware: bool = False) -> DataFrame:
    """Add `fault`; header lines are always good."""
    fault = line_fault(F.col(col), csv_aware)
    if headers:
        fault = F.when(~F.col(col).isin(list(headers)), fault)
    return lines.withColumn("fault", fault)


def quarantine(spark: SparkSession, path: str, csv_aware: bool = False
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good lines, quarantined lines with their fault, and the counts (one pass). Every file may have
    a header of its own."""
    text = spark.read.text(path)
    headers = sorted(set(first_lines(spark, list(text.inputFiles())).values()))
    marked = mark_lines(text, headers=headers, csv_aware=csv_aware)
    return (marked.filter("fault IS NULL").drop("fault"), marked.filter("fault IS NOT NULL"),
            fault_counts(marked))


def fault_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count(F.lit(1)).alias("lines"),
                      F.count_if(F.col("fault").isNotNull()).alias("removed"),
                      F.count_if(F.col("fault") == "repeated_price").alias("repeated_price"),
                      F.count_if(F.col("fault") == "too_few_fields").alias("too_few_fields"))
