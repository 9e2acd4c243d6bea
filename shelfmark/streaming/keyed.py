"""A table with one current row per key, kept by the batches of a stream.

A batch writes its newest row per key to a folder `delta-<id>`. After `every` deltas they are folded
with the base into `base-<id>`, and what two bases ago was current is dropped, so that reading costs
one base and fewer than `every` deltas however long the stream runs, and a reader that began before a
compaction still finds its files. A batch that is repeated overwrites its own delta, or is passed over
if a base already holds it, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources import folders

BATCH = "_batch"


@dataclass(frozen=True)
class KeyedTable:
    """`order` are the columns by which a row is newer, the number of its batch (`_batch`) among
    them or not; rows equal in these are told apart by their other values. `forget` may drop rows of
    a new base that no later batch can need."""

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = (BATCH,)
    every: int = 8
    forget: Callable[[DataFrame], DataFrame] | None = None

    def parts(self, spark: SparkSession) -> tuple[int | None, list[int]]:
        """The number of the newest base, and of the deltas after it."""
        names = [n.split("-") for n in folders.written(spark, self.path)]
        bases = [int(i) for kind, i in names if kind == "base"]
        base = max(bases, default=None)
        return base, sorted(int(i) for kind, i in names if kind == "delta" and (
            base is None or int(i) > base))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys and c not in self.order]
        newest = F.max(F.struct(*self.order, *rest)).alias("_row")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; to be called once or more often per batch, in order."""
        spark = batch.sparkSession
        base, _ = self.parts(spark)
        if base is not None and batch_id <= base:
            return
        rows = batch.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        self._newest(rows).write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id}")
        if len(self.parts(spark)[1]) >= self.every:
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold the base and its deltas into a new base, and drop what the last base replaced."""
        before, _ = self.parts(spark)
        rows = self._rows(spark)
        rows = self.forget(rows) if self.forget else rows
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{upto}")
        for name in folders.written(spark, self.path):
            kind, number = name.split("-")
            if before is not None and (int(number) < before or (
                    kind == "delta" and int(number) <= before)):
                folders.drop(spark, f"{self.path}/{name}")

    def _rows(self, spark: SparkSession) -> DataFrame:
        base, deltas = self.parts(spark)
        names = [f"delta-{i}" for i in deltas] + ([] if base is None else [f"base-{base}"])
        if not names:
            raise ValueError(f"no batch has been written to {self.path}")
        return self._newest(spark.read.parquet(*[f"{self.path}/{n}" for n in names]))

    def current(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key."""
        return self._rows(spark).drop(BATCH)
