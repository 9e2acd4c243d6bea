"""Folders that a job has finished writing, on whatever file system Spark reads."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

DONE = "_SUCCESS"


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written the folder to its end."""
    where, system = _at(spark, f"{path}/{DONE}")
    return system.exists(where)


def written(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path` that are written to their end."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if is_written(spark, f"{path}/{n}"))


def drop(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of each file, none of an empty one. Only the beginning of a file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first(path: str) -> str | None:
        where, system = _at(spark, path)
        stream = system.open(where)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
            plain = stream if codec is None else codec.createInputStream(stream)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                plain, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return {p: line for p, line in zip(paths, pool.map(first, paths), strict=True)
                if line is not None}
