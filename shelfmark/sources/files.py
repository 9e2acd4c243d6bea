"""Readers and writers: catalogs, card records, behaviour documents, interaction tables."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.columns import nan_to_null
from shelfmark.sources import folders
from shelfmark.sources import schemas as S

CORRUPT = "_corrupt_record"


def sniff_separator(header: str) -> str:
    """Comma, unless the header line splits better at semicolons."""
    return ";" if header.count(";") > header.count(",") else ","


def header_names(header: str) -> list[str]:
    return [n.strip().strip('"').lstrip("\ufeff") for n in header.split(sniff_separator(header))]


def read_catalog(spark: SparkSession, path: str,
                 schema: T.StructType = S.PROCESSED_CATALOG) -> DataFrame:
    """Catalog CSV; every file has its own separator, columns and column order.

    The header line of each file is looked at, and files with equal headers are read together.
    Known columns get their declared type, others are text, and a column that a file has not is NULL
    there. Rows that do not fit keep their raw line in `_corrupt_record`. A file without any line
    has no rows.
    """
    paths = list(spark.read.text(path).inputFiles())
    layouts: dict[str, list[str]] = {}
    for file, header in folders.first_lines(spark, paths).items():
        layouts.setdefault(header, []).append(file)
    known = {f.name: f.dataType for f in schema.fields}
    frames = []
    for header, files in sorted(layouts.items()):
        fields = [T.StructField(n, known.get(n, T.StringType())) for n in header_names(header)]
        fields.append(T.StructField(CORRUPT, T.StringType()))
        df = (spark.read.schema(T.StructType(fields)).option("header", True)
              .option("sep", sniff_separator(header)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("quote", '"')
              .option("escape", '"').csv(files))
        floats = {f.name: nan_to_null(f.name) for f in fields if f.dataType == T.DoubleType()}
        frames.append(df.withColumns(floats) if floats else df)
    if not frames:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(
            CORRUPT, T.StringType())]))
    return union_ragged(frames)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of scraped cards, one array per file."""
    return spark.read.schema(S.CARD_RECORD).option("multiLine", True).json(path)


def write_cards(df: DataFrame, path: str) -> None:
    """A09."""
    df.write.mode("overwrite").json(path)


def read_behaviour(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested behaviour documents, one object per file, to flat tables."""
    return flatten_behaviour(spark.read.text(path, wholetext=True))


def flatten_behaviour(docs: DataFrame, col: str = "value") -> dict[str, DataFrame]:
    """Searches, clicks, views, favorites and stored preferences of every user in the texts."""
    per_user = docs.select(F.explode(F.from_json(col, S.BEHAVIOUR)).alias("username", "doc"))
    flat = {}
    for name in ("searches", "clicks", "views"):
        flat[name] = (per_user.select("username", F.posexplode(f"doc.{name}").alias("seq", "e"))
                      .select("username", "seq", "e.*"))
    flat["favorites"] = per_user.select(
        "username", F.posexplode("doc.favorites").alias("seq", "course_id"))
    flat["preferences"] = reduce(DataFrame.unionByName, [
        per_user.select("username", F.lit(dim).alias("dim"),
                        F.explode(f"doc.preferences.{field}").alias("value", "n"))
        for dim, field in (("category", "categories"), ("level", "levels"),
                           ("platform", "platforms"))])
    return flat


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users documents to rows; credentials are not read at all."""
    return flatten_users(spark.read.text(path, wholetext=True))


def flatten_users(docs: DataFrame, col: str = "value") -> DataFrame:
    return (docs.select(F.explode(F.from_json(col, S.USER_RECORDS)).alias("username", "u"))
            .select("username", "u.*"))


def read_interactions(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The five interaction tables with fixed schemas: the rows of all batches that are written
    to their end. A table without a batch is empty."""
    tables = {}
    for name, schema in S.INTERACTIONS.items():
        batches = folders.written(spark, f"{base}/{name}")
        tables[name] = (spark.read.schema(schema).parquet(
            *[f"{base}/{name}/{b}" for b in batches]) if batches
            else spark.createDataFrame([], schema))
    return tables


def append_interactions(df: DataFrame, base: str, table: str, batch: str | None = None) -> bool:
    """Append rows as one batch, in the declared column order of the table; whether they were
    new.

    A batch counts from the moment its last file is written. The same name again adds nothing, so a
    load that is repeated after a failure is taken once; a batch that failed half-way is written
    anew. Without a name every call is a batch of its own.
    """
    name = uuid.uuid4().hex if batch is None else batch
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", name):
        raise ValueError(f"a batch is named by letters, digits, _ and -: {name!r}")
    path, schema = f"{base}/{table}/{name}", S.INTERACTIONS[table]
    if folders.is_written(df.sparkSession, path):
        return False
    df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode(
        "overwrite").parquet(path)
    return True


def enforce_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: declared columns in declared order, missing ones as empty text."""
    return df.select([F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Rows with different columns to one table, gaps as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write a catalog and return the row count observed by the write itself."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return seen.get["rows"]


def verify_rows(spark: SparkSession, path: str, expected: int, fmt: str = "parquet") -> bool:
    """Reload and compare the row count with the one the write observed."""
    again = (spark.read.option("header", True).csv(path) if fmt == "csv"
             else spark.read.parquet(path))
    return again.count() == expected
