"""Compare named queries with their SQL on the same tables.

Run directly: python -m tests.oracle [data folder] [name part ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("shelfmark")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, bool):
        return str(v)
    return v


def rows_of(cols: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, oracle: str, base: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, base)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {str(bad[0])[:600]}" if bad else None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = session(), database(base)
    oracles, failed, seen = entry.oracle_sql(), [], 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        seen += 1
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, fn, oracles[name], base)
            else:
                problem = None if fn(spark, base).collect() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok" if problem is None else "FAIL"
        if problem:
            failed.append(name)
        print(f"{mark:5}{time.time() - start:7.2f}s {'' if name in oracles else '(rows) '}{name} "
              f"{problem or ''}", flush=True)
    print(f"{seen} queries, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
