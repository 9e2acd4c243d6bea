"""Tables written between the steps of an operator, and bounded filters for its later passes."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.common import scratch

#: Bits of a filter: a fixed size of one megabyte, whatever the number of keys.
FILTER_BITS = 1 << 23


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor
    costs a read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """The UTF-8 bytes of a text; a null is an empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def with_key(df: DataFrame, *cols: str) -> DataFrame:
    """Two hashes of the columns, as a 128-bit key `_ka`, `_kb`. It depends on the row's content
    alone, so it is the same in every pass; rows that are equal in the columns share it."""
    return df.withColumns({"_ka": F.xxhash64(F.lit(17), *cols), "_kb": F.xxhash64(F.lit(91), *cols)})


def filter_bits(keys: DataFrame, col: str, bits: int = FILTER_BITS) -> Broadcast:
    """A bit for each value of the long column `col`, by its lowest bits.

    Its size is fixed; with more keys it lets more other rows pass. It only spares rows a shuffle:
    an exact join always follows.
    """
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    rows = (keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("block"))
            .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
            .collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.tobytes())


def passes(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets pass."""
    table = np.frombuffer(bits, np.uint8)
    at = h.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
            ) & np.uint8(1) == 1
