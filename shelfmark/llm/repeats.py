"""Repeated passages by a sparse suffix array.

Of each text only the suffixes that start at a minimiser stay: a k-gram that is smallest in some
window of `window` k-grams, which its words alone decide. A passage of `length` words starts at most
`window` - 1 words before such a suffix, so two copies of it have suffixes that agree in at least
`length - window + 1` words. Suffixes are sorted by the hashes of their first `head` and first
`length` words, spread over range partitions whatever the size of a group, and neighbours are
compared. Where heads agree, the match is extended to the left: the windows of `length` words that
start less than `window` words before the suffix are looked up in the same way. The hits, merged,
are the passages with both ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.words import BLANKS_LOWER, Slab, longs, slabs, text_bytes
from shelfmark.llm.work import filter_bits, keep, passes, text_of

LENGTH, K, WINDOW = 50, 10, 31
_SUFFIX = "_row bigint, at int, head bigint, full bigint"


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w successive values."""
    size = 1
    while 2 * size <= w:
        a = op(a[:len(a) - size], a[size:])
        size *= 2
    rest = w - size
    return op(a[:len(a) - rest], a[rest:]) if rest else a


def minimisers(slab: Slab, k: int, window: int) -> np.ndarray:
    """Positions of k-grams that are smallest in a window of their text; equal ones all stay."""
    g, _ = slab.windows(k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    own = slab.owner()
    inside = own[:n] == own[window + k - 2:window + k - 2 + n]
    least = np.where(inside, _slide(g, window, np.minimum), 0)
    side = np.zeros(window - 1, np.uint64)
    best = _slide(np.concatenate([side, least, side]), window, np.maximum)
    return np.flatnonzero((best == g) & (best > 0))


def _suffixes(base: DataFrame, length: int, k: int, window: int) -> DataFrame:
    head = length - window + 1

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            for slab in slabs(texts, BLANKS_LOWER):
                own = slab.owner()
                at = minimisers(slab, k, window)
                ends = slab.bounds[1:][own[at]] if len(at) else at
                at = at[at + head <= ends] if len(at) else at
                ends = slab.bounds[1:][own[at]] if len(at) else at
                short, long_ = slab.windows(head)[0], slab.windows(length)[0]
                full = at + length <= ends
                whole = np.where(full, long_[np.where(full, at, 0)] if len(long_) else 0,
                                 np.uint64(0)).view(np.int64) if len(at) else at
                text = own[at]
                first = slab.bounds[:-1][text]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_row").take(pa.array(text + slab.lo)),
                    pa.array((at - first).astype(np.int32)), longs(short[at]),
                    pa.array(whole, pa.int64(), mask=~full)],
                    names=["_row", "at", "head", "full"])

    return base.select("_row", "_text").mapInArrow(run, _SUFFIX)


def _neighbours(batches):
    """Rows in sorted order with `same_head` and `same_full`: whether the row before or after
    agrees; `_end` marks a task's first and last row."""
    task, held, first = TaskContext.get().partitionId(), None, True

    def judged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        head = table.column("head").to_numpy()
        full = table.column("full")
        some = ~full.is_null().to_numpy()
        full = full.fill_null(0).to_numpy()
        h = head[1:] == head[:-1]
        f = h & (full[1:] == full[:-1]) & some[1:] & some[:-1]
        out = []
        for eq in (h, f):
            x = np.zeros(len(head), bool)
            x[1:] |= eq
            x[:-1] |= eq
            out.append(x)
        return tuple(out)

    def rows(table: pa.Table, same_head, same_full, end):
        out = table.append_column("same_head", pa.array(same_head)).append_column(
            "same_full", pa.array(same_full)).append_column("_end", pa.array(end))
        out = out.filter(pa.array(same_head | end))
        out = out.append_column("_task", pa.array(np.full(len(out), task, np.int32)))
        yield from out.to_batches()

    last_flags = (False, False)
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        same_head, same_full = judged(table)
        same_head[0] |= last_flags[0]
        same_full[0] |= last_flags[1]
        n = len(table)
        end = np.zeros(n, bool)
        end[0] = first
        if n > 1:
            yield from rows(table.slice(0, n - 1), same_head[:-1], same_full[:-1], end[:-1])
            first = False
        held, last_flags = table.slice(n - 1, 1), (same_head[-1], same_full[-1])
    if held is not None:
        yield from rows(held, np.array([last_flags[0]]), np.array([last_flags[1]]),
                        np.array([True]))


def _sorted(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose head another one shares, with `same_full`."""
    key = ["head", "full", "_row", "at"]
    flags = "same_head boolean, same_full boolean, _end boolean, _task int"
    out = keep(suffixes.repartitionByRange(*key).sortWithinPartitions(*key)
               .mapInArrow(_neighbours, f"{_SUFFIX}, {flags}"), "sorted")
    # What ends one task and begins another: two rows a task at most, so they are broadcast.
    ends = out.filter("_end")
    heads = ends.groupBy("head").agg(F.count_distinct("_task").alias("n")).filter("n > 1")
    fulls = ends.filter("full is not null").groupBy("head", "full").agg(
        F.count_distinct("_task").alias("n")).filter("n > 1")
    heads = F.broadcast(heads.select("head", F.lit(True).alias("over_head")))
    fulls = F.broadcast(fulls.select("head", "full", F.lit(True).alias("over_full")))
    out = out.join(heads, "head", "left").join(fulls, ["head", "full"], "left")
    same_head = F.col("same_head") | F.coalesce("over_head", F.lit(False))
    same_full = F.col("same_full") | F.coalesce("over_full", F.lit(False))
    return out.filter(same_head).select("_row", "at", "head", same_full.alias("same_full"))


def _left_windows(base: DataFrame, open_: DataFrame, length: int, window: int) -> DataFrame:
    """(_row, at) of the windows that start less than `window` words before a suffix of `open_`, and
    that occur more than once."""
    places = keep(open_.groupBy("_row").agg(F.collect_list("at").alias("places")), "places")
    bits = filter_bits(places, "_row")

    def some(batches):
        for batch in batches:
            row = batch.column("_row").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(passes(bits.value, row)))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            places_ = batch.column("places").to_pylist()
            for slab in slabs(texts, BLANKS_LOWER):
                h = slab.windows(length)[0]
                rows, at = [], []
                for i in range(slab.lo, slab.hi):
                    first, end = slab.bounds[i - slab.lo], slab.bounds[i - slab.lo + 1] - length
                    at_ = np.array(places_[i], np.int64)[:, None] - np.arange(1, window)[None, :]
                    at_ = np.unique(at_)
                    at_ = at_[at_ >= 0] + first
                    at_ = at_[at_ <= end]
                    at.append(at_)
                    rows.append(np.full(len(at_), i))
                rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                at = np.concatenate(at).astype(np.int64) if at else rows
                first = slab.bounds[:-1][rows - slab.lo]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_row").take(pa.array(rows)),
                    pa.array((at - first).astype(np.int32)), longs(h[at])],
                    names=["_row", "at", "full"])

    text = base.select("_row", "_text").mapInArrow(some, "_row bigint, _text binary")
    found = keep(text.join(places, "_row").mapInArrow(run, "_row bigint, at int, full bigint"),
                 "left-windows")
    twice = keep(found.groupBy("full").count().filter("count > 1").select("full"), "twice")
    return found.join(twice, "full").select("_row", "at")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      length: int = LENGTH, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per passage: id, start_word, end_word (exclusive), n_words, n_rows (rows that are
    equal in id and text). Every word of it lies in a stretch of `length` words that occurs
    elsewhere, in another document or in the same.

    Words are what stands between blanks, A-Z lower-cased. Null and empty texts have none. Copies
    are repeated as a whole, rows that are equal in id and text too. Other columns are not read.
    Documents without a repeated passage have no row.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    base = base.withColumn("_row", F.xxhash64("_id", "_text"))
    names = base.groupBy("_id", "_row").count()
    shared = keep(_sorted(keep(_suffixes(base, length, k, window), "suffixes")), "shared")
    before = (Window.partitionBy("_row").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, -1))
    past = F.max(F.when(F.col("same_full"), F.col("at"))).over(before)
    # Within a repeated stretch: what lies before the suffix is covered already.
    inner = F.col("same_full") & (F.coalesce(past, F.lit(-1 << 30)) >= F.col("at") - length)
    shared = keep(shared.withColumn("inner", inner), "inner")
    edges = keep(shared.filter(~F.col("inner")).select("head").distinct(), "edges")
    open_ = shared.join(edges, "head", "left_semi").select("_row", "at")
    hits = shared.filter("same_full").select("_row", "at").unionByName(
        _left_windows(base, open_, length, window)).distinct()
    order = Window.partitionBy("_row").orderBy("at")
    new = F.col("at") > F.coalesce(F.lag("at").over(order) + length, F.lit(-1))
    spans = (hits.withColumn("new", new.cast("int"))
             .withColumn("part", F.sum("new").over(order)).groupBy("_row", "part")
             .agg(F.min("at").cast("bigint").alias("start_word"),
                  (F.max("at") + length).cast("bigint").alias("end_word")))
    out = spans.join(names, "_row")
    return out.select(F.col("_id").alias(id_col), "start_word", "end_word",
                      (F.col("end_word") - F.col("start_word")).alias("n_words"),
                      F.col("count").alias("n_rows"))
