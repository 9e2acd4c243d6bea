"""Benchmark decontamination by winnowing.

Every window of `span - k + 1` successive k-grams of words keeps its smallest hash (the last of
equal ones). Two texts that share `span` words share such a window and so a kept hash: each shared
span of at least `span` words is found. Kept hashes of documents are joined with those of the test
items, and every hit is extended to both sides as far as the words agree; runs of at least `span`
words count. An item of fewer words is one window: its own hash, compared with all windows of
that many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.words import LETTERS_LOWER, Slab, lists, longs, slabs, text_bytes
from shelfmark.llm.work import filter_bits, keep, passes, text_of

SPAN, K = 10, 6
_MARKS = ("array<struct<k:int,at:int,fp:bigint,left:array<bigint>,right:array<bigint>>>")


def _winnow(slab: Slab, span: int, k: int) -> np.ndarray:
    """Positions of the kept k-grams of all texts of the slab."""
    g, inside = slab.windows(k)
    w = span - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    own = slab.owner()
    full = own[:n] == own[span - 1:span - 1 + n]  # the window of k-grams lies in one text
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j:j + n], out=least)
    kept = np.zeros(len(g), bool)
    open_ = full.copy()
    for j in range(w - 1, -1, -1):
        hit = open_ & (g[j:j + n] == least)
        kept[j:j + n] |= hit
        open_ &= ~hit
    return np.flatnonzero(kept)


def _context(slab: Slab, at: np.ndarray, step: int, n: int, pad: int) -> np.ndarray:
    """The n words beside each position, nearest first; `pad` beyond the text."""
    own = slab.owner()
    side = at[:, None] + step * np.arange(1, n + 1)[None, :]
    ok = (side >= 0) & (side < len(own))
    safe = np.where(ok, side, 0)
    ok &= own[safe] == own[at][:, None] if len(at) else ok
    return np.where(ok, slab.words[safe].view(np.int64) if len(own) else pad, pad)


def _marks(slab: Slab, k: int, at: np.ndarray, fp: np.ndarray, side: int, pad: int) -> dict:
    return {"own": slab.owner()[at], "k": np.full(len(at), k), "at": at, "fp": fp,
            "left": _context(slab, at, -1, side, pad) if side else np.full((len(at), SPAN), pad),
            "right": _context(slab, at + k - 1, 1, side, pad) if side else
            np.full((len(at), SPAN), pad)}


def _scan(texts: list[bytes], span: int, k: int, short: list[int], bits: bytes | None,
          pad: int) -> Iterator[tuple[Slab, pa.Array]]:
    """Slabs with the marks of each text. With `bits` only what may be in the test set; without, the
    texts are test items and a short one is marked as a whole."""
    side = span - k
    for slab in slabs(texts, LETTERS_LOWER):
        found = []
        at = _winnow(slab, span, k)
        fp = slab.windows(k)[0][at]
        if bits is not None:
            hit = passes(bits, fp)
            at, fp = at[hit], fp[hit]
        if len(at):
            found.append(_marks(slab, k, at, fp, side, pad))
        for m in short:
            h, ok = slab.windows(m)
            if bits is None:  # items of exactly m words
                own = slab.owner()[:len(h)]
                at = np.flatnonzero(ok & (slab.counts[own] == m)) if len(h) else own
            else:
                at = np.flatnonzero(ok & passes(bits, h)) if len(h) else np.zeros(0, np.int64)
            if len(at):
                found.append(_marks(slab, -m, at, h[at], 0, pad))
        counts = np.zeros(slab.hi - slab.lo, np.int64)
        if found:
            one = {x: np.concatenate([f[x][:, :side] if x in ("left", "right") else f[x]
                                      for f in found]) for x in found[0]}
            order = np.argsort(one["own"], kind="stable")
            one = {x: v[order] for x, v in one.items()}
            counts += np.bincount(one["own"], minlength=len(counts))
            wide = np.full(len(order), side)
            marks = pa.StructArray.from_arrays(
                [pa.array(one["k"].astype(np.int32)),
                 pa.array((one["at"] - slab.bounds[one["own"]]).astype(np.int32)),
                 longs(one["fp"]), lists(wide, longs(one["left"].reshape(-1))),
                 lists(wide, longs(one["right"].reshape(-1)))],
                ["k", "at", "fp", "left", "right"])
        else:
            none = pa.array([], pa.list_(pa.int64()))
            marks = pa.StructArray.from_arrays(
                [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int64()), none,
                 none], ["k", "at", "fp", "left", "right"])
        yield slab, lists(counts, marks)


def _marked(df: DataFrame, span: int, k: int, short: list[int], bits, pad: int) -> DataFrame:
    """One row per text: id, number of words, marks. Columns: _id, _text."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = text_bytes(batch.column("_text"))
            ids = batch.column("_id")
            filt = bits.value if bits is not None else None
            for slab, marks in _scan(texts, span, k, short, filt, pad):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(slab.lo, slab.hi - slab.lo), longs(slab.counts), marks],
                    names=["_id", "n_words", "marks"])

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"_id {kind}, n_words bigint, marks {_MARKS}")


def _agree(side: str, n: int):
    """How many words beside the k-gram agree, nearest first."""
    out = F.lit(0)
    for i in range(n - 1, -1, -1):
        same = F.col(f"d.{side}")[i] == F.col(f"t.{side}")[i]
        out = F.when(same, F.lit(1) + out).otherwise(F.lit(0))
    return out


def shared_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K
                 ) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents with `_row`, id, `n_words`; spans with `_row`, `start`,
    `stop` (words, end exclusive) and `item`, one for each kept hash that lies in a shared run.

    Null and empty texts have no words and share nothing. Repeated rows are rows of their own. An
    item without id counts under the empty id. Other columns are not read.
    """
    side = span - k
    tests = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_id"),
                         text_of(item_text).alias("_text"))
    test = keep(_marked(tests, span, k, list(range(1, span)), None, 1), "test-marks")
    test_fp = test.select("_id", F.explode("marks").alias("m")).select(
        F.col("_id").alias("item"), "m.*").distinct()
    short = [-r["k"] for r in test_fp.filter("k < 0").select("k").distinct().collect()]
    bits = filter_bits(test_fp, "fp")
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    marked = keep(_marked(base, span, k, sorted(short), bits, 0)
                  .withColumn("_row", F.monotonically_increasing_id()), "document-marks")
    doc_fp = marked.filter(F.size("marks") > 0).select(
        "_row", F.explode("marks").alias("m")).select("_row", "m.*")
    hit = doc_fp.alias("d").join(test_fp.alias("t"), ["k", "fp"]).select(
        "_row", "k", F.col("d.at").alias("at"), "item", _agree("left", side).alias("l"),
        _agree("right", side).alias("r"))
    hit = hit.filter((F.col("k") < 0) | (F.col("l") + F.col("k") + F.col("r") >= span))
    spans = hit.select(
        "_row", "item", "at",
        F.when(F.col("k") < 0, F.col("at")).otherwise(F.col("at") - F.col("l")).alias("start"),
        (F.col("at") + F.abs("k") + F.when(F.col("k") < 0, F.lit(0)).otherwise(F.col("r")))
        .alias("stop"))
    return marked.select("_row", F.col("_id").alias(id_col), "n_words"), spans


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  span: int = SPAN, k: int = K) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted), contaminated."""
    marked, spans = shared_spans(docs, items, id_col, text_col, item_col, item_text, span, k)
    spans = keep(spans, "shared-spans")
    at = spans.groupBy("_row", "at").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    before = (Window.partitionBy("_row").orderBy("start", "stop")
              .rowsBetween(Window.unboundedPreceding, -1))
    gone = F.coalesce(F.max("stop").over(before), F.lit(0))
    hit = at.withColumn("new", F.greatest(
        F.lit(0), F.col("stop") - F.greatest(F.col("start"), gone)))
    n_hit = hit.groupBy("_row").agg(F.sum("new").cast("bigint").alias("n_hit"))
    found = (spans.select("_row", "item").distinct().groupBy("_row")
             .agg(F.array_sort(F.collect_list("item")).alias("items")))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return (marked.join(n_hit, "_row", "left").join(found, "_row", "left").select(
        F.col(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(items_).cast("bigint").alias("n_items"), items_.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
