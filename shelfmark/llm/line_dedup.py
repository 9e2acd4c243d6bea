"""Line dedup over content-defined chunks of lines.

A window rolls over the hashes of a text's lines; the line with the least hash in each window is a
boundary, so boundaries move with the content and every `window` lines in a row hold one. Chunks lie
between boundaries. The boundary lines are anchors: one that stands more than once in the corpus is
extended line by line to both sides, through the chunks it borders on. A repeated run of `window`
lines or more is a chain of such extensions of anchors of its own, so all of it is found, wherever
it stands and whatever stands around it.

Of extended stretches that occur more than once, the first occurrence by (id, place) stays. The
others go, once their bytes are seen to equal the first's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.words import groups, text_bytes
from shelfmark.llm.work import filter_bits, keep, passes, text_of

#: Lines a window covers: repeated runs of so many lines or more are all found.
WINDOW = 2
_BLANK = np.uint64((1 << 64) - 1)


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """A hash of each line; blank lines have the greatest, so they are boundaries among themselves
    only."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    h[[not x.strip() for x in lines]] = _BLANK
    return h


def boundaries(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which lines have the least hash of a window they lie in; ties all do."""
    w = min(window, len(h))
    least = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)
    edge = np.zeros(w - 1, np.uint64)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, least, edge]), w)
    return around.max(axis=1) == h


def extensions(at: np.ndarray, n: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) line of the stretches from each anchor to every line of the chunks before and
    behind it. Chunks have at most `window` lines, so those lines are as many, whatever stands
    around: equal runs have equal stretches."""
    far = np.arange(1, window)
    first = np.concatenate([np.repeat(at, window - 1), (at[:, None] - far).ravel()])
    last = np.concatenate([(at[:, None] + far).ravel(), np.repeat(at, window - 1)])
    inside = (first >= 0) & (last < n)
    pairs = np.unique(first[inside] * n + last[inside])
    return pairs // n, pairs % n


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _anchors(base: DataFrame, window: int) -> DataFrame:
    """(digest, n) of the boundary lines of all texts that are not blank, counted by slab."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            for lo, hi in groups(texts):
                found = []
                for text in texts[lo:hi]:
                    h = line_hashes(text.split(b"\n"))
                    if len(h) > 1:
                        found.append(h[boundaries(h, window) & (h != _BLANK)])
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(h)), pa.array(n.astype(np.int64))], names=["digest", "n"])

    return base.select("_text").mapInArrow(run, "digest bigint, n bigint")


def _stretches(text: bytes, window: int, known: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the extensions of a text's known anchors."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return []
    h = line_hashes(lines)
    mine = boundaries(h, window) & (h != _BLANK) & passes(known, _signed(h))
    a, b = extensions(np.flatnonzero(mine), len(lines), window)
    end = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return [(i, j - i + 1, text[x:y]) for i, j, x, y in
            zip(a.tolist(), b.tolist(), start[a].tolist(), end[b].tolist(), strict=True)]


def _stretch_rows(base: DataFrame, window: int, known, bits=None) -> DataFrame:
    """_id, _row, at, n, digest of every extension of a known anchor; with a filter on digests,
    those it lets pass, with their bytes."""
    with_bytes = bits is not None

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            for lo, hi in groups(texts):
                own, at, size, dig, raw = [], [], [], [], []
                for i in range(lo, hi):
                    for a, n, piece in _stretches(texts[i], window, known.value):
                        own.append(i)
                        at.append(a)
                        size.append(n)
                        dig.append(xxhash.xxh3_64_intdigest(piece))
                        if with_bytes:
                            raw.append(piece)
                dig = _signed(np.array(dig, np.uint64))
                pick = np.arange(len(own))
                if with_bytes:
                    pick = np.flatnonzero(passes(bits.value, dig))
                take = pa.array(np.array(own, np.int64)[pick])
                cols = [batch.column("_id").take(take), batch.column("_row").take(take),
                        pa.array(np.array(at, np.int32)[pick]),
                        pa.array(np.array(size, np.int32)[pick]), pa.array(dig[pick])]
                names = ["_id", "_row", "at", "n", "digest"]
                if with_bytes:
                    cols.append(pa.array([raw[j] for j in pick], pa.binary()))
                    names.append("piece")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = base.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _row bigint, at int, n int, digest bigint"
    return base.mapInArrow(run, schema + ", piece binary" * with_bytes)


def repeated_lines(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_row, start, end) of the lines that repeat earlier ones byte by byte, end exclusive. Where a
    stretch overlaps its first occurrence, what lies outside that. From _id, _row, _text."""
    anchors = _anchors(base, window).groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    known = filter_bits(keep(anchors.select("digest"), "anchors"), "digest")
    first = _stretch_rows(base, window, known).groupBy("digest").agg(
        F.count(F.lit(1)).alias("times"), F.min("_id").alias("first_id")).filter("times > 1")
    first = keep(first.select("digest", "first_id"), "repeated")
    # These tables grow with the texts: they are merged at any size, not broadcast while still few.
    some = keep(_stretch_rows(base, window, known, filter_bits(first, "digest")).join(
        first.hint("merge"), "digest"), "occurrences")
    model = some.filter(F.col("_id").eqNullSafe(F.col("first_id"))).groupBy("digest").agg(
        F.min(F.struct("_row", "at", "piece")).alias("m"))
    model = keep(model.select("digest", "m.*"), "models").alias("m")
    same = some.alias("s").join(model.hint("merge"), F.col("s.digest") == F.col("m.digest"))
    end = F.col("s.at") + F.col("s.n")
    start = F.when(F.col("s._row") == F.col("m._row"),
                   F.greatest(F.col("s.at"), F.col("m.at") + F.col("s.n"))).otherwise(F.col("s.at"))
    return (same.filter(F.col("s.piece") == F.col("m.piece"))
            .select("s._row", start.alias("start"), end.alias("end")).filter("start < end"))


def _cut(base: DataFrame) -> DataFrame:
    """Texts without the lines in `gone`, how many lines they had and lost."""

    def run(batches):
        for batch in batches:
            texts, out, lines_, removed = text_bytes(batch.column("_text")), [], [], []
            for text, gone in zip(texts, batch.column("gone").to_pylist(), strict=True):
                n = text.count(b"\n") + 1 if text else 0
                left = 0
                if gone:
                    drop = np.zeros(n, bool)
                    for x in gone:
                        drop[x["start"]:x["end"]] = True
                    text = b"\n".join(x for x, d in zip(text.split(b"\n"), drop.tolist(),
                                                        strict=True) if not d)
                    left = int(drop.sum())
                out.append(text)
                lines_.append(n)
                removed.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(out, pa.binary()).cast(pa.string()),
                 pa.array(lines_, pa.int64()), pa.array(removed, pa.int64())],
                names=["_doc", "_cut", "_lines", "_removed"])

    kinds = T.StructType([base.schema["_doc"], T.StructField("_cut", T.StringType()),
                          T.StructField("_lines", T.LongType()),
                          T.StructField("_removed", T.LongType())])
    return base.mapInArrow(run, kinds)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with the text cut, and `_lines`, `_removed`: lines it had and lost.

    Every later occurrence of `window` lines or more in a row goes, not all of them blank, and of
    fewer, but two, where one is an anchor both times. Every line stays where it occurs first; where
    one line fills a run, its first lines stay. A null text has no lines and stays null; an empty
    text has none either. Ids decide which occurrence is first, null ids last; a document that repeats
    another wholly may lose all its text. Rows that are equal in id and text are one document: they
    are cut alike, and their lines count as repeats only if another text, or another place in
    theirs, holds them. Texts may be of any length: stretches are at most `window` lines long. Other
    columns pass unchanged whatever their names; ones named `_lines` or `_removed` give way to the
    counts.
    """
    if window < 2:
        raise ValueError("a window covers two lines or more")
    order = [c for c in docs.columns if c.lower() not in ("_lines", "_removed")]
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("_row"), F.col(id_col).alias("_id"),
                        text_of(text_col).alias("_text"), F.col(text_col).isNull().alias("_none"),
                        F.struct(*(F.col(f"`{c}`") for c in order if c != text_col)).alias("_doc")
                        if len(order) > 1 else F.struct(F.lit(0).alias("_")).alias("_doc"))
    gone = keep(repeated_lines(keyed.select("_id", "_row", "_text"), window).groupBy("_row").agg(
        F.collect_set(F.struct("start", "end")).alias("gone")), "removals")
    whole = keyed.select("_row", "_text", F.struct("_none", "_doc").alias("_doc"))
    out = _cut(whole.join(gone.hint("merge"), "_row", "left"))
    text = F.when(~F.col("_doc._none"), F.col("_cut")).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"_doc._doc.`{c}`") for c in order],
                      "_lines", "_removed")
