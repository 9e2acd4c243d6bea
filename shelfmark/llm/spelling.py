"""Spelling variants: words that are one edit apart, and the form each word goes back to.

`word_counts` counts words with chance misspellings put in by rule. `neighbours` builds a trie of all
words as a table of edges and sends states (word, position, node, edits) down it, one depth per
join. A word without edits stands on the node of its own first characters and branches into one edit;
a state with an edit goes on only where the next character is an edge. An edge says which word
lengths end below it, so a state that can end nowhere goes no further. The trie is built forward and
backward: edits in the second half of a word are found in one, those in the first half in the other,
so no state branches where all words still stand together.

Each level reads the states of the one before from a written table. Words of more than `LEVELS`
characters have no level; they meet by hashes of the word without one character, at most one row per
character, and are compared as texts. Both ways are exact, and no partner is dropped.

Null or empty texts have no words, a null id stands as an empty text in the rule, equal rows count
each, very long texts are read a megabyte at a time, an empty table gives no rows, and other columns
are not read. Ties between forms go to the smaller word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import SLAB, mix
from shelfmark.llm.work import keep

LEAST_CHARS, LEAST_COUNT, EVERY = 5, 3, 97
#: A form has at least this many times the count of its word.
TIMES = 2
#: Characters up to which words walk the trie; lengths are bits of a long.
LEVELS = 40
#: Bytes of words after which a task hands its counts on.
HELD = 32 << 20
_LONG_BASE = 0x9E3779B97F4A7C15


def _slices(text: bytes) -> Iterator[str]:
    """The text in parts of about a megabyte, cut where no word can be."""
    at, edge = 0, re.compile(rb"[^a-z\x80-\xff]")
    while at < len(text):
        found = edge.search(text, at + SLAB)
        end = found.start() if found else len(text)
        yield text[at:end].decode()
        at = end


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words long and frequent enough, A-Z lower-cased. Of a run whose checksum with
    its document's id is a multiple of `EVERY`, one character is left out."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(
                list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{doc or ''}:".encode())
                for part in _slices((text.as_py() or b"").lower()):
                    runs = Counter(run_of.findall(part))
                    for word, n in runs.items():
                        h = zlib.crc32(word.encode(), seed)
                        if h % EVERY == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < LEAST_CHARS:
                                continue
                        total[word] += n
                    held += len(part)
                    if held > HELD:
                        yield batch_of()
                        total.clear()
                        held = 0
            if len(total) > 200_000:
                yield batch_of()
                total.clear()
        yield batch_of()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return (rows.mapInArrow(run, "word string, n bigint").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def _node(back: Column, prefix: Column) -> Column:
    return F.xxhash64(back, prefix)


def _bit(length: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), length.cast("int"))


def _both_ways(words: DataFrame) -> DataFrame:
    """Each word as read forward and backward, and the position from which edits are looked for."""
    size = F.char_length("word").alias("size")
    ways = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    out = words.select("word", size, ways)
    return out.select(
        "back", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("way"),
        "size", F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(
            F.floor(F.col("size") / 2)).cast("int").alias("half"))


def trie(words: DataFrame) -> DataFrame:
    """The edges of the trie: (depth, node, ch, child, ends), where `ends` holds the lengths of the
    words below as bits. Only depths at which an edit can have been made are built."""
    steps = _both_ways(words).select("back", "way", "size", F.explode(F.sequence(
        "half", F.col("size") - 1)).alias("depth"))
    edges = steps.select(
        "depth", _node(F.col("back"), F.substring("way", F.lit(1), F.col("depth"))).alias("node"),
        F.substring("way", F.col("depth") + 1, F.lit(1)).alias("ch"),
        _node(F.col("back"), F.substring("way", F.lit(1), F.col("depth") + 1)).alias("child"),
        F.col("size"))
    return edges.groupBy("depth", "node", "ch", "child").agg(
        F.bit_or(_bit(F.col("size"))).alias("ends"))


def _step(fresh: DataFrame, walking: DataFrame | None, edges: DataFrame, depth: int) -> DataFrame:
    """The edited states of the next depth, `done` where the word is at its end.

    `fresh` are the words that stand at this depth without an edit. A replaced character branches
    into the larger children; a character left out goes on with the one after it, as do the states
    that were edited before. Pairs are so found from the smaller or the longer word.
    """
    here, after = (F.substring("way", F.lit(depth + i), F.lit(1)) for i in (1, 2))
    left = F.substring("way", F.lit(1), F.lit(depth))

    def rest(start: int) -> Column:
        return F.substring("way", F.lit(start), F.col("size"))

    def ends(length: Column) -> Column:
        return F.col("ends").bitwiseAND(_bit(length)) != 0

    replaced = fresh.join(edges, "node").filter((F.col("ch") > here) & ends(F.col("size"))).select(
        "back", "way", "size", F.lit(depth + 1).alias("at"), F.col("child").alias("node"),
        F.concat(left, "ch", rest(depth + 2)).alias("target"))
    # Of equal characters in a row, leaving out the last stands for all.
    going = fresh.filter((F.col("size") > depth + 1) & (here != after)).select(
        "back", "way", "size", F.lit(depth + 1).alias("at"), "node",
        F.concat(left, rest(depth + 2)).alias("target"))
    if walking is not None:
        going = going.unionByName(walking)
    going = going.withColumn("ch", F.substring("way", F.col("at") + 1, F.lit(1)))
    moved = going.join(edges, ["node", "ch"]).filter(ends(F.char_length("target"))).select(
        "back", "way", "size", (F.col("at") + 1).alias("at"), F.col("child").alias("node"),
        "target")
    return replaced.unionByName(moved).withColumn("done", F.col("at") == F.col("size"))


def _trie_pairs(words: DataFrame) -> DataFrame | None:
    """Pairs (word, near) of which `near` is larger and as long, or one character shorter; none if
    there are no words. Each stands for both its orders, and `near` may still be no word."""
    span = words.agg(F.min(F.char_length("word")).alias("lo"),
                     F.max(F.char_length("word")).alias("hi")).first()
    if span is None or span["lo"] is None:
        return None
    starts = keep(_both_ways(words), "ways")
    edges = keep(trie(words).repartitionByRange("depth", "node").sortWithinPartitions("depth"),
                 "trie")
    # Left out at the end, a character leads nowhere: its state is done where it stands.
    found = starts.select("back", "way", F.substring("way", F.lit(1), F.col("size") - 1)
                          .alias("target"))
    walking = None
    for depth in range(span["lo"] // 2, span["hi"]):
        fresh = starts.filter((F.col("half") <= depth) & (F.col("size") > depth)).select(
            "back", "way", "size", _node(F.col("back"), F.substring("way", 1, depth))
            .alias("node"))
        level = keep(_step(fresh, walking, edges.filter(F.col("depth") == depth).drop("depth"),
                           depth), f"level-{depth}")
        walking = level.filter("not done").drop("done")
        found = found.unionByName(level.filter("done").select("back", "way", "target"))
    return found.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(n)
                          for c, n in (("way", "word"), ("target", "near"))])


def _gap_keys(words: DataFrame) -> DataFrame:
    """Per word (_ka, _kb, size, at, gap): the hash of the word without character `at`; with -1 the
    hash of the whole word. One row per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, back = np.uint64(_LONG_BASE), np.uint64(pow(_LONG_BASE, -1, 1 << 64))
        for batch in batches:
            for ka, kb, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
                n = len(code)
                up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base))])
                run_of = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code + base)
                                                                         * up[:n])])
                gaps = run_of[:n] + (run_of[n] - run_of[1:]) * back
                all_of = mix(np.concatenate([run_of[n:], gaps])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, ka)), pa.array(np.full(n + 1, kb)),
                     pa.array(np.full(n + 1, n, np.int32)),
                     pa.array(np.arange(-1, n, dtype=np.int32)), pa.array(all_of)],
                    names=["_ka", "_kb", "size", "at", "gap"])

    return words.select("_ka", "_kb", "word").mapInArrow(
        run, "_ka bigint, _kb bigint, size int, at int, gap bigint")


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs as `_trie_pairs` gives them, of words of which one has more than `LEVELS` characters."""
    some = keep(words.filter(F.char_length("word") >= LEVELS).select(
        "word", F.xxhash64(F.lit(17), "word").alias("_ka"), F.xxhash64(F.lit(91), "word").alias(
            "_kb")), "long-words")
    keys = keep(_gap_keys(some), "gaps")
    a, b = ("_ka", "_kb", "size", "at", "gap"), ("_kc", "_kd", "longer", "cut", "same")
    other = keys.select(*[F.col(x).alias(y) for x, y in zip(a, b, strict=True)])
    replaced = keys.filter("at >= 0").join(other, (F.col("gap") == F.col("same")) & (
        F.col("at") == F.col("cut")) & (F.col("size") == F.col("longer")) & (
        (F.col("_ka") != F.col("_kc")) | (F.col("_kb") != F.col("_kd"))))
    put_in = keys.filter("at = -1").join(other.filter("cut >= 0"), (
        F.col("gap") == F.col("same")) & (F.col("size") + 1 == F.col("longer")))
    met = replaced.filter(F.col("size") > LEVELS).unionByName(put_in).select(
        "_ka", "_kb", "_kc", "_kd", "at", "cut")
    met = met.join(some, ["_ka", "_kb"]).join(
        some.select(F.col("_ka").alias("_kc"), F.col("_kb").alias("_kd"),
                    F.col("word").alias("near")), ["_kc", "_kd"])

    def without(word: str) -> Column:
        return F.concat(F.substring(word, F.lit(1), F.col("cut")), F.substring(
            word, F.col("cut") + 2, F.char_length(word)))

    return met.filter(F.when(F.col("at") >= 0, without("word") == without("near")).otherwise(
        F.col("word") == without("near"))).select("word", "near")


def neighbours(words: DataFrame) -> DataFrame:
    """All (word, near) that are one inserted, deleted or replaced character apart, both ways round,
    once each. `words` has each `word` once."""
    found = _long_pairs(words)
    walked = _trie_pairs(words.filter(F.char_length("word") <= LEVELS))
    if walked is not None:
        # Node ids are hashes: what the trie gives must be a word.
        found = found.unionByName(walked.join(words.select(F.col("word").alias("near")), "near",
                                              "left_semi").select("word", "near"))
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"),
                                                      F.col("word").alias("near")))
    return found.select(F.explode(both).alias("p")).select("p.*").distinct()


def spelling_forms(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words from their counts (word, n): the form is
    the neighbour of largest count, ties to the smaller word, if it has at least `TIMES` the word's
    count; the root is where the forms of forms end."""
    words = keep(words, "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"),
                                               F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    better = -F.col("best.less") >= TIMES * F.col("n")
    out = keep(out.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(better, F.col("best.near")).alias("form"),
        F.when(better, -F.col("best.less")).alias("form_n")), "forms")
    # Counts at least double with every form, so chains are short, and each round doubles the reach.
    most = out.agg(F.max("n")).first()[0] or 0
    links, reach = out.filter("form is not null").select("word", F.col("form").alias("root")), 1
    longest = max(1, (most // LEAST_COUNT).bit_length())
    while reach < longest:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = keep(links.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "roots")
        reach *= 2
    return out.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
