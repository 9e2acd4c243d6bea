"""License scan by an exact set-similarity join.

A template is a license's wording. A block is a line of a text or, as wordings are wrapped, any
stretch of `SPAN` times a template's length in words, line ends ignored. Blocks that hold at least
`threshold` of a template's distinct words are found without comparing all pairs: words are put in
one global order, rarest in the corpus first, a template is posted under the first
`size - needed + 1` of its words (a block that holds `needed` of them holds one of these), blocks of
fewer than `needed` distinct words are passed over, and a hit is given up as soon as the words
that may still follow it are too few. What is left is counted on the whole sets.

Templates are a parameter and few; their index travels with the tasks. Fixed phrases are found
beside them by their places in the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import groups, longs, text_bytes
from shelfmark.llm.work import text_of

THRESHOLD = 0.8
#: Words of a stretch for one of its template: room for all of it and as much in between.
SPAN = 2
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings by label; several wordings may share one.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
            "terms of the gnu general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international "
              "license"),
    ("reserved", "copyright all rights reserved"),
)

_BREAK = b"\x01"
_PLAIN = bytearray(b" " * 256)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _PLAIN[_c] = _c
for _c in range(0x41, 0x5B):
    _PLAIN[_c] = _c + 32
_PLAIN[0x0A] = 0x01
_PLAIN = bytes(_PLAIN)


def split_words(text: bytes) -> list[bytes]:
    """Words of a text, with `_BREAK` for each line end."""
    return text.translate(_PLAIN).replace(_BREAK, b" \x01 ").split()


def word_frequencies(docs: DataFrame, words: Sequence[str], text_col: str = "text"
                     ) -> dict[str, int]:
    """How often each of the given words occurs in all texts; one row per task and word moves."""
    known = {w.encode(): i for i, w in enumerate(words)}

    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            for lo, hi in groups(texts):
                found = map(known.get, split_words(b"\n".join(texts[lo:hi])))
                total += np.bincount([x for x in found if x is not None], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), longs(total)],
                                         names=["word", "n"])

    rows = (docs.select(text_of(text_col).alias("_text")).mapInArrow(run, "word bigint, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())  # as many as `words`
    return {w: 0 for w in words} | {words[r["word"]]: r["n"] for r in rows}


class Scanner:
    """Finds templates in blocks and phrases in texts."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str],
                 frequency: Mapping[str, int], threshold: float) -> None:
        names = sorted({w for _, t in templates for w in t.split()},
                       key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w.encode(): i for i, w in enumerate(names)}  # rarest first
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w.encode()] for w in t.split()}) for _, t in templates]
        self.needed = [max(1, ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.posts: dict[int, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.needed, strict=True)):
            for place, word in enumerate(s[:len(s) - need + 1]):
                self.posts.setdefault(word, []).append((t, place))
        self.least = min(self.needed, default=0)
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.heads: dict[bytes, list[int]] = {}
        for i, (words, _) in enumerate(self.phrases):
            self.heads.setdefault(words[0], []).append(i)
        self.rare = {w for w, i in self.rank.items() if i in self.posts}
        self.spans = [SPAN * len(t.split()) for _, t in templates]

    def stretch(self, t: int, at: list[tuple[int, int]]) -> int:
        """Most distinct words of template `t` in a stretch; `at` has places and ranks of words."""
        own, span = set(self.sets[t]), self.spans[t]
        held: dict[int, int] = {}
        some, lo, most = [x for x in at if x[1] in own], 0, 0
        for place, word in some:
            held[word] = held.get(word, 0) + 1
            while some[lo][0] <= place - span:
                left = some[lo][1]
                held[left] -= 1
                if not held[left]:
                    del held[left]
                lo += 1
            most = max(most, len(held))
        return most

    def wrapped(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that stretches of a text hold, and their highest containment."""
        at = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.rank]
        have = {r for _, r in at}
        found, best = set(), 0.0
        for t in {t for w in have for t, _ in self.posts.get(w, ())}:
            need, full = self.needed[t], self.sets[t]
            if len(have.intersection(full)) >= need:
                both = self.stretch(t, at)
                if both >= need:
                    found.add(self.labels[t])
                    best = max(best, both / len(full))
        return found, best

    def block(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that a block holds, and the highest containment of them."""
        have = sorted({self.rank[w] for w in words if w in self.rank})
        if len(have) < self.least:
            return set(), 0.0
        found, best, tried = set(), 0.0, set()
        for at, word in enumerate(have):
            for t, place in self.posts.get(word, ()):
                if t in tried:
                    continue
                tried.add(t)
                need, full = self.needed[t], self.sets[t]
                # Before this word neither side has one in common: it is the first they share.
                if min(len(have) - at, len(full) - place) < need:
                    continue
                both = len(set(have[at:]).intersection(full[place:]))
                if both >= need:
                    found.add(self.labels[t])
                    best = max(best, both / len(full))
        return found, best

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str], float]:
        """(words, places of phrases, base labels, template labels, score) of a text."""
        every = split_words(text)
        places, base, found, best = [], set(), set(), 0.0
        rare, lines = self.rare.intersection(every), []
        words = every
        if _BREAK in every:
            words = [w for w in every if w != _BREAK]
        known = self.heads.keys() & set(words) if self.heads else ()
        for head in known:
            at = -1
            for _ in range(words.count(head)):
                at = words.index(head, at + 1)
                for i in self.heads[head]:
                    phrase, label = self.phrases[i]
                    if tuple(words[at:at + len(phrase)]) == phrase:
                        places.append(at)
                        base.add(label)
        if rare:
            line: list[bytes] = []
            for w in every:
                if w == _BREAK:
                    lines.append(line)
                    line = []
                else:
                    line.append(w)
            for line in [*lines, line]:
                if not rare.isdisjoint(line):
                    labels, score = self.block(line)
                    found |= labels
                    best = max(best, score)
            if lines:  # a single line holds all stretches
                labels, score = self.wrapped(words)
                found |= labels
                best = max(best, score)
        return len(words), places, base, found, best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES,
                  phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is the highest containment of a template in a block of the document, 1 where a phrase
    stands. Null and empty texts have no words. Repeated rows are scanned each; other columns are
    not read.
    """
    words = sorted({w for _, t in templates for w in t.split()})
    scanner = Scanner(templates, phrases, word_frequencies(docs, words, text_col), threshold)
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            rows = [scanner.scan(x or b"") for x in batch.column("_text").to_pylist()]
            text = [[",".join(sorted(x)) for x in y] for y in (
                [r[2] for r in rows], [r[2] | r[3] for r in rows])]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id"), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                pa.array(text[0], pa.string()), pa.array(text[1], pa.string()),
                pa.array([1.0 if r[1] else r[4] for r in rows], pa.float64())],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels",
                       "labels", "score"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, "
                           "first_word bigint, last_word bigint, base_labels string, "
                           "labels string, score double")
