"""Best-fit packing of documents into token sequences.

Documents become token ids where they are read; what moves on is one small row per piece. Pieces
are dealt evenly over tasks and each task packs its share in the order of a hash: bounded-space
online best-fit. A task has a fixed number of open bins; a bitset has a bit for each amount of
free space that some open bin has, so the tightest bin that takes a piece is one shift and one
lowest set bit away. When a new bin is needed and all are open, the fullest closes.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import groups, longs
from shelfmark.llm.work import keep

LENGTH, END_ID = 1024, 2
OPEN_BINS = 4096
PIECES_PER_TASK = 200_000
#: Entries after which a task forgets its words.
CACHE_WORDS = 400_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one,
    else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _same_merges(path: str):
    """The file's byte-level BPE as an encoder that merges in the order of ids, if that is what
    the file says; else None."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre, vocab = j.get("pre_tokenizer") or {}, j["model"].get("vocab", {})
    merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"].get("merges", [])]
    plain = (j.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex") and not pre.get("add_prefix_space")
             and not j["model"].get("ignore_merges")
             and [vocab.get("".join(m)) for m in merges] == list(range(256, 256 + len(merges))))
    if not plain:
        return None
    import public_tokenizers
    import tiktoken
    byte = _byte_of_char()
    added = {t["content"] for t in j.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


class _Words(dict):
    """Index of the ids of a word, with or without a blank before it; -1 if the text has to be
    taken as a whole."""

    def __init__(self, owner: TokenIds, before: str) -> None:
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, word: str) -> int:
        self[word] = at = self.owner.add(self.before, word)
        return at


class TokenIds:
    """Token ids of texts, as the library gives them.

    A pre-token never reaches over a single blank from its left, so a text's ids are those of its
    words, each with the blank before it, and a word is encoded once. Texts for which this is not
    plain (blanks beside other white space, special strings, letters beyond Latin) are encoded by
    the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.fast = _same_merges(path)
        self.forget()

    def forget(self) -> None:
        self.first, self.next = _Words(self, ""), _Words(self, " ")
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def add(self, before: str, word: str) -> int:
        odd = before and (not word or word[0].isspace() or word[-1].isspace())
        odd = odd or (not before and word and word[-1].isspace())
        if odd or "<|" in word or (word and not word.isascii() and max(word) > "ɏ"):
            return -1
        ids = self.fast.encode_ordinary(before + word)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return len(self.start) - 1

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [self.whole(x) for x in texts]
        if len(self.start) > CACHE_WORDS:
            self.forget()
        at = []
        for text in texts:
            w = text.split(" ")
            some = np.empty(len(w), np.int64)
            some[0] = self.first[w[0]]
            some[1:] = np.fromiter(map(self.next.__getitem__, w[1:]), np.int64, len(w) - 1)
            at.append(some)
        start, size = np.array(self.start), np.array(self.size)
        flat = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        out = []
        for text, some in zip(texts, at, strict=True):
            if (some < 0).any():
                out.append(self.whole(text))
                continue
            n = size[some]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(start[some] - ends + n, n) + np.arange(ends[-1])])
        return out


@lru_cache(maxsize=2)
def _token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first piece may be shorter."""
    if n <= length:
        return [(0, n)]
    head = n % length or length
    return [(0, head), *((at, length) for at in range(head, n, length))]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A null text is empty: its end id
    alone is a piece."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit(""))
                       .alias("_text"))

    def run(batches):
        coder = _token_ids(tokenizer)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in groups(texts):
                rows, own = [], []
                for i, ids in enumerate(coder.encode(texts[lo:hi]), lo):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (a, n) in enumerate(cut(len(ids), length)):
                        own.append(i)
                        rows.append((k, a, n, zlib.crc32(ids[a:a + n].tobytes())))
                cols = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(own)), pa.array(cols[:, 0], pa.int32()),
                     *(longs(cols[:, j]) for j in (1, 2, 3))],
                    names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = base.schema["_id"].dataType.simpleString()
    return base.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, "
                           "ids_crc32 bigint")


class Packer:
    """Bounded-space best fit: `place(n)` gives (bin, offset)."""

    def __init__(self, length: int, bins: int) -> None:
        self.length, self.bins = length, bins
        self.bits = self.open = self.made = 0
        self.free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, space: int) -> int:
        some = self.free[space]
        out = some.pop()
        if not some:
            self.bits &= ~(1 << space)
        self.open -= 1
        return out

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            at = self._take(space)
        else:
            if self.open == self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, at = self.length, self.made
            self.made += 1
        left = space - n
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.length - space


def pack(rows: DataFrame, length: int = LENGTH, bins: int = OPEN_BINS,
         per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with a `length` of 1 to `length` tokens.

    Sequences are whole within a task; their numbers have the task's in the upper bits. Each task
    gets about `per_task` rows, so that its last, half-empty bins weigh little.
    """
    rows = keep(rows, "pieces")
    tasks = max(1, -(-rows.count() // per_task))
    order = F.xxhash64(*rows.columns)
    dealt = rows.repartition(tasks).sortWithinPartitions(order, *rows.columns)

    def run(batches):
        packer, task = Packer(length, bins), TaskContext.get().partitionId()
        for batch in batches:
            at = [packer.place(n) for n in batch.column("length").to_pylist()]
            seq = [(task << 40) | a for a, _ in at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(seq, pa.int64()), pa.array([b for _, b in at],
                                                                    pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")
