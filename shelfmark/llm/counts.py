"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): the digest of a tokenizer file and
of a text whose white space is made plain, which this kind of tokenizer drops. Texts are made
distinct by digest before they move, those the cache has are left out, the rest is encoded once and
appended, and every document reads its count from the cache.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.words import groups, longs
from shelfmark.llm.work import FILTER_BITS, filter_bits, keep, passes

CACHE = "tokenizer string, digest string, n_tokens bigint"
#: Entries after which a task forgets its words.
CACHE_WORDS = 400_000
#: Missing texts are looked for with a filter if less than one in so many is; its most bits.
FEW, MOST_BITS = 4, 1 << 29
_RUNS = r"[\t\n\x0B\f\r][\t\n\x0B\f\r ]*| [\t\n\x0B\f\r ]+"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of a text with each run of ASCII white space as one blank and none at its ends. Case
    and all other characters stay, as special strings depend on them."""
    return F.sha2(F.trim(F.regexp_replace(text, _RUNS, " ")), 256)


class WordCounts:
    """Tokens of whole texts, as the library counts them, by a sum over their words.

    A tokenizer that drops white space never has a token reach over it, and neither do its special
    strings: a text's count is the sum over what ASCII white space parts, and each word is encoded
    once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, int] = {}
        self.by_word = self._drops_blanks()

    def _count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _drops_blanks(self) -> bool:
        """Whether blanks add nothing, tried on words around each kind of white space."""
        words = ["a", "b'll", "c3", "<|endoftext|>", ".", "é"]
        one = sum(self._count(words))
        return all(n == one for n in self._count(
            [s.join(words) for s in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n ")]))

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._count(texts)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        parts = [x.encode().split() for x in texts]
        new = list(set().union(*parts).difference(self.known))
        self.known.update(zip(new, self._count([x.decode() for x in new]), strict=True))
        known = self.known.__getitem__
        return [sum(map(known, x)) for x in parts]


@lru_cache(maxsize=2)
def _word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at `path`; an empty one if there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def _texts_of(texts: DataFrame, misses: DataFrame, rows: int) -> DataFrame:
    """(digest, text) of the digests in `misses`, a written table, each once.

    Where they are few among the `rows` texts, a filter keeps the others from moving. Its size goes
    by their number, up to 64 MB; the join after it is exact.
    """
    n = misses.count()
    if n < rows // FEW:
        size = min(max(1 << (8 * n - 1).bit_length(), FILTER_BITS), MOST_BITS)
        bits = filter_bits(misses.select(F.xxhash64("digest").alias("h")), "h", size)

        @F.arrow_udf("boolean")
        def missing(h: pa.Array) -> pa.Array:
            return pa.array(passes(bits.value, h.to_numpy(zero_copy_only=False)))

        texts = texts.filter(missing(F.xxhash64("digest")))
    return texts.groupBy("digest").agg(F.first("text").alias("text")).join(
        misses, "digest", "left_semi")


def fill_cache(texts: DataFrame, tokenizer: str, cache: str, digests: DataFrame | None = None
               ) -> None:
    """Encode the texts (digest, text) that the cache lacks and append them. `digests` are the
    texts' digests as a written table, if there is one. Texts are not read if none is missing."""
    spark, version = texts.sparkSession, tokenizer_digest(tokenizer)
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    if digests is None:
        digests = keep(texts.select("digest"), "digests")
    misses = keep(digests.distinct().join(stored, "digest", "left_anti"), "misses")
    if misses.isEmpty():
        return

    def run(batches):
        counter = _word_counts(tokenizer)
        for batch in batches:
            some = batch.column("text").to_pylist()
            n = [x for lo, hi in groups(some) for x in counter.count(some[lo:hi])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), longs(np.array(n, np.int64))], names=["digest",
                                                                               "n_tokens"])

    found = _texts_of(texts, misses, digests.count()).mapInArrow(
        run, "digest string, n_tokens bigint")
    found.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode(
        "append").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens. A null text is empty; repeated rows and equal
    texts count alike, so ties need no order; texts of any length are counted whole; other columns
    are not read. The cache may have been filled by any earlier run, with this or other
    tokenizers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("text"),
                       content_digest(text).alias("digest"))
    narrow = keep(base.select("_id", F.octet_length("text").cast("bigint").alias("n_bytes"),
                              "digest"), "digests")
    fill_cache(base.select("digest", "text"), tokenizer, cache, narrow.select("digest"))
    stored = read_cache(docs.sparkSession, cache).filter(
        F.col("tokenizer") == tokenizer_digest(tokenizer))
    # Two runs that append at one time may both have stored a text.
    stored = keep(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return narrow.join(stored, "digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
