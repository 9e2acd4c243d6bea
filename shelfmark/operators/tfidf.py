"""TF-IDF tables (J01, J02): vocabulary and unit-length weights in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.columns import tokens, uni_and_bigrams
from shelfmark.operators.common import cut, dense_index

# Vocabularies up to this size come to the driver; without a max_features bound the join is shuffled.
BROADCAST_TERMS = 100_000
COUNTED = ["term", "df", "cf"]


@dataclass(frozen=True)
class TfidfModel:
    """Fitted tables: vocab(term, term_id, df, cf, idf) and weights(id, term_id, w)."""

    vocab: DataFrame
    weights: DataFrame
    stop_words: tuple[str, ...]
    bigrams: bool
    small_vocab: bool


def english_stop_words() -> list[str]:
    """The English list that ships with Spark ML (needs a running session)."""
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def few_files(docs: DataFrame) -> bool:
    """Whether there are fewer files than cores (or none, as under a checkpoint), so that most cores
    would have no text to split."""
    return len(docs.inputFiles()) < docs.sparkSession.sparkContext.defaultParallelism


def word_lists(docs: DataFrame, key: str, text: str, stop_words: Iterable[str],
               placed: bool = False) -> DataFrame:
    """(key, words): the words of each text in order. Texts stay in the tasks that read them, or are
    `placed` by key."""
    docs = docs.select(key, text)
    docs = docs.repartition(key) if placed else docs
    return docs.select(key, tokens(text, stop_words).alias("words"))


def gram_lists(docs: DataFrame, key: str, text: str, stop_words: Iterable[str],
               bigrams: bool = True, placed: bool = False) -> DataFrame:
    """(key, terms): the terms of each text in order, repeats included."""
    return grams_of(word_lists(docs, key, text, stop_words, placed), key, bigrams)


def grams_of(words: DataFrame, key: str, bigrams: bool) -> DataFrame:
    grams = uni_and_bigrams(F.col("words")) if bigrams else F.col("words")
    return words.select(key, grams.alias("terms"))


def _counts(term: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each of `size` terms is, and at how many places."""
    once = np.sort(doc * np.int64(size) + term)
    once = once[np.diff(once, prepend=-1) > 0]
    return np.bincount(once % size, minlength=size), np.bincount(term, minlength=size)


def _places(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch's lists; of every place the word's number and its document."""
    lists = batch.column(0)
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return (coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            np.repeat(np.arange(len(lists)), sizes))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, word, doc = _places(batch)
        if len(word):
            yield pa.RecordBatch.from_arrays(
                [names, *map(pa.array, _counts(word, doc, len(names)))], names=COUNTED)


def _bigram_counts(batches: Iterator[pa.RecordBatch], among: list[str] | None
                   ) -> Iterator[pa.RecordBatch]:
    """Those of bigrams of words `among` the given ones, or of all."""
    known = None if among is None else pa.array(among, pa.string())
    for batch in batches:
        names, word, doc = _places(batch)
        if len(word) < 2:
            continue
        pair = doc[1:] == doc[:-1]
        if known is not None:
            often = pc.is_in(names.cast(pa.string()), value_set=known).to_numpy(
                zero_copy_only=False)[word]
            pair &= often[1:] & often[:-1]
        pairs, at = np.unique(word[:-1][pair] * len(names) + word[1:][pair], return_inverse=True)
        if len(pairs):
            terms = pc.binary_join_element_wise(*[names.take(pa.array(x)) for x in divmod(
                pairs, len(names))], " ")
            yield pa.RecordBatch.from_arrays(
                [terms, *map(pa.array, _counts(at, doc[1:][pair], len(pairs)))], names=COUNTED)


def _term_rows(words: DataFrame, count: Callable) -> DataFrame:
    """(term, df, cf): `count` adds up the lists of a batch in arrays, so that what goes on is a row
    per term and batch."""
    return words.select("words").mapInArrow(count, "term string, df bigint, cf bigint")


def _frequencies(rows: DataFrame) -> DataFrame:
    """(term, df, cf): documents and places of each term, combined before their shuffle: documents
    are never a key, and common terms no hot spot."""
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _bigram_frequencies(words: DataFrame, stats: DataFrame, kept: DataFrame, min_df: int,
                        max_features: int | None) -> DataFrame:
    """Frequencies of the bigrams that can be in the vocabulary, from those of all words (`stats`)
    and of the words within the bounds (`kept`).

    A bigram is in no more documents and no more places than either of its words. Both so have the
    least document frequency, and at least the count of the last word that the vocabulary would have
    without bigrams. The many rare words, most of all bigrams, are out before anything is shuffled.
    """
    often = stats.filter(F.col("df") >= min_df)
    if max_features:
        last = kept.select("cf").orderBy(F.desc("cf")).limit(max_features).agg(F.when(
            F.count(F.lit(1)) == max_features, F.min("cf")).otherwise(F.lit(0))).first()[0]
        often = often.filter(F.col("cf") >= last)
    often = cut(often.select(F.col("term").alias("word")))
    if often.count() <= BROADCAST_TERMS:
        among = [r["word"] for r in often.collect()]
        return _frequencies(_term_rows(words, lambda batches: _bigram_counts(batches, among)))
    rows = _term_rows(words, lambda batches: _bigram_counts(batches, None))
    for at in (1, -1):
        rows = rows.withColumn("word", F.substring_index("term", " ", at)).join(
            often, "word", "left_semi").drop("word")
    return _frequencies(rows)


def select_vocabulary(words: DataFrame, n_docs: Column, min_df: int, max_df: float,
                      max_features: int | None, bigrams: bool = True) -> DataFrame:
    """Words and bigrams of neighbouring words of the lists `words` that are within the
    document-frequency bounds, the most frequent `max_features` of them."""
    def bounded(stats: DataFrame) -> DataFrame:
        return stats.filter((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(max_df)))

    stats = _frequencies(_term_rows(words, _word_counts))
    if bigrams:
        stats = cut(stats.filter(F.col("df") >= min_df))     # the many rare words are out
        kept = bounded(stats)
        kept = kept.unionByName(bounded(_bigram_frequencies(words, stats, kept, min_df,
                                                            max_features)))
    else:
        kept = bounded(stats)
    if max_features:
        kept = kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    n = n_docs.cast("double")
    return kept.withColumn("idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0)


def _vectors(lists: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, terms, weights): the unit weights of each list, by a vocabulary that comes to the driver."""
    known = vocab.select("term", "idf").orderBy("term_id").collect()
    if not known:
        return lists.select(key, F.array().cast("array<int>").alias("terms"),
                            F.array().cast("array<double>").alias("weights")).limit(0)
    count = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol="terms",
                                                 outputCol="_n")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in known]),
                               inputCol="_n", outputCol="_x")
    unit = Normalizer(p=2.0, inputCol="_x", outputCol="_w")
    rows = unit.transform(weigh.transform(count.transform(lists)))
    vector = rows.select(key, F.unwrap_udt("_w").alias("v"))
    return vector.select(key, F.col("v.indices").alias("terms"), F.col("v.values").alias("weights"))


def unit_weights(lists: DataFrame, vocab: DataFrame, key: str, small: bool) -> DataFrame:
    """(key, term_id, w): tf·idf scaled to unit length per document; keys are unique.

    With a small vocabulary, which comes to the driver, a document's terms are counted, weighted and
    scaled inside its row by ML transformers, and nothing is shuffled. Otherwise terms meet the
    vocabulary by a shuffle.
    """
    if small:
        rows = _vectors(lists, vocab, key)
        each = F.explode(F.arrays_zip(F.col("terms").alias("term_id"),
                                      F.col("weights").alias("w")))
        return rows.select(key, each.alias("e")).select(key, "e.term_id", "e.w")
    v = vocab.select("term", "term_id", "idf")
    grams = lists.select(key, F.explode("terms").alias("term"))
    tf = grams.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(v, "term").withColumn("_x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    return raw.select(key, "term_id", (F.col("_x") / norm).alias("w"))


def fit_tfidf(docs: DataFrame, key: str = "course_id", text: str = "combined_text",
              stop_words: Iterable[str] | None = None, min_df: int = K.TFIDF_MIN_DF,
              max_df: float = K.TFIDF_MAX_DF, max_features: int | None = K.TFIDF_MAX_FEATURES,
              bigrams: bool = True) -> TfidfModel:
    """Smoothed idf ln((1+n)/(1+df))+1, unit rows, bigrams built after stop-word removal."""
    stops = tuple(english_stop_words() if stop_words is None else stop_words)
    n_docs = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    words = word_lists(docs, key, text, stops, few_files(docs))
    chosen = select_vocabulary(words, n_docs, min_df, max_df, max_features, bigrams)
    small = bool(max_features) and max_features <= BROADCAST_TERMS
    if small:
        # The vocabulary has at most max_features rows: one small ordered window numbers it.
        order = Window.orderBy(F.desc("cf"), F.asc("term"))
        vocab = chosen.withColumn("term_id", (F.row_number().over(order) - 1).cast("int"))
    else:
        vocab = dense_index(chosen, [F.desc("cf"), F.asc("term")], "term_id").withColumn(
            "term_id", F.col("term_id").cast("int"))
    vocab = vocab.persist()
    weights = unit_weights(grams_of(words, key, bigrams), vocab, key, small)
    return TfidfModel(vocab, weights, stops, bigrams, small)


def transform_texts(model: TfidfModel, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Unit weights of other texts; words outside the vocabulary are ignored, so a text of
    unknown words has no rows and every score against it is 0."""
    lists = gram_lists(texts, key, text, model.stop_words, model.bigrams, few_files(texts))
    return unit_weights(lists, model.vocab, key, model.small_vocab)


def text_vectors(model: TfidfModel, texts: DataFrame, key: str, text: str) -> DataFrame:
    """`transform_texts` as a packed row (key, terms, weights) per text with a known word; keys are
    unique."""
    if not model.small_vocab:
        rows = transform_texts(model, texts, key, text).groupBy(key).agg(
            F.collect_list(F.struct("term_id", "w")).alias("_v"))
        return rows.select(key, F.col("_v.term_id").alias("terms"), F.col("_v.w").alias("weights"))
    lists = gram_lists(texts, key, text, model.stop_words, model.bigrams, few_files(texts))
    return _vectors(lists, model.vocab, key).filter(F.size("terms") > 0)
