"""Bigrams of rare words are left out before they are counted, and the vocabulary stays the same."""

import random
from collections import Counter

import pytest

from shelfmark.operators import tfidf


@pytest.mark.parametrize("most", [5, 30, 400, None])
@pytest.mark.parametrize("min_df", [1, 2])
def test_vocabulary_equals_plain(spark, most, min_df):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(30 * rng.random() ** 2):02d}" for _ in range(rng.randint(0, 12)))
             + (" all all all" if i % 9 else "") + f" rare{i}" for i in range(60)]
    texts += [texts[0], "", "all all"]
    df = spark.createDataFrame(list(enumerate(texts)), "course_id bigint, combined_text string")
    got = tfidf.fit_tfidf(df, stop_words=[], min_df=min_df, max_df=0.8, max_features=most)
    lists = []
    for t in texts:
        w = t.split()
        lists.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df_of = Counter(x for row in lists for x in set(row))
    cf_of = Counter(x for row in lists for x in row)
    kept = sorted((t for t in cf_of if min_df <= df_of[t] <= 0.8 * len(texts)),
                  key=lambda t: (-cf_of[t], t))[:most]
    rows = sorted(got.vocab.collect(), key=lambda r: r["term_id"])
    assert [(r["term"], r["df"], r["cf"]) for r in rows] == [(t, df_of[t], cf_of[t]) for t in kept]


def test_rare_bigrams_are_not_counted(spark, monkeypatch):
    """Texts of words that occur once add no bigram to the aggregation."""
    texts = [f"a{i} b{i} c{i}" for i in range(50)] + ["xx yy"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "course_id bigint, combined_text string")
    counted = []
    whole = tfidf._frequencies

    def noted(rows):
        counted.append(rows.select("term").distinct().count())
        return whole(rows)

    monkeypatch.setattr(tfidf, "_frequencies", noted)
    got = tfidf.fit_tfidf(df, stop_words=[], max_df=1.0)
    assert {r["term"] for r in got.vocab.collect()} == {"xx", "yy", "xx yy"}
    assert counted == [152, 1]


@pytest.mark.parametrize("few", [0, 100_000])
def test_places_are_not_rows(spark, monkeypatch, few):
    """What is aggregated by term is a row per term and batch, not per place; the same where the
    frequent words are too many for the driver."""
    texts = ["aa bb " * 500, "aa bb aa", "zz yy", "", None, "bb aa"]
    df = spark.createDataFrame(list(enumerate(texts)),
                               "course_id bigint, combined_text string").coalesce(1)
    rows_of = []
    whole = tfidf._frequencies

    def noted(rows):
        rows_of.append(rows.count())
        return whole(rows)

    monkeypatch.setattr(tfidf, "_frequencies", noted)
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", few)
    got = {r["term"]: (r["df"], r["cf"]) for r in tfidf.fit_tfidf(
        df, stop_words=[], max_df=1.0).vocab.collect()}
    assert got == {"aa": (3, 503), "bb": (3, 502), "aa bb": (2, 501), "bb aa": (3, 501)}
    assert max(rows_of) <= 4 * df.count()


def test_rare_words_are_not_written(spark, monkeypatch):
    """What is written of the counted words can be in the vocabulary."""
    texts = [f"a{i} b{i} xx yy" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "course_id bigint, combined_text string")
    written, cut = [], tfidf.cut

    def noted(rows):
        written.append(cut(rows))
        return written[-1]

    monkeypatch.setattr(tfidf, "cut", noted)
    got = tfidf.fit_tfidf(df, stop_words=[], min_df=2, max_df=1.0)
    assert got.vocab.count() == 3      # xx, yy, xx yy
    assert [rows.count() for rows in written] == [2, 2]
