"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions.sqlfunctions import register_functions

CASES = [
    (C.clean_text, "A &amp; <b>B</b>", "A B"),
    (C.clean_text, None, ""),
    (C.clean_text, "café  中文 x", "café   x"),
    (C.normal_category, "html basics", "Machine Learning"),
    (C.normal_category, None, "Other"),
    (C.normal_category, "cooking", "Cooking"),
    (C.normal_category, "it's web-dev", "It'S Web-Dev"),
    (C.normal_category, "  Training", "Artificial Intelligence"),
    (C.normal_level, "Débutant", "Beginner"),
    (C.normal_level, "Expert", "Advanced"),
    (C.normal_level, "?", "All Levels"),
    (C.normal_level, None, "All Levels"),
    (C.clean_rating, "4,7", 4.7),
    (C.clean_rating, "9", 5.0),
    (C.clean_rating, "-1", 0.0),
    (C.clean_rating, "x", 0.0),
    (C.clean_rating, None, 0.0),
    (C.clean_reviews, "22,772", 22772),
    (C.clean_reviews, "1.2k", 1000),
    (C.clean_reviews, "3m", 3000000),
    (C.clean_reviews, "none", 0),
    (C.clean_reviews, None, 0),
    (C.clean_price_label, "gratuit", "Free"),
    (C.clean_price_label, "0", "Free"),
    (C.clean_price_label, "$13.99", "$13.99"),
    (C.clean_price_label, "abc", "Paid"),
    (C.clean_price_label, None, "Subscription"),
    (C.clean_price_label, "Abonnement", "Subscription"),
    (C.encode_price, "Free", 0.0),
    (C.encode_price, "Subscription", 1.0),
    (C.encode_price, "12,5", 12.5),
    (C.encode_price, "$1,299.99", 2.0),
    (C.encode_price, None, 0.0),
    (C.encode_price, "Paid", 2.0),
    (C.price_token, "now $10.99!", "$10.99"),
    (C.price_token, "Gratis", "Gratis"),
    (C.price_token, "", None),
    (C.price_token, None, None),
    (C.category_from_title, "Intro to Big Data", "Data Science"),
    (C.category_from_title, "How to build", "Design"),
    (C.category_from_title, "HTML ml basics", "Machine Learning"),
    (C.category_from_title, None, "General"),
    (C.category_from_title, "Zoo", "General"),
    (C.level_from_metadata, "For INTERMEDIATE people", "Intermediate"),
    (C.level_from_metadata, None, "All Levels"),
    (C.capitalise, "udEMY", "Udemy"),
    (C.nlp_clean, "Learn Python 3 at http://x.y/z?a=1 les 42 bases!", "python bases"),
    (C.nlp_clean, None, ""),
    (C.review_count, "22,772 ratings", 22772),
    (C.review_count, "no", None),
    (C.total_hours, "99 total hours", 99.0),
    (C.total_hours, "5.5 total hour", 5.5),
    (C.lecture_count, "429 lectures", 429),
    (C.tag_level, "x All Levels Beginner", "All Levels"),
    (C.tag_level, "beginner", "N/A"),
    (C.rating_in_text, "4,8 stars", 4.8),
    (C.review_count_suffixed, "(1.5K reviews)", 1500),
    (C.review_count_suffixed, "12 avis", 12),
    (C.review_count_suffixed, "nothing here", None),
    (C.card_level, "Niveau intermédiaire", "Intermediate"),
    (C.card_level, "none", None),
    (C.card_price, "now $ 49.99 only", "$ 49.99"),
    (C.card_price, "Gratuit", "Free"),
    (C.card_price, "see plans", "Subscription"),
    (lambda c: C.half_even(c, 0), 2.5, 2.0),
    (lambda c: C.half_even(c, 2), 2.665, 2.66),
    (lambda c: C.half_even(c, 1), 12.25, 12.2),
    (lambda c: C.ellipsis(c, 3), "abcd", "abc..."),
    (lambda c: C.ellipsis(c, 3), None, "N/A"),
    (lambda c: C.absolute_url(c, "https://h"), "/c", "https://h/c"),
    (lambda c: C.absolute_url(c, "https://h"), "http://x/c", "http://x/c"),
]


@pytest.fixture(scope="module")
def results(spark):
    row = spark.range(1).select(*[
        fn(F.lit(v).cast("string" if v is None or isinstance(v, str) else "double")).alias(f"c{i}")
        for i, (fn, v, _) in enumerate(CASES)])
    return row.first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    assert results[f"c{i}"] == CASES[i][2]


def test_tokens_and_bigrams(spark):
    words = C.tokens(F.lit("The A1 café, is_ok! x"), ["the"])
    row = spark.range(1).select(C.uni_and_bigrams(words).alias("t"),
                                C.uni_and_bigrams(C.tokens(F.lit("x"))).alias("none"),
                                C.split_skills(F.lit("a, b ,c")).alias("s")).first()
    assert row["t"] == ["a1", "café", "is_ok", "a1 café", "café is_ok"]
    assert row["none"] == []
    assert row["s"] == ["a", "b", "c"]


def test_cleaners_are_idempotent(spark):
    df = spark.createDataFrame([("<p>x &amp; y</p>", "4,5", "19.99$")], "t string, r string, p string")
    once = df.select(C.clean_text("t").alias("t"), C.clean_rating("r").alias("r"),
                     C.clean_price_label("p").alias("p"))
    twice = once.select(C.clean_text("t").alias("t"), C.clean_rating("r").alias("r"),
                        C.clean_price_label("p").alias("p"))
    assert once.collect() == twice.collect()


def test_sql_functions_equal_columns(spark):
    names = register_functions(spark)
    assert len(names) == 8
    texts = [v for _, v, _ in CASES if v is None or isinstance(v, str)]
    df = spark.createDataFrame([(v,) for v in texts], "x string")
    pairs = {"sm_clean_text": C.clean_text, "sm_nlp_clean": C.nlp_clean,
             "sm_category": C.normal_category, "sm_level": C.normal_level,
             "sm_rating": C.clean_rating, "sm_reviews": C.clean_reviews,
             "sm_price_label": C.clean_price_label, "sm_price_code": C.encode_price}
    for name, fn in pairs.items():
        bad = df.select("x", F.expr(f"{name}(x)").alias("a"), fn("x").alias("b")).filter(
            "NOT a <=> b")
        assert bad.collect() == [], name
