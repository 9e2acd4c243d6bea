"""Cleaning, catalog, statistics and people on hand-written rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.operators import catalog, cleaning, features, people, prices, standardise, stats
from shelfmark.operators.common import dense_index, exact_quantiles
from shelfmark.plans.build import build, build_catalog
from shelfmark.sources import positions
from tests import plain


def test_first_titles_keep_one_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 3), (None, 2), ("b", 4)],
                               "title string, ingest_seq long")
    got = {(r[0], r[1]) for r in cleaning.drop_duplicate_titles(df).collect()}
    assert got == {("a", 0), (None, 2), ("b", 4)}


def raw_catalog(spark):
    rows = [(0, "Intro to <b>Python</b>", None, "python basics", "Débutant", "4,7", "1.2k", None),
            (1, "Intro to <b>Python</b>", "dup", "x", "Expert", "3", "1", "$5"),
            (2, "Tiny", "short title", "x", "?", "9", "3m", "0"),
            (3, "Big &amp; long title", "", None, None, "bad", None, "abc"),
            (4, "Another fine title", "Text <i>here</i>", "cooking", "mixed", "4.5", "22,772",
             "gratuit")]
    return spark.createDataFrame(
        rows, "ingest_seq long, title string, description string, category string, "
              "level string, rating string, num_reviews string, price string").withColumn(
        "platform", F.lit("Udemy"))


def test_clean_catalog(spark):
    out, before, after = cleaning.clean_catalog(raw_catalog(spark))
    rows = {r["ingest_seq"]: r for r in out.collect()}
    assert (before.get["rows"], after.get["rows"]) == (5, 3)
    assert {k: r["course_id"] for k, r in rows.items()} == {0: 1, 3: 2, 4: 3}
    first, third = rows[0], rows[3]
    assert (first["title"], first["description"], first["category"], first["level"]) == (
        "Intro to Python", "Intro to Python", "Python Programming", "Beginner")
    assert (first["rating"], first["num_reviews"], first["price"]) == (4.7, 1000, "Subscription")
    assert (third["title"], third["category"], third["rating"], third["price"]) == (
        "Big long title", "Other", 0.0, "Paid")
    counts = cleaning.cleaning_counts(raw_catalog(spark)).first()
    assert tuple(counts) == (5, 3, 2)


def test_price_update_rules(spark):
    courses = spark.createDataFrame([
        (1, " Py ", "u1", "udemy", "old"), (2, "Sql", "u2", "udemy", "old"),
        (3, "Go", "u3", "udemy", "old"), (4, "Py", "u1", "coursera", "old"),
        (5, None, "u5", "udemy", "old"), (6, "Py", "u1", "other", "old")],
        "course_id int, title string, url string, platform string, price string")
    feed = spark.createDataFrame([
        ("py", "u1", "$1.50", 1), ("PY ", " u1", "only $2.50", 2), ("sql", "u2", None, 3),
        ("", "u3", "$9", 4), ("go", "", "$9", 5)],
        "title string, url string, current_price string, seq int")
    out = {r["course_id"]: (r["price"], r["price_matched"])
           for r in prices.update_prices(courses, feed).collect()}
    assert out == {1: ("$2.50", True), 2: (None, True), 3: ("old", False),
                   4: (K.COURSERA_PRICE, False), 5: ("old", False), 6: ("old", False)}


def test_combined_text_rebuilds_all_or_nothing(spark):
    df = spark.createDataFrame([("A", "c", "X"), ("B", None, None)],
                               "title string, category string, combined_text string")
    assert [r[0] for r in standardise.add_combined_text(df).select("combined_text")
            .collect()] == ["a c", "b"]
    full = df.filter("title = 'A'")
    assert standardise.add_combined_text(full).first()["combined_text"] == "x"
    assert standardise.add_combined_text(df.drop("combined_text")).first()[
        "combined_text"] == "a c"


def test_standardise_adds_what_is_missing(spark):
    df = spark.createDataFrame([(10, "Deep learning", "For beginners", "coursera"),
                                (11, None, None, "UDEMY")],
                               "ingest_seq long, title string, metadata string, "
                               "source_domain string")
    rows = standardise.standardise(df).orderBy("ingest_seq").collect()
    assert [(r["course_id"], r["category"], r["level"], r["price"], r["platform"])
            for r in rows] == [(0, "Machine Learning", "Beginner", "Free", "Coursera"),
                               (1, "General", "All Levels", "Free", "Udemy")]
    keep = spark.createDataFrame([(7, 3)], "id long, course_id long")
    assert standardise.add_aliases(keep).first()["course_id"] == 3


def test_popularity_limits(spark):
    zero = spark.createDataFrame([(0.0, 0), (0.0, None)], "rating double, num_reviews long")
    assert {r["popularity_score"] for r in features.add_popularity(zero).collect()} == {0.0}
    top = spark.createDataFrame([(5.0, 9), (2.5, 0)], "rating double, num_reviews long")
    assert sorted(r["popularity_score"] for r in features.add_popularity(top).collect()) == [
        0.3, 1.0]


def test_one_hot_refuses_many_values(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("category"))
    with pytest.raises(ValueError):
        features.one_hot_categories(df, limit=10)


def test_search_patterns(spark):
    df = spark.createDataFrame([("C++ now",), ("sql 1",), (None,)], "title string")
    hit = lambda *a, **k: {r[0] for r in df.filter(
        catalog.contains_text(F.col("title"), *a, **k)).collect()}
    assert hit("c++", literal=True) == {"C++ now"}
    assert hit(r"SQL \D") == {"sql 1"}     # the pattern is lower-cased with the text
    with pytest.raises(ValueError):
        hit("c(")


def courses(spark):
    rows = [(1, "a", "Web", "Beginner", 4.0, 2.0), (2, "b", "Web", "Beginner", 4.0, None),
            (3, "c", "Web", "Advanced", None, 1.0), (4, "d", "Web dev", "Intermediate", 5.0, 1.5),
            (5, "e", "Data", "All Levels", 3.0, 9.0)]
    return spark.createDataFrame(rows, "course_id long, title string, category string, "
                                       "level string, rating double, duration_hours double"
                                 ).withColumn("ingest_seq", F.col("course_id"))


def test_learning_path_numbers_present_levels(spark):
    web = [(r["step"], r["level"], r["course_id"], r["rating"], r["duration"])
           for r in catalog.best_per_level(courses(spark)).filter("category = 'Web'")
           .orderBy("step").collect()]
    assert web == [(1, "Beginner", 1, 4.0, 2.0), (2, "Advanced", 3, 0.0, 1.0)]
    path = [(r["step"], r["course_id"]) for r in catalog.learning_path(courses(spark), "WEB")
            .orderBy("step").collect()]
    assert path == [(1, 1), (2, 4), (3, 3)]
    assert catalog.learning_path(courses(spark), "nothing").count() == 0


def test_pages_partition_the_listing(spark):
    seen = []
    for page in (1, 2, 3):
        seen += [r["course_id"] for r in catalog.listing_page(courses(spark), page, 2).collect()]
    assert seen == [4, 1, 2, 5, 3]
    assert tuple(catalog.listing_totals(courses(spark), 2, 2).first()) == (5, 3, 2)
    ignored = catalog.filter_courses(courses(spark), {"min_rating": 5, "platform": ""})
    assert ignored.count() == 5


def test_find_courses_falls_back_to_position(spark):
    wanted = spark.createDataFrame([(3,), (0,), (99,)], "course_id long")
    got = {(r["requested_id"], r["course_id"])
           for r in catalog.find_courses(courses(spark), wanted).collect()}
    assert got == {(3, 3), (0, 1)}


def test_random_order_is_repeatable_and_whole(spark):
    users = spark.range(5).select(F.col("id").alias("user_id"))
    a = catalog.random_order_page(courses(spark), users, 10)
    by_user = plain.groups(a.collect(), "user_id")
    assert all(sorted(r["course_id"] for r in rows) == [1, 2, 3, 4, 5]
               for rows in by_user.values()) and len(by_user) == 5
    b = catalog.random_order_page(courses(spark).repartition(3), users, 10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 3)}",
             rng.choice([None, 1.0, 2.0, round(rng.random() * 9, 1)])) for _ in range(400)]
    rows.append(("single", 3.5))
    df = spark.createDataFrame(rows, "g string, v double")
    want = {"a": 0.25, "b": 0.5, "c": 0.9}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", want).collect()}
    for g, items in plain.groups([{"g": g, "v": v} for g, v in rows if v is not None],
                                 "g").items():
        for name, q in want.items():
            assert got[g][name] == pytest.approx(np.quantile([x["v"] for x in items], q))
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_dense_index_is_gap_free(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    rows = dense_index(df, ["k"], "pos", 1).collect()
    assert all(r["pos"] == r["k"] + 1 for r in rows) and len(rows) == 1000


def test_histogram_edges(spark):
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "rating double")
    assert stats.histogram(same).filter("n > 0").collect()[0]["n"] == 2
    rng = np.random.default_rng(0).random(500) * 4 + 1
    df = spark.createDataFrame([(float(x),) for x in rng], "rating double")
    got = [r["n"] for r in stats.histogram(df).orderBy("bin").collect()]
    assert got == list(np.histogram(rng, bins=20)[0])


def test_slots_round_half_even(spark):
    clicks = spark.createDataFrame([(1, "a")] * 1 + [(1, "b")] * 7, "user_id long, category string")
    got = {r["category"]: r["slots"] for r in people.category_slots(clicks).collect()}
    assert got == {"a": 2, "b": 18}


def test_account_load_equals_one_by_one(spark):
    rng = random.Random(4)
    old = [("u1", "m1@shelf.test"), ("u2", "m2@shelf.test")]
    new = [(i, f"u{rng.randint(0, 25)}", f"m{rng.randint(0, 25)}@shelf.test") for i in range(80)]
    out = people.load_accounts(
        spark.createDataFrame(old, "username string, email string"),
        spark.createDataFrame(new, "seq long, username string, email string").withColumn(
            "password", F.lit("pw")))
    rows = out.collect()
    assert {r["seq"]: r["reason"] for r in rows} == plain.accounts(old, new)
    assert len(rows) == 80 and "password" not in out.columns
    assert rows[0]["password_hash"] == (
        "30c952fab122c3f9759f02a6d95c3758b246b4fee239957b2d4fee46e26170c4")


def test_account_checks(spark):
    df = spark.createDataFrame([("ab", "12345", "12345"), ("abc", "123", "123"),
                                ("abc", "1234", "12345"), ("abc", "1234", "1234"),
                                (None, None, None)],
                               "username string, password string, confirm string")
    assert [r["reason"] for r in catalog.check_accounts(df).collect()] == [
        "username_too_short", "password_too_short", "confirmation_differs", None,
        "username_too_short"]


def test_favorites(spark):
    ev = spark.createDataFrame([(1, 7, "add", 1, 1), (1, 7, "remove", 2, 2), (1, 8, "add", 3, 3),
                                (2, 7, "add", 4, 4), (2, 7, "remove", 4, 5)],
                               "user_id long, course_id long, action string, ts long, "
                               "event_id long")
    now = people.favorites_now(ev)
    assert [(r["user_id"], r["course_id"]) for r in now.collect()] == [(1, 8)]
    req = spark.createDataFrame(
        [(1, 8, "add"), (1, 8, "remove"), (1, 8, "remove"), (1, 9, "add"), (1, 9, "add"),
         (1, 9, "remove"), (1, 7, "remove")], "user_id long, course_id long, action string")
    req = req.coalesce(1).withColumn("event_id", F.monotonically_increasing_id()).withColumn(
        "ts", F.lit(5))
    got = {r["event_id"]: r["changed"] for r in people.favorite_results(now, req).collect()}
    assert got == dict(enumerate([False, True, False, True, False, True, False]))


def test_account_load_refuses_missing_values(spark):
    old = spark.createDataFrame([("a", "a@shelf.test")], "username string, email string")
    new = spark.createDataFrame(
        [(1, None, "x@shelf.test"), (2, "b", None), (3, "b", "x@shelf.test"), (None, "c", "c@t"),
         (5, "d", "x@shelf.test"), (6, "e", "a@shelf.test")],
        "seq long, username string, email string").withColumn("password", F.lit("pw"))
    got = {r["seq"]: r["reason"] for r in people.load_accounts(old, new).collect()}
    assert got == {1: "missing_value", 2: "missing_value", 3: None, None: "missing_value",
                   5: "email_taken", 6: "email_taken"}


def test_saved_path_round_trip(spark):
    users = spark.createDataFrame([(1, "ann")], "id long, username string")
    steps = catalog.best_per_level(courses(spark)).filter("category = 'Web'").withColumn(
        "timestamp", F.lit("2026-01-01")).withColumn("user_id", F.lit(1).cast("long"))
    rows = people.path_rows(users, steps).withColumn("id", F.lit(1))
    bad = rows.withColumn("path_data", F.lit("{oops")).withColumn("id", F.lit(2))
    out = people.saved_paths(rows.unionByName(bad)).orderBy("rank").collect()
    assert [len(r["path"]) for r in out] == [0, 2]
    assert out[1]["path"][0]["title"] == "a" and out[1]["path"][1]["rating"] == 0.0


def test_build_writes_catalog_and_model(spark, tmp_path):
    raw = raw_catalog(spark).withColumn("url", F.lit("u"))
    extra = raw.withColumn("ingest_seq", F.col("ingest_seq") + 10).withColumn(
        "title", F.concat("title", F.lit(" part two")))
    stored = build(spark, raw.unionByName(extra), str(tmp_path), k=2, min_df=1, max_df=1.0,
                   stop_words=[])
    rows = spark.read.parquet(str(tmp_path / "catalog"))
    assert sorted(r["course_id"] for r in rows.collect()) == list(range(rows.count()))
    assert set(K.FEATURE_COLUMNS) <= set(rows.columns)
    assert stored.edges.count() > 0
    assert build_catalog(raw).count() == 3


def test_map_points_without_a_cluster(spark):
    """Missing cells stay missing; defaults are for missing columns."""
    df = spark.createDataFrame([(1, "t", None, None)],
                               "course_id long, title string, cluster int, x double")
    row = standardise.map_points(df).first()
    assert (row["cluster"], row["x"], row["y"], row["level"]) == (None, None, 0.0, "All")


def test_connected_contracts_long_chains(spark):
    """A chain of 2,000 links in few rounds; groups that share nothing stay apart."""
    rng = random.Random(8)
    ids = rng.sample(range(10 ** 9), 2001)
    links = [(ids[i], ids[i + 1]) for i in range(2000)]
    links += [(-5, -6), (-6, -7), (-9, -8), (4, 4)] + [(10 ** 10, 10 ** 10 + i) for i in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["a"]: r["root"] for r in people.connected(df, rounds=12).collect()}
    want = dict.fromkeys(ids, min(ids)) | {-5: -7, -6: -7, -7: -7, -8: -9, -9: -9}
    want |= {10 ** 10 + i: 10 ** 10 for i in range(50)}
    assert got == want


@pytest.mark.parametrize("group_rows", [100_000, 10])
def test_account_load_of_long_chains(spark, group_rows):
    """Names and addresses alternate, so that every row waits for the one before; the load order
    runs along one chain, against another, and at random through a third."""
    rng = random.Random(9)
    size = 1000 if group_rows > 10 else 24
    chains = []
    for c in range(3):
        rows = [(f"c{c}n{(i + 1) // 2}", f"c{c}m{i // 2}@t") for i in range(size)]
        places = list(range(size))
        if c == 1:
            places.reverse()
        elif c == 2:
            rng.shuffle(places)
        chains += [(c * size + p, *r) for p, r in zip(places, rows, strict=True)]
    df = spark.createDataFrame(chains, "seq long, username string, email string")
    want = {seq for seq, why in plain.accounts([], sorted(chains)).items() if why is None}
    got = people._first_come(df, "seq", group_rows=group_rows)
    assert {r["seq"] for r in got.collect()} == want


def test_titles_meet_by_their_digests(spark):
    """No text is a key of an exchange or a sort; NULL is a title, the empty text another."""
    rows = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "w"), (5, "", "v"),
            (None, "b", "u"), (6, "b", "t")]
    df = spark.createDataFrame(rows, "ingest_seq long, title string, more string")
    out = cleaning.drop_duplicate_titles(df)
    assert {r["more"] for r in out.collect()} == {"x", "z", "v", "u"} and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)|Sort \[([^]]*)\]", plan)
    assert keys and not any("title" in a + b for a, b in keys)


def test_category_vectors(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"c{i % 1500:04d}")
                                for i in range(3000)], "id long, category string")
    names = sorted({r["category"] for r in df.collect() if r["category"]})
    for r in features.category_vectors(df).collect():
        vector = r["category_vector"]
        assert vector.size == len(names)
        assert [names[i] for i in vector.indices] == ([r["category"]] if r["category"] else [])
    old = features.category_index(df.filter("category < 'c0003'"))
    some = features.category_vectors(df, index=old).filter("category = 'c0004'").first()
    assert some["category_vector"].size == 3 and len(some["category_vector"].indices) == 0


def test_stored_positions(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 1009, i) for i in range(1009)], "k long, v long")
    path = str(tmp_path / "t")
    positions.write_positions(df, [F.desc("k")], path, 5)
    assert positions.row_count(spark, path) == 1009
    got = [(r["position"], r["k"]) for page in (1, 41, 42, 81, 101, 102)
           for r in positions.stored_page(spark, path, page, 10).orderBy("position").collect()]
    assert got == [(p, 1008 - p) for page in (1, 41, 42, 81, 101) for p in range(
        page * 10 - 10, min(page * 10, 1009))]
    wanted = spark.createDataFrame([(0,), (500,), (500,), (1008,), (1009,), (-1,)], "position long")
    found = positions.at_positions(spark, path, wanted)
    assert {(r["position"], r["k"]) for r in found.collect()} == {(0, 1008), (500, 508), (1008, 0)}
    plan = positions.stored_page(spark, path, 50, 10)._jdf.queryExecution().executedPlan()
    assert "Sort" not in plan.toString() and "Exchange" not in plan.toString()
    one = positions.stored_page(spark, path, 2, 10)
    assert len({f.split("/")[-2] for f in one.inputFiles()}) <= 5
    empty = str(tmp_path / "e")
    positions.write_positions(df.filter("k < 0"), ["k"], empty, 3)
    assert positions.row_count(spark, empty) == 0
    assert positions.stored_page(spark, empty).count() == 0
    assert positions.at_positions(spark, empty, wanted).count() == 0
