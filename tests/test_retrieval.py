"""TF-IDF, matching strategies, similar items, search, stored model."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import evaluate, similarity
from shelfmark.operators.tfidf import fit_tfidf, transform_texts
from shelfmark.plans.model_store import load_model, load_or_train, save_model
from tests import plain

STOPS = ["the", "of"]


def corpus(n=160, seed=1):
    """Skewed words; a third of the texts are copies of one text, one word is in most texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(n):
        if i % 3 == 0:
            docs[i] = "hot copy of the same text w1 w2"
        else:
            picks = [words[int(59 * rng.random() ** 3)] for _ in range(rng.randint(2, 9))]
            docs[i] = " ".join((["hot"] if rng.random() < 0.7 else []) + picks + ["the"])
    docs[n] = "zzz"
    docs[n + 1] = ""
    return docs


@pytest.fixture(scope="module")
def world(spark):
    docs = corpus()
    df = spark.createDataFrame(
        [(i, t, "c%d" % (i % 4), ("en", "fr")[i % 2], 1.0 + i % 5, (i % 10) / 10)
         for i, t in docs.items()],
        "course_id long, combined_text string, category string, platform string, "
        "rating double, popularity_score double").withColumn("title", F.col("combined_text"))
    model = fit_tfidf(df.withColumn("level", F.lit("Beginner")), stop_words=STOPS)
    model.weights.persist()
    return df.withColumn("level", F.lit("Beginner")), model, docs, plain.Tfidf(docs, STOPS)


def test_weights_equal_plain(world):
    _, model, _, ref = world
    terms = {r["term_id"]: r["term"] for r in model.vocab.collect()}
    assert set(terms.values()) == set(ref.idf)
    got = {(r["course_id"], terms[r["term_id"]]): r["w"] for r in model.weights.collect()}
    want = {(i, t): w for i, row in ref.rows.items() for t, w in row.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_weights_do_not_depend_on_partitions(world):
    df, model, _, _ = world
    again = fit_tfidf(df.repartition(7), stop_words=STOPS)
    rows = {(r["course_id"], r["term_id"], round(r["w"], 9)) for r in model.weights.collect()}
    assert {(r["course_id"], r["term_id"], round(r["w"], 9))
            for r in again.weights.collect()} == rows


@pytest.mark.parametrize("strategy", ["postings", "blocks", "split"])
@pytest.mark.parametrize("hot", [256, 3])
def test_edges_equal_brute_force(world, strategy, hot, monkeypatch):
    _, model, _, ref = world
    monkeypatch.setattr(similarity, "HOT_TERMS", hot)
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(similarity, "SALT_PAIRS", 400)
    edges = similarity.similar_edges(model.weights, 5, strategy=strategy)
    got = plain.groups(edges.collect(), "course_id")
    for i, row in ref.rows.items():
        want = plain.best(row, ref.rows, 5, zero=False, skip=i)
        have = sorted(got.get(i, []), key=lambda r: r["rank"])
        assert [(r["score"], r["neighbor_id"]) for r in have] == want, i


@pytest.mark.parametrize("strategy", ["postings", "blocks", "auto"])
def test_edges_of_asked_ids(spark, world, strategy, monkeypatch):
    _, model, _, _ = world
    copies = model.weights.filter("course_id = 1").withColumn("course_id", F.lit(-7).cast("long"))
    weights = model.weights.unionByName(copies).persist()
    asked = spark.createDataFrame([(1,), (1,), (4,), (None,), (10 ** 9,)], "course_id long")
    of_all = similarity.similar_edges(weights, 5).filter("course_id IN (1, 4)").collect()
    seen = []
    monkeypatch.setattr(similarity, "best_matches", lambda q, *a, best=similarity.best_matches: (
        seen.append(q.select("qid").distinct().count()), best(q, *a))[1])
    got = similarity.similar_edges(weights, 5, strategy=strategy, asked=asked).collect()
    assert sorted(got) == sorted(of_all) and len(got) == 10
    assert seen == [2]


def test_pair_scores_are_symmetric_cosines(world):
    _, model, _, _ = world
    d = model.weights.withColumnRenamed("course_id", "did")
    s = similarity.pair_scores(d.withColumnRenamed("did", "qid"), d)
    assert s.filter("score < 0 OR score > 1.000001").count() == 0
    back = s.select(F.col("did").alias("qid"), F.col("qid").alias("did"), "score")
    assert s.exceptAll(back).count() == 0


@pytest.mark.parametrize("strategy", ["postings", "blocks", "split", "auto"])
def test_query_search(spark, world, strategy):
    df, model, _, ref = world
    texts = {1: "hot W1 w2", 2: "unknown words only", 3: "hot w1 W2", 4: "w40 w41 of", 5: ""}
    q = spark.createDataFrame(list(texts.items()), "qid int, query string")
    got = plain.groups(similarity.recommend_by_query(model, df, q, 6, strategy=strategy)
                       .collect(), "qid")
    for qid, text in texts.items():
        want = plain.best(ref.query(text), ref.rows, 6)
        rows = sorted(got[qid], key=lambda r: r["rank"])
        assert [(r["score"], r["course_id"]) for r in rows] == want
        assert [r["rank"] for r in rows] == list(range(1, 7))
        assert [r["similarity_score"] for r in rows] == [plain.r1(s * 100) for s, _ in want]
    assert all(r["score"] == 0 for r in got[2])


def test_query_search_with_filters(spark, world):
    df, model, _, ref = world
    q = spark.createDataFrame([(1, "w1 w2 w3")], "qid int, query string")
    rows = similarity.recommend_by_query(model, df, q, 4, {
        "platform": "fr", "category": "c1", "min_rating": 5, "search": "zzz"}).collect()
    pool = {i: r for i, r in ref.rows.items() if i % 2 == 1 and i % 4 == 1}
    want = plain.best(ref.query("w1 w2 w3"), pool, 4)
    assert [(r["score"], r["course_id"]) for r in sorted(rows, key=lambda r: r["rank"])] == want


def test_unknown_text_has_no_weights(spark, world):
    _, model, _, _ = world
    q = spark.createDataFrame([(1, "nothing known")], "qid int, query string")
    assert transform_texts(model, q, "qid", "query").count() == 0


def test_list_quality_equals_pairwise(world):
    df, model, _, ref = world
    edges = similarity.similar_edges(model.weights, 10).persist()
    got = {r["course_id"]: r for r in evaluate.list_quality(edges, model.weights, df).collect()}
    for i, row in ref.rows.items():
        near = plain.best(row, ref.rows, 10, zero=False, skip=i)
        if not near:
            assert i not in got
            continue
        ids = [j for _, j in near]
        pairs = [sum(w * ref.rows[b].get(t, 0) for t, w in ref.rows[a].items())
                 for x, a in enumerate(ids) for b in ids[x + 1:]]
        assert got[i]["diversity"] == pytest.approx(1 - sum(pairs) / len(pairs), abs=2e-6)
        assert got[i]["avg_similarity"] == pytest.approx(sum(s for s, _ in near) / len(near),
                                                         abs=2e-6)
        assert got[i]["category_share"] == sum(j % 4 == i % 4 for j in ids) / 10


def test_rerank(spark, world):
    df, model, _, _ = world
    edges = similarity.similar_edges(model.weights, 19)
    seeds = spark.createDataFrame([("s", 1)], "seed string, course_id long")
    rows = evaluate.rerank(edges, df, seeds, 5).collect()
    near = {r["neighbor_id"]: r["score"] for r in edges.filter("course_id = 1 AND rank <= 14")
            .collect()}
    top = max(j % 10 / 10 for j in near)
    want = sorted(((-round(0.7 * s + 0.3 * (j % 10 / 10) / (top + 1e-6), 6), j)
                   for j, s in near.items()))[:5]
    assert [(-r["final_score"], r["neighbor_id"]) for r in rows] == want
    plain_rows = evaluate.rerank(edges, df.drop("popularity_score"), seeds, 5).collect()
    assert [r["final_score"] for r in plain_rows] == [r["score"] for r in plain_rows]


def test_model_store_detects_changes(spark, world, tmp_path):
    df, model, _, _ = world
    path = str(tmp_path / "m")
    assert load_model(spark, df, path) is None
    edges = similarity.similar_edges(model.weights, 3)
    save_model(model, df, path, 3, stop_words=STOPS)
    found = load_model(spark, df, path, 3, stop_words=STOPS)
    assert found.edges.count() == edges.count()
    assert load_model(spark, df, path, 5, stop_words=STOPS) is None
    assert found.tfidf.weights.count() == model.weights.count()
    assert found.tfidf.stop_words == tuple(STOPS)
    changed = df.withColumn("combined_text", F.when(F.col("course_id") == 5, F.lit("new"))
                            .otherwise(F.col("combined_text")))
    assert load_model(spark, changed, path, 3, stop_words=STOPS) is None
    assert load_model(spark, df.filter("course_id <> 5"), path, 3, stop_words=STOPS) is None
    again = load_or_train(spark, changed, path, 3, stop_words=STOPS)
    assert again is not None and load_model(spark, changed, path, 3, stop_words=STOPS) is not None
    other = load_or_train(spark, df, path, 2, stop_words=["more"], max_features=2)
    assert other.tfidf.vocab.count() <= 2 and other.tfidf.stop_words == ("more",)
    assert load_model(spark, df, path, 3, stop_words=STOPS).edges.count() == edges.count()


def test_short_lists_are_filled_with_score_zero(spark):
    """A course with one neighbour, one with none, and one whose neighbours are the first ids."""
    rows = [(i, f"t{i}", "c", "p", "l", 1.0) for i in range(9)]
    courses = spark.createDataFrame(rows, "course_id long, title string, category string, "
                                          "platform string, level string, rating double")
    edges = spark.createDataFrame([(0, 5, 0.5, 1), (3, 0, 0.9, 1), (3, 1, 0.8, 2), (3, 2, 0.7, 3)],
                                  "course_id long, neighbor_id long, score double, rank int")
    out = similarity.recommend_similar(edges, courses, n=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["course_id"], r["rank"])):
        got.setdefault(r["course_id"], []).append((r["neighbor_id"], r["similarity_score"]))
    assert len(got) == 9 and all(len(v) == 3 for v in got.values())
    assert got[0] == [(5, 50.0), (1, 0.0), (2, 0.0)]
    assert got[3] == [(0, 90.0), (1, 80.0), (2, 70.0)]
    assert got[1] == [(0, 0.0), (2, 0.0), (3, 0.0)]
    seeds = spark.createDataFrame([(8,), (77,)], "course_id long")
    some = similarity.recommend_similar(edges, courses, seeds, 2).collect()
    assert {(r["course_id"], r["neighbor_id"]) for r in some} == {(8, 0), (8, 1)}
    plain = similarity.recommend_similar(edges, courses, n=3, fill_zero=False)
    assert plain.count() == 4


def test_texts_stay_where_they_are_read(spark, tmp_path):
    """With as many files as cores no text is shuffled, and the tables are the same."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices("red green blue pink grey teal".split(), k=rng.randint(0, 9))))
            for i in range(200)]
    df = spark.createDataFrame(rows, "course_id long, combined_text string")
    df.repartition(8).write.parquet(str(tmp_path / "many"))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    found = []
    for name in ("many", "one"):
        model = fit_tfidf(spark.read.parquet(str(tmp_path / name)), stop_words=["teal"])
        vocab = sorted(map(tuple, model.vocab.collect()))
        weights = sorted((r["course_id"], r["term_id"], round(r["w"], 12))
                         for r in model.weights.collect())
        found.append((vocab, weights))
        plan = model.weights._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (name == "one")
    assert found[0] == found[1] and len(found[0][1]) > 500
