"""Blocks of two tables met without a shuffle: every pair once, bounded blocks, no copies."""

import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import evaluate, similarity
from shelfmark.operators.blocks import block_table, ids_of, meet
from shelfmark.operators.common import cut
from shelfmark.plans import feed


@pytest.mark.parametrize("blocks", [1, 5])
def test_every_pair_is_met_once(spark, blocks):
    def side(n, start):
        rows = spark.range(start, start + n).withColumn("v", F.col("id"))
        return block_table(rows, "id", blocks, lambda t: ids_of(t.column("v")), most=20)

    def fold(state, block):
        state[1].extend((i, j) for i in state[0] for j in block)

    left, right = side(90, 0), side(70, 1000)
    assert left.count() >= 5 and right.count() >= 4
    got = meet(left, right, lambda b: (b, []), fold, lambda s: iter(s[1]), "a bigint, b bigint")
    assert got.count() == got.distinct().count() == 90 * 70


def test_long_rows_end_a_block(spark, monkeypatch):
    monkeypatch.setattr("shelfmark.operators.blocks.BLOCK_BYTES", 4000)
    rows = spark.range(0, 40, 1, 1).withColumn("v", F.repeat(F.lit("x"), 1000))

    def make(table: pa.Table):
        return len(table)

    assert block_table(rows, "id", 1, make).count() >= 10


def _matched(spark, build, n):
    """What `build` gives for n vectors of few terms."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(40) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "did bigint, t array<int>").select(
        "did", F.explode(F.array_distinct("t")).alias("term_id"), F.lit(0.5).alias("w"))
    return build(df)


@pytest.mark.parametrize("n", [40, 120])
def test_blocks_are_not_copied(spark, monkeypatch, n):
    """A side is written as often as it has rows, however many blocks the other has."""
    written = []
    monkeypatch.setattr(similarity, "block_count", lambda n, cores, rows=0: max(1, n // 8))

    def noted(rows, key, blocks, make, most=0):
        table = block_table(rows, key, blocks, make)
        written.append((blocks, rows.count(), table.count()))
        return table

    monkeypatch.setattr(similarity, "block_table", noted)
    got = _matched(spark, lambda d: similarity.best_matches(
        d.withColumnRenamed("did", "qid"), d, 3, "blocks").count(), n)
    assert got == 3 * n
    assert all(rows == n and blocks > 3 and made <= blocks for blocks, rows, made in written)


@pytest.mark.parametrize("times", [1, 2])
def test_noise_is_scored_in_blocks(spark, times):
    """Scores moved by noise are the same by blocks as by postings, where ids repeat as well."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(5)), "c%d" % (i % 3),
             1.0 + i % 5) for i in range(90)] * times
    df = spark.createDataFrame(docs, "course_id bigint, combined_text string, category string, "
                                     "rating double")
    model = similarity.TfidfModel(*_fit(df))
    searches = spark.createDataFrame(
        [(i, i % 6, docs[i * 3][1], f"2024-01-{i + 1:02d}") for i in range(20)],
        "id bigint, user_id bigint, query string, timestamp string")
    clicks = spark.createDataFrame([(1, 1, "c1")], "id bigint, user_id bigint, category string")
    one, two = (sorted(map(tuple, feed.personal_page(
        model, df, searches, clicks, page=2, per_page=7, strategy=s, noise=1.5).collect()))
        for s in ("postings", "blocks"))
    assert one == two and len(one) == 6 * 7


def _fit(df):
    from shelfmark.operators.tfidf import fit_tfidf
    m = fit_tfidf(df, stop_words=[])
    return m.vocab, m.weights, m.stop_words, m.bigrams, m.small_vocab


def test_silhouettes_over_many_blocks(spark, monkeypatch):
    """As many blocks as points give the same sums as one."""
    rng = random.Random(5)
    pts = spark.createDataFrame([(i, i % 3, [rng.gauss(i % 3, 1.0), rng.random()])
                                 for i in range(40)],
                                "id bigint, cluster int, features array<double>")
    found = []
    for blocks in (1, 8):
        monkeypatch.setattr(evaluate, "block_count", lambda n, cores, b=blocks: b)
        many = pts.withColumn("labels", F.array("cluster", (F.col("id") % 2).cast("int")))
        found.append((evaluate.silhouette(pts).first()[0], sorted(
            map(tuple, evaluate.silhouettes(many).collect()))))
    assert found[0] == found[1] and found[0][0] == found[0][1][0][1]


def test_a_left_block_meets_all_in_one_task(spark):
    left, right = (block_table(spark.range(n), "id", 6, lambda t: ids_of(t.column("id")), most=10)
                   for n in (60, 90))
    got = meet(left, right, lambda b: [len(b), 0], lambda s, b: s.__setitem__(1, s[1] + len(b)),
               lambda s: iter([tuple(s)]), "n bigint, met bigint", whole=True).collect()
    assert len(got) == left.count() > 4
    assert sum(r["n"] for r in got) == 60 and {r["met"] for r in got} == {90}


@pytest.mark.parametrize("blocks", [1, 7])
def test_all_nearest_keep_vectors_once(spark, monkeypatch, blocks):
    """One table of blocks is both sides, and no weight is joined after it."""
    rng = random.Random(4)
    rows = [(i, t, 0.3 + t / 100) for i in range(60) for t in rng.sample(range(12), 1 + i % 4)]
    rows += [(i + 100, t, w) for i, t, w in rows if i < 30]
    weights = spark.createDataFrame(rows, "course_id bigint, term_id int, w double").persist()
    want = sorted(map(tuple, similarity.similar_edges(weights, 4, strategy="postings").collect()))
    tables = []
    monkeypatch.setattr(similarity, "block_count", lambda n, cores, rows=0: blocks)
    monkeypatch.setattr(similarity, "block_table", lambda *a, **b: tables.append(
        block_table(*a, **b)) or tables[-1])
    edges = similarity.similar_edges(weights, 4, strategy="blocks")
    assert sorted(map(tuple, edges.collect())) == want
    assert len(tables) == 1 and "weights" not in _plan(edges)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_do_not_move_to_lists(spark, monkeypatch):
    """Lists of more and of fewer known vectors, met over several blocks."""
    rng = random.Random(6)
    vectors = {i: {t: rng.random() for t in rng.sample(range(20), 1 + i % 5)} for i in range(50)}
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()],
                                    "course_id bigint, term_id int, w double")
    lists = {i: rng.sample(range(55), 1 + i % 6) for i in range(50)} | {70: [99]}
    edges = spark.createDataFrame([(i, j, 0.5, r + 1) for i, js in lists.items()
                                   for r, j in enumerate(js)],
                                  "course_id bigint, neighbor_id bigint, score double, rank int")
    courses = spark.range(100).selectExpr("id AS course_id", "'a' AS category",
                                          "0.5D AS popularity_score")
    monkeypatch.setattr(evaluate, "block_count", lambda n, cores, rows=0: 6)
    monkeypatch.setattr(evaluate._Lists, "STEP", 4)
    out = evaluate.list_quality(edges, weights, courses)
    assert "weights" not in _plan(out) and "terms" not in _plan(out)
    got = {r["course_id"]: r["diversity"] for r in out.collect()}
    assert got.keys() == {i for i, js in lists.items() if any(j in vectors for j in js)}
    for i, diversity in got.items():
        known = [vectors[j] for j in lists[i] if j in vectors]
        dots = sum(w * b.get(t, 0) for x, a in enumerate(known) for b in known[x + 1:]
                   for t, w in a.items())
        m = len(lists[i])
        assert diversity == pytest.approx(1 - dots / (m * (m - 1) / 2) if m > 1 else 0, abs=2e-6)


def test_pages_write_documents_once(spark, monkeypatch):
    """Both passes of a page read the same blocks of documents."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(5)), "c%d" % (i % 3),
             1.0 + i % 5) for i in range(60)]
    df = spark.createDataFrame(docs, "course_id bigint, combined_text string, category string, "
                                     "rating double")
    model = similarity.TfidfModel(*_fit(df))
    searches = spark.createDataFrame(
        [(i, i % 4, docs[i * 3][1], f"2024-01-{i + 1:02d}") for i in range(12)],
        "id bigint, user_id bigint, query string, timestamp string")
    clicks = spark.createDataFrame([(1, 1, "c1")], "id bigint, user_id bigint, category string")
    keys = []
    monkeypatch.setattr(similarity, "block_table", lambda rows, key, *a, **b: keys.append(key)
                        or block_table(rows, key, *a, **b))
    page = feed.personal_page(model, df, searches, clicks, strategy="blocks")
    assert page.count() == 4 * 12 and sorted(keys) == ["did", "qid", "qid"]


def test_query_texts_stay_behind(spark, monkeypatch):
    """What is cut, ranked and capped holds no query text; the details come back at the end."""
    df = spark.createDataFrame([(i, "aa bb" if i % 2 else "cc dd", "c", 4.0) for i in range(8)],
                               "course_id bigint, combined_text string, category string, "
                               "rating double")
    model = similarity.TfidfModel(*_fit(df))
    searches = spark.createDataFrame([(1, 1, "aa", "2024-01-01"), (2, 1, "cc", "2024-01-02"),
                                      (3, 2, "", "2024-01-03"), (4, 2, "dd", "2024-01-01")],
                                     "id bigint, user_id bigint, query string, timestamp string")
    clicks = spark.createDataFrame([(1, 1, "c")], "id bigint, user_id bigint, category string")
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    held = []
    monkeypatch.setattr(feed, "cut", lambda rows: held.append(
        rows.filter("source = 'search' AND detail IS NOT NULL").count()) or cut(rows))
    got = feed.candidates(model, df, users, searches, clicks).filter("source = 'search'").collect()
    assert held == [0]
    assert {(r["user_id"], r["src_pos"], r["detail"]) for r in got} == {
        (1, 1, "cc"), (1, 2, "aa"), (2, 2, "dd")}


def test_newest_searches_are_those_of_all_columns(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "t1", "t2", "t3"]), i)
            for i in range(40)]
    searches = spark.createDataFrame([(*r, f"q{r[2]}") for r in rows],
                                     "user_id bigint, timestamp string, id bigint, query string")
    got = sorted(map(str, feed.newest_searches(searches, 3).collect()))
    assert got == sorted(map(str, feed.recent_searches(searches, 3).collect())) and len(got) == 12


@pytest.mark.parametrize("batch", [2, 10_000])
def test_vectors_move_once(spark, monkeypatch, batch):
    """Vectors are packed where they lie and take one exchange to their blocks; no other copy of
    them is written. Rows of an id that lie apart, in any order, are one vector."""
    rng = random.Random(8)
    rows = [(i, t, 0.3 + t / 100) for i in range(40) for t in rng.sample(range(12), 1 + i % 5)]
    rows += [(i + 100, t, w) for i, t, w in rows if i < 20] + [(None, 3, 0.5)]
    rng.shuffle(rows)
    weights = spark.createDataFrame(rows, "course_id bigint, term_id int, w double")
    want = sorted(map(tuple, similarity.similar_edges(weights, 4, strategy="postings").collect()))
    written, plans = [], []
    monkeypatch.setattr(similarity, "cut", lambda df: written.append(df.columns) or cut(df))
    placed = similarity.placed_blocks

    def noted(rows, *a):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return placed(rows, *a)

    monkeypatch.setattr(similarity, "placed_blocks", noted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, similarity.similar_edges(weights, 4, strategy="blocks").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 60 * 4
    assert not [c for c in written if {"terms", "weights", "w"} & set(c)]
    assert plans[0].partition("MapInArrow")[0].count("Exchange") == 1


def test_a_block_keeps_each_term_once():
    """Ten bytes an entry: the weight and its row."""
    n, each = 500, 100
    table = pa.table({"did": pa.array(range(n)), "d_attr": pa.array([0.0] * n),
                      "terms": pa.array([list(range(i % 7, 900, 9))[:each] for i in range(n)]),
                      "weights": pa.array([[i / 1000 + 0.1] * each for i in range(n)])})
    side = similarity._Side(table, "did", "d_attr")
    kept = pickle.dumps([side.w, side.row, side.terms, side.first])
    assert len(side.term) == n * each and set(side.term) == set(side.terms.tolist())
    assert len(kept) < n * each * 10.3
    assert len(pickle.dumps(side)) < n * each * 11


def _side(vectors):
    table = pa.table({
        "did": pa.array(range(len(vectors))), "d_attr": pa.array([i % 5 * 1.0 for i in
                                                                  range(len(vectors))]),
        "tie": pa.array([0.0] * len(vectors)),
        "terms": pa.array([list(v) for v in vectors], pa.list_(pa.int32())),
        "weights": pa.array([list(v.values()) for v in vectors], pa.list_(pa.float64()))})
    return similarity._Side(table, "did", "d_attr")


def _unit_vectors(n, rng, signed=False):
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 20, 60])
        v = {min(int(rng.expovariate(0.02)), 399): rng.random() - 0.4 * signed
             for _ in range(size)}
        norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
        out.append({t: x / norm for t, x in v.items()})
    return out


@pytest.mark.parametrize("columns", [{5: 100, 30: 200}, {2: 1}, {}])
@pytest.mark.parametrize("met", [8192, 0])
@pytest.mark.parametrize("cells", [1 << 24, 3000])
def test_few_pairs_are_scored_and_none_is_lost(monkeypatch, columns, met, cells):
    """Bounds leave out most pairs and none of the best, whatever the columns, also for scores that
    depend on attributes and for weights below zero."""
    monkeypatch.setattr(similarity, "COLUMNS", columns)
    monkeypatch.setattr(similarity, "MET_TERMS", met)
    monkeypatch.setattr(similarity, "MET_ROWS", 0)
    monkeypatch.setattr(similarity, "FULL_CELLS", cells)
    made = []
    monkeypatch.setattr(similarity, "meet", lambda left, right, *a: made.append(a))
    scored, products = [], similarity._Best.products
    monkeypatch.setattr(similarity._Best, "products", lambda self, row, col, d: scored.append(
        len(row)) or products(self, row, col, d))

    def ranked(score, q_attr, d_attr):
        return np.where(score > 0, score + d_attr / 10 + q_attr / 100, 0.0)

    for signed, rescore in ((False, None), (True, None), (False, ranked)):
        rng = random.Random(9)
        vectors, k = _unit_vectors(900, rng, signed), 4
        similarity.block_matches(None, None, k, "bigint", rescore)
        start, fold, finish = made.pop()[:3]
        best = start(_side(vectors[:60]))
        scored.clear()
        for at in range(0, 900, 150):
            part = _side(vectors[at:at + 150])
            part.ids = part.ids + at
            fold(best, part)
        got = sorted(finish(best))
        want = []
        for q in range(60):
            rows = [(round(sum(w * v.get(t, 0.0) for t, w in vectors[q].items()), 6), d)
                    for d, v in enumerate(vectors)]
            if rescore:
                rows = [(float(ranked(s, q % 5, (d % 150) % 5)), d) for s, d in rows]
            rows = sorted((r for r in rows if r[0] > 0), key=lambda r: (-r[0], r[1]))[:k]
            want += [(q, d, s, 0.0) for s, d in rows]
        assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, sorted(want), strict=True))
        if columns != {2: 1} and cells > 3000 and not signed:
            assert sum(scored) < 60 * 900 / 2
