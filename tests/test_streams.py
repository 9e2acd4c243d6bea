"""Streams give what the batch jobs give."""

import datetime as dt

from pyspark.sql import functions as F

from shelfmark.operators import people
from shelfmark.sources import folders
from shelfmark.sources.schemas import EVENT
from shelfmark.streaming import events as S
from shelfmark.streaming.keyed import KeyedTable


def events(spark, n=300, start=0):
    t0 = dt.datetime(2026, 1, 1)
    return [(i, t0 + dt.timedelta(minutes=11 * i), i % 7, "click", i % 5, None,
             "add" if i % 3 else "remove") for i in range(start, start + n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def test_ingest_drops_repeats_and_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / p) for p in ("src", "out", "cp"))
    write(spark, events(spark) + events(spark, 50), src)
    def run():
        S.append_events(S.without_repeats(S.read_events(spark, src)), out, cp).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert run() == list(range(300))
    write(spark, events(spark, 20, 300), src)
    assert run() == list(range(320))
    assert run() == list(range(320))


def test_preferences_equal_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / p) for p in ("src", "out", "cp"))
    attrs = spark.createDataFrame(
        [(i, f"cat{i % 2}", "Beginner" if i else None, "Udemy") for i in range(5)],
        "course_id long, category string, level string, platform string")
    for part in (events(spark, 100), events(spark, 200, 100)):
        write(spark, part, src)
        clicks = S.read_events(spark, src).join(attrs, "course_id")
        S.maintain_preferences(clicks, out, cp).awaitTermination()
    batch = people.preferences(spark.read.parquet(src).join(attrs, "course_id"))
    live = S.current_preferences(spark, out).select(batch.columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_favorites_equal_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / p) for p in ("src", "out", "cp"))
    for part in (events(spark, 150), events(spark, 150, 150)):
        write(spark, part, src)
        S.maintain_favorites(S.read_events(spark, src), out, cp).awaitTermination()
    live = S.current_favorites(spark, out).select("user_id", "course_id")
    batch = people.favorites_now(spark.read.parquet(src)).select("user_id", "course_id")
    assert live.exceptAll(batch).count() == batch.exceptAll(live).count() == 0
    assert batch.count() > 0


def _facts(spark, rows):
    return spark.createDataFrame(rows, "k long, ts long, v string")


def test_keyed_table_folds_its_batches(spark, tmp_path):
    """Few folders however many batches, the newest row per key, and no change by a repeat."""
    table = KeyedTable(str(tmp_path / "t"), ("k",), ("ts",), every=3)
    want, most = {}, 0
    for b in range(14):
        rows = [(k, b * 10 - (40 if k == 3 else 0) * (b % 2), f"v{b}") for k in range(b % 5 + 1)]
        for k, ts, v in rows:
            want[k] = max(want.get(k, (-99, "")), (ts, v))
        table.write(_facts(spark, rows), b)
        most = max(most, len(folders.written(spark, table.path)))
        base, deltas = table.parts(spark)
        assert len(deltas) < 3 and (base is None or all(d > base for d in deltas))
    assert most <= 2 + 2 * 3

    def now():
        return {r["k"]: (r["ts"], r["v"]) for r in table.current(spark).collect()}
    assert now() == want and table.current(spark).columns == ["k", "ts", "v"]
    table.write(_facts(spark, [(0, 999, "again")]), 2)  # a base holds batch 2
    assert now() == want
    base, deltas = table.parts(spark)
    last = 13 if deltas else base
    table.write(_facts(spark, rows), last)
    assert now() == want


def test_keyed_table_passes_over_unfinished_folders(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), ("ts",), every=2)
    table.write(_facts(spark, [(1, 1, "a")]), 0)
    (tmp_path / "t" / "base-5").mkdir()
    (tmp_path / "t" / "delta-1").mkdir()
    assert table.parts(spark) == (None, [0])
    table.write(_facts(spark, [(1, 2, "b")]), 1)
    assert table.parts(spark) == (1, [])
    assert [tuple(r) for r in table.current(spark).collect()] == [(1, 2, "b")]


def test_old_removals_are_forgotten(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, 1, t0, 1, "remove"), (1, 2, t0, 2, "add"),
            (2, 1, t0 + dt.timedelta(days=9), 3, "remove")]
    df = spark.createDataFrame(rows, "user_id long, course_id long, ts timestamp, event_id long, "
                                     "action string")
    table = S.favorite_table(str(tmp_path / "t"), every=1, remember="5 DAYS")
    table.write(df, 0)
    assert {(r["user_id"], r["course_id"]) for r in table.current(spark).collect()} == {
        (1, 2), (2, 1)}


def test_daily_activity_drops_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / p) for p in ("src", "out", "cp"))
    def run():
        stream = S.daily_activity(S.read_events(spark, src), "1 hour")
        S._run(stream.writeStream.format("parquet").outputMode("append").option("path", out)
               .option("checkpointLocation", cp)).awaitTermination()
        return {(r["user_id"], r["day"]): r["n"] for r in spark.read.parquet(out).collect()}
    write(spark, events(spark), src)
    batch = {(r["user_id"], r["day"]): r["n"]
             for r in S.daily_activity_batch(spark.read.parquet(src)).collect()}
    last = max(d for _, d in batch)
    assert run() == {k: n for k, n in batch.items() if k[1] < last}
    late = [(999, dt.datetime(2026, 1, 1), 1, "click", 1, None, "add"),
            (1000, dt.datetime(2026, 2, 1), 1, "click", 1, None, "add")]
    write(spark, late, src)
    final = run()
    assert all(final[k] == n for k, n in batch.items())


def test_search_gate(spark, tmp_path):
    from shelfmark.operators.tfidf import fit_tfidf
    src, out, cp = (str(tmp_path / p) for p in ("src", "out", "cp"))
    courses = spark.createDataFrame([(i, f"topic{i % 3} word{i % 2} more") for i in range(12)],
                                    "course_id long, combined_text string")
    model = fit_tfidf(courses, stop_words=[])
    now = dt.datetime(2026, 1, 1)
    write(spark, [(1, now, 1, "search", None, "topic1", None),
                  (2, now, 1, "search", None, "unknown", None),
                  (3, now, 2, "search", None, "TOPIC1", None)], src)
    S.gate_searches(S.read_events(spark, src), model, courses, out, cp).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {r["event_id"] for r in rows} == {1, 3}
    assert all(r["best"] > 15 for r in rows)
    assert spark.read.parquet(out).filter(F.col("query") == "topic1").count() == 1
