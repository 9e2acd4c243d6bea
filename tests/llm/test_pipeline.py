"""The pipeline against the same stages in plain Python."""

from __future__ import annotations

import corpus_pipeline
from shelfmark.llm.work import keep
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, folder, docs, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")


def test_stages_keep_what_plain_python_keeps(spark, rows, tmp_path):
    docs = [(d, t, "en", s, len(t or "")) for d, t, s in rows if d is not None]
    items = [(1, " ".join((rows[3][1] or "").split()[2:20]))]
    base = str(tmp_path / "in")
    _write(spark, base, docs, items)
    df = spark.read.parquet(f"{base}/documents.parquet")
    kept = {(d, t) for d, t, *_ in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, base)
        assert out.columns == df.columns
        df = keep(out, "stage")
        got = [(r["doc_id"], r["text"]) for r in df.collect()]
        if name == "quality rules":
            kept = {(d, t) for d, t in kept if not plain.quality(t)[-1]} & set(got)
            gone = {d for d, t, *_ in docs if not plain.quality(t)[-1]} - {d for d, _ in got}
            assert len(gone) < 4  # clean documents stay
        elif name == "line dedup":
            cut = plain.line_runs(sorted(kept))
            kept = {(d, cut[d]) for d, t in kept if cut[d].strip() or cut[d] == t}
        elif name == "near-dedup":
            some = sorted(kept)
            comp = plain.components([(d, plain.shingles(t, 5)) for d, t in some],
                                    lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
            kept = {x for x, c in zip(some, comp, strict=True) if x[0] == c}
            assert len(got) == len(set(got))
        else:
            kept = {(r[0], t) for r, (_, t) in zip(plain.leaks(sorted(kept), items), sorted(kept),
                                                   strict=True) if not r[-1]}
        assert set(got) == kept, name
    packed = corpus_pipeline.STAGES[-1][1](spark, df, base).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in kept}


def test_empty_table(spark, tmp_path):
    base = str(tmp_path / "in")
    _write(spark, base, [], [(1, "some words")])
    assert corpus_pipeline.run(spark, base).count() == 0


def test_whole_short_items_are_leaks(spark, tmp_path):
    base = str(tmp_path / "in")
    docs = [(1, "has two words of it", "en", "a", 19), (2, "has two other words", "en", "a", 19)]
    _write(spark, base, docs, [(1, "two words")])
    df = spark.read.parquet(f"{base}/documents.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.leak_stage(spark, df, base).collect()] == [2]
