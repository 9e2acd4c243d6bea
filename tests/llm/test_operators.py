"""Each operator against its contract in plain Python, on rows with every odd case."""

from __future__ import annotations

import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import (counts, decontaminate, licenses, line_dedup, near_dedup, packing,
                           privacy, quality, repeats, sharding)
from shelfmark.llm.queries import tokenizer
from shelfmark.llm.words import BLANKS_LOWER, hash_windows, hash_words, slabs
from tests.llm import plain

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def _as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_word_hashes_depend_on_words_alone():
    text = b"one two  three two one " * 200_000
    h, start, stop = hash_words(text.translate(BLANKS_LOWER))
    assert len(h) == 1_000_000 and len(set(h.tolist())) == 3
    assert text[start[-2]:stop[-2]] == b"two"
    assert (hash_windows(h, 3)[:1000] == hash_windows(h[5:], 3)[:1000]).all()
    slab = list(slabs([b"a b", b"", b"c"], BLANKS_LOWER))[0]
    assert slab.counts.tolist() == [2, 0, 1]


def test_near_dedup(docs, rows, none):
    got = _as_counter(near_dedup.components(docs, k=3, percent=85).select(
        "doc_id", "n_shingles", "component_id"))
    want = Counter((d, n, c) for d, n, c, _ in plain.near([r[:2] for r in rows]))
    assert got == want
    assert sum(d != c for d, _, c in want) > 20
    assert near_dedup.components(none).count() == 0


def test_near_dedup_reaches_classes_that_no_star_links(spark):
    """A chain of edits: neighbours are alike, ends are not, and no text is alike to all."""
    w = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(30):
        texts.append((i, " ".join(w)))
        for j in range(3):
            w[(i * 7 + j) % 200] = f"e{i}x{j}"
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r[0]: r[1] for r in near_dedup.components(df, k=3, percent=85).select(
        "doc_id", "component_id").collect()}
    assert got == {d: c for d, _, c, _ in plain.near(texts)}


def test_near_dedup_moves_few_sets_of_long_texts_that_are_half_alike(spark, monkeypatch):
    """Texts whose every shingle others share, at a similarity of about 0.56 by pairs, and one pair
    of links among them."""
    rng = random.Random(5)
    slots = [[" ".join(f"s{i}v{v}w{j}" for j in range(16)) for v in range(2)] for i in range(200)]
    texts = [" ".join(s[rng.random() < 0.13] for s in slots) for _ in range(300)]
    texts.append(texts[7].replace("s3v", "edit"))
    seen, plain_keep = {}, near_dedup.keep

    def counted(df, label):
        out = plain_keep(df, label)
        seen.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(near_dedup, "keep", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = near_dedup.components(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] != r["component_id"]} == {
        300: 7}
    assert seen["pairs"][-1].count() < 45_150 // 20  # of all pairs; similarities vary by 0.05


def test_near_dedup_of_lists_of_many_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)  # all is left over
    some = Counter((r["doc_id"], r["n_shingles"], r["component_id"])
                   for r in near_dedup.components(docs, k=3, percent=85).collect())
    assert some == Counter(x[:3] for x in plain.near([(d, t) for d, t, _ in rows]))


def test_decontaminate(docs, rows, items, none):
    df, some = items
    out = decontaminate.contamination(docs, df).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], plain.sha(r["items"]),
                   r["contaminated"]) for r in out)
    assert got == Counter(plain.leaks([r[:2] for r in rows], some))
    assert sum(r["contaminated"] for r in out) > 3
    assert decontaminate.contamination(none, df).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(
        docs, df.filter("item_id = 4")).collect())


def test_personal_data(docs, rows, none):
    out = privacy.personal_data(docs).collect()
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"],
                   plain.sha(r["base_spans"].split(","))) for r in out)
    assert got == Counter((r[0], *plain.personal(r[1])) for r in rows)
    assert privacy.personal_data(none).count() == 0
    text = {r["doc_id"]: r["text"] for r in privacy.sanitised(docs).collect()}
    assert text[81] == "Write to [EMAIL] or [PHONE] now"


def test_terms_that_reveal(spark):
    """Two surroundings share a name; the rest of the corpus never has it."""
    rows = [(1, "Please call Zebulon under +1 (017) 555-7713 today"),
            (2, "the office of Zebulon is at +1 (017) 555-7713 from nine"),
            (3, "copied +1 (017) 555-7713 twice"), (4, "from nine today the office please")]
    rows += [(i, "please call the office today from nine") for i in range(5, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in privacy.personal_data(df).collect()}
    assert got[1] == "term:12:19,phone:26:43" and got[2] == "term:14:21,phone:28:45"
    assert got[3] == "phone:7:24" and got[4] == ""
    text = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert text[1] == "Please call [NAME] under [PHONE] today" and set(text) == {1, 2, 3}


def _ids(path, text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, rows, none):
    out = packing.pack(packing.pieces(docs, BYTES), per_task=50).collect()
    want = Counter()
    for doc, text, _ in rows:
        ids = np.array([*_ids(BYTES, text), 2], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            want[doc, k, a, n, zlib.crc32(ids[a:a + n].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and sum(s[-1]) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert packing.pack(packing.pieces(none, BYTES)).count() == 0
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_packer_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [p.place(n) for n in (5, 8, 9, 5)] == [(2, 0), (3, 0), (4, 0), (2, 5)]


def test_repeats(docs, rows, none):
    got = _as_counter(repeats.repeated_passages(docs).select("doc_id", "start_word", "end_word"))
    want = Counter(plain.repeats([(-1 if d is None else d, t) for d, t, _ in rows]))
    # Rows that are equal in id and text have one row for all.
    want = Counter({(None if k[0] == -1 else k[0], *k[1:]): 1 for k in want})
    assert got == want and len({k[0] for k in got}) > 20
    assert repeats.repeated_passages(none).count() == 0


def test_sharding(docs, rows, none):
    tree = sharding.regular_tree(24)
    out = sharding.assign(docs, tree).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign(none, tree).count() == 0


def test_weights_move_keys_within_their_subtree_only(spark):
    tree = [sharding.Leaf(f"r{i // 4}", f"k{i // 2}", i) for i in range(8)]
    heavy = [x._replace(weight=3.0) if x.shard == 1 else x for x in tree]
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(sharding.shard_of(key, tree).alias("a"),
                                    sharding.shard_of(key, heavy).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b < 4 for _, b in moved)  # into the region that gained
    assert not any(a < 2 and b in (2, 3) for a, b in moved)  # never out of the rack that gained
    share = Counter(r["b"] for r in rows)
    assert abs(share[1] / 4000 - 3 / 10) < 0.04 and abs(share[6] / 4000 - 1 / 10) < 0.03


def test_licenses(docs, rows, none):
    got = _as_counter(licenses.scan_licenses(docs))
    want = Counter((d, *plain.licenses(t, licenses.TEMPLATES, licenses.THRESHOLD))
                   for d, t, _ in rows)
    assert got == want
    assert licenses.scan_licenses(none).count() == 0


def test_quality(docs, rows, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    some = docs.select("doc_id", "text", "source")
    out = quality.judge(some).collect()
    assert Counter((r["doc_id"], *(r[c] for c in cols)) for r in out) == Counter(
        (d, *plain.quality(t)) for d, t, _ in rows)
    assert not any(r["kept"] and r["base_failed"] for r in out)
    assert all(r["kept"] for r in out if not r["base_failed"] and r["n_soft"] == 0)
    assert quality.judge(none.select("doc_id", "text", "source")).count() == 0


def test_host_verdicts(spark):
    """Against plain Python; the corpus decides what is bad and what is good, not a fixed bar."""
    good = " ".join(f"word{i}" for i in range(40))
    odd, odder = good + " " + "# " * 14, good.replace("word", "##word")  # one soft rule, two
    rows = [(t, h) for h, n in (("a", 400), ("b", 400), ("c", 400), (None, 3)) for t in [good] * n]
    rows += [(odd, "a")] * 250 + [(odd, "b")] * 20 + [(odder, "b")] * 20 + [(odder, "c")] * 2
    rows += [("short", "a")] * 9 + [(odder, None), (odd, "alone")]
    for some in (rows, [(t, "one host") for t, _ in rows[-60:]], [(odd, None)]):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(some)],
                                   "doc_id long, text string, source string")
        got = {r["doc_id"]: r for r in quality.judge(df).collect()}
        for i, (rate, verdict, kept) in enumerate(plain.judged(some)):
            assert got[i]["host_rate"] == pytest.approx(rate, abs=1e-9)
            assert (got[i]["host_verdict"], got[i]["kept"]) == (verdict, kept)
    want = {(t, h): v for (t, h), v in zip(rows, plain.judged(rows), strict=True)}
    assert want[odd, "a"][1:] == ("bad", False) and want[good, "a"][2]  # at a rate of 0.39
    assert want[odd, "b"][1:] == ("usual", True) and not want[odder, "b"][2]
    assert want[odder, "c"][1:] == ("good", True) and want[odd, "alone"][1] == "usual"


def test_quality_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "h", 5, 6, 7, 8)], "doc_id long, text string, "
                               "source string, n_words int, _host int, verdict int, kept int")
    r = quality.judge(df).collect()[0]
    assert (r["n_words"], r["_host"], r["verdict"], r["kept"]) == (2, 6, 7, False)


def test_token_counts_and_their_cache(docs, rows, none, tmp_path):
    cache = str(tmp_path / "cache")
    want = Counter((d, len((t or "").encode()), len(_ids(WORDS, t))) for d, t, _ in rows)
    assert _as_counter(counts.token_counts(docs, WORDS, cache)) == want
    spark = docs.sparkSession
    stored = counts.read_cache(spark, cache).count()
    assert _as_counter(counts.token_counts(docs, WORDS, cache)) == want
    assert counts.read_cache(spark, cache).count() == stored  # nothing was encoded again
    assert counts.token_counts(none, WORDS, cache).count() == 0
    assert counts.token_counts(none, WORDS, str(tmp_path / "new")).count() == 0


def test_texts_the_cache_has_do_not_move(spark, tmp_path):
    """Cached texts are not read; of the others, no more than a filter lets pass."""
    cache = str(tmp_path / "cache")
    df = spark.range(400).select(F.concat(F.lit("text no "), F.col("id")).alias("text"))
    df = df.withColumn("digest", counts.content_digest(F.col("text")))
    counts.fill_cache(df.limit(390), WORDS, cache)
    df.select("digest").write.parquet(str(tmp_path / "digests"))
    digests = spark.read.parquet(str(tmp_path / "digests"))
    misses = digests.join(counts.read_cache(spark, cache), "digest", "left_anti")
    assert misses.count() == 10
    some = counts._texts_of(df, misses, 400)
    assert {r["digest"] for r in some.collect()} == {r["digest"] for r in misses.collect()}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("missing(")  # the filter stands below the exchange
    counts.fill_cache(df, WORDS, cache, digests)
    unread = df.withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    counts.fill_cache(unread, WORDS, cache, digests)
    assert counts.read_cache(spark, cache).count() == 400


def test_line_dedup(docs, rows, none):
    """The recall of repeated runs is 1, whatever their length; clashing names pass or give way."""
    named = docs.withColumns({"_row": F.col("doc_id"), "_id": F.lit("i"), "_text": F.lit("t"),
                              "gone": F.lit(1), "_DOC": F.lit(2), "a.b": F.lit(3)})
    out = line_dedup.without_repeats(named)
    assert out.columns == [c for c in named.columns if c != "_lines"] + ["_lines", "_removed"]
    out = out.collect()
    some = [(d, t) for d, t, _ in rows if d is not None and t is not None]
    want = plain.line_runs(sorted(set(some)))
    got = {r["doc_id"]: r["text"] for r in out}
    assert {d: got[d] for d in want} == want and len(out) == len(rows)
    assert sum(want[d] != t for d, t in some) > 5
    assert got[72] is None and got[79] == "x\nx\n"
    assert {(r["_row"] == r["doc_id"], r["_id"], r["_text"], r["gone"], r["_DOC"], r["a.b"])
            for r in out if r["doc_id"] is not None} == {(True, "i", "t", 1, 2, 3)}
    assert line_dedup.without_repeats(none).count() == 0
    assert line_dedup.without_repeats(none.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("window", [2, 3, 5])
@pytest.mark.parametrize("shift", [0, 1, 5])
def test_boundaries_move_with_the_content(shift, window):
    body = [b"line %d of a passage" % (i * i % 97) for i in range(60)]
    lead = [b"other %d" % i for i in range(shift)]
    mark = [line_dedup.boundaries(line_dedup.line_hashes(x), window) for x in (body, lead + body)]
    inside = slice(window, 60 - window)
    assert (mark[0][inside] == mark[1][shift:][inside]).all()
    gaps = np.diff(np.flatnonzero(mark[0]))
    assert gaps.max() <= window and (window == 2 or gaps.max() > 1)


def test_anchors_are_extended_to_both_sides():
    of = lambda *x: list(zip(*(y.tolist() for y in line_dedup.extensions(*x)), strict=True))
    assert of(np.array([0, 1, 4]), 5, 2) == [(0, 1), (1, 2), (3, 4)]
    assert of(np.array([2]), 4, 3) == [(0, 2), (1, 2), (2, 3)]
    assert of(np.array([], np.int64), 4, 3) == []


def test_blank_lines_and_windows_of_any_size(spark):
    """Long runs of blank lines stay; with a wider window, runs of its size go all the same."""
    run = "\n".join(f"shared {i}" for i in range(5))
    rows = [(1, "a" + "\n" * 3000 + "b"), (2, "c" + "\n" * 3000 + "d"), (3, f"p\n{run}\nq"),
            (4, f"r\n{run}\ns"), (None, f"t\n{run}"), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (2, 3, 5):
        out = line_dedup.without_repeats(df, window=window).collect()
        want = rows[:3] + [(4, "r\ns"), (None, "t"), (None, None), (6, "")]
        key = lambda x: (x[0] or 99, x[1] or "")
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=key) == sorted(want, key=key)
    with pytest.raises(ValueError):
        line_dedup.without_repeats(df, window=1)


@pytest.mark.parametrize("size", [2, 3, 4, 8])
def test_short_runs_are_cut_between_other_lines(spark, size):
    run = [f"shared {i}" for i in range(size)]
    text = lambda d: "\n".join([f"{d} a", f"{d} b", *run, f"{d} c", f"{d} d"])
    df = spark.createDataFrame([(d, text(d)) for d in range(6)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()}
    assert got == {d: text(0) if d == 0 else f"{d} a\n{d} b\n{d} c\n{d} d" for d in range(6)}


@pytest.mark.parametrize("width", [25, 50, 79])
def test_wrapped_licenses(spark, width):
    """Wordings over several lines, as the usual files have them; scattered words are none."""
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files (the \"Software\"), to deal in it")
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are "
           "permitted provided that the following conditions are met:")
    apart = f" {'filler ' * 30}\n".join(bsd.split())
    texts = [f"# {chr(10).join(textwrap.wrap(x, width))}\nmore" for x in (mit, bsd)] + [apart]
    texts.append("\n * ".join(["lead"] * 40 + textwrap.wrap(mit, width) + ["end"] * 40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("", 0.0), 3: ("mit", 1.0)}


def test_cards_with_a_separator_after_every_digit(spark):
    rows = [(1, "-".join("4111111111111111")), (2, "card " + " ".join("4111111111111111") + ".")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["base_spans"] for r in privacy.personal_data(df).collect()}
    assert got == {1: "card:0:31", 2: "card:5:36"}


def test_terms_that_reveal_from_afar(spark):
    """Short names and identifiers with digits, hundreds of characters from the entity."""
    far = " please call the office today from nine" * 20
    rows = [(1, f"Kim wrote{far} at +1 (017) 555-7713 today"),
            (2, f"ask Kim of X7B{far} or +1 (017) 555-7713 now"),
            (3, f"see X7B here{far} under +1 (017) 555-7713 too")]
    rows += [(i, f"nothing else{far}") for i in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert text == {1: f"[NAME] wrote{far} at [PHONE] today", 2: f"ask [NAME] of [NAME]{far} or "
                    "[PHONE] now", 3: f"see [NAME] here{far} under [PHONE] too"}


def test_near_dedup_asks_for_fewer_matches_at_lower_similarities():
    assert [near_dedup.matches_for(x) for x in (85, 80)] == [near_dedup.MATCHES] * 2
    assert 17 > near_dedup.matches_for(70) > near_dedup.matches_for(50) > 0
    with pytest.raises(ValueError):
        near_dedup.matches_for(10)
