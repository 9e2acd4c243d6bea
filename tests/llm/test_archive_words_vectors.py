"""The web archive, spelling variants and whitening against plain Python, on rows with every odd
case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import spelling, warc, whitening
from shelfmark.llm.work import keep
from shelfmark.operators.common import scratch

PAGES = "page_id long, url string, html string, digest string, copy int, salt string"


def _pages():
    big, other = "<p>é𝒳 " + "long " * 300 + "</p>", "y" * 1000
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
    rows = [(i, f"http://h{i % 3}/p", big) for i in range(40)]
    rows += [(100 + i, f"http://h/{i}", "small") for i in range(60)]
    rows += [(7, "http://h7/again", big), (39, "http://h0/p", big), (39, "http://h0/p", big),
             (39, "http://z", big), (None, "http://null-id", big), (None, None, other),
             (None, None, other), (200, None, None), (201, "", ""), (202, "http://x\r\nEvil: 1", "é"),
             (203, "http://y", "y" * 999), (204, "http://y", other), (205, "u", trap),
             (206, "v", trap), (207, "http://long", "z" * 3_000_000), (204, "http://y", other)]
    return rows


def _archived(rows):
    """The contract: rows of (page_id, payload_bytes, digest, type, refers_to)."""
    body = [(h or "").encode() for _, _, h in rows]
    groups = defaultdict(list)
    for (page, _, _), b in zip(rows, body, strict=True):
        groups[b].append(page)
    out = []
    for b, pages in groups.items():
        sha = hashlib.sha1(b).hexdigest()
        known = [p for p in pages if p is not None]
        first = max(known) if known else None
        left = pages.copy()
        if len(b) >= 1000:
            left.remove(first)
            out.append((first, len(b), sha, "response", None))
            out += [(p, len(b), sha, "revisit", first) for p in left]
        else:
            out += [(p, len(b), sha, "response", None) for p in left]
    return Counter(out)


def _back(df):
    return Counter((None if r["page_id"] is None else int(r["page_id"]), r["payload_bytes"],
                    r["payload_digest"], r["record_type"],
                    None if r["refers_to"] is None else int(r["refers_to"])) for r in df.collect())


def test_archive_gives_back_every_page(spark):
    rows = _pages()
    df = spark.createDataFrame([(*r, "d", 3, "s") for r in rows], PAGES).repartition(3)
    path = scratch(spark, "archive")
    warc.write_archive(df, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in rows})
    got = warc.read_pages(spark, path)
    assert _back(got) == _archived(rows)
    pages = Counter((r["page_id"], r["url"], bytes(r["payload"])) for r in got.collect())
    assert pages == Counter((None if p is None else str(p),
                             u and u.replace("\r", "%0D").replace("\n", "%0A"),
                             (h or "").encode()) for p, u, h in rows)
    assert _back(warc.read_pages(spark, path, with_payload=False)) == _archived(rows)


def test_archive_of_nothing(spark):
    path = scratch(spark, "archive")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0


def test_many_copies_are_met_by_a_broadcast_or_dealt(spark):
    """A page that half of all rows share, equal rows, and a small payload of many records."""
    rows = ([(i, "u", "x" * 1200) for i in range(1500)] + [(9, "v", "same" * 300)] * 2500
            + [(i, "w", "tiny") for i in range(2100)] + [(i, "q", f"{i}" * 400) for i in range(40)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = scratch(spark, "archive")
    warc.write_archive(df, path)
    assert _back(warc.read_pages(spark, path)) == _archived(rows)


def test_files_hold_the_same_records(spark):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    path, folder = scratch(spark, "archive"), scratch(spark, "files")
    warc.write_archive(df, path)
    records = warc.read_records(spark, path)
    warc.write_files(records, folder, per_file=20)
    assert Counter(bytes(r[0]) for r in warc.read_files(spark, folder).collect()) == Counter(
        bytes(r[0]) for r in records.collect())


def test_damaged_payloads_are_not_handed_on(spark):
    path, bad = scratch(spark, "archive"), scratch(spark, "bad")
    warc.write_archive(spark.createDataFrame([(1, "u", "text"), (2, "v", "other")],
                                             "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/heads").write.parquet(f"{bad}/heads")
    stored = spark.read.parquet(f"{path}/payloads")
    stored.withColumn("payload", F.lit(b"tixt")).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_pages(spark, bad)
    gone = scratch(spark, "gone")
    spark.read.parquet(f"{path}/heads").write.parquet(f"{gone}/heads")
    stored.filter("bytes = 4").write.parquet(f"{gone}/payloads")
    with pytest.raises(Exception, match="no payload"):
        warc.read_pages(spark, gone)


def _forms(rows):
    """The contract of the spelling variants."""
    count: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].add(w)
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda t: (-n[t], t), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]),
                    None if form[w] is None else n[form[w]]))
    return Counter(out)


def _spelled(df):
    out = spelling.spelling_forms(spelling.word_counts(df))
    return Counter(tuple(r) for r in out.select(
        "word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_variants(spark, docs, rows, none):
    assert _spelled(docs) == _forms([r[:2] for r in rows])
    assert spelling.spelling_forms(spelling.word_counts(none)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_of_alike_words(spark, seed):
    """Few letters, so that runs of equal letters, many neighbours and long chains occur."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aabÿ") for _ in range(rng.randint(5, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + f" {'Abba' * i} ") for i in range(60)]
    chain = [("linka", 4), ("linkab", 9), ("linkabc", 20), ("linkabcd", 60), ("linkabcde", 150)]
    rows += [(100, " ".join(" ".join([w] * n) for w, n in chain))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = _spelled(df)
    assert got == _forms(rows)
    assert sum(r[1] is not None and r[2] != r[1] for r in got) >= 3


def test_spelling_of_words_without_a_level(spark):
    """Words around and beyond the trie's depth, one of them very long, all of one letter or two."""
    rng = random.Random(5)
    words = []
    for n in (37, 38, 39, 40, 41, 42, 43, 60, 5000):
        base = "".join(rng.choice("xy") for _ in range(n))
        at = rng.randrange(n)
        words += [base, base[:at] + "q" + base[at + 1:], base[:at] + base[at + 1:],
                  base[:at] + "w" + base[at:], base[:-1] + "é", "z" * n, "z" * (n + 1)]
    rows = [(i, " ".join(w for j, w in enumerate(words) for _ in range(1 + j % 3)))
            for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _spelled(df) == _forms(rows)


def test_no_trie_state_goes_where_no_word_ends(spark):
    """Without the lengths below an edge, each word would go on along all edges."""
    words = spark.createDataFrame([(a + b + "ing", 3) for a in "abcdefgh" for b in "klmnopqr"],
                                  "word string, n long")
    edges = spelling.trie(words).collect()
    assert all(r["ends"] == 1 << 5 for r in edges)
    assert {r["depth"] for r in edges} == {2, 3, 4}


VECTORS = "vec_id long, embedding array<float>, component int, n long, whitened string"


def _whitened(rows, k=16):
    """Whitening with a dense solver: (ids, vectors, whitened values, eigenvalue shares, deviation)."""
    good = [(i, v) for i, v in rows if v is not None and all(
        c is not None and np.isfinite(c) for c in v) and len(v)]
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v in good])
    u = np.unique(x, axis=0)
    e, q = np.linalg.eigh(np.cov(u.T, bias=True).reshape(x.shape[1], -1))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    whole, sums = x.astype(int), u.sum(axis=0).astype(int)
    dev = ((len(u) * whole - sums) ** 2).sum(axis=1)
    return ([i for i, _ in good], (x - u.mean(axis=0)) @ q / np.sqrt(e),
            e / np.var(u, axis=0).sum(), dev, len(u))


def _compare(df, rows):
    ids, want, share, dev, n = _whitened(rows)
    got = whitening.whitened(df).collect()
    k = want.shape[1]
    assert len(got) == len(ids) * k
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append((r["whitened"], r["deviation"], r["explained"]))
    signs = {}
    for c in range(k):
        assert all(abs(x[2] / share[c] - 1) < 1e-9 for i in ids for x in by[i, c + 1])
        far = max(range(len(ids)), key=lambda i: abs(want[i, c]))
        signs[c] = np.sign(want[far, c]) * np.sign(by[ids[far], c + 1][0][0])
        mine = sorted((str(i), round(w * signs[c], 6), d) for i in set(ids)
                      for w, d, _ in by[i, c + 1])
        theirs = sorted((str(i), round(w, 6), d) for i, w, d in zip(
            ids, want[:, c].tolist(), dev.tolist(), strict=True))
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-5


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "w") for i, v in rows], VECTORS).repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 60)) @ np.diag(np.linspace(3, 0.5, 60))
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(900, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (901, None)]
    rows += [(902, [*rows[0][1][:-1], None]), (903, [float("nan"), *rows[0][1][1:]]),
             (904, [float("inf"), *rows[0][1][1:]])]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    _compare(_vectors(spark, rows), rows)


def test_whitening_takes_several_cycles_and_is_certified(spark):
    """A flat spectrum, where the first block is far from the wanted vectors."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 70)))]
    df = _vectors(spark, rows)
    model = whitening.fit(keep(whitening.distinct_vectors(df), "v"), 70)
    assert model.passes > 2 * whitening.DEGREE
    assert model.residual <= whitening.ROUNDING * model.values[0]
    _compare(df, rows)


def test_whitening_without_variance_or_rows(spark):
    flat = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
    assert whitening.whitened(_vectors(spark, flat)).count() == 0
    assert whitening.whitened(_vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    out = whitening.whitened(_vectors(spark, line)).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 9
    odd = [*line, (50, [1.0]), (51, [1.0] * 80), (52, [1e30, 0.0, 0.0])]
    assert whitening.whitened(_vectors(spark, odd)).count() == 9


def test_deviations_beyond_a_long_are_null():
    centre = whitening.Centre(3, [10, 20])
    x = np.array([[1, 2], [1 << 33, 0], [(1 << 31) // 3, 5]], np.int64)
    want = [sum((3 * a - b) ** 2 for a, b in zip(r, (10, 20), strict=True)) for r in x.tolist()]
    assert centre.deviations(x) == [w if w < 1 << 63 else None for w in want]
