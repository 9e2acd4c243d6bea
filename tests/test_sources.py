"""Readers, writers, quarantine, extraction."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.bindings import views as V
from shelfmark.operators import extract
from shelfmark.operators.people import preferences
from shelfmark.sources import files, lines

SMALL = "/root/testdata/sf0.001"


def test_read_catalog_either_separator(spark, tmp_path):
    for sep in ",;":
        p = tmp_path / f"c{ord(sep)}.csv"
        p.write_text(sep.join(["title", "rating", "price", "id"]) + "\n"
                     + sep.join(["A", "4.5", '"x"', "1"]) + "\n"
                     + sep.join(["B", "NaN", "", "2"]) + "\n"
                     + sep.join(["C", "oops", "y", "3"]) + "\n", encoding="utf-8")
        rows = {r["title"]: r for r in files.read_catalog(spark, str(p)).collect()}
        assert rows["A"]["rating"] == 4.5 and rows["A"]["id"] == 1
        assert rows["B"]["rating"] is None and rows["B"][files.CORRUPT] is None
        assert rows["C"]["rating"] is None and "oops" in rows["C"][files.CORRUPT]


def test_a_folder_of_different_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title;rating;price;id\nA;4.5;x;1\nB;oops;;2\n")
    (tmp_path / "b.csv").write_text('\ufeffid,extra,title\n3,"p,q","C;c"\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("title;rating;price;id\nD;1;y;4\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("rating,id\n")
    rows = {r["id"]: r for r in files.read_catalog(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1]["title"], rows[1]["rating"], rows[1]["extra"]) == ("A", 4.5, None)
    assert rows[2]["rating"] is None and "oops" in rows[2][files.CORRUPT]
    assert (rows[3]["title"], rows[3]["extra"], rows[3]["price"]) == ("C;c", "p,q", None)
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    assert files.read_catalog(spark, str(empty)).count() == 0


def test_behaviour_documents(spark, tmp_path):
    clicks = [{"course_id": i, "title": f"t{i}", "category": "Web" if i % 3 else "Data",
               "level": "Beginner", "platform": "Udemy" if i % 2 else "Coursera",
               "timestamp": f"2026-01-0{i}T00:00:00"} for i in range(1, 8)]
    doc = {"ann": {"searches": [{"query": "sql", "timestamp": "t1"},
                                {"query": "sql", "timestamp": "t2"}],
                   "clicks": clicks, "views": [{"course_id": 1, "timestamp": "t"}],
                   "favorites": [5, 6],
                   "preferences": {"categories": {"Web": 5, "Data": 2},
                                   "levels": {"Beginner": 7},
                                   "platforms": {"Udemy": 4, "Coursera": 3}}},
           "bob": {"searches": [], "clicks": [], "views": [], "favorites": [],
                   "preferences": {"categories": {}, "levels": {}, "platforms": {}}}}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=1))
    flat = files.read_behaviour(spark, str(tmp_path / "b.json"))
    assert {k: v.count() for k, v in flat.items()} == {
        "searches": 2, "clicks": 7, "views": 1, "favorites": 2, "preferences": 5}
    # recounting the clicks gives the stored preferences
    again = preferences(flat["clicks"].withColumn("user_id", F.col("username")))
    stored = {tuple(r) for r in flat["preferences"].select("username", "dim", "value",
                                                          "n").collect()}
    assert {tuple(r) for r in again.collect()} == stored


def test_users_document_drops_credentials(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps(
        {"ann": {"email": "ann@shelf.test", "password": "secret", "created_at": "c"}}))
    df = files.read_users(spark, str(tmp_path / "u.json"))
    assert df.columns == ["username", "email", "created_at", "last_login"]
    assert df.first()["last_login"] is None


def test_cards_round_trip(spark, tmp_path):
    cards = [{"platform": "Udemy", "title": "A", "url": "u", "rating": 4.5, "reviews": 10},
             {"platform": "Udemy", "title": "B", "url": "v", "current_price": "$9"}]
    (tmp_path / "raw.json").write_text(json.dumps(cards, indent=2))
    df = files.read_cards(spark, str(tmp_path / "raw.json"))
    files.write_cards(df, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_write_and_verify(spark, tmp_path):
    df = V.courses(spark, SMALL)
    for fmt in ("parquet", "csv"):
        n = files.write_catalog(df, str(tmp_path / fmt), fmt)
        assert n == df.count() and files.verify_rows(spark, str(tmp_path / fmt), n, fmt)
        assert not files.verify_rows(spark, str(tmp_path / fmt), n + 1, fmt)


def test_interaction_tables(spark, tmp_path):
    users = spark.createDataFrame([(1, "ann")], "id long, username string").selectExpr(
        "id", "username", "'e' AS email", "'p' AS password", "'c' AS created_at",
        "CAST(NULL AS STRING) AS last_login")
    for name in files.S.INTERACTIONS:
        empty = spark.createDataFrame([], files.S.INTERACTIONS[name])
        files.append_interactions(users if name == "users" else empty, str(tmp_path), name)
    files.append_interactions(users, str(tmp_path), "users")
    tables = files.read_interactions(spark, str(tmp_path))
    assert tables["users"].count() == 2 and tables["clicks"].count() == 0


def test_a_batch_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, "t")], files.S.INTERACTIONS["favorites"])
    base = str(tmp_path)
    assert files.append_interactions(rows, base, "favorites", "b1")
    assert not files.append_interactions(rows, base, "favorites", "b1")
    assert files.append_interactions(rows, base, "favorites", "b2")
    half = tmp_path / "favorites" / "b3"  # a load that was lost half-way
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"broken")
    assert files.read_interactions(spark, base)["favorites"].count() == 2
    assert files.append_interactions(rows, base, "favorites", "b3")
    tables = files.read_interactions(spark, base)
    assert tables["favorites"].count() == 3 and tables["clicks"].count() == 0
    with pytest.raises(ValueError, match="named by"):
        files.append_interactions(rows, base, "favorites", "../x")


def test_quarantine(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(16))
    good = ",".join("x" * 16)
    filler = ",".join([K.MISSING_PRICE] * 3 + [" " + K.COURSERA_PRICE] * 2 + list("abcde"))
    almost = ",".join([K.MISSING_PRICE] * 4 + list("abcdef"))
    short = ",".join("x" * 9)
    quoted = '"a,b,c,d,e,f,g,h,i,j",x'
    (tmp_path / "l.csv").write_text("\n".join([header, good, filler, almost, short, quoted]))
    ok, bad, counts = lines.quarantine(spark, str(tmp_path / "l.csv"))
    assert {r[0] for r in ok.collect()} == {header, good, almost, quoted}
    assert {r["fault"] for r in bad.collect()} == {"repeated_price", "too_few_fields"}
    assert counts.first().asDict() == {"lines": 6, "removed": 2, "repeated_price": 1,
                                       "too_few_fields": 1}
    aware, _, _ = lines.quarantine(spark, str(tmp_path / "l.csv"), csv_aware=True)
    assert quoted not in {r[0] for r in aware.collect()}


def test_quoted_commas_on_long_lines(spark):
    """Quotes are emptied in one pass: a line of a million quoted commas neither recurses nor takes
    quadratic time."""
    rows = [('"' + "," * 1_000_000 + '",x',), (",".join(['"a,b"'] * 10),), ('open " a' + "," * 9,)]
    df = spark.createDataFrame(rows, "value string")
    assert [r["fault"] for r in lines.mark_lines(df, csv_aware=True).collect()] == [
        "too_few_fields", None, None]


def test_every_file_has_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one,two\n" + ",".join("x" * 10) + "\n")
    (tmp_path / "b.csv").write_text("three;four\nshort\n")
    good, bad, _ = lines.quarantine(spark, str(tmp_path))
    assert {r[0] for r in bad.collect()} == {"short"} and good.count() == 3


CARD = """<section class="course-product-card x"><h2 class="t"><a href="/course/py/"><div>Py
 101</div></a></h2><span data-purpose="safely-visible-instructors">Ann</span>
<span data-purpose="rating-number">4.6</span><ul class="tag-list-module--list"><li>22,772 ratings</li>
<li>99.5 total hours</li><li>429 lectures</li><li>All Levels</li></ul>
<div data-purpose="course-price-text">$13.99</div><div data-purpose="course-old-price-text">$84.99</div>
</section>"""


def test_tagged_cards(spark):
    nolink = '<section class="course-product-card"><h2>No link</h2></section>'
    pages = spark.createDataFrame([(1, "u", f"<body>{CARD}{nolink}{CARD}</body>")],
                                  "page_id long, url string, html string")
    cards = extract.tagged_cards(extract.walk_cards(pages)).orderBy("pos").collect()
    assert [c["pos"] for c in cards] == [0, 2]
    c = cards[0]
    assert (c["title"], c["course_url"], c["instructor"]) == (
        "Py 101", "https://www.udemy.com/course/py/", "Ann")
    assert (c["rating"], c["reviews"], c["duration_hours"], c["lectures"], c["level"]) == (
        4.6, 22772, 99.5, 429, "All Levels")
    assert (c["current_price"], c["original_price"]) == ("$13.99", "$84.99")


def test_cards_are_walked_not_matched():
    """Elements inside elements of the same tag, entities, parts that are open at the end."""
    page = ('<section class="a course-product-card"><section><h2>A &amp; <span>B<br>C</span></h2>'
            '</section><div data-purpose="course-price-text"><div>now</div> $5</div>'
            '<div data-purpose="course-price-text">twice</div></section><p>between'
            '<section class="course-product-card"><a href="/x"></a><a href="/course/d/">'
            '<ul class="tag-list"><li>3 ratings<li>2 lectures</ul></p></section>'
            '<section class="course-product-card"><h2>open')
    one, two, three = extract.CardWalker().walk(page)
    assert {k: " ".join(v.split()) for k, v in one.items()} == {
        "title": "A & B C", "current_price": "now $5"}
    assert two["link"] == "/course/d/" and two["tags"].split() == "3 ratings 2 lectures".split()
    assert three == {"title": "open"}
    assert extract.CardWalker().walk("") == []


def test_pages_without_cards(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>none</p>")], "page_id long, html string")
    assert extract.tagged_cards(extract.walk_cards(pages)).count() == 0


def test_text_cards(spark):
    html = ('<li><a href="/learn/ml"><h3>ML</h3></a><p>By hand</p>'
            '<span aria-label="rating">4,8 stars</span> 150K students Débutant</li>')
    df = spark.createDataFrame([(html,)], "card string")
    c = extract.text_cards(df).first()
    assert (c["title"], c["course_url"], c["rating"], c["num_reviews"], c["level"], c["price"],
            c["description"]) == ("ML", "https://www.coursera.org/learn/ml", 4.8, 150000,
                                  "Beginner", "Subscription", "By hand")


def test_assemble_limits_per_topic(spark):
    rows = [("a", "u1", 1), ("a", "u1", 2), ("a", "u2", 3), ("a", "u3", 4), ("b", "u1", 5),
            ("b", None, 6)]
    df = spark.createDataFrame(rows, "topic string, url string, pos int")
    out = extract.assemble(df, "topic", "url", ["pos"], 2).collect()
    assert {(r["topic"], r["url"], r["pos"]) for r in out} == {
        ("a", "u1", 1), ("a", "u2", 3), ("b", "u1", 5)}
