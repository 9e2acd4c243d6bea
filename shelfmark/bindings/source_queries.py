"""Sources, line quarantine, card extraction, harvest, standardisation, cleaning, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.bindings import views as V
from shelfmark.bindings.registry import query
from shelfmark.bindings.sql import chain, in_list, lit, r6, rnd, sql, title_case
from shelfmark.functions import columns as C
from shelfmark.operators import cleaning, extract, features, prices, standardise
from shelfmark.operators.common import dense_index, scratch
from shelfmark.sources import files, lines

WS = C.SPACE_RUN


# -- A ---------------------------------------------------------------------------------------

@query("A01_A08_catalog_csv", sql("""
    SELECT course_id AS id, title, instructor AS partner, rating, category,
           platform AS source_domain, num_reviews AS num_ratings, duration_hours, level_enc,
           price FROM courses"""))
def catalog_csv(spark, base):
    df = V.courses(spark, base).select(
        F.col("course_id").alias("id"), "title", F.col("instructor").alias("partner"), "rating",
        "category", F.col("platform").alias("source_domain"),
        F.col("num_reviews").alias("num_ratings"), "duration_hours", "level_enc", "price")
    out = scratch(spark, "catalog")
    df.write.option("header", True).option("sep", ";").csv(out)
    return files.read_catalog(spark, out).drop(files.CORRUPT)


@query("A01_mixed_folder", sql("""
    SELECT course_id AS id, title, rating, category, num_reviews AS num_ratings,
           CASE WHEN course_id % 3 = 2 THEN NULL ELSE price END AS price FROM courses"""))
def mixed_folder(spark, base):
    """One folder with three kinds of files: separators, column orders and columns differ."""
    df = V.courses(spark, base).select(
        F.col("course_id").alias("id"), "title", "rating", "category",
        F.col("num_reviews").alias("num_ratings"), "price")
    out, orders = scratch(spark, "mixed"), (
        (";", ["id", "title", "rating", "category", "num_ratings", "price"]),
        (",", ["price", "category", "id", "num_ratings", "title", "rating"]),
        (",", ["title", "num_ratings", "id", "rating", "category"]))
    for kind, (sep, names) in enumerate(orders):
        df.filter(F.col("id") % 3 == kind).select(names).write.mode("append").option(
            "header", True).option("sep", sep).csv(out)
    return files.read_catalog(spark, out).select(df.columns)


@query("A02_behaviour_documents", sql("""
    SELECT 'user_' || CAST(user_id AS VARCHAR) AS username, 'clicks' AS kind, course_id,
           category AS detail, timestamp FROM clicks
    UNION ALL SELECT 'user_' || CAST(user_id AS VARCHAR), 'searches', NULL, query, timestamp
    FROM searches
    UNION ALL SELECT 'user_' || CAST(user_id AS VARCHAR), 'favorites', course_id, NULL, NULL
    FROM favorites"""))
def behaviour_documents(spark, base):
    """One document per event; the flat tables come back as one."""
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    click = F.struct("course_id", F.col("course_title").alias("title"), "category", "level",
                     "platform", "timestamp")

    def docs(df, **parts):
        return df.select(F.to_json(F.create_map(name, F.struct(*[
            F.array(v).alias(k) for k, v in parts.items()]))).alias("value"))

    texts = (docs(V.clicks(spark, base), clicks=click)
             .unionByName(docs(V.searches(spark, base),
                               searches=F.struct("query", "timestamp")))
             .unionByName(docs(V.favorites(spark, base), favorites=F.col("course_id"))))
    flat = files.flatten_behaviour(texts)
    none = F.lit(None)
    return (flat["clicks"].select("username", F.lit("clicks").alias("kind"), "course_id",
                                  F.col("category").alias("detail"), "timestamp")
            .unionByName(flat["searches"].select(
                "username", F.lit("searches").alias("kind"),
                none.cast("bigint").alias("course_id"), F.col("query").alias("detail"),
                "timestamp"))
            .unionByName(flat["favorites"].select(
                "username", F.lit("favorites").alias("kind"), "course_id",
                none.cast("string").alias("detail"), none.cast("string").alias("timestamp"))))


@query("A03_user_documents", sql("SELECT username, NULL::VARCHAR AS email, created_at, "
                                 "last_login FROM users"))
def user_documents(spark, base):
    docs = V.users(spark, base).select(F.to_json(F.create_map(
        "username", F.struct(F.lit("hidden").alias("password"), "created_at", "last_login")))
        .alias("value"))
    return files.flatten_users(docs)


@query("A04_A09_card_records", sql("""
    SELECT title, url, instructor, rating, num_reviews AS reviews, price AS current_price
    FROM courses"""))
def card_records(spark, base):
    """Arrays of at most a thousand cards, a file each, and the rows once more as lines."""
    out = scratch(spark, "cards")
    cards = V.courses(spark, base).select(
        "course_id", "title", "url", "instructor", "rating",
        F.col("num_reviews").alias("reviews"), F.col("price").alias("current_price"))
    arrays = cards.groupBy(F.floor(F.col("course_id") / 1000).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*cards.columns[1:]))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{out}/arrays")
    back = files.read_cards(spark, f"{out}/arrays")
    files.write_cards(back, f"{out}/lines")
    return spark.read.schema(files.S.CARD_RECORD).json(f"{out}/lines").select(
        "title", "url", "instructor", "rating", "reviews", "current_price")


@query("A07_verified_write", sql("""
    SELECT count(*) AS written, count(*) AS reloaded FROM courses"""))
def verified_write(spark, base):
    out = scratch(spark, "verified")
    n = files.write_catalog(V.courses(spark, base), out)
    return spark.read.parquet(out).agg(F.lit(n).cast("bigint").alias("written"),
                                       F.count(F.lit(1)).alias("reloaded"))


@query("A05_interaction_tables", sql("""
    SELECT 'users' AS table_name, count(*) AS n, min(created_at) AS first_seen FROM users
    UNION ALL SELECT 'searches', count(*), min(timestamp) FROM searches
    UNION ALL SELECT 'clicks', count(*), min(timestamp) FROM clicks
    UNION ALL SELECT 'favorites', count(*), min(timestamp) FROM favorites
    UNION ALL SELECT 'saved_paths', 0, NULL"""))
def interaction_tables(spark, base):
    """Written in two batches each, the second of them twice, and read back."""
    out = _appended(spark, base)
    return files.union_ragged([
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
               F.min("created_at" if name == "users" else "timestamp").alias("first_seen"))
        for name, df in files.read_interactions(spark, out).items()])


def _appended(spark, base):
    """Interaction tables in a new folder; a batch that is sent again must not count twice."""
    out = scratch(spark, "interactions")
    frames = {"users": V.users(spark, base).withColumns({
        c: F.lit(None).cast("string") for c in ("email", "password")}),
        "searches": V.searches(spark, base), "clicks": V.clicks(spark, base),
        "favorites": V.favorites(spark, base)}
    for name, df in frames.items():
        for batch, part in (("odd", "id % 2 = 1"), ("even", "id % 2 = 0"), ("even", "true")):
            files.append_interactions(df.filter(part), out, name, batch)
    return out


@query("H06_interaction_append", sql("""
    SELECT id, user_id, course_id, category, level, platform, timestamp FROM clicks"""))
def interaction_append(spark, base):
    return files.read_interactions(spark, _appended(spark, base))["clicks"].select(
        "id", "user_id", "course_id", "category", "level", "platform", "timestamp")


@query("A06_line_quarantine", sql(rf"""
    SELECT doc_id, pos, CASE WHEN len(parts) < 10 THEN 'too_few_fields'
        WHEN len(list_filter(parts[1:5], lambda p: trim(p) IN
             {in_list([K.MISSING_PRICE, K.COURSERA_PRICE])})) = 5 THEN 'repeated_price' END AS fault
    FROM (SELECT doc_id, pos, string_split(regexp_replace(line, '^{WS}|{WS}$', '', 'g'), ',')
                 AS parts
          FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
                FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""))
def line_quarantine(spark, base):
    rows = V.table(spark, base, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return lines.mark_lines(rows).select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                                         "fault")


@query("A06_line_counts", sql(r"""
    SELECT count(*) AS lines, count(*) FILTER (n < 10) AS removed,
           CAST(0 AS BIGINT) AS repeated_price, count(*) FILTER (n < 10) AS too_few_fields
    FROM (SELECT len(string_split(line, ',')) AS n
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))"""))
def line_counts(spark, base):
    rows = V.table(spark, base, "documents").select(F.explode(F.split("text", "\n"))
                                                    .alias("value"))
    return lines.fault_counts(lines.mark_lines(rows))


@query("A10_declared_columns", sql(
    "SELECT " + ", ".join(
        {"platform": "platform", "title": "title", "category": "category",
         "instructor": "instructor", "rating": "rating", "num_reviews": "num_reviews",
         "price": "price", "level": "level", "url": "url"}.get(c, "''") + f" AS {c}"
        for c in K.RAW_COLUMNS) + " FROM courses"))
def declared_columns(spark, base):
    return files.enforce_columns(V.courses(spark, base), K.RAW_COLUMNS)


@query("A11_ragged_union", sql("""
    SELECT course_id, title, category, url, CAST(NULL AS VARCHAR) AS lang FROM (
      SELECT course_id, title, category, url FROM courses)
    UNION ALL SELECT doc_id, text, source, NULL, lang FROM documents"""))
def ragged_union(spark, base):
    docs = V.table(spark, base, "documents").select(
        F.col("doc_id").alias("course_id"), F.col("text").alias("title"),
        F.col("source").alias("category"), "lang")
    return files.union_ragged(
        [V.courses(spark, base).select("course_id", "title", "category", "url"), docs])


def _sql_clean(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), '&[a-z]+;', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    c = f"regexp_replace({c}, '{WS}', ' ', 'g')"
    return rf"trim(regexp_replace({c}, '[^\x00-\x7F\x{{C0}}-\x{{FF}}]+', ' ', 'g'))"


VISIBLE = _sql_clean(
    r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')")
PAGE_FIELDS = {"pages_text": f"SELECT page_id, html, {VISIBLE} AS t FROM pages"}


def _tag(tag: str) -> str:
    found = rf"regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"
    return f"nullif({_sql_clean(found)}, '')"


@query("A13_page_cards", sql(rf"""
    SELECT page_id, {_tag('h1')} AS title,
        CASE WHEN starts_with(link, '/') THEN 'https://www.coursera.org' || link ELSE link END
            AS course_url,
        CASE WHEN contains(lower(t), 'free') OR contains(lower(t), 'gratuit') THEN 'Free'
             ELSE coalesce(nullif(regexp_extract(t, '[\$€£]\s*(\d+(?:[.,]\d{{2}})?)', 0), ''),
                           'Subscription') END AS price,
        {_tag('p')} AS description
    FROM (SELECT *, nullif(regexp_extract(html, '(?is)<a\s[^>]*href="([^"]*)"', 1), '') AS link
          FROM pages_text)""", PAGE_FIELDS))
def page_cards(spark, base):
    pages = V.table(spark, base, "pages").select("page_id", "html")
    return extract.text_cards(pages, "html", title_tags=("h1",)).select(
        "page_id", "title", "course_url", "price", "description")


@query("A13_tagged_cards", sql("""
    SELECT course_id // 4 AS page_id, course_id % 4 AS pos, title,
           'https://www.udemy.com/course/' || CAST(course_id AS VARCHAR) || '/' AS course_url,
           instructor, rating, num_reviews AS reviews, duration_hours, course_id % 300 AS lectures,
           CASE WHEN level = 'Advanced' THEN 'N/A' ELSE level END AS level,
           '$' || price AS current_price, 'N/A' AS original_price
    FROM courses WHERE course_id % 7 <> 0"""))
def tagged_cards(spark, base):
    """Pages of four marked-up cards each; every seventh course has no link and gives no card."""
    c = V.courses(spark, base)

    def tag(name, attrs, *inside):
        return F.concat(F.lit(f"<{name} {attrs}>"), *inside, F.lit(f"</{name}>"))

    name = tag("h2", "class=t", tag("div", "", "title"), F.lit("<br>"))
    link = F.concat(F.lit('<a href="/course/'), F.col("course_id").cast("string"), F.lit('/">'))
    level = F.when(F.col("level") == "Advanced", F.lit("")).otherwise(F.concat(
        F.lit("<li>"), "level", F.lit("</li>")))
    card = tag(
        "section", 'class="x course-product-card--main"',
        F.when(F.col("course_id") % 7 == 0, name).otherwise(F.concat(link, name, F.lit("</a>"))),
        tag("section", "class=inner", tag("span", 'data-purpose="safe-visible-instructors"',
                                          F.lit("<b>"), "instructor", F.lit("</b>"))),
        tag("span", 'data-purpose="rating-number"', F.col("rating").cast("string")),
        tag("ul", 'class="tag-list-module--list"', F.lit("<li>"), F.format_number(
            "num_reviews", 0), F.lit(" ratings</li><li>"), F.col("duration_hours").cast("string"),
            F.lit(" total hours</li><li>"), (F.col("course_id") % 300).cast("string"),
            F.lit(" lectures</li>"), level),
        tag("div", 'data-purpose="course-price-text"', tag("div", "", F.lit("$"), "price")))
    pages = c.select(F.floor(F.col("course_id") / 4).alias("page_id"), F.struct(
        "course_id", card.alias("card")).alias("c")).groupBy("page_id").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list("c")), lambda x: x["card"]), "\n<hr>")
            .alias("html"))
    out = extract.tagged_cards(extract.walk_cards(pages))
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "title", "course_url",
                      "instructor", "rating", "reviews", "duration_hours", "lectures", "level",
                      "current_price", "original_price")


@query("I09_I14_text_fields", sql(rf"""
    SELECT page_id,
        try_cast(replace(regexp_extract(t, '([\d,]+)\s*ratings?', 1), ',', '') AS BIGINT)
            AS reviews,
        try_cast(regexp_extract(t, '([\d.]+)\s*total hours?', 1) AS DOUBLE) AS hours,
        try_cast(regexp_extract(t, '(\d+)\s*lectures?', 1) AS BIGINT) AS lectures,
        {chain('t', [(k, k) for k in K.TAG_LEVELS], "'N/A'")} AS tag_level,
        try_cast(replace(regexp_extract(t, '(\d+[.,]?\d*)', 1), ',', '.') AS DOUBLE) AS rating,
        CAST(floor(try_cast(replace(regexp_extract(t, '(?i)\(?([\d.,]+)\s*[KkMm]?\)?\s*(?:reviews?|avis|étudiants?|students?)', 1), ',', '.') AS DOUBLE)
            * CASE WHEN contains(lower(t), 'k') THEN 1e3 WHEN contains(lower(t), 'm') THEN 1e6
                   ELSE 1e0 END) AS BIGINT) AS num_reviews,
        {chain('lower(t)', [(w, label) for label, ws in K.CARD_LEVELS for w in ws], 'NULL')}
            AS card_level
    FROM pages_text""", PAGE_FIELDS))
def text_fields(spark, base):
    t = extract.visible_text(F.col("html"))
    return V.table(spark, base, "pages").select("page_id", t.alias("t")).select(
        "page_id", C.review_count("t").alias("reviews"), C.total_hours("t").alias("hours"),
        C.lecture_count("t").alias("lectures"), C.tag_level("t").alias("tag_level"),
        C.rating_in_text("t").alias("rating"),
        C.review_count_suffixed("t").alias("num_reviews"), C.card_level("t").alias("card_level"))


@query("A14_harvest", sql(r"""
    SELECT topic, url, page_id, topic_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY page_id) AS topic_rank FROM (
        SELECT page_id, url, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS topic,
               row_number() OVER (PARTITION BY regexp_extract(url, '://[^/]+/([a-z]+)/', 1), url
                                  ORDER BY page_id) AS r
        FROM pages) WHERE r = 1) WHERE topic_rank <= 70"""))
def harvest(spark, base):
    pages = V.table(spark, base, "pages").select(
        "page_id", "url", F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1).alias("topic"))
    return extract.assemble(pages, "topic", "url", ["page_id"], 70).select(
        "topic", "url", "page_id", F.col("topic_rank").cast("bigint").alias("topic_rank"))


@query("A15_harvest_summary", sql("""
    SELECT platform, count(*) AS n FROM courses GROUP BY platform
    UNION ALL SELECT 'total', count(*) FROM courses"""))
def harvest_summary(spark, base):
    return extract.harvest_summary(V.courses(spark, base))


@query("A15_harvest_preview", sql("""
    SELECT platform, course_id, title, place FROM (
      SELECT *, row_number() OVER (PARTITION BY platform ORDER BY ingest_seq) AS place
      FROM courses) WHERE place <= 3"""))
def harvest_preview(spark, base):
    return extract.harvest_preview(V.courses(spark, base)).select(
        "platform", "course_id", "title", F.col("place").cast("bigint").alias("place"))


# -- B ---------------------------------------------------------------------------------------

@query("B01_aliases", """
    SELECT p_partkey AS id, p_brand AS partner, p_name AS title_clean, p_partkey AS course_id,
           p_brand AS instructor, p_name AS combined_text FROM part""")
def aliases(spark, base):
    part = V.table(spark, base, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("partner"),
        F.col("p_name").alias("title_clean"))
    return standardise.add_aliases(part)


@query("B02_dense_ids", """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS course_id FROM orders""")
def dense_ids(spark, base):
    return dense_index(V.table(spark, base, "orders").select("o_orderkey"), ["o_orderkey"],
                       "course_id")


@query("B03_B06_defaults", sql(f"""
    SELECT doc_id, {chain('lower(text)', [(w, c) for c, ws in K.TITLE_CATEGORIES for w in ws],
                          "'General'")} AS category,
           {chain('lower(text)', [(w, c) for c, ws in K.METADATA_LEVELS for w in ws],
                  "'All Levels'")} AS level,
           'Free' AS price, upper(lang[1]) || lower(lang[2:]) AS platform
    FROM documents"""))
def defaults(spark, base):
    docs = V.table(spark, base, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("text").alias("metadata"),
        F.col("lang").alias("platform"))
    return standardise.add_defaults(docs).select("doc_id", "category", "level", "price",
                                                 "platform")


@query("B07_combined_text", sql("""
    SELECT course_id, lower(title || ' ' || category || ' ' || level) AS combined_text
    FROM courses"""))
def combined_text(spark, base):
    gap = V.courses(spark, base).withColumn(
        "combined_text", F.when(F.col("level") != "Advanced", F.col("title")))
    return standardise.add_combined_text(gap).select("course_id", "combined_text")


@query("B08_title_category_text", sql("""
    SELECT course_id, lower(title || ' ' || category) AS combined_text FROM text_courses"""))
def title_category_text(spark, base):
    return V.text_courses(spark, base).select(
        "course_id", standardise.title_category_text("title").alias("combined_text"))


@query("B09_weighted_text", sql("""
    SELECT course_id, repeat(category || ' ', 3) || title AS weighted FROM text_courses"""))
def weighted_text(spark, base):
    return V.text_courses(spark, base).select("course_id",
                                              standardise.weighted_text(3).alias("weighted"))


STOPS = in_list(K.nlp_stop_words())


def nlp_sql(x: str) -> str:
    return (f"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace("
            f"lower(coalesce({x}, '')), '{C.URL_RUN}', '', 'g'), '{C.NON_WORD}', ' ', 'g'), "
            f"'{WS}'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, "
            rf"'\p{{Nd}}+') AND w NOT IN {STOPS}), ' ')")


@query("B10_feature_text", sql(f"""
    SELECT course_id, {nlp_sql("title || ' ' || category")} AS combined_text
    FROM text_courses"""))
def feature_text(spark, base):
    df = V.text_courses(spark, base).drop("combined_text")
    return df.select("course_id", standardise.feature_text(df).alias("combined_text"))


@query("B11_parse_time", sql("""
    SELECT id, strftime(try_cast(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS scraped_at
    FROM clicks"""))
def parse_time(spark, base):
    raw = V.clicks(spark, base).select("id", F.col("timestamp").alias("scraped_at"))
    return standardise.parse_scraped_at(raw).select(
        "id", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("B12_map_points", sql("""
    SELECT l.course_id AS id, substring(title, 1, 50) AS title, category,
           CAST(l.cluster AS INTEGER) AS cluster, x, y, rating, level
    FROM labelled l LEFT JOIN points p ON p.id = l.course_id"""))
def map_points(spark, base):
    xy = V.points(spark, base).select(F.col("id").alias("course_id"),
                                      F.col("features")[0].alias("x"),
                                      F.col("features")[1].alias("y"))
    return standardise.map_points(V.labelled_courses(spark, base).join(xy, "course_id", "left"))


@query("B13_bubbles", sql("""
    SELECT course_id, category, rating, popularity_score, num_reviews / 10e0 AS bubble_size
    FROM rated_courses"""))
def bubbles(spark, base):
    return standardise.bubbles(V.rated_courses(spark, base))


@query("B14_display_users", sql("""
    SELECT id, username, substring(created_at, 1, 10) AS created_day,
           coalesce(substring(last_login, 1, 10), 'N/A') AS last_login_day FROM users"""))
def display_users(spark, base):
    return standardise.display_user(V.users(spark, base))


@query("B14_display_courses", sql(f"""
    SELECT course_id, CASE WHEN title IS NULL OR title = '' THEN 'N/A'
               WHEN length(title) > 100 THEN substring(title, 1, 100) || '...'
               ELSE title END AS short_title,
           CAST(floor(rating) AS INTEGER) AS stars, {rnd('rating', 1)} AS rating_1dp,
           array_to_string(list_transform(string_split(platform || ', ' || category, ','),
                                          lambda s: trim(s)), '|') AS skill_list
    FROM text_courses"""))
def display_courses(spark, base):
    df = V.text_courses(spark, base).withColumn("skills", F.concat_ws(", ", "platform",
                                                                      "category"))
    return standardise.display_course(df).withColumn("skill_list",
                                                     F.array_join("skill_list", "|"))


@query("B15_topic_labels", f"""
    SELECT slug, {title_case("replace(slug, '-', ' ')")} AS topic_label,
           replace(replace(slug, '-', ' '), ' ', '+') AS search_query,
           replace(slug, '-', ', ') AS skills
    FROM (SELECT DISTINCT lower(p_type) || '-' || replace(p_name, ' ', '-') AS slug FROM part)""")
def topic_labels(spark, base):
    slugs = V.table(spark, base, "part").select(F.concat(
        F.lower("p_type"), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")))
        .alias("slug")).distinct()
    return slugs.select("slug", *[c.alias(n)
                                  for n, c in standardise.topic_labels("slug").items()])


@query("B16_absolute_urls", sql("""
    SELECT course_id, 'https://www.udemy.com' || url AS url FROM courses
    UNION ALL SELECT page_id, url FROM pages"""))
def absolute_urls(spark, base):
    both = V.courses(spark, base).select("course_id", "url").unionByName(
        V.table(spark, base, "pages").select(F.col("page_id").alias("course_id"), "url"))
    return both.select("course_id", C.absolute_url("url", extract.UDEMY).alias("url"))


# -- C ---------------------------------------------------------------------------------------

@query("C01_first_titles", sql("""
    SELECT course_id, title FROM courses
    QUALIFY row_number() OVER (PARTITION BY title ORDER BY ingest_seq) = 1"""))
def first_titles(spark, base):
    return cleaning.drop_duplicate_titles(V.courses(spark, base)).select("course_id", "title")


@query("C02_clean_text", f"SELECT page_id, {_sql_clean('html')} AS txt FROM pages")
def clean_text(spark, base):
    return V.table(spark, base, "pages").select("page_id", C.clean_text("html").alias("txt"))


@query("C03_clean_titles", sql(f"""
    SELECT course_id, t AS title FROM (SELECT course_id, {_sql_clean('title')} AS t
                                       FROM text_courses) WHERE length(t) > 5"""))
def clean_titles(spark, base):
    return cleaning.clean_titles(V.text_courses(spark, base)).select("course_id", "title")


@query("C04_clean_descriptions", sql(f"""
    SELECT course_id, coalesce(nullif({_sql_clean("CASE WHEN num_reviews % 3 > 0 THEN title END")},
                                      ''), category) AS description
    FROM text_courses"""))
def clean_descriptions(spark, base):
    df = V.text_courses(spark, base).select(
        "course_id", F.col("category").alias("title"),
        F.when(F.col("num_reviews") % 3 > 0, F.col("title")).alias("description"))
    return cleaning.clean_descriptions(df).select("course_id", "description")


@query("C05_normal_category", sql(f"""
    SELECT course_id, CASE WHEN t IS NULL THEN 'Other' ELSE
        {chain('lower(trim(t))', K.CATEGORY_MAPPING, title_case('t'))} END AS category
    FROM (SELECT course_id, CASE WHEN level <> 'Advanced' THEN title END AS t
          FROM text_courses)"""))
def normal_category(spark, base):
    t = F.when(F.col("level") != "Advanced", F.col("title"))
    return V.text_courses(spark, base).select("course_id", C.normal_category(t)
                                              .alias("category"))


@query("C06_normal_level", sql(f"""
    SELECT course_id, {chain('lower(trim(title))', K.LEVEL_MAPPING, "'All Levels'")} AS level
    FROM text_courses"""))
def normal_level(spark, base):
    return V.text_courses(spark, base).select("course_id", C.normal_level("title").alias("level"))


@query("C07_clean_rating", """
    SELECT o_orderkey, greatest(0e0, least(5e0, coalesce(try_cast(replace(
        replace(CAST(o_totalprice AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) / 1e0, 0e0)))
        AS big, coalesce(greatest(0e0, least(5e0, try_cast(o_orderpriority[1] AS DOUBLE))), 0e0)
        AS small FROM orders""")
def clean_rating(spark, base):
    price = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    return V.table(spark, base, "orders").select(
        "o_orderkey", C.clean_rating(price).alias("big"),
        C.clean_rating(F.substring("o_orderpriority", 1, 1)).alias("small"))


@query("C08_clean_reviews", r"""
    SELECT doc_id, coalesce(try_cast(regexp_extract(t, '(\d+)', 1) AS BIGINT)
        * CASE WHEN contains(t, 'k') THEN 1000 WHEN contains(t, 'm') THEN 1000000 ELSE 1 END, 0)
        AS num_reviews
    FROM (SELECT doc_id, regexp_replace(lower(n_chars || ' ' || source || ' ' || lang), '[, ]',
                                        '', 'g') AS t FROM documents)""")
def clean_reviews(spark, base):
    text = F.concat_ws(" ", F.col("n_chars").cast("string"), "source", "lang")
    return V.table(spark, base, "documents").select("doc_id", C.clean_reviews(text)
                                                    .alias("num_reviews"))


PRICE_CASES = ("CASE level WHEN 'Beginner' THEN 'gratuit' WHEN 'Intermediate' THEN "
               "'$' || price WHEN 'Advanced' THEN platform ELSE NULL END")


def _mixed_price():
    return (F.when(F.col("level") == "Beginner", F.lit("gratuit"))
            .when(F.col("level") == "Intermediate", F.concat(F.lit("$"), F.col("price")))
            .when(F.col("level") == "Advanced", F.col("platform")))


@query("C09_price_labels", sql(rf"""
    SELECT course_id, CASE WHEN p IS NULL THEN 'Subscription'
        WHEN contains(lower(p), 'free') OR contains(lower(p), 'gratuit') OR trim(p) = '0'
            THEN 'Free'
        WHEN contains(lower(p), 'subscription') OR contains(lower(p), 'abonnement')
            THEN 'Subscription'
        WHEN regexp_matches(p, '[\d.,]+') THEN p ELSE 'Paid' END AS price
    FROM (SELECT course_id, {PRICE_CASES} AS p FROM courses)"""))
def price_labels(spark, base):
    return V.courses(spark, base).select("course_id", C.clean_price_label(_mixed_price())
                                         .alias("price"))


@query("C10_fill_missing", sql("""
    SELECT course_id, title, CASE WHEN level <> 'Advanced' THEN category ELSE 'Other' END
           AS category, coalesce(CASE WHEN num_reviews > 25 THEN rating END, 0e0) AS rating
    FROM courses WHERE length(CASE WHEN level <> 'Beginner' THEN title ELSE '' END) > 0"""))
def fill_missing(spark, base):
    df = V.courses(spark, base).select(
        "course_id", F.when(F.col("level") != "Beginner", F.col("title")).alias("title"),
        F.when(F.col("level") != "Advanced", F.col("category")).alias("category"),
        F.when(F.col("num_reviews") > 25, F.col("rating")).alias("rating"))
    return cleaning.fill_missing(df)


@query("C11_fill_price", sql(f"""
    SELECT course_id, coalesce({PRICE_CASES}, {lit(K.MISSING_PRICE)}) AS price FROM courses"""))
def fill_price(spark, base):
    return cleaning.fill_price(V.courses(spark, base).select("course_id",
                                                             _mixed_price().alias("price")))


@query("C12_price_tokens", sql(rf"""
    SELECT course_id, CASE WHEN length(p) > 0 THEN coalesce(nullif(regexp_extract(p,
        '\$?(\d+\.\d+|\d+)', 0), ''), p) END AS price
    FROM (SELECT course_id, {PRICE_CASES} AS p FROM courses)"""))
def price_tokens(spark, base):
    return V.courses(spark, base).select("course_id", C.price_token(_mixed_price())
                                         .alias("price"))


def _raw_catalog(spark, base):
    """Text courses with what a raw catalog may hold in every column."""
    return V.text_courses(spark, base).select(
        "ingest_seq", "title", F.lit("").alias("description"), "category", "level",
        F.regexp_replace(F.col("rating").cast("string"), r"\.", ",").alias("rating"),
        F.concat(F.col("num_reviews").cast("string"), F.lit(" avis")).alias("num_reviews"),
        F.lit("0").alias("price"), "platform")


CLEANED = {"cleaned": f"""
    SELECT ingest_seq, title, title AS description, category, level, rating, num_reviews,
           'Free' AS price, platform
    FROM (SELECT ingest_seq, {_sql_clean('title')} AS title,
                 {chain('lower(trim(category))', K.CATEGORY_MAPPING, title_case('category'))}
                     AS category,
                 {chain('lower(trim(level))', K.LEVEL_MAPPING, "'All Levels'")} AS level,
                 rating, num_reviews, platform
          FROM text_courses
          QUALIFY row_number() OVER (PARTITION BY text_courses.title ORDER BY ingest_seq) = 1)
    WHERE length(title) > 5"""}


@query("C13_clean_catalog", sql("""
    SELECT *, row_number() OVER (ORDER BY ingest_seq) AS course_id FROM cleaned""", CLEANED))
def clean_catalog(spark, base):
    return cleaning.clean_catalog(_raw_catalog(spark, base))[0]


@query("C13_cleaning_counts", sql("""
    SELECT (SELECT count(*) FROM text_courses) AS rows_before,
           (SELECT count(*) FROM cleaned) AS rows_after,
           (SELECT count(*) FROM text_courses) - (SELECT count(*) FROM cleaned)
               AS rows_removed""", CLEANED))
def cleaning_counts(spark, base):
    return cleaning.cleaning_counts(_raw_catalog(spark, base))


@query("C14_shuffled", sql("""
    SELECT course_id, row_number() OVER (ORDER BY md5(CAST(course_id AS VARCHAR) || ':42'),
                                         course_id) - 1 AS position FROM courses"""))
def shuffled(spark, base):
    return cleaning.shuffled(V.courses(spark, base).select("course_id"))


@query("C15_missing_profile", """
    SELECT 'o_orderkey' AS column_name, 'bigint' AS column_type, count(*) - count(o_orderkey)
           AS missing, count(*) AS row_count FROM orders
    UNION ALL SELECT 'priority', 'string', count(*) FILTER (o_orderpriority = '1-URGENT'),
           count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(*) FILTER (o_totalprice IS NULL
           OR isnan(o_totalprice)), count(*) FROM orders""")
def missing_profile(spark, base):
    df = V.table(spark, base, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
        .alias("priority"), "o_totalprice")
    return cleaning.missing_profile(df)


@query("C16_category_count", sql(f"""
    SELECT count(DISTINCT {chain('lower(trim(category))', K.CATEGORY_MAPPING,
                                 title_case('category'))}) AS n_categories FROM courses"""))
def category_count(spark, base):
    return cleaning.category_count(V.courses(spark, base))


# -- E01, I ----------------------------------------------------------------------------------

@query("E01_price_update", sql(rf"""
    SELECT course_id, CASE WHEN platform = 'coursera' THEN {lit(K.COURSERA_PRICE)}
                           WHEN k_url IS NOT NULL THEN new_price ELSE price END AS price,
           k_url IS NOT NULL AS price_matched
    FROM courses LEFT JOIN (
        SELECT lower(trim(p_name)) AS k_title, '/course/' || CASE WHEN l_partkey % 3 = 1 THEN 'old/' ELSE '' END
                   || CAST(l_partkey AS VARCHAR) AS k_url,
               CASE WHEN l_returnflag <> 'R'
                    THEN '$' || CAST(l_extendedprice AS VARCHAR) END AS new_price
        FROM lineitem JOIN part ON p_partkey = l_partkey
        QUALIFY row_number() OVER (PARTITION BY l_partkey
                                   ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)
      ON platform = 'udemy' AND lower(trim(title)) = k_title AND url = k_url"""))
def price_update(spark, base):
    item = V.table(spark, base, "lineitem")
    part = V.table(spark, base, "part")
    feed = item.join(part, item["l_partkey"] == part["p_partkey"]).select(
        F.col("p_name").alias("title"),
        F.concat(F.lit("/course/"), F.when(F.col("l_partkey") % 3 == 1, F.lit("old/"))
                 .otherwise(F.lit("")), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("l_returnflag") != "R", F.concat(
            F.lit("$"), F.col("l_extendedprice").cast("string"))).alias("current_price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return prices.update_prices(V.courses(spark, base), feed).select("course_id", "price",
                                                                     "price_matched")


@query("I01_nlp_clean", f"SELECT doc_id, {nlp_sql('text')} AS txt FROM documents")
def nlp_clean(spark, base):
    return V.table(spark, base, "documents").select("doc_id", C.nlp_clean("text").alias("txt"))


@query("I02_I04_codes", sql(rf"""
    SELECT course_id, CASE platform WHEN 'coursera' THEN 1 WHEN 'udemy' THEN 2 ELSE 0 END
               AS platform_encoded,
           CASE level WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 WHEN 'Advanced' THEN 3
                      ELSE 0 END AS level_encoded,
           CASE WHEN p IS NULL OR contains(lower(p), 'free') THEN 0e0
                WHEN contains(lower(p), 'subscription') THEN 1e0
                ELSE coalesce(try_cast(replace(nullif(regexp_extract(lower(p), '([\d.,]+)', 1),
                     ''), ',', '.') AS DOUBLE), 2e0) END AS price_encoded
    FROM (SELECT *, {PRICE_CASES} AS p FROM courses)"""))
def codes(spark, base):
    df = V.courses(spark, base).select("course_id", C.capitalise("platform").alias("platform"),
                                       "level", _mixed_price().alias("price"))
    return features.encode_columns(df).select("course_id", "platform_encoded", "level_encoded",
                                              "price_encoded")


@query("I03_path_level_code", sql("""
    SELECT course_id, CASE level WHEN 'Beginner' THEN 0 WHEN 'All Levels' THEN 1
           WHEN 'Intermediate' THEN 2 WHEN 'Advanced' THEN 3 ELSE 1 END AS path_level
    FROM courses"""))
def path_level_code(spark, base):
    return V.courses(spark, base).select("course_id", C.encode_path_level("level")
                                         .alias("path_level"))


@query("I05_I06_popularity", sql(f"""
    SELECT course_id, {r6('rating / (SELECT max(rating) FROM courses)')} AS rating_normalized,
           popularity_score FROM rated_courses"""))
def popularity(spark, base):
    return features.add_popularity(V.courses(spark, base)).select(
        "course_id", C.r6("rating_normalized").alias("rating_normalized"), "popularity_score")


@query("I07_one_hot", sql("""
    SELECT course_id, """ + ", ".join(
        f"CAST(category = '{c}' AS INTEGER) AS cat_{c.lower()}"
        for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM courses"))
def one_hot(spark, base):
    return features.one_hot_categories(
        V.courses(spark, base).select("course_id", "category")).drop("category")


@query("I07_category_vectors", """
    SELECT p_partkey AS course_id, dense_rank() OVER (ORDER BY p_name) AS place,
           (SELECT count(DISTINCT p_name) FROM part) AS places FROM part""")
def category_vectors(spark, base):
    """Names as categories, of which there is no bound."""
    from pyspark.ml.functions import vector_to_array
    df = V.table(spark, base, "part").select(F.col("p_partkey").alias("course_id"),
                                             F.col("p_name").alias("category"))
    hot = vector_to_array("category_vector")
    return features.category_vectors(df).select(
        "course_id", F.array_position(hot, 1.0).alias("place"),
        F.size(hot).cast("bigint").alias("places"))


@query("I08_feature_rows", sql(f"""
    SELECT course_id, {nlp_sql("title || ' ' || category")} AS combined_text,
           CASE platform WHEN 'coursera' THEN 1 ELSE 2 END AS platform_encoded,
           CASE level WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 WHEN 'Advanced' THEN 3
                      ELSE 0 END AS level_encoded,
           CAST(price AS DOUBLE) AS price_encoded,
           {r6('rating / (SELECT max(rating) FROM courses)')} AS rating_normalized,
           {r6('ln(1e0 + num_reviews) / (SELECT max(ln(1e0 + num_reviews)) FROM courses)')}
               AS reviews_normalized, popularity_score
    FROM rated_courses"""))
def feature_rows(spark, base):
    df = V.courses(spark, base).withColumn("platform", C.capitalise("platform"))
    out = features.engineer(df)
    rounded = {"rating_normalized": C.r6("rating_normalized"),
               "reviews_normalized": C.r6("reviews_normalized")}
    return out.withColumns(rounded).select("course_id", "combined_text",
                                           *features.feature_columns(out))


@query("M01_sql_functions", sql(rf"""
    SELECT doc_id, {nlp_sql('text')} AS nlp,
           {chain('lower(trim(text))', K.LEVEL_MAPPING, "'All Levels'")} AS level,
           {_sql_clean('text')} AS txt FROM documents"""))
def sql_functions(spark, base):
    from shelfmark.functions.sqlfunctions import register_functions
    register_functions(spark)
    return V.table(spark, base, "documents").selectExpr(
        "doc_id", "sm_nlp_clean(text) AS nlp", "sm_level(text) AS level",
        "sm_clean_text(text) AS txt")
