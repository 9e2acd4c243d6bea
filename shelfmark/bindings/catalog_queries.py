"""Lookups, listings, statistics, learning paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.bindings import views as V
from shelfmark.bindings.registry import query
from shelfmark.bindings.sql import r6, rnd, sql
from shelfmark.operators import catalog, stats
from shelfmark.operators.common import scratch
from shelfmark.sources import positions

LISTED = ("course_id", "title", "category", "platform", "level", "rating")
COLS = ", ".join(LISTED)


# -- D ---------------------------------------------------------------------------------------

@query("D01_D02_filters", sql(f"""
    SELECT {COLS} FROM courses WHERE platform = 'udemy' AND category = 'PROMO'
        AND level = 'Beginner' AND regexp_matches(lower(title), 'b[lo]+')"""))
def filters(spark, base):
    return catalog.filter_courses(V.courses(spark, base), {
        "platform": "udemy", "category": "PROMO", "level": "Beginner", "search": "B[lo]+",
    }).select(*LISTED)


@query("D02_literal_search", sql("""
    SELECT course_id FROM text_courses WHERE contains(lower(title), '. in')"""))
def literal_search(spark, base):
    df = V.text_courses(spark, base)
    return df.filter(catalog.contains_text(F.col("title"), ". In", literal=True)).select(
        "course_id")


@query("D03_D04_matches", sql("""
    SELECT course_id, regexp_matches(category, '(?i)eco|pro') AS in_category,
           regexp_matches(category, '(?i)small') OR regexp_matches(title, '(?i)small') AS in_either
    FROM courses"""))
def match_flags(spark, base):
    m = catalog.matches
    return V.courses(spark, base).select(
        "course_id", m("category", "eco|pro").alias("in_category"),
        (m("category", "small") | m("title", "small")).alias("in_either"))


@query("D05_min_rating", sql(f"""
    SELECT {COLS} FROM courses WHERE rating >= 4.5e0"""))
def min_rating(spark, base):
    return catalog.filter_courses(V.courses(spark, base), {"min_rating": "4.5"},
                                  apply_min_rating=True).select(*LISTED)


@query("D06_find_courses", sql("""
    SELECT o.o_custkey AS requested_id, c.course_id, c.title
    FROM (SELECT DISTINCT o_custkey FROM orders) o JOIN (
        SELECT course_id * 2 AS course_id, title, row_number() OVER (ORDER BY ingest_seq) - 1
               AS pos FROM courses) c
      ON CASE WHEN o.o_custkey % 2 = 0 AND o.o_custkey / 2 < (SELECT count(*) FROM courses)
              THEN c.course_id = o.o_custkey ELSE c.pos = o.o_custkey END"""))
def find_courses(spark, base):
    df = V.courses(spark, base).withColumn("course_id", F.col("course_id") * 2)
    wanted = V.table(spark, base, "orders").select(F.col("o_custkey").alias("course_id"))
    return catalog.find_courses(df, wanted).select("requested_id", "course_id", "title")


@query("D06_find_stored_courses", sql("""
    SELECT o.o_custkey AS requested_id, c.course_id, c.title
    FROM (SELECT DISTINCT o_custkey FROM orders) o JOIN (
        SELECT course_id * 2 AS course_id, title, row_number() OVER (ORDER BY ingest_seq) - 1
               AS pos FROM courses) c
      ON CASE WHEN o.o_custkey % 2 = 0 AND o.o_custkey / 2 < (SELECT count(*) FROM courses)
              THEN c.course_id = o.o_custkey ELSE c.pos = o.o_custkey END"""))
def find_stored_courses(spark, base):
    """The same from a catalog that is stored with its places."""
    out = scratch(spark, "placed")
    df = V.courses(spark, base).withColumn("course_id", F.col("course_id") * 2)
    positions.write_positions(df, ["ingest_seq"], out)
    wanted = V.table(spark, base, "orders").select(F.col("o_custkey").alias("course_id"))
    return catalog.find_stored_courses(spark, out, wanted).select("requested_id", "course_id",
                                                                  "title")


@query("D07_top_category_rows", sql("""
    SELECT course_id, category FROM text_courses WHERE category IN (
        SELECT category FROM text_courses GROUP BY category ORDER BY count(*) DESC, category
        LIMIT 10)"""))
def top_category_rows(spark, base):
    return catalog.in_top_categories(V.text_courses(spark, base)).select("course_id", "category")


@query("D08_platform_masks", sql("""
    SELECT course_id, platform = 'udemy' AS is_udemy, platform = 'coursera' AS is_coursera
    FROM courses"""))
def platform_masks(spark, base):
    return catalog.platform_masks(V.courses(spark, base)).select("course_id", "is_udemy",
                                                                 "is_coursera")


SEEDS = {"bolt": "blue bolt", "gear": "GEAR", "ring": "^small", "none": "zebra"}


@query("D09_seed_courses", sql(" UNION ALL ".join(f"""
    SELECT '{n}' AS seed, min(course_id) AS course_id FROM courses
    WHERE regexp_matches(title, '(?i){p}') HAVING count(*) > 0""" for n, p in SEEDS.items())))
def seed_courses(spark, base):
    return catalog.seed_courses(V.courses(spark, base), SEEDS)


@query("D11_account_checks", """
    SELECT c_custkey, CASE WHEN length(u) < 3 THEN 'username_too_short'
               WHEN length(p) < 4 THEN 'password_too_short'
               WHEN p <> q THEN 'confirmation_differs' END AS reason
    FROM (SELECT c_custkey, substring(c_mktsegment, 1, c_nationkey % 7) AS u,
                 CAST(c_custkey * 7 AS VARCHAR) AS p,
                 CASE WHEN c_nationkey > 5 THEN CAST(c_custkey * 7 AS VARCHAR) ELSE 'other' END
                     AS q FROM customer)""")
def account_checks(spark, base):
    p = (F.col("c_custkey") * 7).cast("string")
    accounts = V.table(spark, base, "customer").select(
        "c_custkey", F.expr("substring(c_mktsegment, 1, c_nationkey % 7)").alias("username"),
        p.alias("password"), F.when(F.col("c_nationkey") > 5, p).otherwise(F.lit("other"))
        .alias("confirm"))
    return catalog.check_accounts(accounts).select("c_custkey", "reason")


# -- F ---------------------------------------------------------------------------------------

@query("F01_top_categories", sql("""
    SELECT category, count(*) AS n FROM text_courses GROUP BY category
    ORDER BY n DESC, category LIMIT 10"""))
def top_categories(spark, base):
    return stats.value_counts(V.text_courses(spark, base), "category", 10)


@query("F02_platform_share", sql(f"""
    SELECT platform, count(*) AS n,
           {rnd('count(*) * 100e0 / (SELECT count(*) FROM courses)', 1)} AS percent
    FROM courses GROUP BY platform"""))
def platform_share(spark, base):
    return stats.share(V.courses(spark, base), "platform")


@query("F04_mean_rating", sql(f"""
    SELECT platform, {r6('avg(rating)')} AS avg_rating FROM courses GROUP BY platform"""))
def mean_rating(spark, base):
    return stats.mean_by(V.courses(spark, base), "platform", "rating", "avg_rating")


def _stats_sql(free: str) -> str:
    dims = " UNION ALL ".join(f"""
        SELECT '{d}', {d}, count(*), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)
        FROM courses GROUP BY {d}""" for d in ("platform", "category", "level"))
    return sql(f"""
        SELECT 'all' AS dim, CAST(NULL AS VARCHAR) AS value, count(*) AS n,
               {rnd('avg(rating)', 2)} AS avg_rating, {free} AS free_courses FROM courses
        UNION ALL {dims}""")


@query("F05_catalog_stats", _stats_sql("count(*)"))
def catalog_stats(spark, base):
    return stats.catalog_stats(V.courses(spark, base))


@query("F06_cleaned_stats", _stats_sql("count(*) FILTER (contains(price, '00'))"))
def cleaned_stats(spark, base):
    df = V.courses(spark, base).withColumn(
        "price", F.when(F.col("price").contains("00"), F.lit("Free")).otherwise(F.col("price")))
    return stats.catalog_stats(df, free=F.col("price") == "Free")


@query("F09_total_users", sql("SELECT count(*) AS total_users FROM users"))
def total_users(spark, base):
    return stats.total_rows(V.users(spark, base), "total_users")


@query("F10_distinct_values", sql("""
    SELECT 'category' AS dim, category AS value FROM courses GROUP BY category
    UNION ALL SELECT 'platform', platform FROM courses GROUP BY platform
    UNION ALL SELECT 'level', level FROM courses GROUP BY level"""))
def distinct_values(spark, base):
    df = V.courses(spark, base)
    parts = [stats.distinct_values(df, c).select(F.lit(c).alias("dim"), F.col(c).alias("value"))
             for c in ("category", "platform", "level")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("F12_rating_summary", sql(f"""
    SELECT {r6('avg(rating)')} AS mean, {r6('quantile_cont(rating, 5e-1)')} AS median,
           {r6('stddev_samp(rating)')} AS std, min(rating) AS min, max(rating) AS max
    FROM text_courses"""))
def rating_summary(spark, base):
    return stats.describe_rating(V.text_courses(spark, base))


@query("F13_rating_histogram", sql(f"""
    SELECT b AS bin, {r6('lo + (b - 1) * (hi - lo) / 20e0')} AS bin_from,
           {r6('lo + b * (hi - lo) / 20e0')} AS bin_to, count(course_id) AS n
    FROM (SELECT unnest(range(1, 21)) AS b),
         (SELECT min(rating) AS lo, max(rating) AS hi FROM text_courses)
         LEFT JOIN text_courses
           ON least(20, floor((rating - lo) / (hi - lo) * 20e0) + 1) = b
    GROUP BY b, lo, hi"""))
def rating_histogram(spark, base):
    return stats.histogram(V.text_courses(spark, base))


@query("F14_correlation", sql(f"""
    SELECT {r6('corr(rating, popularity_score)')} AS correlation FROM rated_courses"""))
def correlation(spark, base):
    return stats.correlation(V.rated_courses(spark, base))


@query("F15_top_partners", sql("""
    SELECT instructor, count(*) AS n FROM courses GROUP BY instructor
    ORDER BY n DESC, instructor LIMIT 10"""))
def top_partners(spark, base):
    return stats.value_counts(V.courses(spark, base), "instructor", 10)


@query("F16_level_distribution", sql(f"""
    SELECT level_enc, CASE level_enc WHEN 0 THEN 'Tous niveaux' WHEN 1 THEN 'Débutant'
               WHEN 2 THEN 'Intermédiaire' WHEN 3 THEN 'Avancé'
               ELSE 'Niveau ' || CAST(level_enc AS VARCHAR) END AS label, count(*) AS n,
           {rnd('count(*) * 100e0 / (SELECT count(*) FROM courses)', 1)} AS percent
    FROM (SELECT CASE WHEN num_reviews > 35 THEN 7 ELSE level_enc END AS level_enc FROM courses)
    GROUP BY level_enc"""))
def level_distribution(spark, base):
    df = V.courses(spark, base).withColumn(
        "level_enc", F.when(F.col("num_reviews") > 35, 7).otherwise(F.col("level_enc")))
    return stats.level_distribution(df)


@query("F17_duration_boxes", sql(f"""
    WITH top AS (SELECT category FROM text_courses GROUP BY category
                 ORDER BY count(*) DESC, category LIMIT 10),
    quart AS (SELECT category, quantile_cont(duration_hours, 25e-2) AS q1,
                     quantile_cont(duration_hours, 5e-1) AS med,
                     quantile_cont(duration_hours, 75e-2) AS q3
              FROM text_courses JOIN top USING (category) GROUP BY category),
    marked AS (SELECT *, duration_hours AS v, duration_hours >= q1 - 15e-1 * (q3 - q1)
                      AND duration_hours <= q3 + 15e-1 * (q3 - q1) AS inside
               FROM text_courses JOIN quart USING (category))
    SELECT category, count(*) AS n, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3,
           {r6('avg(v)')} AS mean,
           coalesce(min(v) FILTER (inside AND v <= q1), q1) AS whisker_low,
           coalesce(max(v) FILTER (inside AND v >= q3), q3) AS whisker_high,
           count(*) FILTER (NOT inside) AS outliers,
           {r6('med - 157e-2 * (q3 - q1) / sqrt(count(*))')} AS notch_low,
           {r6('med + 157e-2 * (q3 - q1) / sqrt(count(*))')} AS notch_high
    FROM marked GROUP BY category, q1, med, q3""").replace("\nWITH top", ",\ntop"))
def duration_boxes(spark, base):
    return stats.duration_boxes(V.text_courses(spark, base))


@query("F18_mean_duration", sql(f"""
    SELECT category, count(*) AS n, {rnd('avg(duration_hours)', 1)} AS mean_duration
    FROM text_courses GROUP BY category ORDER BY n DESC, category LIMIT 5"""))
def mean_duration(spark, base):
    return stats.mean_duration_top(V.text_courses(spark, base))


@query("F19_source_share", f"""
    SELECT source, count(*) AS n,
           {rnd('count(*) * 100e0 / (SELECT count(*) FROM documents)', 1)} AS percent
    FROM documents GROUP BY source""")
def source_share(spark, base):
    return stats.share(V.table(spark, base, "documents"), "source")


@query("F20_home_figures", sql(f"""
    SELECT count(*) AS total_courses, count(DISTINCT category) AS n_categories,
           {rnd('avg(rating)', 1)} AS avg_rating,
           (SELECT count(*) FROM clicks) AS total_clicks FROM courses"""))
def home_figures(spark, base):
    return stats.home_figures(V.courses(spark, base), V.clicks(spark, base))


# -- G ---------------------------------------------------------------------------------------

@query("G02_popular", sql("""
    SELECT course_id, title, popularity_score FROM rated_courses
    ORDER BY popularity_score DESC NULLS LAST, course_id LIMIT 10"""))
def popular(spark, base):
    return catalog.popular(V.rated_courses(spark, base), 10).select("course_id", "title",
                                                                    "popularity_score")


@query("G02_popular_in_category", sql("""
    SELECT course_id, title, rating FROM courses WHERE category = 'PROMO'
    ORDER BY rating DESC NULLS LAST, course_id LIMIT 7"""))
def popular_in_category(spark, base):
    return catalog.popular(V.courses(spark, base), 7, "PROMO").select("course_id", "title",
                                                                      "rating")


@query("G02_popular_per_category", sql("""
    SELECT category, course_id, row_number() OVER (PARTITION BY category
               ORDER BY popularity_score DESC NULLS LAST, course_id) AS rank
    FROM rated_text_courses QUALIFY rank <= 8"""))
def popular_per_category(spark, base):
    return catalog.popular_per_category(V.rated_text_courses(spark, base), 8).select(
        "category", "course_id", F.col("rank").cast("bigint").alias("rank"))


@query("G03_listing_page", sql("""
    SELECT course_id, title, rating FROM courses WHERE platform = 'udemy'
    ORDER BY rating DESC NULLS LAST, course_id LIMIT 12 OFFSET 24"""))
def listing_page(spark, base):
    return catalog.listing_page(V.courses(spark, base), 3, 12, "rating",
                                {"platform": "udemy"}).select("course_id", "title", "rating")


@query("G03_deep_page", sql("""
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1
           AS position FROM orders
    QUALIFY position // 12 = (SELECT count(*) // 24 FROM orders)"""))
def deep_page(spark, base):
    """The page in the middle of all orders, dearest first, of a listing stored with its places."""
    out = scratch(spark, "listing")
    orders = V.table(spark, base, "orders").select("o_orderkey", "o_totalprice")
    positions.write_positions(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], out)
    middle = positions.row_count(spark, out) // 24
    return positions.stored_page(spark, out, middle + 1, 12)


@query("G03_listing_by_title", sql("""
    SELECT course_id, title FROM courses ORDER BY title DESC, course_id LIMIT 20"""))
def listing_by_title(spark, base):
    return catalog.listing_page(V.courses(spark, base), 1, 20, "title").select("course_id",
                                                                               "title")


@query("G03_listing_totals", sql("""
    SELECT count(*) AS total, CAST(ceil(count(*) / 12e0) AS BIGINT) AS pages,
           CAST(3 AS BIGINT) AS current_page FROM courses WHERE platform = 'udemy'"""))
def listing_totals(spark, base):
    return catalog.listing_totals(V.courses(spark, base), 3, 12, {"platform": "udemy"})


PATHS = """
    SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE level
               WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 ELSE 3 END) AS INTEGER) AS step,
           level, course_id, title, rating, duration_hours AS duration
    FROM (SELECT * FROM {src} WHERE level IN ('Beginner', 'Intermediate', 'Advanced')
          QUALIFY row_number() OVER (PARTITION BY category, level
                                     ORDER BY rating DESC NULLS LAST, course_id) = 1)"""


@query("G04_paths_all_categories", sql(PATHS.format(src="text_courses")))
def paths_all_categories(spark, base):
    return catalog.best_per_level(V.text_courses(spark, base))


@query("G04_learning_path", sql("""
    SELECT 'o' AS category, CAST(row_number() OVER (ORDER BY CASE level WHEN 'Beginner' THEN 1
               WHEN 'Intermediate' THEN 2 ELSE 3 END) AS INTEGER) AS step,
           level, course_id, title, rating, duration_hours AS duration
    FROM (SELECT * FROM courses WHERE level IN ('Beginner', 'Intermediate', 'Advanced')
              AND regexp_matches(category, '(?i)o')
          QUALIFY row_number() OVER (PARTITION BY level
                                     ORDER BY rating DESC NULLS LAST, course_id) = 1)"""))
def learning_path(spark, base):
    return catalog.learning_path(V.courses(spark, base), "o")


PATH_QUERIES = {"blue": "BLUE", "promo": "promo", "either": "ring|small"}


@query("G05_path_by_popularity", sql(" UNION ALL ".join(f"""
    SELECT '{n}' AS query, CAST(row_number() OVER (ORDER BY level_enc) AS INTEGER) AS step,
           'Niveau ' || CAST(level_enc AS VARCHAR) AS stage, course_id, title,
           instructor AS partner, CAST(duration_hours AS VARCHAR) || 'h' AS duration,
           url AS link
    FROM (SELECT * FROM rated_courses WHERE regexp_matches(category, '(?i){p}')
              OR regexp_matches(title, '(?i){p}')
          QUALIFY row_number() OVER (PARTITION BY level_enc
                                     ORDER BY popularity_score DESC, course_id) = 1)
    QUALIFY step <= 3""" for n, p in PATH_QUERIES.items())))
def path_by_popularity(spark, base):
    return catalog.path_by_popularity(V.rated_courses(spark, base), PATH_QUERIES)


@query("G12_random_order", sql("""
    SELECT user_id, CAST(step + 1 AS INTEGER) AS rank, course_id
    FROM (SELECT id AS user_id, unnest(range(12)) AS step, (SELECT count(*) FROM courses) AS n,
                 CAST(floor(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 8)
                      AS BIGINT) / 4294967296e0 * (SELECT count(*) FROM courses)) AS BIGINT)
                      AS first
          FROM users)
         JOIN (SELECT course_id, row_number() OVER (
                   ORDER BY md5(CAST(course_id AS VARCHAR) || ':42'), course_id) - 1 AS slot
               FROM courses) ON slot = (first + step) % n"""))
def random_order(spark, base):
    return catalog.random_order_page(
        V.courses(spark, base), V.users(spark, base).select(F.col("id").alias("user_id")), 12)
