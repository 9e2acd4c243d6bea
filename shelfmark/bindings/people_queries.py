"""Users, interactions, favorites, accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.bindings import views as V
from shelfmark.bindings.registry import query
from shelfmark.bindings.sql import PATH_STEPS, sql
from shelfmark.operators import catalog, people

@query("E02_rows_of_users", sql("""
    SELECT c.id, user_id, username, course_id FROM clicks c JOIN users u ON u.id = user_id"""))
def rows_of_users(spark, base):
    return people.rows_of_users(V.users(spark, base), V.clicks(spark, base)).select(
        "id", "user_id", "username", "course_id")


@query("E06_enriched_clicks", sql("""
    SELECT id, user_id, course_id, course_title, category, level, platform FROM clicks"""))
def enriched_clicks(spark, base):
    return V.clicks(spark, base).drop("timestamp")


PREFS = {"prefs": " UNION ALL ".join(
    f"SELECT user_id, '{d}' AS dim, {d} AS value, count(*) AS n FROM clicks GROUP BY ALL"
    for d in people.DIMS)}


@query("F07_preferences", sql("SELECT user_id, dim, value, n FROM prefs", PREFS))
def preferences(spark, base):
    return people.preferences(V.clicks(spark, base))


@query("F07_preference_maps", sql("""
    SELECT user_id, dim, string_agg(value || '=' || CAST(n AS VARCHAR), ',' ORDER BY value)
           AS counts FROM prefs GROUP BY ALL""", PREFS))
def preference_maps(spark, base):
    maps = people.preference_maps(people.preferences(V.clicks(spark, base)))
    text = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("user_id", "dim", F.array_join(text, ",").alias("counts"))


PERSON = {
    "top_cats": """
    SELECT user_id, category, count(*) AS n, row_number() OVER (PARTITION BY user_id
           ORDER BY count(*) DESC, category) AS rank FROM clicks GROUP BY user_id, category""",
    "recent": """
    SELECT user_id, id, query, timestamp, row_number() OVER (PARTITION BY user_id
           ORDER BY timestamp DESC, id DESC) AS rank FROM searches"""}


@query("F08_user_stats", sql("""
    SELECT u.id AS user_id, username, coalesce(s.n, 0) AS total_searches,
           coalesce(c.n, 0) AS total_clicks, coalesce(f.n, 0) AS total_favorites,
           coalesce(t.v, '') AS top_categories, coalesce(r.v, '') AS recent_searches
    FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS n FROM searches GROUP BY user_id) s
        ON s.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM clicks GROUP BY user_id) c ON c.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM favorites GROUP BY user_id) f
        ON f.user_id = u.id
    LEFT JOIN (SELECT user_id, string_agg(category, '|' ORDER BY rank) AS v FROM top_cats
               WHERE rank <= 3 GROUP BY user_id) t ON t.user_id = u.id
    LEFT JOIN (SELECT user_id, string_agg(query, '|' ORDER BY rank) AS v FROM recent
               WHERE rank <= 5 GROUP BY user_id) r ON r.user_id = u.id""", PERSON))
def user_stats(spark, base):
    out = people.user_stats(V.users(spark, base), V.searches(spark, base),
                            V.clicks(spark, base), V.favorites(spark, base))
    return out.withColumns({c: F.array_join(c, "|")
                            for c in ("top_categories", "recent_searches")})


@query("G06_recent_searches", sql("""
    SELECT user_id, rank, id, query, timestamp FROM recent WHERE rank <= 10""", PERSON))
def recent_searches(spark, base):
    return people.recent_searches(V.searches(spark, base)).withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("G07_top_user_categories", sql("""
    SELECT user_id, category, n, rank FROM top_cats WHERE rank <= 5""", PERSON))
def top_user_categories(spark, base):
    return people.top_categories(V.clicks(spark, base)).withColumn(
        "rank", F.col("rank").cast("bigint"))


SLOTS = {**PERSON, "slots": """
    SELECT user_id, rank, category, n, total AS top_clicks,
           CAST(greatest(2, round_even(CAST(n AS DOUBLE) / total * 20e0, 0)) AS INTEGER) AS slots
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total
          FROM top_cats WHERE rank <= 5)"""}


@query("G11_category_slots", sql("SELECT * FROM slots", SLOTS))
def category_slots(spark, base):
    return people.category_slots(V.clicks(spark, base)).withColumn(
        "rank", F.col("rank").cast("bigint"))


def _paths(spark, base):
    """Every user's first favorite names a category whose learning path the user saves."""
    fav = V.favorites(spark, base).join(V.courses(spark, base).select("course_id", "category"),
                                        "course_id")
    kept = fav.groupBy("user_id", "category").agg(F.min("timestamp").alias("timestamp"))
    steps = catalog.best_per_level(V.courses(spark, base))
    rows = people.path_rows(V.users(spark, base), kept.join(steps, "category"))
    return rows.withColumn("id", F.xxhash64("user_id", "category"))


@query("H06_I15_path_rows", sql(f"""
    SELECT k.user_id, k.category, k.timestamp, count(*) AS steps,
           string_agg(p.level || ':' || CAST(p.course_id AS VARCHAR) || ':'
                      || CAST(p.rating AS VARCHAR), '|' ORDER BY step) AS summary
    FROM (SELECT user_id, category, min(f.timestamp) AS timestamp
          FROM favorites f JOIN courses USING (course_id) GROUP BY ALL) k
         JOIN users u ON u.id = k.user_id JOIN ({PATH_STEPS}) p ON p.category = k.category
    GROUP BY ALL"""))
def path_rows(spark, base):
    rows = _paths(spark, base).withColumn("p", people.decode_path("path_data"))
    text = F.transform("p", lambda s: F.concat(
        s["level"], F.lit(":"), s["course_id"].cast("string"), F.lit(":"),
        s["rating"].cast("string")))
    return rows.select("user_id", "category", "timestamp",
                       F.size("p").cast("bigint").alias("steps"),
                       F.array_join(text, "|").alias("summary"))


@query("G10_saved_paths", sql("""
    SELECT user_id, category, n AS rank, CAST(k AS BIGINT) AS steps FROM (
      SELECT user_id, category, row_number() OVER (PARTITION BY user_id
                 ORDER BY timestamp DESC, category) AS n,
             CASE WHEN category = 'PROMO' THEN 0 ELSE 3 END AS k
      FROM (SELECT user_id, category, min(f.timestamp) AS timestamp
            FROM favorites f JOIN courses USING (course_id)
            WHERE user_id IN (SELECT id FROM users) GROUP BY ALL))"""))
def saved_paths(spark, base):
    rows = _paths(spark, base).withColumns({
        "path_data": F.when(F.col("category") == "PROMO", F.lit("[not json"))
        .otherwise(F.col("path_data")),
        "id": F.ascii("category") * -1000 - F.ascii(F.substring("category", 2, 1))})
    out = people.saved_paths(rows)
    return out.select("user_id", "category", F.col("rank").cast("bigint").alias("rank"),
                      F.size("path").cast("bigint").alias("steps"))


def _favorite_events(spark, base):
    """Purchases add, errors remove; both fall on the same few courses per user."""
    e = V.table(spark, base, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select("event_id", "ts", "user_id", (F.floor("value") % 7).alias("course_id"),
                    F.when(F.col("event_type") == "purchase", F.lit("add"))
                    .otherwise(F.lit("remove")).alias("action"))


FAV = {"fav_events": """
    SELECT event_id, ts, user_id, CAST(floor(value) AS BIGINT) % 7 AS course_id,
           CASE event_type WHEN 'purchase' THEN 'add' ELSE 'remove' END AS action
    FROM events WHERE event_type IN ('purchase', 'error')"""}


@query("H04_favorites_now", sql("""
    SELECT user_id, course_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (
      SELECT * FROM fav_events QUALIFY row_number() OVER (PARTITION BY user_id, course_id
          ORDER BY ts DESC, event_id DESC) = 1) WHERE action = 'add'""", FAV))
def favorites_now(spark, base):
    return people.favorites_now(_favorite_events(spark, base)).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("H04_favorite_results", sql("""
    SELECT event_id, CASE action WHEN 'add' THEN NOT has ELSE has END AS changed FROM (
      SELECT event_id, action, coalesce(lag(action) OVER (PARTITION BY user_id, course_id
              ORDER BY ts, event_id) = 'add', (user_id, course_id) IN (
          SELECT (user_id, course_id) FROM fav_events WHERE action = 'add'
              AND ts < TIMESTAMP '2024-01-11')) AS has
      FROM fav_events WHERE ts >= TIMESTAMP '2024-01-11')""", FAV))
def favorite_results(spark, base):
    e = _favorite_events(spark, base)
    split = F.expr("TIMESTAMP_NTZ '2024-01-11 00:00:00'")
    had = e.filter((F.col("ts") < split) & (F.col("action") == "add"))
    return people.favorite_results(had, e.filter(F.col("ts") >= split)).select("event_id",
                                                                               "changed")


@query("H05_account_load", sql("""
    SELECT c_custkey AS seq, username, sha256(CAST(c_custkey AS VARCHAR)) AS password_hash,
           CASE WHEN known OR r > 1 THEN 'username_taken' END AS reason,
           NOT (known OR r > 1) AS accepted
    FROM (SELECT *, username IN (SELECT 'u' || CAST(s_nationkey AS VARCHAR) || '_BUILDING'
                                 FROM supplier) AS known,
                 row_number() OVER (PARTITION BY username ORDER BY c_custkey) AS r
          FROM (SELECT c_custkey, 'u' || CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment
                       AS username FROM customer))"""))
def account_load(spark, base):
    old = V.table(spark, base, "supplier").select(F.concat(
        F.lit("u"), F.col("s_nationkey").cast("string"), F.lit("_BUILDING")).alias("username"))
    old = old.withColumn("email", F.concat("username", F.lit("@shelf.test")))
    new = V.table(spark, base, "customer").select(
        F.col("c_custkey").alias("seq"), F.concat(
            F.lit("u"), F.col("c_nationkey").cast("string"), F.lit("_"), "c_mktsegment")
        .alias("username"), F.col("c_custkey").cast("string").alias("password"))
    new = new.withColumn("email", F.concat("username", F.lit("@shelf.test")))
    return people.load_accounts(old, new).select("seq", "username", "password_hash", "reason",
                                                 "accepted")


@query("H06_known_user_rows", sql("""
    SELECT event_id, u.id AS user_id FROM events e JOIN users u
        ON u.username = 'user_' || CAST(e.user_id + 3 AS VARCHAR)"""))
def known_user_rows(spark, base):
    rows = V.table(spark, base, "events").select("event_id", F.concat(
        F.lit("user_"), (F.col("user_id") + 3).cast("string")).alias("username"))
    return people.known_user_rows(V.users(spark, base), rows)


@query("H07_last_logins", sql("""
    SELECT u.id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_login
    FROM users u LEFT JOIN events e ON e.user_id = u.id AND event_type = 'view'
    GROUP BY u.id"""))
def last_logins(spark, base):
    users = V.users(spark, base).withColumn("last_login", F.lit(None).cast("timestamp_ntz"))
    views = V.table(spark, base, "events").filter("event_type = 'view'")
    return people.last_logins(users, views).select(
        "id", F.date_format("last_login", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_login"))
