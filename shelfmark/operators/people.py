"""Users and their interactions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.columns import half_even
from shelfmark.operators.common import cut, first_per, full_rank
from shelfmark.sources.schemas import PATH_DATA

DIMS = ("category", "level", "platform")


def rows_of_users(users: DataFrame, table: DataFrame) -> DataFrame:
    """Interaction rows with the user's name; rows of unknown users drop out."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return table.join(names, "user_id")


def enrich_clicks(clicks: DataFrame, courses: DataFrame) -> DataFrame:
    """Clicks with the course's attributes; clicks on unknown courses drop out."""
    attrs = courses.select("course_id", F.col("title").alias("course_title"), *DIMS)
    return clicks.join(attrs, "course_id")


def preferences(clicks: DataFrame) -> DataFrame:
    """F07 for all users: (user_id, dim, value, n), the three counts in one pass."""
    dim = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for d in DIMS:
        dim = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(dim)
        value = F.when(F.grouping(d) == 0, F.col(d)).otherwise(value)
    sets = [["user_id", d] for d in DIMS]
    return (clicks.select("user_id", *DIMS).groupingSets(sets, "user_id", *DIMS)
            .agg(dim.alias("dim"), value.alias("value"), F.count(F.lit(1)).alias("n"))
            .select("user_id", "dim", "value", "n").filter(F.col("value").isNotNull()))


def preference_maps(prefs: DataFrame) -> DataFrame:
    """One map value -> count per user and dimension (values per dimension are few)."""
    return prefs.groupBy("user_id", "dim").agg(F.map_from_entries(
        F.collect_list(F.struct("value", "n"))).alias("counts"))


def category_clicks(clicks: DataFrame) -> DataFrame:
    return (clicks.filter(F.col("category").isNotNull()).groupBy("user_id", "category")
            .agg(F.count(F.lit(1)).alias("n")))


def top_categories(clicks: DataFrame, n: int = 5) -> DataFrame:
    """Most clicked categories per user, ties by name."""
    return first_per(category_clicks(clicks), ["user_id"], [F.desc("n"), F.asc("category")], n,
                     "rank")


def recent_searches(searches: DataFrame, n: int = 10) -> DataFrame:
    """Newest searches per user, repeats kept."""
    return first_per(searches, ["user_id"], [F.desc("timestamp"), F.desc("id")], n,
                     "rank").select("user_id", "rank", "id", "query", "timestamp")


def user_stats(users: DataFrame, searches: DataFrame, clicks: DataFrame, favorites: DataFrame
               ) -> DataFrame:
    """totals, top three categories and five newest searches for every user.

    Each table is reduced to one row per user before it is joined; the lists hold at most 3 and 5.
    """
    def per_user(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))

    def as_list(df: DataFrame, col: str, name: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct("rank", F.col(col).alias("v"))))
        return df.groupBy("user_id").agg(F.transform(packed, lambda s: s["v"]).alias(name))

    out = users.select(F.col("id").alias("user_id"), "username")
    totals = ((searches, "total_searches"), (clicks, "total_clicks"),
              (favorites, "total_favorites"))
    for df, name in totals:
        out = out.join(per_user(df, name), "user_id", "left")
    out = (out.join(as_list(top_categories(clicks, 3), "category", "top_categories"),
                    "user_id", "left")
           .join(as_list(recent_searches(searches, 5), "query", "recent_searches"),
                 "user_id", "left"))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return out.select("user_id", "username", *[F.coalesce(n, zero).alias(n) for _, n in totals],
                      *[F.coalesce(n, none).alias(n)
                        for n in ("top_categories", "recent_searches")])


def category_slots(clicks: DataFrame, top: int = 5, target: int = 20, least: int = 2) -> DataFrame:
    """Feed slots per top category, in proportion to the clicks, at least `least`."""
    best = top_categories(clicks, top).withColumn(
        "top_clicks", F.sum("n").over(Window.partitionBy("user_id")))
    slots = F.greatest(F.lit(least), half_even(
        F.col("n") / F.col("top_clicks") * F.lit(float(target)), 0).cast("int"))
    return best.select("user_id", "rank", "category", "n", "top_clicks", slots.alias("slots"))


def encode_path(steps: str | Column = "steps") -> Column:
    """I15."""
    return F.to_json(steps, {"ignoreNullFields": "false"})


def decode_path(data: str | Column = "path_data") -> Column:
    """Unreadable JSON gives an empty path."""
    parsed = F.from_json(data, PATH_DATA)
    whole = F.coalesce(F.forall(parsed, lambda s: s.isNotNull()), F.lit(False))
    return F.when(whole, parsed).otherwise(F.array().cast(PATH_DATA))


def saved_paths(paths: DataFrame) -> DataFrame:
    """Decoded paths with their newest-first position per user."""
    ranked = full_rank(paths, ["user_id"], [F.desc("timestamp"), F.desc("id")], "rank")
    return ranked.withColumn("path", decode_path("path_data")).drop("path_data")


def path_rows(users: DataFrame, steps: DataFrame) -> DataFrame:
    """Saved-path rows (one JSON text per user and category) from learning-path steps.

    A path has at most three steps, so the list per group is bounded.
    """
    step = F.struct("step", "level", "course_id", "title", "rating", "duration", "category")
    packed = steps.groupBy("user_id", "category", "timestamp").agg(
        F.array_sort(F.collect_list(step)).alias("steps"))
    return (packed.join(users.select(F.col("id").alias("user_id")), "user_id")
            .select("user_id", "category", encode_path("steps").alias("path_data"), "timestamp"))


def known_user_rows(users: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to append, named users resolved, unknown ones dropped."""
    return rows.join(users.select(F.col("id").alias("user_id"), "username"), "username").drop(
        "username")


def favorites_now(events: DataFrame) -> DataFrame:
    """Current favorites from add/remove events; the latest event per pair decides."""
    last = events.groupBy("user_id", "course_id").agg(
        F.max(F.struct("ts", "event_id", "action")).alias("e"))
    return last.filter(F.col("e.action") == "add").select(
        "user_id", "course_id", F.col("e.ts").alias("ts"))


def favorite_results(current: DataFrame, requests: DataFrame,
                     order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """True per request when it changes something: an add of a new pair, a remove of an old.

    A request finds what the request before it on the same pair left, the first one the table.
    """
    have = current.select("user_id", "course_id").distinct().withColumn("_have", F.lit(True))
    joined = requests.join(have, ["user_id", "course_id"], "left")
    before = F.lag("action").over(Window.partitionBy("user_id", "course_id").orderBy(*order))
    has = F.coalesce(before == "add", "_have", F.lit(False))
    return joined.withColumn("changed", F.when(F.col("action") == "add", ~has).otherwise(has)
                             ).drop("_have")


def load_accounts(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Bulk registration. Adds `password_hash`, `accepted` and `reason`.

    A row without a name, address or place in the order is refused first. A name or address that
    exists, or that an earlier accepted row of the load takes, is refused; the name is checked
    first. Rows are decided in load order, so a refused row blocks nobody. Places are unique.
    """
    rows = new.withColumn("password_hash", F.sha2("password", 256)).drop("password")
    for key in ("username", "email"):
        taken = existing.select(key).distinct().withColumn(f"_old_{key}", F.lit(True))
        rows = rows.join(taken, key, "left")
    open_rows = rows.filter(F.col("_old_username").isNull() & F.col("_old_email").isNull())
    open_rows = open_rows.filter(~_incomplete(order))
    accepted = _first_come(open_rows.drop("_old_username", "_old_email"), order)
    return _with_reasons(rows, accepted, order)


def _incomplete(order: str) -> Column:
    return F.col("username").isNull() | F.col("email").isNull() | F.col(order).isNull()


def _settle(left: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """One round: the rows that come first for both their keys, and those that they leave open."""
    first_u = left.groupBy("username").agg(F.min(order).alias("_u"))
    first_e = left.groupBy("email").agg(F.min(order).alias("_e"))
    wins = cut(left.join(first_u, "username").join(first_e, "email")
               .filter((F.col("_u") == F.col(order)) & (F.col("_e") == F.col(order)))
               .select("username", "email", order))
    return wins, cut(left.join(wins.select("username"), "username", "left_anti")
                     .join(wins.select("email"), "email", "left_anti"))


def _first_come(rows: DataFrame, order: str, rounds: int = 2, group_rows: int = 100_000
                ) -> DataFrame:
    """Accepted rows among rows that compete inside one load.

    A row that comes first for both its name and its address is accepted; later rows that share a
    key with it are refused. Two such rounds settle whatever hangs on one hot name or address. What
    is left are chains through alternating names and addresses: these are split into groups that
    share no key, by a number of contractions that grows with the logarithm of a chain, and each
    group is decided row after row in one task. Groups beyond `group_rows` rows, which no task
    should hold, go on in rounds; complete rows settle at least their first in each.
    """
    won: list[DataFrame] = []
    left = cut(rows.select("username", "email", order))
    for _ in range(rounds):
        wins, left = _settle(left, order)
        won.append(wins)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, won)
    name, mail = F.xxhash64(F.lit("name"), "username"), F.xxhash64(F.lit("mail"), "email")
    groups = connected(left.select(name.alias("a"), mail.alias("b")))
    left = cut(left.withColumn("a", name).join(groups, "a").drop("a"))
    large = left.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows)
    small = left.join(large, "root", "left_anti")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        names, mails, keep = set(), set(), []
        group = group.sort_values(order)
        for u, e in zip(group["username"], group["email"], strict=True):
            new = u not in names and e not in mails
            keep.append(new)
            if new:
                names.add(u)
                mails.add(e)
        return group.loc[keep, ["username", "email", order]]

    kinds = left.select("username", "email", order).schema
    won.append(cut(small.groupBy("root").applyInPandas(decide, kinds)))
    left = cut(left.join(large, "root", "left_semi").select("username", "email", order))
    while not left.isEmpty():
        wins, left = _settle(left, order)
        won.append(wins)
    return reduce(DataFrame.unionByName, won)


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, root): for every node of the edges (a, b) the least node it is connected with.

    Each round links all neighbours of a node first to the least of them that is above it, then to
    the least of all, so paths shrink by a factor a round and a hot node is only ever a minimum.
    """
    links = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
            "a != b").unionByName(least.withColumnRenamed("m", "b"))
        links = cut(small.distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)"))).first())
        if now == state:
            return links.select("a", F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"not connected after {rounds} rounds")


def _with_reasons(rows: DataFrame, accepted: DataFrame, order: str) -> DataFrame:
    by_name = accepted.select("username", F.col(order).alias("_u"))
    by_mail = accepted.select("email", F.col(order).alias("_e"))
    name_gone = F.col("_old_username") | (F.col("_u") < F.col(order))
    mail_gone = F.col("_old_email") | (F.col("_e") < F.col(order))
    return (rows.join(by_name, "username", "left").join(by_mail, "email", "left")
            .withColumn("reason", F.when(_incomplete(order), F.lit("missing_value"))
                        .when(name_gone, F.lit("username_taken"))
                        .when(mail_gone, F.lit("email_taken")))
            .withColumn("accepted", F.col("reason").isNull())
            .drop("_old_username", "_old_email", "_u", "_e"))


def last_logins(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users with their latest login; users without one keep the old value."""
    seen = logins.groupBy("user_id").agg(F.max("ts").alias("_ts"))
    return (users.join(seen.withColumnRenamed("user_id", "id"), "id", "left")
            .withColumn("last_login", F.greatest("last_login", F.col("_ts")))
            .drop("_ts"))
