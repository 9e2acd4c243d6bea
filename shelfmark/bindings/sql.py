"""The same views as SQL text, for checking results with another engine."""

from __future__ import annotations

import re

from shelfmark import constants as K


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def r6(x: str) -> str:
    return f"(round_even(CAST(({x}) AS DOUBLE) * 1e6, 0)::DOUBLE / 1e6)"


def rnd(x: str, digits: int) -> str:
    return f"(round_even(CAST(({x}) AS DOUBLE) * 1e{digits}, 0)::DOUBLE / 1e{digits})"


def chain(col: str, pairs, default: str) -> str:
    hits = " ".join(f"WHEN contains({col}, {lit(k)}) THEN {lit(v)}" for k, v in pairs)
    return f"(CASE {hits} ELSE {default} END)"


def title_case(col: str) -> str:
    return (f"list_aggregate(list_transform(regexp_extract_all({col}, "
            r"'(\p{L}+|[^\p{L}]+)'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), "
            "'string_agg', '')")


LEVEL_BY_SIZE = ("CASE WHEN p_size <= 12 THEN 'Beginner' WHEN p_size <= 25 THEN 'Intermediate' "
                 "WHEN p_size <= 37 THEN 'Advanced' ELSE 'All Levels' END")
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

VIEWS: dict[str, str] = {
    "courses": f"""
        SELECT *, CASE level WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2
                             WHEN 'Advanced' THEN 3 ELSE 0 END AS level_enc FROM (
        SELECT p_partkey AS course_id, p_name AS title, p_type AS category,
               p_brand AS instructor,
               CASE WHEN p_partkey % 3 = 0 THEN 'coursera' ELSE 'udemy' END AS platform,
               {LEVEL_BY_SIZE} AS level, least(5e0, {r6('q / 10e0 + 2e0')}) AS rating,
               coalesce(n, 0) AS num_reviews, CAST(p_size AS DOUBLE) AS duration_hours,
               CAST(p_retailprice AS VARCHAR) AS price,
               '/course/' || CAST(p_partkey AS VARCHAR) AS url, p_partkey AS ingest_seq
        FROM part LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS q, count(*) AS n
                             FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)""",
    "rated_courses": f"""
        SELECT *, {r6('''6e-1 * (rating / (SELECT max(rating) FROM courses))
            + 4e-1 * (ln(1e0 + num_reviews)
                      / (SELECT max(ln(1e0 + num_reviews)) FROM courses))''')}
            AS popularity_score FROM courses""",
    "text_courses": f"""
        SELECT doc_id AS course_id, text AS title, source AS category, lang AS platform,
               CASE doc_id % 4 WHEN 0 THEN 'Beginner' WHEN 1 THEN 'Intermediate'
                               WHEN 2 THEN 'Advanced' ELSE 'All Levels' END AS level,
               {r6('1e0 + (n_chars % 41) / 10e0')} AS rating, n_chars % 997 AS num_reviews,
               {r6('n_chars / 1000e0')} AS duration_hours, doc_id AS ingest_seq,
               lower(text || ' ' || source) AS combined_text
        FROM documents""",
    "rated_text_courses": f"""
        SELECT *, {r6('''6e-1 * (rating / (SELECT max(rating) FROM text_courses))
            + 4e-1 * (ln(1e0 + num_reviews)
                      / (SELECT max(ln(1e0 + num_reviews)) FROM text_courses))''')}
            AS popularity_score FROM text_courses""",
    "users": f"""
        SELECT user_id AS id, 'user_' || CAST(user_id AS VARCHAR) AS username,
               {STAMP.format('c')} AS created_at, {STAMP.format('l')} AS last_login
        FROM (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS c, max(ts) AS l
              FROM events GROUP BY user_id) WHERE c IS NOT NULL""",
    "clicks": f"""
        SELECT event_id AS id, user_id, course_id, title AS course_title, category, level,
               platform, {STAMP.format('ts')} AS timestamp
        FROM events JOIN courses ON course_id = event_id % (SELECT count(*) FROM part)
        WHERE event_type = 'click'""",
    "searches": f"""
        SELECT event_id AS id, user_id, course_id, title AS query,
               {STAMP.format('ts')} AS timestamp
        FROM events JOIN courses ON course_id = event_id % (SELECT count(*) FROM part)
        WHERE event_type = 'view'""",
    "favorites": f"""
        SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM part) AS course_id,
               {STAMP.format('ts')} AS timestamp FROM events WHERE event_type = 'purchase'""",
    "text_clicks": f"""
        SELECT event_id AS id, user_id, course_id, title AS course_title, category, level,
               platform, {STAMP.format('ts')} AS timestamp
        FROM events JOIN text_courses ON course_id = event_id % (SELECT count(*) FROM documents)
        WHERE event_type = 'click'""",
    "text_searches": f"""
        SELECT event_id AS id, user_id, course_id, title AS query,
               {STAMP.format('ts')} AS timestamp
        FROM events JOIN text_courses ON course_id = event_id % (SELECT count(*) FROM documents)
        WHERE event_type = 'view'""",
    "everyone_course": """
        SELECT course_id, title, category, platform, level, rating FROM text_courses
        UNION ALL SELECT r_regionkey + 1000000000, r_name, 'region', 'none', 'All Levels', 0e0
        FROM region""",
    "labelled": """
        SELECT t.*, label AS cluster FROM text_courses t
        LEFT JOIN embeddings ON vec_id = course_id""",
    "points": """
        SELECT vec_id AS id, label AS cluster, CAST(embedding[1] AS DOUBLE) AS x,
               CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS v
        FROM embeddings""",
}


def tfidf_views(source: str, key: str, text: str, prefix: str = "", stop_words=None,
                max_df: float = K.TFIDF_MAX_DF, max_features: int = K.TFIDF_MAX_FEATURES
                ) -> dict[str, str]:
    """Vocabulary and unit weights of a text column."""
    stops = in_list(K.nlp_stop_words() if stop_words is None else stop_words)
    p = prefix
    return {
        f"{p}tf": f"""
        SELECT {key} AS id, term, count(*) AS tf FROM (
          SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)),
                 lambda i: t[i] || ' ' || t[i + 1]))) AS term
          FROM (SELECT {key}, list_filter(regexp_extract_all(lower(coalesce({text}, '')),
                       '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {stops}) AS t
                FROM {source})) GROUP BY ALL""",
        f"{p}vocab": f"""
        SELECT term, row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id, df, cf,
               ln((n + 1e0) / (df + 1e0)) + 1e0 AS idf
        FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
                     any_value(n) AS n FROM {p}tf, (SELECT count(*) AS n FROM {source})
              GROUP BY term HAVING count(*) >= 2 AND count(*) <= any_value(n) * {max_df}e0
              ORDER BY cf DESC, term LIMIT {max_features})""",
        f"{p}weights": unit_weights_sql(f"{p}tf", f"{p}vocab"),
    }


def unit_weights_sql(tf: str, vocab: str) -> str:
    return f"""
        SELECT id, term, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w
        FROM (SELECT id, term, term_id, tf * idf AS x FROM {tf} JOIN {vocab} USING (term))"""


TEXT_MODEL = tfidf_views("text_courses", "course_id", "combined_text")

EDGES = f"""
        SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY score DESC, neighbor_id)
               AS rank
        FROM (SELECT a.id AS course_id, b.id AS neighbor_id, {r6('sum(a.w * b.w)')} AS score
              FROM weights a JOIN weights b ON a.term_id = b.term_id AND a.id <> b.id
              GROUP BY ALL) WHERE score > 0
        QUALIFY rank <= 20"""


def text_matches_sql(queries: str, n: int, fill: bool = True) -> dict[str, str]:
    """Best n text courses per row of a (qid, query) view, unscored ones last in id order."""
    extra = {f"q_{k}": v for k, v in {
        "tf": tfidf_views(queries, "qid", "query")["tf"],
        "weights": unit_weights_sql("q_tf", "vocab")}.items()}
    scored = f"""
        SELECT q.id AS qid, d.id AS course_id, {r6('sum(q.w * d.w)')} AS score
        FROM q_weights q JOIN weights d USING (term_id) GROUP BY ALL"""
    if fill:
        pairs = f"""
        SELECT qid, course_id, coalesce(score, 0e0) AS score
        FROM (SELECT qid FROM {queries}) CROSS JOIN (SELECT course_id FROM text_courses)
             LEFT JOIN scored USING (qid, course_id)"""
    else:
        pairs = "SELECT * FROM scored WHERE score > 0"
    ranked = f"""
        SELECT *, {rnd('score * 100e0', 1)} AS similarity_score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, course_id) AS rank
        FROM pairs QUALIFY rank <= {n}"""
    return {**extra, "scored": scored, "pairs": pairs, "matches": ranked}


PATH_STEPS = """
    SELECT category, row_number() OVER (PARTITION BY category ORDER BY CASE level
               WHEN 'Beginner' THEN 1 WHEN 'Intermediate' THEN 2 ELSE 3 END) AS step,
           level, course_id, title, rating, duration_hours AS duration
    FROM (SELECT * FROM courses WHERE level IN ('Beginner', 'Intermediate', 'Advanced')
          QUALIFY row_number() OVER (PARTITION BY category, level
                                     ORDER BY rating DESC NULLS LAST, course_id) = 1)"""


def filled_sql(n: int) -> dict[str, str]:
    """The n nearest of every course, short lists filled with courses of score 0 in id order."""
    return {"filled": f"""
        SELECT course_id, neighbor_id, score, row_number() OVER (PARTITION BY course_id
                   ORDER BY score DESC, neighbor_id) AS rank
        FROM (SELECT course_id, neighbor_id, score FROM edges
              UNION ALL SELECT c.course_id, s.course_id, 0e0
              FROM everyone_course c CROSS JOIN (SELECT course_id FROM everyone_course
                                                 ORDER BY course_id LIMIT {2 * n + 1}) s
                   ANTI JOIN edges e ON e.course_id = c.course_id AND e.neighbor_id = s.course_id
              WHERE c.course_id <> s.course_id)
        QUALIFY rank <= {n}"""}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """`body` after the views it names, directly or through others."""
    pool = {**VIEWS, **TEXT_MODEL, "edges": EDGES, **(extra or {})}
    order = list(pool)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(pool[name])

    visit(body)
    # Definitions follow use: a view comes after every view it names.
    placed: list[str] = []

    def place(name: str) -> None:
        if name in placed:
            return
        for other in order:
            if other != name and other in needed and re.search(rf"\b{other}\b", pool[name]):
                place(other)
        placed.append(name)

    for name in order:
        if name in needed:
            place(name)
    if not placed:
        return body.strip()
    heads = ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in placed)
    return f"WITH {heads}\n{body.strip()}"
