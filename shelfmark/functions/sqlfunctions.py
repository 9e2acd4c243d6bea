"""Cleaners and encoders as SQL functions: `SELECT sm_clean_text(title) FROM ...`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfmark import constants as K
from shelfmark.functions.columns import NON_WORD, SPACE_RUN, URL_RUN


def _str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(var: str, pairs: list[tuple[str, str]], default: str) -> str:
    hits = " ".join(f"WHEN contains({var}, {_str(k)}) THEN {_str(v)}" for k, v in pairs)
    return f"CASE {hits} ELSE {default} END"


def function_bodies() -> dict[str, tuple[str, str, str]]:
    """Name -> (argument, return type, SQL expression)."""
    stops = ", ".join(_str(w) for w in K.nlp_stop_words())
    words = (f"split(regexp_replace(regexp_replace(lower(coalesce(x, '')), {_str(URL_RUN)}, ''), "
             f"{_str(NON_WORD)}, ' '), {_str(SPACE_RUN)})")
    reviews = "regexp_replace(lower(x), '[, ]', '')"
    return {
        "sm_clean_text": ("x STRING", "STRING", (
            "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
            "coalesce(x, ''), '&[a-z]+;', ' '), '<[^>]+>', ' '), "
            f"{_str(SPACE_RUN)}, ' '), {_str(r'[^\x00-\x7F\x{C0}-\x{FF}]+')}, ' '))")),
        "sm_nlp_clean": ("x STRING", "STRING", (
            f"array_join(filter({words}, w -> length(w) > 2 AND NOT w RLIKE "
            f"{_str(r'^\p{Nd}+$')} AND w NOT IN ({stops})), ' ')")),
        "sm_category": ("x STRING", "STRING", (
            "CASE WHEN x IS NULL THEN 'Other' ELSE "
            + _chain("lower(trim(x))", K.CATEGORY_MAPPING,
                     f"array_join(transform(regexp_extract_all(x, {_str(r'(\p{L}+|[^\p{L}]+)')}, "
                     "1), w -> concat(if(substring(w, 1, 1) = 'ß', 'Ss', upper(substring(w, 1, 1))), "
                     "lower(substring(w, 2)))), '')")
            + " END")),
        "sm_level": ("x STRING", "STRING",
                     _chain("lower(trim(x))", K.LEVEL_MAPPING, "'All Levels'")),
        "sm_rating": ("x STRING", "DOUBLE", (
            "greatest(0D, least(5D, coalesce(nullif(try_cast(replace(trim(x), ',', '.') "
            "AS DOUBLE), double('NaN')), 0D)))")),
        "sm_reviews": ("x STRING", "BIGINT", (
            f"coalesce(try_cast(regexp_extract({reviews}, {_str(r'(\d+)')}, 1) AS BIGINT) * "
            f"CASE WHEN contains({reviews}, 'k') THEN 1000L "
            f"WHEN contains({reviews}, 'm') THEN 1000000L ELSE 1L END, 0L)")),
        "sm_price_label": ("x STRING", "STRING", (
            "CASE WHEN x IS NULL THEN 'Subscription' "
            "WHEN contains(lower(x), 'free') OR contains(lower(x), 'gratuit') "
            "OR trim(x) = '0' THEN 'Free' "
            "WHEN contains(lower(x), 'subscription') OR contains(lower(x), 'abonnement') "
            f"THEN 'Subscription' WHEN x RLIKE {_str(r'[\d.,]+')} THEN x ELSE 'Paid' END")),
        "sm_price_code": ("x STRING", "DOUBLE", (
            "CASE WHEN x IS NULL OR contains(lower(x), 'free') THEN 0D "
            "WHEN contains(lower(x), 'subscription') THEN 1D ELSE coalesce(try_cast(replace("
            f"regexp_extract(x, {_str(r'([\d.,]+)')}, 1), ',', '.') AS DOUBLE), 2D) END")),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; they expand to built-in expressions at planning."""
    for name, (arg, kind, body) in function_bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arg}) RETURNS {kind} "
                  f"RETURN {body}")
    return list(function_bodies())
