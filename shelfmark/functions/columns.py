"""Column expressions for text, labels and numbers. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as K

# Unicode-aware character classes that mean the same in Java and RE2 regular expressions.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\p{Z}"
SPACE_RUN = f"[{WS}]+"
NON_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"
URL_RUN = f"http[^{WS}]+|www[^{WS}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- numbers ---------------------------------------------------------------------------------

def half_even(col: Column | str, digits: int) -> Column:
    """Round half to even at `digits` decimals, on the binary value."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def r6(col: Column | str) -> Column:
    """Six decimals: applied to every float before it is ranked or returned."""
    return half_even(col, 6)


def mean_of_r6(col: Column | str) -> Column:
    """Mean of six-decimal numbers, added as integers so the order of rows cannot matter."""
    c = _c(col)
    return F.rint(F.sum(F.rint(c * 1e6).cast("bigint")) / F.count(c)) / F.lit(1e6)


def nan_to_null(col: Column | str) -> Column:
    """NaN stands for a missing number in the sources; aggregates here skip NULL only."""
    return F.when(~F.isnan(_c(col)), _c(col))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


# -- text ------------------------------------------------------------------------------------

def capitalise(col: Column | str) -> Column:
    """First character upper (a sharp s becomes Ss), the rest lower."""
    c = _c(col)
    first = F.substring(c, 1, 1)
    return F.concat(F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first)),
                    F.lower(F.substr(c, F.lit(2))))


def title_case(col: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    words = F.regexp_extract_all(_c(col), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: capitalise(w)), "")


def clean_text(col: Column | str) -> Column:
    """Entities and tags to spaces, space runs to one, non-Latin runs to one space, trim."""
    c = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"&[a-z]+;", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, SPACE_RUN, " ")
    c = F.regexp_replace(c, r"[^\x00-\x7F\x{C0}-\x{FF}]+", " ")
    return F.trim(c)


def nlp_clean(col: Column | str, stop_words: Iterable[str] | None = None) -> Column:
    """Lower, drop URLs, symbols, bare numbers, stop words and tokens of at most 2 chars."""
    stops = K.nlp_stop_words() if stop_words is None else list(stop_words)
    c = F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), URL_RUN, "")
    words = F.split(F.regexp_replace(c, NON_WORD, " "), SPACE_RUN)
    keep = F.filter(words, lambda w: (F.length(w) > 2)
                    & ~w.rlike(r"^\p{Nd}+$") & ~w.isin(stops))
    return F.array_join(keep, " ")


def tokens(col: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case tokens of at least two word characters, stop words out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(TOKEN), 0)
    stops = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stops)) if stops else words


def bigrams_of(words: Column) -> Column:
    """The pairs of neighbouring tokens."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def uni_and_bigrams(words: Column) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""
    return F.concat(words, bigrams_of(words))


def ellipsis(col: Column | str, n: int) -> Column:
    """Cut at n characters with a trailing ellipsis; NULL and empty become N/A."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), F.lit("N/A"))
            .when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("...")))
            .otherwise(c))


def absolute_url(col: Column | str, base: str) -> Column:
    """Prefix the host unless the link is absolute already."""
    c = _c(col)
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), c))


def split_skills(col: Column | str) -> Column:
    return F.transform(F.split(_c(col), ","), lambda s: F.trim(s))


# -- labels ----------------------------------------------------------------------------------

def first_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]],
                default: Column | str | None) -> Column:
    """Label of the first class that has a keyword contained in `text`."""
    chain = None
    for label, words in classes:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain if default is None else chain.otherwise(default)


def _by_key(mapping: Sequence[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, [key]) for key, label in mapping]


def category_from_title(col: Column | str) -> Column:
    """Nine ordered keyword classes, else General."""
    return first_class(F.lower(_c(col)), K.TITLE_CATEGORIES, F.lit("General"))


def level_from_metadata(col: Column | str) -> Column:
    """Level word in free metadata, else All Levels."""
    return first_class(F.lower(_c(col)), K.METADATA_LEVELS, F.lit("All Levels"))


def normal_category(col: Column | str) -> Column:
    """First mapped key contained in the text; NULL is Other, no hit is title-cased."""
    c = _c(col)
    return F.when(c.isNull(), F.lit("Other")).otherwise(
        first_class(F.lower(F.trim(c)), _by_key(K.CATEGORY_MAPPING), title_case(c)))


def normal_level(col: Column | str) -> Column:
    """First mapped key contained in the text, else All Levels."""
    return first_class(F.lower(F.trim(_c(col))), _by_key(K.LEVEL_MAPPING), F.lit("All Levels"))


def clean_rating(col: Column | str) -> Column:
    """Decimal comma accepted, clamped to 0..5, anything unreadable is 0."""
    num = F.regexp_replace(F.trim(_c(col).cast("string")), ",", ".").try_cast("double")
    return clamp(F.coalesce(nan_to_null(num), F.lit(0.0)), 0.0, 5.0)


def clean_reviews(col: Column | str) -> Column:
    """First integer run, times 1000 with a `k`, else times 10^6 with an `m`."""
    text = F.regexp_replace(F.lower(_c(col).cast("string")), "[, ]", "")
    num = F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")
    factor = (F.when(text.contains("k"), 1000).when(text.contains("m"), 1000000)
              .otherwise(1).cast("bigint"))
    return F.coalesce(num * factor, F.lit(0).cast("bigint"))


def clean_price_label(col: Column | str) -> Column:
    """Free, Subscription, the amount as it is, or Paid."""
    raw = _c(col).cast("string")
    low = F.lower(F.trim(raw))
    return (F.when(raw.isNull(), F.lit("Subscription"))
            .when(low.contains("free") | low.contains("gratuit") | (low == "0"), F.lit("Free"))
            .when(low.contains("subscription") | low.contains("abonnement"),
                  F.lit("Subscription"))
            .when(low.rlike(r"[\d.,]+"), raw).otherwise(F.lit("Paid")))


def price_token(col: Column | str) -> Column:
    """Amount with an optional dollar sign; no amount gives the input, empty gives NULL."""
    c = _c(col)
    found = F.regexp_extract(c, r"\$?(\d+\.\d+|\d+)", 0)
    return F.when(F.length(c) > 0, F.when(found != "", found).otherwise(c))


def encode_price(col: Column | str) -> Column:
    """0 free or missing, 1 subscription, the amount, else 2."""
    low = F.lower(_c(col).cast("string"))
    amount = F.regexp_replace(F.regexp_extract(low, r"([\d.,]+)", 1), ",", ".")
    return (F.when(low.isNull() | low.contains("free"), F.lit(0.0))
            .when(low.contains("subscription"), F.lit(1.0))
            .otherwise(F.coalesce(amount.try_cast("double"), F.lit(2.0))))


def code_of(col: Column | str, codes: dict, default) -> Column:
    """Value of a small fixed code table, `default` for anything else."""
    c = _c(col)
    chain = None
    for key, value in codes.items():
        chain = (F.when(c == key, F.lit(value)) if chain is None
                 else chain.when(c == key, F.lit(value)))
    return chain.otherwise(default)


def encode_platform(col: Column | str) -> Column:
    return code_of(col, K.PLATFORM_CODES, F.lit(0))


def encode_level(col: Column | str) -> Column:
    return code_of(col, K.LEVEL_CODES, F.lit(0))


def encode_path_level(col: Column | str) -> Column:
    return code_of(col, K.PATH_LEVEL_CODES, F.lit(1))


def level_label(col: Column | str) -> Column:
    """Display label of an encoded level, `Niveau n` when unknown (F16)."""
    return code_of(col, K.LEVEL_ENC_LABELS, F.concat(F.lit("Niveau "), _c(col).cast("string")))


# -- fields in card text ---------------------------------------------------------------------

def review_count(col: Column | str) -> Column:
    """`22,772 ratings`."""
    run = F.regexp_extract(_c(col), r"([\d,]+)\s*ratings?", 1)
    return F.regexp_replace(run, ",", "").try_cast("bigint")


def total_hours(col: Column | str) -> Column:
    """`5.5 total hours`."""
    return F.regexp_extract(_c(col), r"([\d.]+)\s*total hours?", 1).try_cast("double")


def lecture_count(col: Column | str) -> Column:
    """`429 lectures`."""
    return F.regexp_extract(_c(col), r"(\d+)\s*lectures?", 1).try_cast("bigint")


def tag_level(col: Column | str) -> Column:
    """First level keyword, case-sensitive, else N/A."""
    return first_class(_c(col), [(k, [k]) for k in K.TAG_LEVELS], F.lit("N/A"))


def rating_in_text(col: Column | str) -> Column:
    """First number with an optional decimal part."""
    run = F.regexp_extract(_c(col), r"(\d+[.,]?\d*)", 1)
    return F.regexp_replace(run, ",", ".").try_cast("double")


def review_count_suffixed(col: Column | str) -> Column:
    """Number before reviews/avis/students, scaled when a k (else an m) is in the text."""
    c = _c(col)
    run = F.regexp_extract(
        c, r"(?i)\(?([\d.,]+)\s*[KkMm]?\)?\s*(?:reviews?|avis|étudiants?|students?)", 1)
    num = F.regexp_replace(run, ",", ".").try_cast("double")
    low = F.lower(c)
    factor = F.when(low.contains("k"), 1e3).when(low.contains("m"), 1e6).otherwise(1.0)
    return F.floor(num * factor).cast("bigint")


def card_level(col: Column | str) -> Column:
    """Bilingual level keywords, NULL when none is present."""
    return first_class(F.lower(_c(col)), K.CARD_LEVELS, None)


def card_price(col: Column | str) -> Column:
    """Free, an amount with its currency sign, else Subscription."""
    c = _c(col)
    low = F.lower(c)
    amount = F.regexp_extract(c, r"[\$€£]\s*(\d+(?:[.,]\d{2})?)", 0)
    return (F.when(low.contains("free") | low.contains("gratuit"), F.lit("Free"))
            .when(amount != "", amount).otherwise(F.lit("Subscription")))


# -- deterministic chance --------------------------------------------------------------------

def unit_hash(*cols: Column | str, seed: int = K.SEED) -> Column:
    """Number in [0, 1) that depends on the given values and the seed only."""
    text = F.concat_ws(":", *[_c(c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def shuffle_key(*cols: Column | str, seed: int = K.SEED) -> Column:
    """Sort key of a repeatable shuffle."""
    return F.md5(F.concat_ws(":", *[_c(c).cast("string") for c in cols], F.lit(str(seed))))
