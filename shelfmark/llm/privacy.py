"""Personal data: patterns, and terms that reveal what they find.

E-mail addresses, network addresses, cards and phone numbers are found by pattern and checked. Each
value is a protected entity. The corpus tells how strongly a term, any word in a document of it
outside what the patterns found, gives it away: with n documents, PMI(t, e) = ln(n * n_te / (n_t * n_e)) is what t tells of e, ln(n / n_e) is all there is
to tell, and a term is a disclosure where it tells at least `threshold` of that, in at least
`support` documents in which the surroundings of the entity or of the term differ (copies are one).
Disclosing terms are generalised (names) or removed in the documents of their
entity.

Everything is a DataFrame expression. Places come from what lies between matches: a running sum of
the lengths of gaps and matches, in one row per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.work import keep

#: The four kinds in the order of their spans. The possessive forms match the same
#: text as the plain ones and do not go back over it; an address begins where a run of its
#: characters begins, or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
SEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Surroundings, only to tell copies: characters beside an entity, words beside a term.
NEAR, BESIDE = 80, 8
SUPPORT, THRESHOLD = 2, 0.7
#: Groups of terms by hash: an upper bound of what is broadcast to pass over other words.
GROUPS = 1 << 16
TERM_KIND = "term"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _with_gaps(text: Column, pattern: str) -> Column:
    """Matches in order with the text before and after each, up to its neighbours. All arrays are
    made once a text; there is one gap more than matches."""
    gap = F.split(text, pattern, -1)
    rows = F.arrays_zip(_matches(text, pattern).alias("value"), gap.alias("before"),
                        F.slice(gap, 2, F.lit(1 << 30)).alias("after"))
    return F.filter(rows, lambda x: x["value"].isNotNull())


def _found(text: Column, pattern: str, near: int) -> Column:
    """Matches in order: value, length of the gap before it, and the text on both sides."""
    return F.transform(_with_gaps(text, pattern), lambda x: F.struct(
        x["value"].alias("value"), F.length(x["before"]).alias("gap"),
        F.right(x["before"], F.lit(near)).alias("before"),
        F.left(x["after"], F.lit(near)).alias("after"), F.length(x["after"]).alias("next")))


def _luhn(digits: Column) -> Column:
    full = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.substring(full, i, 1).cast("int")
        if i % 2 == 0:
            d = d * 2 - F.when(d > 4, 9).otherwise(0)
        total = total + d
    return total % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    return (F.when(F.col("kind") == "email", F.lit(True))
            .when(F.col("kind") == "ip", F.col("value").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
            .when(F.col("kind") == "card",
                  F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
            .otherwise(n.between(10, 15)))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end of each match, from rows with `i`, `gap` and `value`."""
    run = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(run)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def _base(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows with _row, _id, and the text where something was found; spans with _row,
    ord, kind, value, start, end, and the text on both sides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    none = F.array().cast("array<struct<value:string,gap:int,before:string,after:string,"
                          "next:int>>")
    found = {}
    for kind, pattern in PATTERNS.items():
        seed = SEEDS[kind]
        has = F.col("_text").rlike(r"[0-9][\x20-]?[0-9]" if seed is None else r"[0-9]") if kind != "email" \
            else F.lit(True)
        if seed is not None:
            has = F.contains("_text", F.lit(seed)) & has
        found[kind] = F.when(has, _found(F.col("_text"), pattern, NEAR)).otherwise(none)
    base = base.withColumns(found)
    any_ = F.lit(False)
    for kind in PATTERNS:
        any_ = any_ | (F.size(kind) > 0)
    rows = keep(base.select(F.monotonically_increasing_id().alias("_row"), "_id",
                            F.when(any_, F.col("_text")).alias("_text"), *PATTERNS), "found")
    parts = [rows.filter(F.size(kind) > 0).select(
        "_row", F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        .select("_row", "ord", "kind", "i", "m.*") for i, kind in enumerate(PATTERNS)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = keep(_placed(every, ["_row", "ord"]).filter(_valid()).drop("i", "gap"), "base-spans")
    return rows.select("_row", "_id", "_text"), spans


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_matches(text, TERM), F.lower))


def _entities(spans: DataFrame, support: int) -> DataFrame:
    """_row, entity, n_e and a hash of the surroundings, of entities in `support` documents."""
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("value"))
                         .otherwise(F.regexp_replace("value", "[^0-9.]", "")))
    seen = spans.select("_row", entity.alias("entity"), F.xxhash64("before", "after").alias("near"))
    seen = keep(seen.groupBy("_row", "entity").agg(F.bit_xor("near").alias("near")), "seen")
    n_e = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(
        F.col("n_e") >= support)
    return keep(seen.join(n_e, "entity").select("_row", "entity", "near", "n_e"), "entities")


def _words(rows: DataFrame, spans: DataFrame, entities: DataFrame) -> DataFrame:
    """Words of the documents of `entities`, but not within base spans: _row, start, end, value,
    term, and a hash of the words beside each."""
    some = entities.select("_row").distinct()
    words = rows.join(some, "_row").select("_row", F.posexplode(F.transform(
        _with_gaps(F.col("_text"), TERM), lambda x: F.struct(
            x["value"].alias("value"), F.length(x["before"]).alias("gap")))).alias("i", "m"))
    words = _placed(words.select("_row", "i", "m.*"), ["_row"]).select(
        "_row", "start", "end", "value")
    both = words.withColumn("base", F.lit(False)).unionByName(
        spans.join(some, "_row", "left_semi").select(
            "_row", "start", "end", "value", F.lit(True).alias("base")))
    order = Window.partitionBy("_row").orderBy("start", "end", "base")
    past = F.max(F.when(F.col("base"), F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    # The nearest start ahead is the next base span's, as spans come by start.
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(
        Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("end"), F.desc("base"))
        .rowsBetween(Window.unboundedPreceding, -1))
    beside = F.xxhash64(F.collect_list("value").over(order.rowsBetween(-BESIDE, BESIDE)))
    placed = both.withColumns({"past": past, "beside": beside}).withColumn("ahead", ahead)
    return keep(placed.filter(
        ~F.col("base") & (F.coalesce("past", F.lit(0)) <= F.col("start"))
        & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))).select(
            "_row", "start", "end", "value", F.lower("value").alias("term"), "beside"), "words")


def disclosures(docs: DataFrame, entities: DataFrame, words: DataFrame, text_col: str = "text",
                support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, share): terms that tell at least `threshold` of what there is to tell of an
    entity. `entities` and `words` are those of `_entities` and `_words`. Counts are of documents,
    over all of `docs`; a term counts wherever in them it stands."""
    terms = words.groupBy("_row", "term").agg(F.bit_xor("beside").alias("beside"))
    n_te = keep(entities.join(terms, "_row").groupBy("entity", "n_e", "term").agg(
        F.count(F.lit(1)).alias("n_te"),
        F.count_distinct(F.xxhash64("near", "beside")).alias("n_near"))
        .filter(F.col("n_near") >= support), "pairs")
    group = F.pmod(F.xxhash64("term"), F.lit(GROUPS)).alias("group")
    groups = n_te.select(group).distinct()  # GROUPS rows at most
    every = docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    n_t = (every.withColumn("group", group).join(F.broadcast(groups), "group", "left_semi")
           .groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    n = docs.select(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    whole = F.ln(n / F.col("n_e"))
    told = F.ln(n * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return (n_te.join(n_t, "term").withColumn("share", F.when(whole > 0, told / whole))
            .filter(F.col("share") >= threshold).select(
                F.col("entity"), "term", F.round("share", 6).alias("share")))


def _term_spans(entities: DataFrame, words: DataFrame, told: DataFrame) -> DataFrame:
    """Places of the disclosing terms in the documents of their entity: _row, start, end, value."""
    flagged = entities.join(told, "entity").select("_row", "term").distinct()
    return words.join(flagged, ["_row", "term"], "left_semi").select(
        "_row", "start", "end", "value")


def _all_spans(docs: DataFrame, id_col: str, text_col: str, support: int, threshold: float
               ) -> tuple[DataFrame, DataFrame]:
    rows, spans = _base(docs, id_col, text_col)
    entities = _entities(spans, support)
    words = _words(rows, spans, entities)
    told = keep(disclosures(docs, entities, words, text_col, support, threshold), "disclosures")
    terms = _term_spans(entities, words, told).select(
        "_row", F.lit(len(PATTERNS)).alias("ord"), F.lit(TERM_KIND).alias("kind"), "value", "start",
        "end")
    every = spans.select("_row", "ord", "kind", "value", "start", "end").unionByName(terms)
    return rows, keep(every, "spans")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, n_term, `base_spans` and `spans`
    (`kind:start:end` by start, then kind as listed; code points, end exclusive).

    Null and empty texts have no spans. Repeated rows count each and have equal spans. Other columns
    are not read.
    """
    rows, spans = _all_spans(docs, id_col, text_col, support, threshold)
    one = F.struct("start", "ord", F.concat_ws(":", "kind", "start", "end").alias("span"))
    base = F.col("ord") < len(PATTERNS)
    name = [*PATTERNS, TERM_KIND]
    counts = [F.count_if(F.col("ord") == i).alias(f"n_{k}") for i, k in enumerate(name)]
    by_row = spans.groupBy("_row").agg(
        *counts, F.array_sort(F.collect_list(F.when(base, one))).alias("b"),
        F.array_sort(F.collect_list(one)).alias("s"))
    out = rows.select("_row", "_id").join(by_row, "_row", "left")
    join = [F.coalesce(F.array_join(F.transform(c, lambda x: x["span"]), ","), F.lit(""))
            for c in ("b", "s")]
    return out.select(F.col("_id").alias(id_col),
                      *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in name],
                      join[0].alias("base_spans"), join[1].alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Id and new text of each document that changes: entities become their kind, disclosing words
    that begin with a capital become `[NAME]`, others go. Documents without spans have no row."""
    rows, spans = _all_spans(docs, id_col, text_col, support, threshold)
    order = Window.partitionBy("_row").orderBy("start", "ord")
    past = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                      F.lit(0))
    label = F.when(F.col("kind") != TERM_KIND, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))
                   ).when(F.col("value").rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
    cut = spans.withColumn("past", past).select(
        "_row", F.struct("start", "ord", "past", "end", F.when(
            F.col("start") >= F.col("past"), label).otherwise(F.lit("")).alias("label")).alias("s"))
    cut = cut.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("s"),
                                  F.max("s.end").alias("last"))
    parts = F.transform("s", lambda x: F.concat(F.substring(
        F.col("_text"), x["past"].cast("int") + 1,
        F.greatest(F.lit(0), x["start"] - x["past"]).cast("int")), x["label"]))
    text = F.concat(F.array_join(parts, ""), F.substring(
        F.col("_text"), F.col("last").cast("int") + 1, F.length("_text")))
    return rows.join(cut, "_row").select(F.col("_id").alias(id_col), text.alias(text_col))
