"""Cosine similarity over unit weights: all pairs, similar items, query search.

Both sides of a match are long tables of unit weights (id, term_id, w); a score is the sum of
products over shared terms. Three exact ways compute the best k per query:

* `postings` joins the sides on the term and sums. The work is the number of (query, document,
  shared term) combinations, small when queries are short or terms are selective. Terms with many
  pairs are salted, so no term is one task's work.
* `blocks` writes both sides once, in blocks of bounded size. A task holds one query block and its
  best k, and reads the document blocks one after the other (see `blocks.py`): a product of short
  single-precision rows bounds the scores of all their pairs from above, and the few pairs that can
  still be among the best k are scored in full (see `_Best`). Neither pairs nor copies of a block are
  ever rows of a table, so disk and shuffle grow with the weights; the work with the pairs.
* `split` keeps the few most common terms out of the join: candidates come from the other terms
  only, whose postings are short, and are scored in full. A document that shares common terms
  alone scores at most the product of the two common parts' lengths, so a query whose k-th
  candidate beats that bound is done; the others meet the common parts in blocks that are only
  as wide as there are common terms.

All nearest texts (`similar_edges`) keep their vectors as one table of blocks, which is both sides.

`best_matches` takes term statistics of both sides (one small aggregate) and picks the cheapest
way. Documents with the same vector are one entry in any way, see `similar_edges`.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from copy import copy
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.columns import half_even, r6
from shelfmark.operators.blocks import BLOCK_ROWS, block_count, block_table, ids_of, meet
from shelfmark.operators.catalog import filter_condition
from shelfmark.operators.common import cut, first_per
from shelfmark.operators.tfidf import TfidfModel, text_vectors

SALT_PAIRS = 50_000_000    # joined postings of one term beyond this many are split
BROADCAST_ROWS = 500_000   # query weights up to this many rows (about 50 MB) are broadcast
SHARED_ROWS = 3_000        # rows of a query block, or of one that is read on both sides
HOT_TERMS = 256            # common terms: kept out of a split join
# Columns of the product that bounds scores, for documents with up to so many terms. Longer ones have
# a column for each term, if they may.
COLUMNS = {100: 512, 200: 1_024, 400: 1_536}
MET_TERMS = 8_192          # up to so many terms are dealt to columns by what they are met with,
MET_ROWS = 1_000           # in query blocks of so many rows; it does not pay for fewer
ATTR_GROUPS = 8            # groups of columns with an attribute whose bounds are told together
FULL_CELLS = 1 << 24       # cells of the matrix in which the rows of a query block are looked up
LOOKED_UP = 1 << 15        # entries looked up at a time, few enough for a core's cache
# Costs in multiply-adds of a dense product, measured on one machine.
PAIR_COST = 5_000          # one joined posting
SPLIT_COST = 60_000        # one candidate of a split match, its common terms looked up
BLOCK_COST = 1_000         # one pair of a block product
MOVE_COST = 2_000          # one weight packed into a block
READ_COST = 50             # one weight of a block read again

# Score to rank by, from cosine and the attributes of query and document, element by element.
Rescore = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Settle = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def match_stats(queries: DataFrame, docs: DataFrame) -> dict:
    """Sizes that decide how to match: joined postings, rows, most pairs of a term, widest term id.

    Per-term counts are combined before their small shuffle; the numbers of ids are estimates
    (within a few percent), which is all that block sizes and costs need. `cutoff` is the
    document frequency above which a term is common: at most HOT_TERMS terms are.
    """
    q = queries.groupBy("term_id").agg(F.count(F.lit(1)).alias("qf"))
    d = docs.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    terms = cut(q.join(d, "term_id", "full").select(
        "term_id", F.coalesce("qf", F.lit(0)).alias("qf"), F.coalesce("df", F.lit(0)).alias("df"),
        (F.coalesce("qf", F.lit(0)).cast("double") * F.coalesce("df", F.lit(0))).alias("pairs")))
    head = terms.select("df").orderBy(F.desc("df")).limit(HOT_TERMS + 1)
    low = head.agg(F.when(F.count(F.lit(1)) > HOT_TERMS, F.min("df")).otherwise(F.lit(0))
                   .alias("v")).scalar()
    work = terms.withColumn("cutoff", low).agg(
        F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("df") <= F.col("cutoff"), F.col("pairs"))), F.lit(0.0))
        .alias("rare_pairs"),
        F.coalesce(F.max("cutoff"), F.lit(0)).alias("cutoff"),
        F.coalesce(F.sum("qf"), F.lit(0)).alias("q_rows"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("d_rows"),
        F.coalesce(F.max("pairs"), F.lit(0.0)).alias("most"),
        F.coalesce(F.max("term_id"), F.lit(-1)).alias("top_term"))
    sizes = work.select(
        "*", queries.select(F.approx_count_distinct("qid")).scalar().alias("n_q"),
        docs.select(F.approx_count_distinct("did")).scalar().alias("n_d"))
    return sizes.first().asDict()


def pick_strategy(stats: dict, cores: int,
                  ways: tuple[str, ...] = ("postings", "blocks", "split")) -> str:
    """The cheapest of the given ways, in multiply-adds."""
    met = float(stats["n_q"]) * stats["n_d"]
    moved = MOVE_COST * (float(stats["q_rows"]) + stats["d_rows"]) + READ_COST * float(
        stats["d_rows"]) * block_count(stats["n_q"], cores, 2 * BLOCK_ROWS)
    cost = {"postings": stats["pairs"] * PAIR_COST, "blocks": met * BLOCK_COST + moved,
            "split": stats["rare_pairs"] * SPLIT_COST + met * HOT_TERMS + moved}
    return min(ways, key=cost.__getitem__)


def best_matches(queries: DataFrame, docs: DataFrame, k: int, strategy: str = "auto",
                 blocks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best k documents per query: (qid, did, score, rank), score > 0, ties by did.

    `queries` is (qid, term_id, w), or packed, `docs` is (did, term_id, w), both of unit length.
    `blocks` holds both in blocks already, where they are.
    """
    rows, queries = queries, unpacked(queries, "qid")
    stats = match_stats(queries, docs)
    if strategy == "auto":
        strategy = pick_strategy(stats, queries.sparkSession.sparkContext.defaultParallelism)
    if strategy == "postings":
        found = pair_scores(queries, docs, stats).filter("score > 0")
    elif strategy == "split":
        found = _split_matches(queries, docs, k, stats)
    elif blocks is not None:
        found = block_matches(*blocks, k, dict(queries.dtypes)["qid"]).drop("tie")
    else:
        found = _block_matches(rows, docs, k, stats)
    return first_per(found, ["qid"], [F.desc("score"), F.asc("did")], k, "rank")


def pair_scores(queries: DataFrame, docs: DataFrame, stats: dict | None = None) -> DataFrame:
    """Sparse dot products of every query with every document it shares a term with."""
    sums = _pair_sums(queries, docs, stats or match_stats(queries, docs))
    return sums.select("qid", "did", r6("s").alias("score"))


def _pair_sums(queries: DataFrame, docs: DataFrame, stats: dict) -> DataFrame:
    q, d = queries.select("qid", "term_id", F.col("w").alias("qw")), docs
    keys = ["term_id"]
    if stats["q_rows"] <= BROADCAST_ROWS:
        q = F.broadcast(q)
    elif stats["most"] > SALT_PAIRS:
        # A term's documents are spread over as many salts as its pairs need, and its query rows
        # are repeated as often; terms with few pairs have one salt and no repeats.
        qf = q.groupBy("term_id").agg(F.count(F.lit(1)).alias("_qf"))
        sizes = d.groupBy("term_id").agg(F.count(F.lit(1)).alias("_df")).join(qf, "term_id")
        sizes = cut(sizes.select("term_id", F.least("_df", F.ceil(
            F.col("_qf") * F.col("_df") / F.lit(float(SALT_PAIRS)))).cast("bigint")
            .alias("_k")))
        d = d.join(sizes, "term_id").withColumn("_salt", F.pmod(F.xxhash64("did"), "_k")).drop(
            "_k")
        q = q.join(sizes, "term_id").withColumn("_salt", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("_k") - 1))).drop("_k")
        keys = ["term_id", "_salt"]
    return (d.join(q, keys).groupBy("qid", "did")
            .agg(F.sum(F.col("w") * F.col("qw")).alias("s")))


def _split_matches(queries: DataFrame, docs: DataFrame, k: int, stats: dict) -> DataFrame:
    """(qid, did, score) that contains the best k of every query, common terms never joined."""
    freq = docs.groupBy("term_id").agg(F.count(F.lit(1)).alias("df")).filter(
        F.col("df") > stats["cutoff"])
    hot = F.broadcast(cut(freq.select("term_id", (F.row_number().over(
        Window.orderBy("term_id")) - 1).alias("hot_id"))))

    def parts(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        common = df.join(hot, "term_id").select(key, F.col("hot_id").alias("term_id"), "w")
        vec = cut(pack(common, key).withColumn("norm", F.sqrt(F.aggregate(
            "weights", F.lit(0.0), lambda a, x: a + x * x))))
        return df.join(hot, "term_id", "left_anti"), vec

    q_rare, q_hot = parts(queries, "qid")
    d_rare, d_hot = parts(docs, "did")
    sums = _pair_sums(q_rare, d_rare, stats)
    lookup = d_hot.select("did", F.map_from_arrays("terms", "weights").alias("_m"))
    wanted = q_hot.select("qid", F.arrays_zip("terms", "weights").alias("_v"))
    both = sums.join(wanted, "qid", "left").join(lookup, "did", "left")
    extra = F.aggregate(
        F.coalesce("_v", F.array().cast("array<struct<terms:int,weights:double>>")), F.lit(0.0),
        lambda a, e: a + e["weights"] * F.coalesce(F.try_element_at("_m", e["terms"]),
                                                   F.lit(0.0)))
    cands = both.select("qid", "did", r6(F.col("s") + F.coalesce(extra, F.lit(0.0)))
                        .alias("score"))
    cands = cut(first_per(cands, ["qid"], [F.desc("score"), F.asc("did")], k, "_r"))
    kth = cands.filter(F.col("_r") == k).select("qid", F.col("score").alias("_kth"))
    longest = d_hot.select(F.max("norm").alias("v")).scalar()
    slack = F.lit(2e-6)
    open_q = (q_hot.join(kth, "qid", "left").withColumn("_kth", F.coalesce("_kth", F.lit(0.0)))
              .filter(F.col("_kth") <= F.col("norm") * longest + slack))
    need = open_q.select(F.min((F.col("_kth") - slack) / F.col("norm")).alias("v")).scalar()
    near = d_hot.filter(F.col("norm") >= need)
    q = open_q.select("qid", "terms", "weights", F.lit(0.0).alias("q_attr"))
    d = near.select("did", "terms", "weights", F.lit(0.0).alias("d_attr"),
                    F.lit(0.0).alias("tie"))
    common = block_products(q, d, k, stats["n_q"], stats["n_d"])
    # A candidate may come back with its common part only; its full score is never lower.
    return (cands.select("qid", "did", "score").unionByName(common.select("qid", "did", "score"))
            .groupBy("qid", "did").agg(F.max("score").alias("score")).filter("score > 0"))


# -- blocks ----------------------------------------------------------------------------------

def pack(weights: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: its terms and weights as arrays (at most one entry per term)."""
    return (weights.groupBy(key, *extra)
            .agg(F.collect_list(F.struct("term_id", "w")).alias("_v"))
            .select(key, *extra, F.col("_v.term_id").alias("terms"),
                    F.col("_v.w").alias("weights")))


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """(key, term_id, w) of packed rows; others as they are."""
    if "terms" not in rows.columns:
        return rows
    each = F.explode(F.arrays_zip(F.col("terms").alias("term_id"), F.col("weights").alias("w")))
    return rows.select(key, each.alias("e")).select(key, "e.term_id", "e.w")


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0, in as few bytes as they need."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


class _Side:
    """A block's vectors by term: its terms in order, where the entries of each begin (and the last
    end), and the row and weight of each entry."""

    def __init__(self, table: pa.Table, key: str, attr: str) -> None:
        self.ids = ids_of(table.column(key))
        self.attr = table.column(attr).to_numpy()
        self.tie = table.column("tie").to_numpy() if "tie" in table.column_names else None
        terms = table.column("terms").combine_chunks()
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32),
                        np.diff(terms.offsets.to_numpy()))
        term = terms.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self._by(term[order])
        self.row = _narrow(row[order])
        self.w = table.column("weights").combine_chunks().flatten().to_numpy(
            zero_copy_only=False)[order]
        self.asks = (table.column("asks").to_numpy() if "asks" in table.column_names
                     else np.ones(len(self.ids), bool))

    def asking(self) -> _Side:
        """The rows that are queries as well."""
        if self.asks.all():
            return self
        out, here = copy(self), self.asks[self.row]
        out.ids, out.attr, out.asks = (x[self.asks] for x in (self.ids, self.attr, self.asks))
        out._by(self.term[here])
        out.w, out.row = self.w[here], (np.cumsum(self.asks) - 1)[self.row[here]]
        return out

    def _by(self, term: np.ndarray) -> None:
        terms, first = np.unique(term, return_index=True)
        self.terms, self.first = _narrow(terms), _narrow(np.append(first, len(term)))

    @property
    def term(self) -> np.ndarray:
        """The term of each entry."""
        return np.repeat(self.terms, np.diff(self.first.astype(np.int64)))


class _Rows:
    """A side's entries row by row, where those of each row begin, the place of each entry's term
    among a query block's terms, and the lengths of the rows. Of a term that a row has twice the last
    entry counts."""

    def __init__(self, side: _Side, place: np.ndarray) -> None:
        order, term = np.argsort(side.row, kind="stable"), side.term
        row = side.row[order]
        last = np.append((row[1:] != row[:-1]) | (term[order[1:]] != term[order[:-1]]), True)
        order = order[last[:len(order)]]
        self.row, self.w = side.row[order].astype(np.int64), side.w[order]
        self.at = np.take(place, term[order], mode="clip")
        self.size = np.bincount(self.row, minlength=len(side.ids))
        self.first = np.cumsum(self.size) - self.size
        self.norm = np.sqrt(np.bincount(self.row, self.w * self.w, len(side.ids)))


def _together(rows: _Rows, terms: int) -> np.ndarray:
    """How much the terms are met together, by some of the rows: only how tight bounds are depends on
    it."""
    some = np.linspace(0, len(rows.size) - 1, min(len(rows.size), 512)).astype(int)
    place = np.full(len(rows.size), -1)
    place[some] = np.arange(len(some))
    here = place[rows.row] >= 0
    x = np.zeros((len(some), terms), np.float32)
    x[place[rows.row[here]], rows.at[here]] = np.abs(rows.w[here])
    return x.T @ x


def _columns(often: np.ndarray, together: np.ndarray | None, many: int) -> np.ndarray:
    """The column of each term, and -1 for terms that the block lacks. While there are columns a term
    gets its own; the others, rare ones last, share that whose terms they are met with least."""
    column = np.full(len(often) + 1, -1)
    column[often] = np.arange(len(often)) % many
    if together is None or len(often) <= many:
        return column
    met, load = together[often[:many]].T.copy(), np.ones(many)
    most = 1.5 * len(often) / many
    for term in often[many:].tolist():
        at = column[term] = int(np.argmin(met[term] + (load >= most) * 1e30))
        met[:, at] += together[term]
        load[at] += 1
    return column


def _short(rows: _Rows, chosen: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Short single-precision rows of the chosen ones, whose products are no less than those of the
    whole rows. A row has the length of its part in each column: by the inequality of Cauchy and
    Schwarz a column adds as much to a product as its terms do, at least."""
    many = int(column.max(initial=0)) + 1
    place = np.full(len(rows.size), -1)
    place[chosen] = np.arange(len(chosen))
    row, at = place[rows.row], column[rows.at]
    here = (row >= 0) & (at >= 0)
    w = rows.w[here]
    parts = np.bincount(row[here] * many + at[here], w * w, len(chosen) * many)
    return np.sqrt(parts).astype(np.float32).reshape(len(chosen), many)


class _Best:
    """The best k of a query block so far.

    Few pairs are scored: a product of short rows bounds all scores of two blocks, in more columns for
    longer documents, and only pairs whose bound reaches a query's k-th are scored in full.
    """

    def __init__(self, side: _Side) -> None:
        self.q, n = side, len(side.ids)
        often = np.argsort(-np.diff(side.first.astype(np.int64)), kind="stable")
        # Of each term its place in the block, of terms that it lacks the one behind the last.
        self.place = np.full(int(side.terms.max(initial=0)) + 2, len(often), np.int32)
        self.place[side.terms] = np.arange(len(often))
        self.width, self.rows = len(often) + 1, _Rows(side, self.place)
        dealt = n >= MET_ROWS and len(often) <= MET_TERMS
        together = _together(self.rows, len(often)) if dealt else None
        self.columns = [_columns(often, together, many) for many in (
            *COLUMNS.values(), max(1, FULL_CELLS // max(n, 1)))]
        self.mine = [_short(self.rows, np.arange(n), column) for column in self.columns]
        self.full: tuple[int, np.ndarray] | None = None
        self.kth = np.zeros(n)
        self.row = np.zeros(0, np.int64)
        self.did, self.key = np.zeros(0, object), np.zeros(0, np.int64)
        self.score, self.tie = np.zeros(0), np.zeros(0)

    def bounds(self, d: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents in order of length, the matrix of bounds of the products with them in that order,
        and the slack of each query: no product is above its bound by more, which is what single
        precision and the rounding of scores may lose. While there is nothing to beat, all rows are
        as wide as they may."""
        order = np.argsort(d.size, kind="stable")
        ends = np.searchsorted(d.size[order], list(COLUMNS), "right") * bool(self.kth.any())
        parts = [mine @ _short(d, chosen, column).T for mine, column, chosen in zip(
            self.mine, self.columns, np.split(order, ends), strict=True) if len(chosen)]
        bound = np.concatenate(parts, axis=1) if parts else np.zeros((len(self.kth), 0), np.float32)
        loss = (max(x.shape[1] for x in self.mine) + 8) * 2.0 ** -23
        return order, bound, loss * self.rows.norm * d.norm.max(initial=0.0) + 1e-6

    def products(self, row: np.ndarray, col: np.ndarray, d: _Rows) -> np.ndarray:
        """Dot products of pairs of rows, in order of `row`. The block's rows are looked up in a matrix,
        as many at a time as it holds."""
        width, size = self.width, d.size[col]
        step = max(1, FULL_CELLS // width)
        stripe, piece = row // step, np.cumsum(size) // LOOKED_UP
        ends = np.flatnonzero((np.diff(stripe) != 0) | (np.diff(piece) != 0)) + 1
        out = [np.zeros(0)]
        for lo, hi in pairwise([0, *ends.tolist(), len(row)] if len(row) else []):
            start, many = int(stripe[lo]) * step, size[lo:hi]
            owner = np.repeat(np.arange(hi - lo), many)
            entry = np.arange(len(owner)) + (d.first[col[lo:hi]] - np.cumsum(many) + many)[owner]
            cell = ((row[lo:hi] - start) * width)[owner] + d.at[entry]
            out.append(np.bincount(owner, self._filled(start, step).take(cell) * d.w[entry],
                                   hi - lo))
        return np.concatenate(out)

    def _filled(self, start: int, step: int) -> np.ndarray:
        """The cells of the block's rows from `start` on, the last of each for terms it lacks."""
        if self.full is None or self.full[0] != start:
            self.full, mine = None, slice(*np.searchsorted(self.rows.row, (start, start + step)))
            full = np.zeros((min(step, len(self.q.ids) - start), self.width))
            full[self.rows.row[mine] - start, self.rows.at[mine]] = self.rows.w[mine]
            self.full = start, full.ravel()
        return self.full[1]

    def add(self, row: np.ndarray, col: np.ndarray, score: np.ndarray, d: _Side, k: int) -> None:
        """Keep the best k of what is held and the given cells, ties by tie column and id. Only rows
        with new cells are ordered anew."""
        if not len(row):
            return
        new = np.zeros(len(self.q.ids), bool)
        new[row] = True
        stay = ~new[self.row]
        held = [x[stay] for x in (self.row, self.score, self.tie, self.key, self.did)]
        ids = d.ids[col]
        key = np.array([_LEAST if i is None else i for i in ids], np.int64)
        old = [x[~stay] for x in (self.row, self.score, self.tie, self.key, self.did)]
        row, score, tie, key, did = (np.concatenate(x) for x in zip(
            old, (row, score, d.tie[col], key, ids), strict=True))
        order = np.lexsort((key, tie, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left")
        order, last = order[place < k], order[place == k - 1]
        self.row, self.score, self.tie, self.key, self.did = (
            np.concatenate([x, y[order]]) for x, y in zip(
                held, (row, score, tie, key, did), strict=True))
        self.kth[row[last]] = score[last]


_LEAST = np.iinfo(np.int64).min


def block_products(queries: DataFrame, docs: DataFrame, k: int, n_q: int, n_d: int,
                   rescore: Rescore | None = None, settle: Settle | None = None) -> DataFrame:
    """Best k per query by block products: (qid, did, score, tie).

    `queries` is (qid, q_attr, terms, weights), `docs` is (did, d_attr, tie, terms, weights).
    `rescore` turns cosine scores, with the attributes of queries and documents, into the scores to
    rank by; these never fall where a cosine score or the attribute of a document rises. With `settle`
    they are upper bounds: the cells that can still be among the best k are given to it (cosine
    score, attributes, ids) for their score.

    Both sides are written once, as blocks. A task holds a query block and its best k so far, and
    reads the document blocks one after the other.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return block_matches(query_blocks(queries, n_q, cores), doc_blocks(docs, n_d, cores), k,
                         dict(queries.dtypes)["qid"], rescore, settle)


def query_blocks(queries: DataFrame, n: int, cores: int) -> DataFrame:
    return block_table(queries, "qid", block_count(n, cores, SHARED_ROWS),
                       lambda t: _Side(t, "qid", "q_attr"), 2 * SHARED_ROWS)


def doc_blocks(docs: DataFrame, n: int, cores: int) -> DataFrame:
    return block_table(docs, "did", block_count(n, cores), lambda t: _Side(t, "did", "d_attr"))


def placed_blocks(docs: DataFrame, blocks: int, most: int = 2 * BLOCK_ROWS) -> DataFrame:
    """Those of documents that lie in so many partitions by id already."""
    return block_table(docs, "did", blocks, lambda t: _Side(t, "did", "d_attr"), most, placed=True)


def _reaching(bound: np.ndarray, slack: np.ndarray, least: np.ndarray, q_attr: np.ndarray,
              d_attr: np.ndarray, rescore: Rescore | None, signed: bool
              ) -> tuple[np.ndarray, np.ndarray]:
    """The cells, in order of rows, that by their bounds may have a score, and one that reaches `least`
    of their row."""
    none = 5e-7 - slack if signed else np.finfo(np.float32).tiny
    if rescore is None:
        return np.nonzero(bound >= np.maximum(least - slack, none)[:, None].astype(np.float32))
    # Columns in a few groups by attribute: of each group and row the least cosine that reaches it with
    # the group's highest attribute, found by halving.
    group = np.empty(len(d_attr), np.int64)
    order = np.argsort(d_attr, kind="stable")
    group[order] = np.arange(len(order)) * ATTR_GROUPS // max(len(order), 1)
    highest = np.full(ATTR_GROUPS, -np.inf)
    np.maximum.at(highest, group, d_attr)
    need = np.maximum(least, np.finfo(float).tiny)[:, None]
    low = np.zeros((len(least), ATTR_GROUPS), np.int64)
    high = np.full_like(low, int((bound.max(initial=0.0) + slack.max(initial=0.0)) * 1e6) + 2)
    for _ in range(int(high.max(initial=1)).bit_length()):
        mid = (low + high) // 2
        enough = rescore(mid / 1e6, q_attr[:, None], highest[None, :]) >= need
        low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
    start = np.maximum((high / 1e6).T - slack, none).T.astype(np.float32)
    return np.nonzero(bound >= start.take(group, axis=1))


def block_matches(left: DataFrame, right: DataFrame, k: int, kind: str,
                  rescore: Rescore | None = None, settle: Settle | None = None) -> DataFrame:
    """`block_products` of sides that are in blocks, queries with ids of type `kind`. A table of
    documents is a left side as well: that of the rows that ask."""
    def fold(best: _Best, d: _Side) -> None:
        there = _Rows(d, best.place)
        order, bound, slack = best.bounds(there)

        def scored(row: np.ndarray, col: np.ndarray, least: np.ndarray | None) -> tuple:
            """Of the given cells in order of rows: those that have a score, which reaches `least` of
            its row, and the scores."""
            cosine = np.rint(best.products(row, col, there) * 1e6) / 1e6
            found = cosine if rescore is None else rescore(cosine, best.q.attr[row], d.attr[col])
            good = found > 0 if least is None else (found > 0) & (found >= least[row])
            row, col, cosine, found = row[good], col[good], cosine[good], found[good]
            if settle is not None:
                found = settle(cosine, best.q.attr[row], d.attr[col], best.q.ids[row], d.ids[col])
                good = found > 0
                row, col, found = row[good], col[good], found[good]
            return row, col, found

        least = best.kth
        if 0 < k < bound.shape[1] and not best.kth.any():
            # Nothing to beat yet: the last of the k pairs with the highest bounds is.
            first = np.argpartition(bound, bound.shape[1] - k, axis=1)[:, -k:]
            some = np.take_along_axis(bound, first, axis=1) > 0
            row, _, found = scored(np.nonzero(some)[0], order[first[some]], None)
            least = np.full(len(best.kth), np.inf)
            np.minimum.at(least, row, found)
            least[np.bincount(row, minlength=len(least)) < k] = 0.0
        signed = min(best.rows.w.min(initial=0.0), there.w.min(initial=0.0)) < 0
        row, col = _reaching(bound, slack, least, best.q.attr, d.attr[order], rescore, signed)
        row, col, found = scored(row, order[col], least)
        good = found >= least[row]
        best.add(row[good], col[good], found[good], d, k)

    def finish(best: _Best) -> Iterator[tuple]:
        return zip(best.q.ids[best.row].tolist(), best.did.tolist(), best.score.tolist(),
                   best.tie.tolist(), strict=True)

    return meet(left, right, lambda side: _Best(side.asking()), fold, finish,
                f"qid {kind}, did bigint, score double, tie double")


def _block_matches(queries: DataFrame, docs: DataFrame, k: int, stats: dict) -> DataFrame:
    q = queries if "terms" in queries.columns else pack(queries, "qid")
    q = q.withColumn("q_attr", F.lit(0.0))
    d = pack(docs, "did").withColumns({"d_attr": F.lit(0.0), "tie": F.lit(0.0)})
    return block_products(q, d, k, stats["n_q"], stats["n_d"]).drop("tie")


# -- all pairs -------------------------------------------------------------------------------

def _pieces(weights: DataFrame, key: str) -> DataFrame:
    """(key, terms, weights): rows of an id that lie next to each other as one. An id has more than
    one piece where a batch ends or its rows lie apart."""
    types = dict(weights.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *lists = batch.columns
            if not len(ids):
                continue
            runs = pc.run_end_encode(ids)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), runs.run_ends])
            yield pa.RecordBatch.from_arrays(
                [runs.values, *[pa.ListArray.from_arrays(ends, x) for x in lists]],
                names=[key, "terms", "weights"])

    return weights.select(key, "term_id", "w").mapInArrow(
        run, f"{key} {types[key]}, terms array<{types['term_id']}>, weights array<{types['w']}>")


def _copies(weights: DataFrame, key: str) -> DataFrame:
    """(key, copy_of): documents with equal vectors share the smallest of their ids.

    Vectors are compared by 128 bits of their number of entries and of sums of the hashes of those
    (term, weight), which no order changes: they are added up where the rows lie, and only a row per
    document and task moves.
    """
    sums = []
    for seed in range(2):
        entry = F.xxhash64(F.lit(seed), "term_id", F.round("w", 12))
        sums += [F.sum(entry.bitwiseAND(F.lit((1 << 32) - 1))).alias(f"_low{seed}"),
                 F.sum(F.shiftrightunsigned(entry, 32)).alias(f"_high{seed}")]
    added = weights.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *sums)
    parts = [c for c in added.columns if c != key]
    marked = cut(added.select(key, *[F.xxhash64(F.lit(seed), *parts).alias(f"_d{seed}")
                                     for seed in range(2)]))
    heads = marked.groupBy("_d0", "_d1").agg(F.min(key).alias("copy_of"))
    return marked.join(heads, ["_d0", "_d1"]).select(key, "copy_of")


def _unblocked(table: DataFrame, key: str, kind: str, asks: bool = False) -> DataFrame:
    """(key, term_id, w): the weights of a table of blocks, or of its rows that ask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                side = pickle.loads(data.as_py())
                side = side.asking() if asks else side
                ids = pa.array(side.ids.tolist()).take(pa.array(side.row.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(side.term.astype(np.int32)), pa.array(side.w)],
                    names=[key, "term_id", "w"])

    return table.select("data").mapInArrow(run, f"{key} {kind}, term_id int, w double")


def similar_edges(weights: DataFrame, k: int = 10, key: str = "course_id",
                  strategy: str = "auto", asked: DataFrame | None = None) -> DataFrame:
    """The k nearest other documents of every document, or of the ids of `asked` alone, among all
    documents: (id, neighbor_id, score, rank).

    Copies are matched once: one head per distinct vector goes through the product, and the k + 1
    smallest ids of a group stand for the group on the document side (scores inside a group are
    equal and ties go to smaller ids, so no other member can be among anyone's best k). The heads'
    lists are then handed to their copies.
    """
    cores = weights.sparkSession.sparkContext.defaultParallelism
    groups = cut(_copies(weights, key))
    listed, heads = groups, groups.filter(F.col(key) == F.col("copy_of"))
    if asked is not None:
        listed = groups.join(asked.select(key).distinct(), key, "left_semi")
        heads = listed.select("copy_of").distinct()
    stand_ins = first_per(groups, ["copy_of"], [F.asc(key)], k + 1).select(key)
    marked = stand_ins.join(heads.select(F.col("copy_of").alias(key), F.lit(True).alias("asks")),
                            key, "left")
    # The vectors move once, packed, to their blocks; all that matches them reads those.
    n = block_count(stand_ins.count(), cores, SHARED_ROWS)
    # Marks and pieces take one exchange together; a join of both may put another after it.
    piece = F.struct("terms", "weights")
    each = _pieces(weights, key).select(key, F.lit(None).cast("boolean").alias("asks"),
                                        piece.alias("_p"))
    each = each.unionByName(marked.select(key, F.coalesce("asks", F.lit(False)).alias("asks")),
                            allowMissingColumns=True)
    whole = (each.filter(F.col(key).isNotNull()).repartition(n, key).groupBy(key)
             .agg(F.max("asks").alias("asks"), F.collect_list("_p").alias("_p"))
             .filter(F.col("asks").isNotNull()))
    rows = whole.select(
        F.col(key).alias("did"), "asks", F.lit(0.0).alias("d_attr"), F.lit(0.0).alias("tie"),
        F.flatten("_p.terms").alias("terms"), F.flatten("_p.weights").alias("weights"))
    table = placed_blocks(rows, n, 2 * SHARED_ROWS)
    kind = dict(weights.dtypes)[key]
    queries, docs = _unblocked(table, "qid", kind, asks=True), _unblocked(table, "did", kind)
    left = table if asked is None else query_blocks(
        pack(queries, "qid").withColumn("q_attr", F.lit(0.0)), heads.count(), cores)
    found = best_matches(queries, docs, k + 1, strategy, (left, table))
    lists = listed.join(found.select(F.col("qid").alias("copy_of"),
                                     F.col("did").alias("neighbor_id"), "score"), "copy_of")
    others = lists.filter(F.col(key) != F.col("neighbor_id")).drop("copy_of")
    return first_per(others, [key], [F.desc("score"), F.asc("neighbor_id")], k, "rank")


def with_percent(scored: DataFrame) -> DataFrame:
    return scored.withColumn("similarity_score", half_even(F.col("score") * 100.0, 1))


def recommend_similar(edges: DataFrame, courses: DataFrame, seeds: DataFrame | None = None,
                      n: int = 10, fill_zero: bool = True) -> DataFrame:
    """Similar courses with their attributes, for all or for the given course ids.

    A course with fewer than n neighbours goes on with courses of score 0 in id order, itself left
    out; a course whose text has no known word has only these. Ids that no course has get no rows;
    resolve them before (D06).
    """
    asked = courses.select("course_id").distinct()
    if seeds is not None:
        asked = asked.join(seeds.select("course_id").distinct(), "course_id", "left_semi")
        edges = edges.join(asked, "course_id", "left_semi")
    top = edges.filter(F.col("rank") <= n).select("course_id", "neighbor_id", "score", "rank")
    if fill_zero:
        found = top.select(F.col("course_id").alias("qid"), F.col("neighbor_id").alias("did"),
                           "score", "rank")
        filled = fill_with_zero(found, asked.select(F.col("course_id").alias("qid")), courses, n,
                                besides_itself=True)
        top = filled.select(F.col("qid").alias("course_id"), F.col("did").alias("neighbor_id"),
                            "score", "rank")
    attrs = courses.select(F.col("course_id").alias("neighbor_id"), "title", "category",
                           "platform", "level", "rating")
    return with_percent(top).join(attrs, "neighbor_id")


def fill_with_zero(scored: DataFrame, queries: DataFrame, courses: DataFrame, n: int,
                   besides_itself: bool = False) -> DataFrame:
    """Queries with fewer than n hits are filled with unscored courses in id order, where a query is
    itself a course with others only.

    A query misses at most n rows and skips at most n scored ones and itself, so the n smallest
    course ids beyond its own hits are among the 2n + 1 smallest of the catalog.
    """
    hits = scored.groupBy("qid").agg(F.count(F.lit(1)).alias("_hits"))
    short = (queries.select("qid").distinct().join(hits, "qid", "left")
             .withColumn("_hits", F.coalesce("_hits", F.lit(0))).filter(F.col("_hits") < n))
    spare = (courses.select("course_id").orderBy("course_id").limit(2 * n + 1)
             .agg(F.array_sort(F.collect_list("course_id")).alias("ids")).select("ids").scalar())
    extra = (short.withColumn("did", F.explode(spare))
             .join(scored.select("qid", "did"), ["qid", "did"], "left_anti"))
    if besides_itself:
        extra = extra.filter(F.col("qid") != F.col("did"))
    extra = first_per(extra, ["qid"], [F.asc("did")], n, "_pos").filter(
        F.col("_pos") + F.col("_hits") <= n)
    return scored.unionByName(extra.select(
        "qid", "did", F.lit(0.0).alias("score"),
        (F.col("_pos") + F.col("_hits")).cast("int").alias("rank")))


def recommend_by_query(model: TfidfModel, courses: DataFrame, queries: DataFrame, n: int = 10,
                       filters: dict | None = None, key: str = "qid", text: str = "query",
                       fill_zero: bool = True, strategy: str = "auto") -> DataFrame:
    """Best n courses for each of many text queries: (qid, course_id, score, rank, %).

    Equal texts are scored once. Filters restrict the documents before anything is scored; the
    idf stays that of the whole catalog. Courses without a weight score 0, so a model that lags
    behind the catalog needs no padding.
    """
    pool = courses.filter(filter_condition({c: v for c, v in (filters or {}).items()
                                            if c not in ("search", "min_rating")}))
    texts = queries.select(key, text).withColumn("_h", F.sha2(F.lower(text), 256))
    once = texts.groupBy("_h").agg(F.min(text).alias("_t"))
    # Whole texts are read once; what is read again holds their digests only.
    q = cut(text_vectors(model, once, "_h", "_t").withColumnRenamed("_h", "qid"))
    texts = cut(texts.select(key, "_h"))
    docs = model.weights.withColumnRenamed("course_id", "did")
    if filters:
        docs = docs.join(pool.select(F.col("course_id").alias("did")), "did", "left_semi")
    scored = cut(best_matches(q, docs, n, strategy))
    if fill_zero:
        scored = fill_with_zero(scored, texts.select(F.col("_h").alias("qid")), pool, n)
    per_query = texts.select(key, "_h").join(scored.withColumnRenamed("qid", "_h"), "_h")
    return with_percent(per_query.select(key, F.col("did").alias("course_id"), "score", "rank"))
