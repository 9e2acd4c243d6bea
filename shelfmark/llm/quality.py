"""Quality rules by host.

Each document is held to rules of its own. Failures are added up by host, each host's failure rate
is shrunk towards the corpus by a beta prior fitted to all hosts' rates, and the host verdict is
joined back. A host is bad if its posterior says that its odds of a failure are `LIFT` times the
corpus's or more, and good if they are as much lower. On a bad host a document that fails one softer
rule goes, on a good one it needs to fail three, elsewhere two. A document that fails no rule stays,
whatever its host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.words import BLANKS, Slab, longs, slabs, text_bytes
from shelfmark.llm.work import keep, text_of

#: Parameters of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SOFT = {"symbols": "5 * n_symbols > n_words",
        "mostly symbols": "n_symbols > n_words",
        "lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
        "length": "word_chars < 2 * n_words or word_chars > 20 * n_words"}
#: Odds of a failure against the corpus's that make a host bad (or, turned round, good), and the
#: standard deviations of the posterior that must lie beyond them: 1.645 for 19 chances of 20.
LIFT, SURE = 2.0, 1.645
#: Softer rules a document must fail to go, by its host's verdict.
SOFT_LIMITS = {"bad": 1, "usual": 2, "good": 3}

_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RESULT = (*FIGURES, "base_failed", "n_soft", "host_rate", "host_verdict", "kept")


def _repeat_words(slab: Slab, size: int) -> np.ndarray:
    """Words of each text that lie in a window which the text holds twice or more."""
    out = np.zeros(slab.hi - slab.lo, np.int64)
    h, inside = slab.windows(size)
    if not len(h):
        return out
    own = slab.owner()
    at = np.flatnonzero(inside)
    text = own[at]
    order = np.lexsort((h[at], text))
    sh, st = h[at][order], text[order]
    same = (sh[1:] == sh[:-1]) & (st[1:] == st[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(own) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + size, -1)
    covered = np.cumsum(step)[:-1] > 0
    return np.bincount(own[covered], minlength=len(out))


def _lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches):
    for batch in batches:
        texts = text_bytes(batch.column("_text"))
        rest = batch.select([x for x in batch.schema.names if x != "_text"])
        for slab in slabs(texts, BLANKS):
            some = slab.texts
            lines = np.array([_lines(x) for x in some], np.int64).reshape(-1, 2)
            chars = [len(x.translate(None, _CONTINUED + _BLANK)) for x in some]
            symbols = [len(x) - len(x.translate(None, _SYMBOLS)) for x in some]
            figures = [slab.counts, np.array(chars), np.array(symbols), lines[:, 0], lines[:, 1],
                       _repeat_words(slab, WINDOW)]
            part = rest.slice(slab.lo, slab.hi - slab.lo)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(longs, figures)],
                                             names=[*part.schema.names, *FIGURES])


def figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of `df` with what the rules are about: words and code points in them,
    symbols, lines with a word, those equal to an earlier line, words in repeated windows. A null
    text is empty; columns with the names of `FIGURES` or `_text` give way."""
    rest = [c for c in df.columns if c != text_col and c.lower() not in (*FIGURES, "_text")]
    narrow = df.select(*(F.col(f"`{c}`") for c in rest), text_of(text_col).alias("_text"))
    kinds = T.StructType([*narrow.schema.fields[:-1], *(T.StructField(c, T.LongType())
                                                        for c in FIGURES)])
    return narrow.mapInArrow(_measure, kinds)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> DataFrame:
    """One row: alpha and beta by the method of moments over hosts, each host counting by its
    documents. `hosts` has n and failed. Rates that do not differ more than chance would make them
    give a prior as strong as the whole corpus."""
    sums = hosts.agg(
        F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), F.sum("failed").alias("failed"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(2.0))).alias("squares"),
        F.sum(F.pow(F.col("failed").cast("double"), F.lit(2.0)) / F.col("n")).alias("spread"))
    sums = sums.withColumn("mean", (F.col("failed") + 0.5) / (F.col("docs") + 1.0))
    # Between-host variance: what is left of the spread after the binomial part.
    left = F.greatest(F.lit(0.0), F.col("spread") - F.col("docs") * F.pow("mean", F.lit(2.0))
                      - (F.col("hosts") - 1) * F.col("mean") * (1 - F.col("mean")))
    room = F.col("docs") - F.col("squares") / F.col("docs") - (F.col("hosts") - 1)
    var = F.when(room > 0, left / room).otherwise(F.lit(0.0))
    full = F.col("mean") * (1 - F.col("mean"))
    strength = F.least(F.col("docs").cast("double"), F.greatest(F.lit(1.0), F.when(
        var > 0, full / var - 1).otherwise(F.col("docs").cast("double"))))
    return sums.select((F.col("mean") * strength).alias("alpha"),
                       ((1 - F.col("mean")) * strength).alias("beta"))


def _bar(mean: Column, lift: float) -> Column:
    """The rate at which the odds are `lift` times those of `mean`."""
    return lift * mean / (1 - mean + lift * mean)


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: n, failed, rate (shrunk), verdict (bad, usual or good).

    The posterior of a host's rate is a beta with `rate` as its mean; its tails are taken as those of
    a normal of the same mean and variance. Where hosts do not differ more than chance, the prior
    holds all rates at the corpus's, and all hosts are usual.
    """
    soft = [F.expr(x).cast("int") for x in SOFT.values()]
    hosts = keep(measured.groupBy(host).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(base_failed() | (sum(soft[1:], soft[0]) > 0), 1).otherwise(0))
        .alias("failed")), "hosts")
    prior = beta_prior(hosts)
    alpha, beta = prior.select("alpha").scalar(), prior.select("beta").scalar()
    hosts = hosts.select("*", alpha.alias("alpha"), beta.alias("beta"))
    mean, weight = F.col("alpha") / (F.col("alpha") + F.col("beta")), F.expr("n + alpha + beta")
    hosts = hosts.withColumn("rate", (F.col("failed") + F.col("alpha")) / weight)
    margin = SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    verdict = (F.when(F.col("rate") - margin >= _bar(mean, LIFT), "bad")
               .when(F.col("rate") + margin <= _bar(mean, 1 / LIFT), "good").otherwise("usual"))
    return hosts.select(host, "n", "failed", "rate", verdict.alias("verdict"))


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The columns of `df` but the text, with the figures of `FIGURES`, `base_failed`, `n_soft`,
    `host_rate`, `host_verdict` and `kept`.

    A null host is one host. Null and empty texts have too few words; very long ones are measured
    whole. Repeated rows count each. No verdict depends on an order, so there are no ties. Columns
    that bear the name of one of the result's give way to it; others pass unchanged.
    """
    rest = [c for c in df.columns if c not in (text_col, host_col) and c.lower() not in RESULT]
    other = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("_"))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    measured = keep(figures(df.select(other.alias("_rest"), host.alias("_host"), F.col(text_col)),
                            text_col), "figures")
    verdict = keep(host_verdicts(measured, "_host").select("_host", "rate", "verdict"), "verdicts")
    soft = [F.expr(x).cast("int") for x in SOFT.values()]
    out = (measured.withColumns({"base_failed": base_failed(), "n_soft": sum(soft[1:], soft[0])})
           .join(verdict, "_host"))
    limit = F.create_map(*(F.lit(x) for kind in SOFT_LIMITS.items() for x in kind))[
        F.col("verdict")]
    return out.select(*(F.col(f"_rest.`{c}`") for c in rest), *FIGURES, "base_failed", "n_soft",
                      F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"),
                      (~F.col("base_failed") & (F.col("n_soft") < limit)).alias("kept"))
