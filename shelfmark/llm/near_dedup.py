"""Near-duplicates by MinHash: a join on signature coordinates.

Each text's set of word shingles has a signature of `COORDINATES` minima. Texts with equal sets are
one class. Classes are posted under their (coordinate, value) pairs; pairs that only one class has
match nothing. Two classes that agree in at least `matches` coordinates must share a pair among the
rarest `common - matches + 1` common pairs of each, so only this prefix is joined, and classes with
fewer than `matches` common pairs are skipped altogether. What the prefixes bring together is kept
if the whole signatures collide in at least `matches` coordinates, and is then confirmed on the
full sets.

Inside a posting list not all pairs are formed. Its most central class meets all others first;
classes that get linked are one component and need no further test among themselves. For what is
left, each class counts how many of its shingles the other classes of the mixed lists have at all,
and marks its shingles in a small bitmap; both bound from above what two classes share. A second, longer
signature, of these classes only, is held to a threshold of its own, so that whole sets move for few
pairs that are not alike, however long the texts. The lists are compared block by block, each pair
of blocks by itself, and every pair of different components that collides often enough and that the
bounds allow becomes a candidate.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.words import (BLANKS_LOWER, SLAB, Slab, groups, lists, longs, slabs,
                                 text_bytes)
from shelfmark.llm.work import filter_bits, keep, passes, text_of

COORDINATES = 32
#: Coordinates that must collide. At a similarity of 0.85 a pair falls short of 17 of 32 with a
#: chance of 4 in a million, and components usually hold it by other links too.
MATCHES = 17
#: Most chance of a miss that a pair at the least similarity may have.
MISS = 2e-4
STAR_ROUNDS = 1
#: Rows of a block of a posting list, and 64-bit words of a set's marks.
BLOCK_ROWS = 256
MARK_WORDS = 32
#: Coordinates of the longer signature, a byte each, the most chance that a pair at the least
#: similarity falls short of its threshold, and pairs that are compared at a time.
MORE, MORE_MISS, PAIRS = 512, 1e-9, 8192


def _orders(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return flip, rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FIRST, _SECOND = _orders(7919, COORDINATES), _orders(104729, MORE)


@lru_cache(maxsize=8)
def more_matches_for(percent: int) -> int:
    """Coordinates of the longer signature that must collide. Bytes of unlike minima collide too,
    which only lets more pairs pass."""
    p, miss = percent / 100, 0.0
    for i in range(MORE):
        miss += comb(MORE, i) * p ** i * (1 - p) ** (MORE - i)
        if miss > MORE_MISS:
            return i
    return MORE


def matches_for(percent: int) -> int:
    """Coordinates that must collide: MATCHES, or as many fewer as keep the chance of a miss at a
    similarity of percent/100 within MISS. Refuses a percent for which not even one does."""
    p, miss, most = percent / 100, 0.0, 0
    for i in range(MATCHES):
        miss += comb(COORDINATES, i) * p ** i * (1 - p) ** (COORDINATES - i)
        most = i + 1 if miss <= MISS else most
    if not most:
        raise ValueError(f"{COORDINATES} coordinates miss too many pairs at {percent} percent")
    return most


def shingle_sets(slab: Slab, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text. A shorter text is one shingle; a
    text without words has none."""
    by_size = {m: slab.windows(m)[0] for m in {k, *(int(c) for c in slab.counts if 0 < c < k)}}
    out = []
    for first, n in zip(slab.bounds[:-1], slab.counts, strict=True):
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < k:
            out.append(by_size[int(n)][first:first + 1])
        else:
            out.append(np.unique(by_size[k][first:first + n - k + 1]))
    return out


def signatures(sets: list[np.ndarray], orders: tuple[np.ndarray, np.ndarray] = _FIRST
               ) -> np.ndarray:
    """Minima of each set under each coordinate's order; the sets must not be empty."""
    out = np.zeros((len(sets), len(orders[0])), np.uint32)
    if sets:
        every = np.concatenate(sets)
        start = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
        for i, (flip, times) in enumerate(zip(*orders, strict=True)):
            value = ((every ^ flip) * times) >> np.uint64(32)
            out[:, i] = np.minimum.reduceat(value, start)
    return out.view(np.int32)


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
    return int(raw[0]), int(raw[1])


def _signed(df: DataFrame, k: int) -> DataFrame:
    """_id, _row, n_shingles, ka, kb (digest of the set), sig. From _id, _row, _text."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("_text"))
            for slab in slabs(texts, BLANKS_LOWER):
                sets = shingle_sets(slab, k)
                full = np.array([len(x) > 0 for x in sets])
                sig = signatures([x for x in sets if len(x)])
                names = [_digest(x) for x in sets]
                part = batch.slice(slab.lo, slab.hi - slab.lo)
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), part.column("_row"), longs(np.array(list(map(len, sets)))),
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    lists(np.where(full, COORDINATES, 0), pa.array(sig.reshape(-1), pa.int32()))],
                    names=["_id", "_row", "n_shingles", "ka", "kb", "sig"])

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"_id {kind}, _row bigint, n_shingles bigint, ka bigint, kb bigint, "
                         "sig array<int>")


def _sets(df: DataFrame, k: int, bits) -> DataFrame:
    """Full sets of the rows that a filter on `_row` lets pass: c, set."""

    def run(batches):
        for batch in batches:
            row = batch.column("_row").to_numpy(zero_copy_only=False)
            some = np.flatnonzero(passes(bits.value, row))
            if not len(some):
                continue
            texts = text_bytes(batch.column("_text").take(pa.array(some)))
            for slab in slabs(texts, BLANKS_LOWER):
                sets = [x for x in shingle_sets(slab, k) if len(x)]
                names = [_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    pa.array([x.tobytes() for x in sets], pa.binary())], names=["ka", "kb", "set"])

    out = df.select("_row", "_text").mapInArrow(run, "ka bigint, kb bigint, set binary")
    return out.select(F.struct("ka", "kb").alias("c"), "set")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(),
                            strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                both = 0
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = (pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b"))
    c = "struct<ka:bigint,kb:bigint>"
    return full.select("a", "b", "x", "y").mapInArrow(run, f"a {c}, b {c}")


def _collisions(x: str, y: str) -> Column:
    same = [(F.col(x)[i] == F.col(y)[i]).cast("int") for i in range(COORDINATES)]
    return reduce(lambda p, q: p + q, same)


def connected(labels: DataFrame, links: DataFrame, own: bool = False) -> DataFrame:
    """Merge the labels (c, lab) that links (a, b) connect: each component gets its least label.
    With `own` every label is its class.

    Links are contracted: every label takes the least label it is linked with, twice over, and the
    links are drawn anew between what is left, until none is left.
    """
    if own:
        edge = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        edge = (links.join(labels.select(F.col("c").alias("a"), F.col("lab").alias("u")), "a")
                .join(labels.select(F.col("c").alias("b"), F.col("lab").alias("v")), "b"))
    while True:
        edge = keep(edge.filter("u != v").select(F.least("u", "v").alias("u"),
                                                 F.greatest("u", "v").alias("v")).distinct(),
                    "edges")
        if edge.isEmpty():
            return labels
        ends = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = keep(ends.groupBy("u").agg(F.min("v").alias("v"))
                  .select("u", F.least("u", "v").alias("p")), "parents")
        two = keep(up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.u")).select(
            F.col("x.u").alias("lab"), F.col("y.p").alias("p")), "parents")
        labels = keep(labels.join(two, "lab", "left")
                      .select("c", F.coalesce("p", "lab").alias("lab")), "labels")
        edge = (edge.join(two.select(F.col("lab").alias("u"), F.col("p").alias("pu")), "u")
                .join(two.select(F.col("lab").alias("v"), F.col("p").alias("pv")), "v")
                .select(F.col("pu").alias("u"), F.col("pv").alias("v")))


def _active(classes: DataFrame, matches: int) -> DataFrame:
    """Classes that share enough coordinate values with others: c, sig, prefix, score."""
    pair = F.shiftleft(F.col("i").cast("bigint"), 32) + F.pmod(
        F.col("v").cast("bigint"), F.lit(1 << 32))
    posts = classes.select("c", F.posexplode("sig").alias("i", "v")).select(
        "c", pair.alias("token"))
    common = keep(posts.groupBy("token").count().filter("count > 1"), "common-pairs")
    rare = F.array_sort(F.collect_list(F.struct("count", "token")))
    found = posts.join(common, "token").groupBy("c").agg(
        rare.alias("posts"), F.sum("count").alias("score")).filter(F.size("posts") >= matches)
    prefix = F.slice("posts", F.lit(1), F.size("posts") - (matches - 1))
    found = found.select("c", "score", F.transform(prefix, lambda x: x["token"]).alias("prefix"))
    return found.join(classes.select("c", "sig", "_row"), "c")


def _star(posts: DataFrame, order: Column, matches: int) -> DataFrame:
    """Pairs of each posting list's first class in `order` with those of other components that
    collide with it often enough."""
    hub = posts.groupBy("token").agg(
        F.max(F.struct(order.alias("o"), "c", "lab", "sig")).alias("h"),
        F.min("lab").alias("low"), F.max("lab").alias("high")).filter("low != high")
    hub = keep(hub.select("token", F.col("h.c").alias("b"), F.col("h.lab").alias("hub_lab"),
                          F.col("h.sig").alias("hub_sig")), "hubs")
    on = ((F.col("p.token") == F.col("h.token")) & (F.col("lab") != F.col("hub_lab"))
          & (_collisions("sig", "hub_sig") >= matches))
    return posts.alias("p").join(hub.alias("h"), on).select(F.col("c").alias("a"), "b").distinct()


def _marks(h: np.ndarray) -> np.ndarray:
    """A bit of `MARK_WORDS` words for each hash."""
    at = np.unique(h & np.uint64(64 * MARK_WORDS - 1))
    out = np.zeros(MARK_WORDS, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64),
                     np.uint64(1) << (at & np.uint64(63)))
    return out


def _room(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """c, n (size of the set), marks (its bits), more (its longer signature) and m: how many of its
    shingles any other class of the lists has. A class can share no more than m with any of them."""
    mine = keep(sets.join(posts.select("c").distinct(), "c", "left_semi"), "list-sets")

    def run(batches):
        for batch in batches:
            sets_ = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
            own = np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
            rows = batch.column("c").take(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [rows.field("ka"), rows.field("kb"),
                 longs(np.concatenate(sets_) if sets_ else np.zeros(0, np.int64))],
                names=["ka", "kb", "h"])

    def mark(batches):
        for batch in batches:
            raw = batch.column("set").to_pylist()
            sets_ = [np.frombuffer(x, np.uint64) for x in raw]
            more = [x.astype(np.uint8).tobytes() for lo, hi in groups(raw, 8 * SLAB)
                    for x in signatures(sets_[lo:hi], _SECOND)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), longs(np.array([len(x) for x in sets_], np.int64)),
                 pa.array([_marks(x).tobytes() for x in sets_], pa.binary()),
                 pa.array(more, pa.binary())], names=["c", "n", "marks", "more"])

    each = mine.mapInArrow(run, "ka bigint, kb bigint, h bigint")
    alone = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ka").alias("ka"),
                                  F.min("kb").alias("kb")).filter("n = 1")
    alone = alone.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("alone")).select(
        F.struct("ka", "kb").alias("c"), "alone")
    marked = mine.mapInArrow(mark, "c struct<ka:bigint,kb:bigint>, n bigint, marks binary, "
                             "more binary")
    return keep(marked.join(alone, "c", "left").select(
        "c", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), "marks", "more"),
        "room")


class _Block:
    """Rows of one posting list as arrays."""

    def __init__(self, rows: pa.StructArray):
        def number(col, name):
            return col.field(name).to_numpy(zero_copy_only=False)

        self.c = rows.field("c")
        self.lab = np.stack([number(rows.field("lab"), x) for x in ("ka", "kb")])
        self.n, self.m = number(rows, "n"), number(rows, "m")
        self.sig = rows.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(
            len(rows), -1).T
        self.marks = np.frombuffer(b"".join(rows.field("marks").to_pylist()),
                                   np.uint64).reshape(len(rows), -1)
        self.more = np.frombuffer(b"".join(rows.field("more").to_pylist()),
                                  np.uint8).reshape(len(rows), -1)
        self.prefix = rows.field("prefix").to_pylist()


def _candidates(x: _Block, y: _Block, same: bool, token: int, matches: int, percent: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two blocks of a list are of different components, collide often enough and
    can be similar enough; only where the list is the first that both are in."""
    apart = (x.lab[0][:, None] != y.lab[0]) | (x.lab[1][:, None] != y.lab[1])
    if same:
        apart = np.triu(apart, 1)
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.zeros(apart.shape, np.uint8)
    for p, q in zip(x.sig, y.sig, strict=True):
        hits += p[:, None] == q
    i, j = np.nonzero(apart & (hits >= matches))
    # A bit that one set has alone stands for a shingle or more that the other does not have.
    p, q = x.marks[i], y.marks[j]
    both = np.minimum(np.minimum(x.m[i], x.n[i] - np.bitwise_count(p & ~q).sum(1, np.int64)),
                      np.minimum(y.m[j], y.n[j] - np.bitwise_count(q & ~p).sum(1, np.int64)))
    able = 100 * both >= percent * (x.n[i] + y.n[j] - both)
    i, j = i[able], j[able]
    least = more_matches_for(percent)
    alike = [(x.more[i[a:a + PAIRS]] == y.more[j[a:a + PAIRS]]).sum(1) >= least
             for a in range(0, len(i), PAIRS)]
    alike = np.concatenate([np.zeros(0, bool), *alike])
    i, j = i[alike], j[alike]
    first = [min(set(x.prefix[a]).intersection(y.prefix[b])) == token
             for a, b in zip(i, j, strict=True)]
    first = np.array(first, bool)
    return i[first], j[first]


def _left_over(posts: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """All pairs of one posting list and different components that can be similar enough by what
    each shares with the others, and that collide often enough; each at the first pair that their
    prefixes share. Lists are met block by block, so only such pairs become rows."""
    room = _room(posts, sets).filter(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n"))
    posts = keep(posts.join(room, "c"), "rest")
    # Written, so that the join stands between exchanges alone and a hot list's rows can be split.
    sizes = keep(posts.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))
                                            .cast("int").alias("parts"),
                                            F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                 .select("token", "parts"), "list-sizes")
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    blocks = keep(posts.join(sizes, "token").groupBy("token", "parts", part.alias("part")).agg(
        F.collect_list(F.struct("c", "lab", "n", "m", "sig", "marks", "more", "prefix"))
        .alias("rows")), "blocks")

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            same = batch.column("same").to_pylist()
            for r, token in enumerate(batch.column("token").to_pylist()):
                left = _Block(x[r].values)
                right = left if same[r] else _Block(y[r].values)
                i, j = _candidates(left, right, same[r], token, matches, percent)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [left.c.take(pa.array(i)), right.c.take(pa.array(j))], names=["a", "b"])

    # Blocks with themselves need no shuffle; two blocks of a list meet under a key of their own.
    own = blocks.select("token", F.lit(True).alias("same"), F.col("rows").alias("x"),
                        F.lit(None).cast(blocks.schema["rows"].dataType).alias("y"))
    many = blocks.filter("parts > 1")
    low = many.filter("part + 1 < parts").select(
        "token", F.col("part").alias("lo"), F.explode(F.expr("sequence(part + 1, parts - 1)"))
        .alias("hi"), F.col("rows").alias("x"))
    high = many.filter("part > 0").select(
        "token", F.explode(F.expr("sequence(0, part - 1)")).alias("lo"), F.col("part").alias("hi"),
        F.col("rows").alias("y"))
    met = low.join(high, ["token", "lo", "hi"]).select("token", F.lit(False).alias("same"), "x", "y")
    c = "struct<ka:bigint,kb:bigint>"
    return own.unionByName(met).mapInArrow(run, f"a {c}, b {c}")


def _mixed(posts: DataFrame) -> DataFrame:
    """The posts of lists that hold more than one component."""
    lists_ = posts.groupBy("token").agg(F.min("lab").alias("low"), F.max("lab").alias("high"))
    return posts.join(keep(lists_.filter("low != high").select("token"), "mixed"), "token")


def _links(base: DataFrame, classes: DataFrame, k: int, percent: int, matches: int) -> DataFrame:
    """Labels (c, lab) of all classes that may have links."""
    active = keep(_active(classes, matches), "active")
    sets = _sets(base, k, filter_bits(active, "_row"))
    sets = keep(sets.join(active.select("c"), "c", "left_semi").groupBy("c")
                .agg(F.first("set").alias("set")), "sets")
    labels = active.select("c", F.col("c").alias("lab"))
    plain = active.select("c", "sig", "score", "prefix", F.explode("prefix").alias("token"))
    posts = plain.withColumn("lab", F.col("c"))
    for turn in range(STAR_ROUNDS):
        order = F.col("score") if turn == 0 else F.xxhash64(F.lit(turn), "c")
        pairs = keep(_star(posts, order, matches), "pairs")
        labels = connected(labels, keep(_confirm(pairs, sets, percent), "links"), turn == 0)
        posts = keep(_mixed(plain.join(labels, "c")), "posts")
        if posts.isEmpty():
            return labels
    rest = keep(_left_over(posts, sets, matches, percent), "pairs")
    return connected(labels, keep(_confirm(rest, sets, percent), "links"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
               percent: int = 80, matches: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id of its group of
    near-duplicates), `ka`/`kb` (digest of its set), `first` (whether its set holds that least id).

    Two documents are linked if their sets of k-word shingles have a Jaccard similarity of at
    least percent/100; groups are what links connect. Texts without words, null and empty ones,
    have no links. Repeated rows have equal sets. Null ids count for nothing in the least id: a
    group of null ids alone has a null one. Other columns are not read.
    """
    matches = matches_for(percent) if matches is None else matches
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    base = base.withColumn("_row", F.xxhash64("_id", "_text"))
    signed = keep(_signed(base, k), "signatures")
    some = signed.filter("n_shingles > 0").select(
        F.struct("ka", "kb").alias("c"), "_id", "_row", "sig")
    classes = keep(some.groupBy("c").agg(
        F.min("_id").alias("least"), F.min("_row").alias("_row"), F.first("sig").alias("sig")),
        "classes")
    labels = _links(base, classes, k, percent, matches)
    tops = keep(labels.join(classes.select("c", "least"), "c").groupBy("lab")
                .agg(F.min("least").alias("top")), "tops")
    linked = labels.join(tops, "lab").select("c", "top")
    named = keep(classes.select("c", "least").join(linked, "c", "left").select(
        F.col("c.ka").alias("ka"), F.col("c.kb").alias("kb"), "least",
        F.coalesce("top", "least").alias("top"), F.lit(True).alias("_known")), "named")
    out = signed.select("_id", "n_shingles", "ka", "kb").join(named, ["ka", "kb"], "left")
    known = F.col("_known").isNotNull()
    return out.select(
        F.col("_id").alias(id_col), "n_shingles",
        F.when(known, F.col("top")).otherwise(F.col("_id")).alias("component_id"), "ka", "kb",
        F.when(known, F.col("least").eqNullSafe(F.col("top"))).otherwise(F.lit(True))
        .alias("first"))
