"""Whitening of vectors by their leading principal components, found with a Chebyshev filter.

Entries become whole numbers, each distinct vector is kept once, and every product with the
covariance V is one pass over these: centred rows of a task times the block, summed up by position.
A few Lanczos steps tell where the spectrum ends. A cycle then sends a block of vectors through a
polynomial of V that is small on the unwanted part, makes it orthonormal (QR) and solves the small
problem inside it (Rayleigh-Ritz), until the residual of every wanted pair is at rounding level.
Blocks have the size of the model (dimension times `3 * components`), never that of the data.

Very long vectors only make blocks larger. Repeated rows count once in the fit and come back as
often as they were given. Vectors of another length than most (ties: the longer), and entries whose
64-fold has no place in a long, count as unusable like nulls and NaN. Components of no variance (up
to 1e-10 of the largest) cannot be scaled and are left out, so a table whose vectors are all alike
gives no rows, nor does an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.work import keep

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes of a cycle's polynomial, of the search for the spectrum's end, and cycles at most.
DEGREE, LANCZOS, CYCLES = 8, 8, 60
#: A pair is certified at this residual, relative to the largest eigenvalue.
CERTAIN = 4e-15
#: Where rounding ends the progress, this much is still accepted.
ROUNDING = 1e-12
#: Variances up to this part of the largest count as none.
NO_VARIANCE = 1e-10
#: Rows multiplied at a time.
ROWS = 4096
_LIMIT = float(1 << 62)


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of row, length, entries one after the other) of the usable vectors of a batch, as
    floor(64 c)."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(STEPS * values)
        usable = np.abs(values) < _LIMIT
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(owner[~usable], minlength=len(sizes)) == 0
    good &= sizes > 0
    return np.flatnonzero(good), sizes[good], values[good[owner]].astype("<i8")


def distinct_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct vector of whole numbers once, as bytes in a column `x`; offset not added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, values = _whole(batch.column(0))
            ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()),
                                          pa.py_buffer(values.tobytes())])], names=["x"])

    return df.select(F.col(vector).cast("array<double>")).mapInArrow(run, "x binary").distinct()


def _rows(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """The vectors of a batch of bytes, some rows at a time."""
    for lo in range(0, batch.num_rows, ROWS):
        part = b"".join(batch.column(0).slice(lo, ROWS).to_pylist())
        yield np.frombuffer(part, "<i8").reshape(-1, d)


@dataclass
class Centre:
    """Count and exact sums of the fitted vectors; sums come in whole part and rest, so that
    centring loses nothing."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.float64) / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exact; none where it has no place in a long."""
        near = float(self.n) * self.centred(x)
        rough = np.einsum("ij,ij->i", near, near)
        out: list[int | None] = [None] * len(x)
        small = np.flatnonzero(rough < 2.0 ** 62)
        if self.n < 1 << 31:
            # |n x - S| is below 2^31 here, so neither it nor the sum of squares can overflow.
            r = np.array([s % self.n for s in self.sums], np.int64)
            v = self.n * (x[small] - self.base) - r
            for i, s in zip(small.tolist(), (v * v).sum(axis=1).tolist(), strict=True):
                out[i] = s
            small = np.flatnonzero((rough >= 2.0 ** 62) & (rough < 2.0 ** 63 * 1.01))
        for i in small.tolist():
            s = sum((self.n * a - b) ** 2 for a, b in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = s if s < 1 << 63 else None
        return out


def _summed(vectors: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of a model-sized array that `of` makes from some rows; one pass. A task
    sends one number per place of the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _rows(batch, d):
                part = of(x).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)),
                                              pa.array(total)], names=["at", "v"])

    kind = of(np.zeros((1, d), np.int64)).ravel()
    whole = kind.dtype == np.int64
    rows = (vectors.mapInArrow(run, f"at int, v {'bigint' if whole else 'double'}")
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(len(kind), kind.dtype)
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def centre_of(vectors: DataFrame, d: int) -> Centre:
    """Count and exact sums; high and low halves are added apart, so nothing overflows."""
    got = _summed(vectors, d, lambda x: np.concatenate(
        [[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64)).tolist()
    return Centre(got[0], [h * (1 << 32) + w for h, w in zip(got[1:d + 1], got[d + 1:],
                                                            strict=True)])


def _lowest(product: Callable[[np.ndarray], np.ndarray], d: int, rng: np.random.Generator
            ) -> float:
    """About the least eigenvalue, from below, by a few Lanczos steps."""
    q = [v := rng.standard_normal(d)]
    q[0] = v / np.linalg.norm(v)
    alpha, beta = [], []
    for _ in range(min(LANCZOS, d)):
        w = product(q[-1][:, None])[:, 0]
        alpha.append(float(q[-1] @ w))
        basis = np.stack(q, axis=1)
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q.append(w / beta[-1])
    side = beta[:len(alpha) - 1]
    e, s = np.linalg.eigh(np.diag(alpha) + np.diag(side, 1) + np.diag(side, -1))
    return max(0.0, float(e[0] - abs(beta[-1] * s[-1, 0])))


def _filtered(product: Callable[[np.ndarray], np.ndarray], x: np.ndarray, low: float, cut: float,
              top: float) -> np.ndarray:
    """The block after a Chebyshev polynomial of V that stays small on [low, cut], scaled to about
    one at `top`. One pass per degree."""
    half, mid = max((cut - low) / 2, 1e-6 * top), (cut + low) / 2
    first = scale = half / max(top - mid, half)
    y = (product(x) - mid * x) * (scale / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - scale)
        x, y = y, (product(y) - mid * y) * (2 * after / half) - (scale * after) * x
        scale = after
    return y


@dataclass
class Fit:
    centre: Centre
    vectors: np.ndarray  # a unit eigenvector per column, by falling eigenvalue
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS, seed: int = 20240229) -> Fit:
    """The leading eigenpairs of the covariance of `vectors`, certified by their residuals."""
    centre, passes = centre_of(vectors, d), 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return _summed(vectors, d, of).reshape(block.shape) / centre.n

    trace = float(_summed(vectors, d, lambda x: (centre.centred(x) ** 2).sum(axis=0)).sum()
                  ) / centre.n
    wide = min(d, max(3 * components, components + 8))
    wanted = min(components, d)
    rng = np.random.default_rng(seed)
    low = _lowest(product, d, rng) if wide < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, wide)))[0]
    before = np.inf
    for _ in range(CYCLES):
        image = product(q)
        small = q.T @ image
        e, s = np.linalg.eigh((small + small.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        q, image = q @ s, image @ s
        left = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max()
        top = float(e[0])
        if left <= CERTAIN * top or wide == d or (
                left <= ROUNDING * top and left > before / 4):
            break
        before = left
        if wide < d:  # a new direction each cycle, so that none can be missed by the first block
            q[:, -1] = rng.standard_normal(d)
        q = np.linalg.qr(_filtered(product, q, min(low, float(e[-1])), float(e[-1]), top))[0]
    else:
        raise RuntimeError(f"not certified: residual {left / top:.1e} after {CYCLES} cycles")
    real = e[:wanted] > max(NO_VARIANCE * top, 0.0)
    count = int(real.sum())
    return Fit(centre, q[:, :count].copy(), e[:count].copy(), trace, float(left), passes)


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest entry of the whitened covariance minus the identity."""
    k = len(model.values)

    def of(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    got = _summed(vectors, len(model.vectors), of).reshape(k + 1, k) / model.centre.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """One row per usable row of `df` and component: id, component from 1, n (fitted vectors),
    deviation, whitened, explained, identity_error. The fit is made at once, the rows when they are
    asked for. Null ids stay; a deviation that has no place in a long is null."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    vectors = keep(distinct_vectors(rows, "_v"), "vectors")
    sizes = vectors.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(
        F.desc("count"), F.desc("bytes")).limit(1).collect()
    out = ("id {0}, component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double").format(id_type)
    if not sizes:
        return df.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    d = sizes[0]["bytes"] // 8
    vectors = vectors.filter(F.octet_length("x") == 8 * d)
    model = fit(vectors, d, components)
    if not len(model.values):
        return df.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    error = identity_error(vectors, model)
    share = (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                at, size, values = _whole(part.column("_v"))
                fits = size == d
                x = values[np.repeat(fits, size)].reshape(-1, d)
                w = model.whitened(x)
                ends = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(at[fits])),
                     pa.array(model.centre.deviations(x), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))],
                    names=["_id", "deviation", "w"])

    found = rows.mapInArrow(run, f"_id {id_type}, deviation bigint, w array<double>")
    shares = F.array(*[F.lit(s) for s in share])
    return found.select("_id", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        F.col("_id").alias(id_col), (F.col("_at") + 1).alias("component"),
        F.lit(model.centre.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))
