"""Whitening of vectors by refined eigenvectors of their distributed covariance.

Executors reduce the distinct vectors, centred at whole numbers near their
mean, to exact integer cross-products, so the covariance depends neither on
the order of rows nor on lost and repeated tasks.  Its eigenvectors are first
found in single precision and then corrected by the iterations of Ogita and
Aishima: matrix products in extended precision give a first-order correction
for all vectors at once, which squares their error.  Where eigenvalues lie
closer than the error, the vectors are no directions of their own yet; the
covariance is projected on such a cluster, shifted by its mean eigenvalue and
solved there.

The driver holds the sums and a matrix of dimensions by dimensions.

Defined results: a vector that is null, empty or holds a null or non-finite
entry is left out, and so is one whose length is not the commonest (of equally
common ones the greatest); a component without variance has whitened value 0
and takes no part in ``identity_error``; ``deviation`` is null where it does
not fit a long; repeated rows and rows without an id have their own results;
vectors of fewer dimensions have fewer components; an empty table gives an
empty result; other columns are not looked at; an entry beyond ``LARGEST`` is
an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import record, settle

#: Factor from entries to whole numbers, largest whole number, components returned, rows of a matrix product.
FACTOR, LARGEST, COMPONENTS, ROWS = 256, 1 << 40, 4, 4096
_LONG = 1 << 63


def scaled(vectors: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``vec_id, x`` of the vectors whose entries are all finite, with whole entries."""
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(e, lambda c: F.when(F.abs(c * factor) < LARGEST, F.floor(c * factor)).otherwise(
        F.raise_error(F.lit("an entry is too large for exact sums"))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


_SUMS = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("total", pa.decimal128(38))])


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of every dimension, largest distance of an entry from its mean."""

    def run(batches):
        n, total, low, high = 0, [0] * dims, None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dims)
                n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(0))]
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield record(_SUMS, [np.arange(dims), [n] * dims, low, high, total])

    parts = fit.mapInArrow(run, "at int, n long, low long, high long, total decimal(38,0)")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).orderBy("at").collect()
    n, total = int(rows[0].n), [int(r.total) for r in rows]
    return n, total, max(max(abs(r.low - t // n), abs(r.high - t // n)) for r, t in zip(rows, total))


def _products(y: np.ndarray, widest: int) -> np.ndarray:
    """Exact cross-products of whole numbers, in blocks that double precision holds."""
    rows = (1 << 53) // max(1, widest * widest)
    if rows < 1 or widest * widest * len(y) >= _LONG:
        return y.T.astype(object) @ y.astype(object)
    total = np.zeros((y.shape[1],) * 2, np.int64)
    for i in range(0, len(y), min(rows, ROWS)):
        block = y[i:i + min(rows, ROWS)].astype(np.float64)
        total += (block.T @ block).astype(np.int64)
    return total


_CELLS = pa.schema([("at", pa.int32()), ("value", pa.decimal128(38))])


def covariance(fit: DataFrame, dims: int, n: int, total: list[int], widest: int) -> np.ndarray:
    """Covariance with divisor n in extended precision, rounded once from whole numbers."""
    middle = np.array([t // n for t in total], np.int64)
    upper = np.triu_indices(dims)

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                own = _products(_matrix(b.column(0), dims) - middle, widest)[upper]
                held = [int(v) for v in own] if held is None else [a + int(v) for a, v in zip(held, own)]
        if held is not None:
            yield record(_CELLS, [np.arange(len(held)), held])

    parts = fit.mapInArrow(run, "at int, value decimal(38,0)")
    rest = [t - n * int(m) for t, m in zip(total, middle)]
    out = np.zeros((dims, dims), np.longdouble)
    whole = lambda v: np.longdouble(str(v))
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        i, j = upper[0][r.at], upper[1][r.at]
        out[i, j] = out[j, i] = whole(int(r.value) * n - rest[i] * rest[j]) / whole(n) / whole(n)
    return out


# ---------------------------------------------------------------- eigenvectors

def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors ``x``: the better ones, their eigenvalues and
    which pairs of eigenvalues are told apart by it."""
    size = np.eye(len(a), dtype=a.dtype)
    r, s = size - x.T @ x, x.T @ a @ x
    lam = np.diag(s) / (1 - np.diag(r))
    off = np.linalg.norm((s - np.diag(lam)).astype(float), 2) + np.linalg.norm(a.astype(float), 2) * np.linalg.norm(r.astype(float), 2)
    gap = lam[None, :] - lam[:, None]
    e = (s + lam[None, :] * r) / np.where(gap == 0, 1, gap)
    # values that are told apart by more than the error, and whose correction is one of first order
    apart = (np.abs(gap) > 2 * off) & (np.abs(e) < 1e-3)
    apart &= apart.T
    return x + x @ np.where(apart, e, r / 2), lam, apart


def orthonormal(x: np.ndarray) -> np.ndarray:
    """A step of Newton and Schulz: nearly orthonormal columns become so, with their error squared."""
    return x @ (3 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2


def clusters(lam: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring eigenvalues that are not told apart, of two or more."""
    order = np.argsort(lam)
    cuts = np.flatnonzero([apart[i, j] for i, j in zip(order, order[1:])]) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(a: np.ndarray, turns: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision.

    ``a`` may be in extended precision; single precision is the start, matrix
    products do the rest.
    """
    a = a.astype(np.longdouble)
    scale = np.abs(a).max() if a.size else 0
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    tiny, best = np.finfo(np.longdouble).eps * len(a), None
    for turn in range(turns):
        x, lam, apart = refine(a, x)
        for group in clusters(lam, apart):
            # a cluster's vectors span the right space; the shifted projection has its small gaps at full precision
            own = x[:, group]
            shifted = own.T @ (a @ own - own * lam[group].mean())
            if np.abs(shifted - np.diag(np.diag(shifted))).max() > tiny:
                turned = np.linalg.eigh(((shifted + shifted.T) / 2 / np.abs(shifted).max()).astype(float))[1]
                x[:, group] = own @ orthonormal(turned.astype(np.longdouble))
        s = x.T @ a @ x
        wrong = np.abs(s - np.diag(np.diag(s))).max() + np.abs(x.T @ x - np.eye(len(a))).max()
        if best is None or wrong < best[0]:
            best = wrong, x
        elif turn > 4:
            break
        if wrong <= tiny:
            break
    x = orthonormal(best[1])
    x = x / np.sqrt((x * x).sum(axis=0))
    lam = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-lam, kind="stable")
    return (lam[order] * scale).astype(float), x[:, order].astype(float)


# ---------------------------------------------------------------- rows

_WHITE = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])


def _deviations(x: np.ndarray, n: int, total: list[int], widest: int) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2; null beyond a long."""
    if (n * (widest + 1)) ** 2 * x.shape[1] < _LONG:
        return ((x * n - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    out: list[int | None] = [None] * len(x)
    rough = ((x - np.array([t / n for t in total])) ** 2).sum(axis=1) * float(n) ** 2
    for i in np.flatnonzero(rough < 1.01 * _LONG):
        exact = sum((n * v - t) ** 2 for v, t in zip(x[i].tolist(), total))
        out[i] = exact if exact < _LONG else None
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, factor: int = FACTOR) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per kept row and component."""
    kept = scaled(vectors, factor)
    commonest = kept.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = commonest.dims
    kept = kept.where(F.size("x") == dims)
    fit = settle(kept.select("x").distinct(), "fit")
    n, total, widest = sums(fit, dims)
    v = covariance(fit, dims, n, total, widest)
    lam, x = eigenvectors(v)
    trace, count = float(np.trace(v)), min(components, dims)
    lam, x = lam[:count], x[:, :count]
    varies = lam > dims * np.finfo(float).eps * max(float(lam[0]), 0.0)
    weights = np.where(varies, x / np.sqrt(np.where(varies, lam, 1.0)), 0.0)
    mean = np.array([float(t // n) + (t % n) / n for t in total])

    def products(batches):
        held = np.zeros((count + 1, count))
        for b in batches:
            if b.num_rows:
                w = (_matrix(b.column(0), dims) - mean) @ weights
                held += np.vstack([w.T @ w, w.sum(axis=0)])
        yield record(_PRODUCTS, [np.arange(held.size), held.ravel()])

    parts = fit.mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    both = np.zeros(count * (count + 1))
    for r in parts:
        both[r.at] = r.value
    both = both.reshape(count + 1, count) / n
    error = np.abs(both[:count] - np.outer(both[count], both[count]) - np.eye(count))[np.ix_(varies, varies)]

    def run(batches):
        for b in batches:
            if b.num_rows:
                whole = _matrix(b.column(1), dims)
                white = (whole - mean) @ weights
                ids = np.repeat(np.arange(len(whole)), count)
                own = pa.array(_deviations(whole, n, total, widest), pa.int64())
                yield record(_WHITE, [b.column(0).take(pa.array(ids)), np.tile(np.arange(1, count + 1), len(whole)), own.take(pa.array(ids)), white.ravel()])

    done = kept.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    share = F.array(*[F.lit(float(e) / trace if trace else 0.0) for e in lam])
    return done.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("component") - 1).alias("explained"), F.lit(float(error.max(initial=0.0))).alias("identity_error"))


_PRODUCTS = pa.schema([("at", pa.int32()), ("value", pa.float64())])
