"""Embedding whitening by principal components from contour integration.

Vectors are put on a grid (x = floor(256 c)). The components are unit
eigenvectors of the covariance of the distinct grid vectors, and a row's
whitened values are its projections on them over the root of the eigenvalue.

Method: the distinct vectors are written once; two passes sum them and their
products, centred on the rounded mean, in whole numbers, so the covariance is
exact to rounding and the same in every run. Its size is that of the vectors
squared, whatever the rows, and it is solved on the driver by the FEAST
algorithm: the spectral projector of an interval is an integral of (zI - V)^-1
around it; Gauss-Legendre quadrature of complex shifted solves applies it to a
block of vectors, and Rayleigh-Ritz in their span gives eigenvalues and
vectors; repeated until the residuals are at rounding. Interval borders are put
into gaps, and inertia counts on both sides (sign changes of a Sturm sequence
of the tridiagonal form) tell how many eigenvalues lie between: an interval is
done only when that many have been found. Rows are then projected in one pass.

Defined results: rows whose vector is null or empty, holds a null or
non-finite entry, or an entry whose grid value is no long take no part; nor
do rows of another length than most (the longer of two equally common
ones). Null and repeated ids are kept, a row each. Components beyond the rank
(eigenvalue under 1e-12 of the trace) are left out, so fewer than ``k`` per row
may come, none if all vectors are equal. A deviation that is no long is null.
The sign makes a component's largest entry positive. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K = 4
GRID = 256
#: Quadrature nodes of the upper half of a contour, and rounds of subspace iteration.
NODES, ROUNDS = 8, 40
LEAST_SHARE = 1e-12
#: Rows handled at once inside a task.
ROWS = 4096


def gridded(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: the rows that take part, on the grid."""
    v = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * GRID))  # no long beyond 2**63: caught before
    fits = F.forall(F.col(vector_col), lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**63 / GRID, F.lit(False)))  # false for NaN, too
    d = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fits)
    return d.select(F.col(id_col).alias("id"), v.alias("x"))


def common_length(rows: DataFrame) -> int:
    top = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in C.sliced(batches, ROWS):
        x = b.column("x")
        yield b, x.flatten().to_numpy().reshape(b.num_rows, -1)


def _exact(x: np.ndarray, centre: np.ndarray, scale: int = 1) -> np.ndarray:
    """scale * x - centre in whole numbers: int64 where nothing can overflow, else Python's."""
    bound = scale * int(np.abs(x).max(initial=0)) + max(map(abs, centre.tolist()), default=0)
    return x * scale - centre.astype(np.int64) if bound < 2**62 else x.astype(object) * scale - centre


def _products(y: np.ndarray) -> np.ndarray:
    """y'y in Python's whole numbers; by floats where those are exact."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T.dot(y)


DECIMAL = pa.decimal128(38, 0)


def _moments(centre: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of a task: of the vectors, or of their centred products (upper half)."""
    total = 0
    for _, x in _matrices(batches):
        if centre is None:
            total = total + x.astype(object).sum(axis=0)
        else:
            total = total + _products(_exact(x, centre))
    if not isinstance(total, int):
        values = total if centre is None else total[np.triu_indices(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([int(v) for v in values], DECIMAL)], ["k", "v"])


def _summed(fit: DataFrame, centre: np.ndarray | None = None) -> list[int]:
    """A row per entry and task is summed by Spark; the entries come to the driver."""
    got = fit.mapInArrow(functools.partial(_moments, centre), "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return [int(r["v"]) for r in sorted(got)]


def covariance(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums S and the covariance of the rows of ``fit`` (x). Centred on
    the mean's rounding before multiplying; what that leaves is taken off in
    whole numbers, so every entry is the exact one, rounded."""
    n = fit.count()
    sums = np.array(_summed(fit), object)
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], object)
    rest = [int(s) - n * int(c) for s, c in zip(sums, centre)]
    v, at = np.zeros((d, d)), 0
    products = _summed(fit, centre)
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = Fraction(n * products[at] - rest[i] * rest[j], n * n)
            at += 1
    return n, sums, v


class Inertia:
    """Counts of eigenvalues above a shift, from the tridiagonal form."""

    def __init__(self, v: np.ndarray):
        a, n = v.copy(), len(v)
        for k in range(n - 2):  # Householder reflections
            x = a[k + 1:, k].copy()
            alpha = -np.copysign(np.linalg.norm(x), x[0])
            x[0] -= alpha
            size = np.linalg.norm(x)
            if size == 0:
                continue
            u = x / size
            p = a[k + 1:, k + 1:] @ u
            q = p - u * (u @ p)
            a[k + 1:, k + 1:] -= 2 * (np.outer(u, q) + np.outer(q, u))
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = alpha
        self.diagonal, self.squares = np.diag(a).copy(), np.diag(a, 1) ** 2
        self.scale = max(np.abs(v).sum(axis=1).max(), np.finfo(float).tiny)

    def above(self, shift: float) -> int:
        """Eigenvalues greater than the shift: positive pivots of T - shift I."""
        count, pivot = 0, 1.0
        for i, x in enumerate(self.diagonal):
            pivot = x - shift - (self.squares[i - 1] / pivot if i else 0.0)
            if pivot == 0:
                pivot = -np.finfo(float).eps * self.scale
            count += pivot > 0
        return count

    def kth(self, k: int, tolerance: float) -> tuple[float, float]:
        """A bracket of the kth largest eigenvalue, by bisection on counts."""
        low, high = -self.scale, self.scale
        while high - low > tolerance * self.scale:
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return low, high


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), falling, and their vectors; ``count`` of them by inertia."""
    n, scale = len(v), np.abs(v).sum(axis=1).max()
    centre, radius = (low + high) / 2, (high - low) / 2
    node, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + node)  # the upper half circle; the lower one is its conjugate
    width = min(n, count + max(4, count // 2))
    block = np.random.default_rng(13).standard_normal((n, width))
    shifts = centre + radius * np.exp(1j * angle)
    factors = [np.linalg.inv(z * np.eye(n) - v) for z in shifts]
    for _ in range(ROUNDS):
        projected = sum((w * radius / 2 * np.exp(1j * t) * (f @ block)).real for w, t, f in zip(weight, angle, factors))
        q, _ = np.linalg.qr(projected)
        value, turn = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz, at most a few values wide
        block = q @ turn
        inside = (value > low) & (value < high)
        residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * value[inside], axis=0)
        if inside.sum() == count and (residual <= 4 * n * np.finfo(float).eps * scale).all():
            return value[inside][::-1], block[:, inside][:, ::-1]
    raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}), {inside.sum()} found, residuals {residual}")


def leading(v: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above the rank's border, falling, and their
    unit vectors as rows. Found interval by interval from the top; borders lie
    in gaps, so eigenvalues that can't be told apart share an interval."""
    trace, inertia = np.trace(v), Inertia(v)
    k = min(k, len(v), inertia.above(LEAST_SHARE * trace) if trace > 0 else 0)
    values, vectors, high, done = [], [], inertia.scale * 1.01, 0
    while done < k:
        last = done + 1
        while last < len(v):  # the first eigenvalue that a gap follows
            (a, _), (_, b) = inertia.kth(last, 1e-10), inertia.kth(last + 1, 1e-10)
            if a - b > 1e-6 * max(a, 0):
                break
            last += 1
        low = (a + b) / 2 if last < len(v) else -inertia.scale * 1.01
        count = inertia.above(low) - inertia.above(high)
        if count != last - done:
            raise ArithmeticError("inertia counts disagree")
        # a circle close around the interval's eigenvalues, as far from others as from them
        top = inertia.kth(done + 1, 1e-10)[1]
        close = min(high, top + max(top - low, 1e-9 * inertia.scale))
        if inertia.above(close) != inertia.above(high):
            close = high
        value, vector = feast(v, low, close, count)
        values, vectors, high, done = [*values, *value], [*vectors, *vector.T], low, last
    sign = [1 if u[np.argmax(np.abs(u))] > 0 else -1 for u in vectors]
    return np.array(values[:k]), np.array([s * u / np.linalg.norm(u) for s, u in zip(sign, vectors)][:k]).reshape(k, len(v))


class Whitener:
    """What the tasks need: sums, eigenvalues and vectors; d squared numbers at most."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, error: float | None = None):
        self.n, self.sums, self.values, self.vectors, self.trace, self.error = n, sums, values, vectors, trace, error

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        y = _exact(x, self.sums, self.n)
        if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2**63:
            y = y.astype(object)
        return [int(s) for s in (y * y).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened values: x - S/n, unrounded but for the double, on the components."""
        centre = np.array([(2 * int(s) + self.n) // (2 * self.n) for s in self.sums], object)
        rest = np.array([float(Fraction(int(s) - self.n * int(c), self.n)) for s, c in zip(self.sums, centre)])
        centred = _exact(x, centre).astype(np.float64) - rest
        return centred @ self.vectors.T / np.sqrt(self.values)

    def _check(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total, rows = len(self.values), 0.0, 0
        for _, x in _matrices(batches):
            w = self.whiten(x)
            total = total + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            rows += len(w)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(total)], ["k", "v"])

    def identity_error(self, fit: DataFrame) -> float:
        """Largest entry of the whitened fit rows' covariance minus the identity."""
        k = len(self.values)
        got = fit.mapInArrow(self._check, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        mean = np.array([r["v"] for r in sorted(got)]) / self.n
        return float(np.abs(mean[k:].reshape(k, k) - np.outer(mean[:k], mean[:k]) - np.eye(k)).max())


def fit(rows: DataFrame, k: int = K) -> Whitener | None:
    """rows: x, all of one length. None where there is no component."""
    distinct = C.written(rows.select("x").distinct(), "whitening-fit")
    first = distinct.first()
    if first is None:
        return None
    n, sums, v = covariance(distinct, len(first["x"]))
    values, vectors = leading(v, k)
    if not len(values):
        return None
    model = Whitener(n, sums, values, vectors, float(np.trace(v)))
    model.error = model.identity_error(distinct)
    return model


SCHEMA = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(model: Whitener, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for b, x in _matrices(batches):
        rows = len(x)
        each = pa.array(np.repeat(np.arange(rows), k))
        deviation = [s if s < 2**63 else None for s in model.deviations(x)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
             pa.array(deviation, pa.int64()).take(each), pa.array(model.whiten(x).ravel()),
             pa.array(np.tile(model.values / model.trace, rows)), pa.array(np.full(rows * k, model.error))],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """Per row that takes part and component: id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    x = gridded(rows, id_col, vector_col)
    x = x.where(F.size("x") == common_length(x))
    kind = x.schema["id"].dataType.simpleString()
    model = fit(x, k)
    if model is None:
        return rows.sparkSession.createDataFrame([], SCHEMA.format(kind))
    return x.mapInArrow(functools.partial(_whiten, model), SCHEMA.format(kind))


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
