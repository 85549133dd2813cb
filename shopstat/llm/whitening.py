"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 11).

The principal components of the vectors are found without forming their
covariance: a block ``Q`` of ``WANTED + GUARD`` directions is refined by
passes over the data, each adding up ``X'(XQ)`` of the centred vectors
``X`` in the tasks; only blocks of ``d x k`` numbers leave a task, and they
are added in tasks again before the driver sees one.

1. Counts and sums per dimension (exact whole numbers); vectors are centred
   as ``(n*x - S) / n``, whose numerator is exact.
2. A few Lanczos steps estimate the lowest eigenvalue.
3. Filter: the three-term recurrence of Chebyshev polynomials, one pass per
   degree, is small on the unwanted part of the spectrum (from the lowest
   eigenvalue to the lowest Ritz value of the block) and grows beyond it.
4. QR of the filtered block, one more pass for ``Q'VQ``, Rayleigh-Ritz.
5. Steps 3 and 4 repeat until every wanted pair is certified: the norm of
   ``Vq - eq`` is below ``CERTIFIED`` times the largest eigenvalue and no
   longer shrinks.  ``NotCertified`` is raised rather than returning less.

A block that spans the whole space (``k = d``) is exact after one Rayleigh-Ritz.

Defined results: rows whose vector is null or empty or holds null, NaN or
infinite entries are dropped, as are entries beyond ``2^52 / SCALE`` (no exact
whole number) and vectors that haven't the commonest length (of equally common
ones the longest); components without spread (``e <= FLAT`` times the largest) can't
be whitened and are left out; repeated rows each count; an empty table, or one
of equal vectors, gives no rows; a deviation beyond 64 bits is null; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstat.llm.common import materialise

SCALE, SHIFT = 64, 1_000_000        # x = floor(64 * c) + 1000000
WANTED, GUARD = 32, 16
DEGREE, LANCZOS, MOST_ROUNDS = 10, 12, 60
CERTIFIED, SETTLED, FLAT = 1e-12, 4e-15, 1e-10
GROUPS = 8                          # tasks that add up the tasks' blocks
EXACT = float(1 << 52)


class NotCertified(RuntimeError):
    pass


# -- passes ---------------------------------------------------------------
def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The whole numbers of a batch, one row per vector."""
    column = batch.column("x")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype="<i8", count=len(column) * d, offset=int(offsets[0])).reshape(-1, d)


def _summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple, dtype: str) -> np.ndarray:
    """The sum of ``part`` over the batches of all tasks."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=dtype)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch, d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, dtype=dtype), False
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                total, some = total + np.frombuffer(raw, dtype=dtype).reshape(shape), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
    found = rows.select("x").mapInArrow(local, "part binary").repartition(GROUPS).mapInArrow(add, "part binary").collect()
    total = np.zeros(shape, dtype=dtype)
    for r in found:
        total = total + np.frombuffer(r["part"], dtype=dtype).reshape(shape)
    return total


# -- vectors --------------------------------------------------------------
def whole_vectors(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> tuple[DataFrame, int]:
    """``vec_id`` and the whole numbers ``x`` (64-bit, in one binary) of the
    vectors that count, and their dimension."""
    v = F.col(f"`{column}`")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) * SCALE >= F.lit(EXACT)))
    rows = vectors.filter(v.isNotNull() & (F.size(v) > 0)).filter(~bad).select(F.col(f"`{id_column}`").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = (np.floor(SCALE * c).astype("<i8") + SHIFT)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (8 * d)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])], names=["vec_id", "x"])
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary"
    return materialise(rows.filter(F.size("v") == d).mapInArrow(run, schema), "whitening-vectors"), d


class Centred:
    """Passes over the centred vectors of a table."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        # the count rides along; sums of 32-bit halves, so that no table overflows a task's 64 bits
        def part(x: np.ndarray) -> np.ndarray:
            return np.concatenate(([len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)))
        total = _summed(rows, d, part, (1 + 2 * d,), "<i8").tolist()
        self.n = total[0]
        self.sums = [(high << 32) + low for high, low in zip(total[1:1 + d], total[1 + d:])]
        self.floor = [s // self.n for s in self.sums] if self.n else [0] * d
        self.rest = [s - self.n * f for s, f in zip(self.sums, self.floor)]

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from whole numbers to ``x - S/n``."""
        floor, rest, n = np.array(self.floor, dtype=np.int64), self.rest, self.n
        exact = n < 1 << 20             # n * (x - floor) has at most 20 + 53 bits; beyond, two terms are rounded once each
        shift, low = np.array(rest, dtype=np.float64), np.array(rest, dtype=np.int64)

        def centred(x: np.ndarray) -> np.ndarray:
            y = x - floor
            if exact and len(y) and np.abs(y).max() < 1 << 42:
                return (n * y - low) / n
            return y - shift / n
        return centred

    def product(self, q: np.ndarray) -> np.ndarray:
        """``V q``: one pass."""
        centred, shape = self.centring(), q.shape

        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ q)
        return _summed(self.rows, self.d, part, shape, "<f8") / self.n

    def spread(self) -> np.ndarray:
        """Variance of each dimension; they add up to the trace of ``V``."""
        centred = self.centring()
        return _summed(self.rows, self.d, lambda x: np.square(centred(x)).sum(axis=0), (self.d,), "<f8") / self.n


# -- eigenpairs -----------------------------------------------------------
def lowest(x: Centred, rng: np.random.Generator) -> float:
    """An estimate of the lowest eigenvalue from below, by Lanczos steps."""
    q = rng.standard_normal(x.d)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, x.d)):
        w = x.product(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for b in basis:
            w = w - (b @ w) * b
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    t = np.diag(alpha) + np.diag(beta[:k - 1], 1) + np.diag(beta[:k - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, values[0] - beta[k - 1] * abs(vectors[-1, 0]))


def chebyshev(x: Centred, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block after a polynomial that is at most 1 on ``[low, high]`` and
    grows beyond ``high``, scaled by its size at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (x.product(q) - middle * q) * (sigma / half)
    for _ in range(2, degree + 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * following / half * (x.product(now) - middle * now) - sigma * following * before
        sigma = following
    return now


def principal(x: Centred, wanted: int = WANTED, guard: int = GUARD, degree: int = DEGREE,
              most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, unit vectors in columns)``, the ``wanted`` largest."""
    k, rng = min(x.d, wanted + guard), np.random.default_rng(11)
    wanted = min(wanted, x.d)
    q = np.linalg.qr(rng.standard_normal((x.d, k)))[0] if k < x.d else np.eye(x.d)
    low = lowest(x, rng) if k < x.d else 0.0
    last = np.inf
    for _ in range(most_rounds):
        applied = x.product(q)
        h = q.T @ applied
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, applied = q @ turn, applied @ turn
        worst = np.linalg.norm(applied[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
        scale = max(values[0], 0.0)
        if worst <= SETTLED * scale or (worst <= CERTIFIED * scale and worst >= last / 2) or k == x.d:
            return values[:wanted], q[:, :wanted]
        last = worst
        high = values[-1]
        if not low < high < values[0]:          # nothing to tell apart yet, or a flat spectrum: damp from zero on
            low, high = 0.0, max(high, 1e-6 * values[0])
            if high >= values[0]:
                high = values[0] * (1 - 1e-6)
        q = np.linalg.qr(chebyshev(x, q, low, high, values[0], degree))[0]
    raise NotCertified(f"residual {worst} of an eigenvalue {scale} after {most_rounds} rounds")


# -- whitening ------------------------------------------------------------
class Whitening:
    """What whitens vectors like those it was fitted on."""

    def __init__(self, x: Centred, wanted: int = WANTED):
        spread = x.spread() if x.n else np.zeros(x.d)
        self.x, self.trace = x, float(spread.sum())
        if self.trace > 0:
            values, vectors = principal(x, wanted)
            some = values > FLAT * values[0]
            self.values, self.vectors = values[some], vectors[:, some]
        else:
            self.values, self.vectors = np.zeros(0), np.zeros((x.d, 0))
        self.projection = self.vectors / np.sqrt(self.values)

    def identity_error(self) -> float:
        """The largest entry of the whitened vectors' covariance less the identity."""
        centred, p, k = self.x.centring(), self.projection, len(self.values)

        def part(x: np.ndarray) -> np.ndarray:
            w = centred(x) @ p
            return np.vstack((w.T @ w, w.sum(axis=0)))
        total = _summed(self.x.rows, self.x.d, part, (k + 1, k), "<f8") / self.x.n
        return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())

    def whiten(self) -> DataFrame:
        """``vec_id, deviation, whitened`` (all components in one array)."""
        centred, p, d, n = self.x.centring(), self.projection, self.x.d, self.x.n
        floor, rest, exact_rest = np.array(self.x.floor, dtype=np.int64), np.array(self.x.rest, dtype=object), np.array(self.x.rest, dtype=np.float64)

        def deviations(x: np.ndarray) -> pa.Array:
            y = x - floor
            size = float(n) * np.abs(y).max(initial=0) + exact_rest.max(initial=0)
            if size * size * d < 2.0 ** 62:
                z = n * y - rest.astype(np.int64)
                return pa.array(np.einsum("ij,ij->i", z, z), pa.int64())
            totals = [sum(v * v for v in (n * row - rest)) for row in y.astype(object)]
            return pa.array([int(t) if t < 1 << 63 else None for t in totals], pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, d) if batch.num_rows else np.zeros((0, d), dtype=np.int64)
                w = centred(x) @ p
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviations(x), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                                                 names=["vec_id", "deviation", "whitened"])
        id_type = self.x.rows.schema["vec_id"].dataType.simpleString()
        return self.x.rows.mapInArrow(run, f"vec_id {id_type}, deviation bigint, whitened array<double>")


def fit(vectors: DataFrame, wanted: int = WANTED, column: str = "embedding", id_column: str = "vec_id") -> Whitening:
    return Whitening(Centred(*whole_vectors(vectors, column, id_column)), wanted)


def report(vectors: DataFrame) -> DataFrame:
    """The contract's row per vector and component."""
    fitted = fit(vectors)
    error = fitted.identity_error() if len(fitted.values) else 0.0
    shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]).cast("array<double>")
    return fitted.whiten().select("vec_id", "deviation", shares.alias("shares"), F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fitted.x.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.col("shares")[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
