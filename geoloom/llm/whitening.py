"""Whitening of embeddings by the leading components of their covariance, extracted by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import ship_package, stored

COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues searched for in one interval.
PER_INTERVAL = 6
#: Quadrature nodes on the upper half of a contour (the lower half is its mirror).
NODES = 12
#: Rounds of one interval, and the residual (relative to the largest eigenvalue) at which it has converged.
ROUNDS, RESIDUAL = 60, 1e-13
#: Least eigenvalue of a component, relative to the largest.
RANK = 1e-12
#: Eigenvalues that lie closer, relative to the largest, stay in one interval.
APART = 1e-11
#: Largest multiple of SCALE that an entry keeps; beyond it (entries of about 7e13) it is held there.
WIDEST = float(2**52)


def fixed_points(table: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """`(vec_id, x)` of the rows of `table` (vec_id, embedding) that can be used: entries as whole numbers floor(scale * c) + offset.

    Dropped are null and empty vectors, those with a null or non-finite entry, and those of another length than most (of
    equally frequent lengths, the shortest counts). Null and repeated vec_ids and ties stay; other columns are left out.
    """
    entries = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = table.select("vec_id", entries.alias("c")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    lengths = kept.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    of_length = kept.where(F.size("c") == (lengths[0].d if lengths else 0))
    held = lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-WIDEST)), F.lit(WIDEST))
    return of_length.select("vec_id", F.transform("c", lambda c: held(c).cast("bigint") + offset).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column(column))


def sums(points: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows `points` (x) has, and the exact sum of each dimension, added up by the cluster."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _blocks(batches, 0):
            n, total = n + len(x), x.sum(0, dtype=np.int64) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["k", "v"])

    rows = points.select("x").mapInArrow(partial, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    found = {r.k: r.v for r in rows}
    n = found.pop(-1, 0)
    return n, np.array([found[k] for k in sorted(found)], dtype=object)


def centre(n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means, as whole numbers and what they lack, so that no digits are lost."""
    return np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])


def covariance(points: DataFrame, n: int, total: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the rows of `points` (x), or of what `weights` (dimensions x components) make of them, centred before multiplying.

    A task adds up its own products; the matrix's entries are summed by the cluster, so only one matrix reaches the driver.
    """
    whole, part = centre(n, total)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, first = 0.0, 0.0
        for x in _blocks(batches, 0):
            y = (x - whole) - part
            if weights is not None:
                y = y @ weights
            product, first = product + y.T @ y, first + y.sum(0)
        if isinstance(product, np.ndarray):
            d = len(product)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d + 1), d), pa.int32()), pa.array(np.tile(np.arange(d), d + 1), pa.int32()), pa.array(np.concatenate((product.ravel(), first)))], ["i", "j", "v"])

    rows = points.select("x").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((r.j for r in rows), default=-1) + 1
    out = np.zeros((d + 1, d))
    for r in rows:
        out[r.i, r.j] = r.v
    left = out[d] / n
    return out[:d] / n - np.outer(left, left)


class Inertia:
    """Counts of the eigenvalues of a symmetric matrix above a shift, by Sylvester's law on its tridiagonal form."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, float)
        d = len(a)
        for k in range(d - 2):
            x = a[k + 1 :, k].copy()
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x[0] += norm if x[0] >= 0 else -norm
            x /= np.linalg.norm(x)
            a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        self.diagonal, self.beside = np.diag(a).copy(), np.diag(a, 1) ** 2 if d > 1 else np.empty(0)
        self.tiny = np.finfo(float).tiny ** 0.5

    def above(self, shift: float) -> int:
        """Eigenvalues greater than `shift`: positive pivots of the factorisation of the shifted matrix."""
        count, pivot = 0, 1.0
        for k, value in enumerate(self.diagonal - shift):
            pivot = value - (self.beside[k - 1] / pivot if k else 0.0)
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def _gap(self, count: int, inside: float, low: float, high: float) -> tuple[float, float]:
        """The two ends of the gap round `inside`, within (low, high), in which `count` eigenvalues lie above."""
        ends = []
        for outside in (low, high):
            near = inside
            while abs(outside - near) > 1e-3 * abs(near - inside) + 1e-15 * abs(inside) and (middle := (near + outside) / 2) not in (near, outside):
                near, outside = (middle, outside) if self.above(middle) == count else (near, middle)
            ends.append(near)
        return ends[0], ends[1]

    def boundary(self, wanted: int, low: float, high: float) -> tuple[float, int]:
        """A shift amid a gap with `wanted` eigenvalues above it, and their number; over `wanted` where eigenvalues coincide."""
        bottom, top, least = low, high, APART * high
        while high - low > least / 4:
            middle = (low + high) / 2
            n = self.above(middle)
            if n == wanted:
                break
            low, high = (middle, high) if n > wanted else (low, middle)
        else:
            middle = low
        while True:
            n = self.above(middle)
            a, b = self._gap(n, middle, bottom, top)
            if b - a > least or a <= bottom:
                return (a + b) / 2, n
            middle = max(bottom, a - least / 4)


def contour_components(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues within (low, high) of a symmetric matrix, falling, and their unit eigenvectors.

    Gauss-Legendre quadrature of the resolvent along a circle round the interval: complex shifted solves filter a block of
    vectors, a Rayleigh-Ritz step on their span gives the pairs, until the residuals vanish. `count` is what the inertia
    says there is; raises ArithmeticError when another number converges.
    """
    d = len(matrix)
    size = min(d, 2 * count + 8)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    shifts = middle + radius * np.exp(1j * angle)
    inverses = [np.linalg.inv(z * np.eye(d) - matrix) for z in shifts]
    block = np.random.default_rng(seed).standard_normal((d, size))
    scale = np.abs(matrix).max() or 1.0
    inside, residual = np.empty(0, int), np.empty(0)
    for _ in range(ROUNDS):
        filtered = sum((w / 2 * radius) * (np.exp(1j * t) * (inverse @ block)).real for w, t, inverse in zip(weights, angle, inverses, strict=True))
        basis = np.linalg.qr(filtered)[0]
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ small
        inside = np.flatnonzero((values > low) & (values < high))
        if len(inside) == count:
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if (residual <= RESIDUAL * scale * np.sqrt(d)).all():
                break
    inside = inside[::-1]
    if len(inside) != count or (residual > 1e4 * RESIDUAL * scale * np.sqrt(d)).any():
        raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found between {low} and {high}")
    return values[inside], block[:, inside]


def leading_components(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues of a covariance, falling, and unit eigenvectors as columns; fewer where its rank is less.

    The spectrum is cut from the top into intervals of about PER_INTERVAL eigenvalues, at shifts between two of them that
    inertia counts find; equal ones stay together. The counts verify that each interval gives all it holds.
    """
    d = len(matrix)
    trace = float(np.trace(matrix)) if d else 0.0
    if not trace > 0:
        return np.empty(0), np.empty((d, 0))
    inertia = Inertia(matrix)
    top = float(np.abs(matrix).sum(0).max()) * (1 + 1e-9)
    largest, _ = inertia.boundary(0, 0.0, top)
    wanted = min(k, inertia.above(RANK * largest))
    values, vectors, high, done = [], [], top, 0
    while done < wanted:
        low, count = inertia.boundary(min(done + PER_INTERVAL, wanted), RANK * largest, high)
        e, v = contour_components(matrix, low, high, count - done)
        values.append(e)
        vectors.append(v)
        high, done = low, count
    e, v = np.concatenate(values), np.concatenate(vectors, axis=1)
    v = np.linalg.qr(v)[0] if v.shape[1] > 1 else v
    e = np.einsum("ij,ij->j", v, matrix @ v)
    order = np.argsort(-e, kind="stable")[:wanted]
    return e[order], v[:, order]


def whiten(table: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Rows of `table` (vec_id, embedding) projected on the `k` leading components of their covariance, each of unit variance.

    The covariance is over the different vectors, each once; they are told apart by all their entries in a distributed
    aggregation, copies combined before it is shuffled, and stored once. The cluster adds up sums and products; the driver holds one matrix of
    dimensions squared, which the dimension bounds. Returns vec_id, component (from 1), n, deviation (null where it needs
    over 64 bits), whitened, explained and identity_error, one row for each vector and component; no rows for an empty
    table, for a covariance of zero, and for components beyond its rank. What is dropped: see `fixed_points`.
    """
    spark = table.sparkSession
    ship_package(spark)
    points = fixed_points(table)
    different = stored(points.select("x").distinct())
    n, total = sums(different)
    values, vectors = np.empty(0), np.empty((0, 0))
    if n:
        matrix = covariance(different, n, total)
        values, vectors = leading_components(matrix, k)
    m = len(values)
    if not m:
        return spark.createDataFrame([], SCHEMA)
    weights = vectors / np.sqrt(values)
    error = float(np.abs(covariance(different, n, total, weights) - np.eye(m)).max())
    explained = values / np.trace(matrix)
    whole, part = centre(n, total)
    rest = np.array([s % n for s in total], dtype=object)

    def deviations(x: np.ndarray) -> list[int | None]:
        # n * x - S = n * (x - S // n) - S % n, exact in 64 bits unless the bound below says that it may not be.
        near = x - whole
        most = n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            return ((n * near - rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = [sum((n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = len(x)
            spread = lambda a: pa.array(np.tile(a, rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))).cast(pa.int64()),
                    spread(np.arange(1, m + 1, dtype=np.int32)),
                    pa.array(np.full(rows * m, n, np.int64)),
                    pa.array([v for v in deviations(x) for _ in range(m)], pa.int64()),
                    pa.array((((x - whole) - part) @ weights).ravel()),
                    spread(explained),
                    pa.array(np.full(rows * m, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.mapInArrow(projected, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings` whitened by the 16 leading components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
