"""Whitening of embeddings by the principal components of their covariance.

Vectors are put on a whole-numbered grid, and each distinct one counts once in the fit. Their sums are exact. Every task
centres its vectors before it multiplies them and adds up the products, so the driver gets one matrix with a side as long as a
vector, whatever the number of rows. Cyclic Jacobi rotations make it diagonal: an entry is rotated away until it is small
next to the two diagonal entries it belongs to, not next to the largest one, which keeps small eigenvalues accurate. The components
in falling order of eigenvalue, divided by its root, are broadcast (at most a vector's length times ``KEPT`` numbers), and
every row is projected on them.

Defined cases: rows whose vector is null, empty, of another length than most, holds a null or non-finite entry, or one too large for the
grid (``LIMIT``) take no part; rows without a vec_id do, and rows that repeat one are rows of their own; components
whose eigenvalue is rounding next to the largest are not returned, so equal vectors alone, or one, give no rows; a deviation beyond
a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.scratch import discard, sliced, written

#: An entry c becomes floor(GRID * c) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Entries have to be smaller than this on the grid, which doubles hold exactly.
LIMIT = float(1 << 52)
#: Components returned at most.
KEPT = 16
#: Sweeps of rotations after which the matrix counts as one that does not converge; a dozen is usual.
SWEEPS = 60
#: Bits of the lower half of a grid value, whose sums are kept apart so that they fit a long.
LOW = 26


def on_grid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, with their vectors on the grid."""
    vector = F.col(column)
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) * GRID >= LIMIT))
    rows = vectors.where(vector.isNotNull() & (F.size(vector) > 0) & ~odd)
    sizes = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * GRID) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size(vector) == (sizes[0]["size"] if sizes else 0)).select("vec_id", x.alias("x"))


def _grid_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


@dataclass
class Whitener:
    """The centre as whole part and rest over n, the eigenvalues in falling order and their vectors in columns."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 for each row, exactly; None beyond a long."""
        away = x - self.whole
        most = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            whole = self.n * away - self.rest
            return (whole * whole).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in away.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n axes once, in rounds whose pairs share no axis, by turning all axes but the first around it."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(p, q) < n]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring[1:] = ring[-1:] + ring[1:-1]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order, and unit eigenvectors in columns, by cyclic Jacobi rotations."""
    a, v = np.array(matrix, float), np.eye(len(matrix))
    eps = np.finfo(float).eps
    least = eps * eps * np.abs(np.diag(a)).max(initial=0.0)
    cycle = rounds(len(a))
    for _ in range(SWEEPS):
        turned = False
        for p, q in cycle:
            off = a[p, q]
            large = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), least)
            p, q, off = p[large], q[large], off[large]
            if not len(p):
                continue
            turned = True
            head, tail = a[p, p], a[q, q]
            slope = (tail - head) / (2 * off)
            t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(slope, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            upper, lower = a[p], a[q]
            a[p], a[q] = c[:, None] * upper - s[:, None] * lower, s[:, None] * upper + c[:, None] * lower
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = head - t * off, tail + t * off
        if not turned:
            order = np.argsort(-np.diag(a), kind="stable")
            return np.diag(a)[order], v[:, order]
    raise ArithmeticError(f"the matrix is not diagonal after {SWEEPS} sweeps")


def _totals(points: DataFrame) -> tuple[int, list[int]]:
    """The number of points and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in sliced(batches, 4096):
            x = _grid_of(batch.column(0))
            n, high, low = n + len(x), high + (x >> LOW).sum(axis=0), low + (x & ((1 << LOW) - 1)).sum(axis=0)
        if n:
            columns = [np.arange(len(high)), np.full(len(high), n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["axis", "n", "high", "low"])

    parts = points.mapInArrow(run, "axis long, n long, high long, low long").groupBy("axis")
    wide = "decimal(38,0)"
    sums = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "low")])
    rows = sums.orderBy("axis").collect()  # one for each dimension
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << LOW) + int(r["low"]) for r in rows]


def _products(points: DataFrame, model: Whitener, project: bool) -> np.ndarray:
    """The mean over points of the products of their centred, or whitened, entries."""
    shared = points.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in sliced(batches, 4096):
            x = _grid_of(batch.column(0))
            y = shared.value.whitened(x) if project else shared.value.centred(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "product"])

    side = len(model.values) if project else len(model.whole)
    out = np.zeros((side, side))
    parts = points.mapInArrow(run, "i long, j long, product double").groupBy("i", "j").agg(F.sum("product").alias("product"))
    for r in parts.collect():  # as many as a matrix of one vector's length has
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["product"] / model.n
    return out


def fit(rows: DataFrame, kept: int = KEPT) -> Whitener | None:
    """The whitener of the distinct vectors ``x`` of rows, or None where they span nothing."""
    points = written(rows.select("x").distinct(), "whitening-points")
    n, sums = _totals(points)
    if not n:
        return None
    whole = np.array([s // n for s in sums])
    rest = np.array([s % n for s in sums])
    model = Whitener(n, whole, rest, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    covariance = _products(points, model, project=False)
    values, vectors = jacobi(covariance)
    real = values > len(values) * np.finfo(float).eps * values.max(initial=0.0)
    count = min(kept, int(real.sum()))
    model.values, model.vectors, model.trace = values[:count], vectors[:, :count], float(np.trace(covariance))
    if not count:
        return None
    model.identity_error = float(np.abs(_products(points, model, project=True) - np.eye(count)).max())
    discard(points)
    return model


def whiten(rows: DataFrame, model: Whitener) -> DataFrame:
    """(vec_id, deviation, whitened) of grid vectors: the exact distance from the centre, and the projections as an array."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            x, model = _grid_of(batch.column(1)), shared.value
            y = model.whitened(x)
            ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            whitened = pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1)))
            columns = [batch.column(0), pa.array(model.deviations(x), pa.int64()), whitened]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def components_of(vectors: DataFrame, column: str = "embedding", kept: int = KEPT) -> DataFrame:
    """One row for each vector and component, with what the fit says of the component and of itself."""
    rows = on_grid(vectors, column)
    model = fit(rows, kept)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
