"""Presence matrices: TF-IDF weights, truncated SVD over partitions, imputation, correlations and groups of features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.operators import graphs
from pricewright.sources.steps import dropped, stored


def presence(long: DataFrame) -> DataFrame:
    """(row_id, feature) of values that are there: neither null, blank nor a number equal to 0."""
    there = F.col("value").isNotNull() & (F.trim("value") != "") & ~F.coalesce(F.col("value").try_cast("double") == 0, F.lit(False))
    return long.where(there).select("row_id", "feature").distinct()


def tfidf(cells: DataFrame) -> DataFrame:
    """(row_id, feature, w): smooth inverse document frequency ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    n = cells.select("row_id").distinct().agg(F.count("*").alias("n"))
    df = cells.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    idf = df.select("feature", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = cells.join(idf, "feature")
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("row_id")))
    return weighed.select("row_id", "feature", (F.col("idf") / length).alias("w"))


@dataclass
class Factors:
    """Right singular vectors by feature, singular values, and each component's share of the squared weights."""

    features: list[str]
    right: np.ndarray
    values: np.ndarray
    explained: np.ndarray


#: Features of a fit at most: times ``rank`` and some, their numbers have to fit the driver and every task.
FEATURES = 1 << 18
#: Columns of a block beyond the rank, columns of the basis beyond which it isn't widened, and the residual that ends it.
SPARE, WIDEST, RESIDUAL = 10, 1000, 1e-10
#: Rows of a task, tasks whose sums come to the driver as they are, features in a piece of a sum.
ROWS, TASKS, PIECE = 20_000, 32, 4096


def places(weights: DataFrame) -> tuple[list[str], DataFrame]:
    """The features in order, and (feature, at) with their places."""
    found = weights.select("feature").distinct().limit(FEATURES + 1).collect()
    if len(found) > FEATURES:
        raise ValueError(f"more than {FEATURES} features")
    features = sorted(r["feature"] for r in found)
    table = weights.sparkSession.createDataFrame(list(zip(features, range(len(features)), strict=True)), "feature string, at int")
    return features, table


def sparse_rows(weights: DataFrame, at: DataFrame) -> DataFrame:
    """(row_id, at, w): the places and weights of each row's known features, as arrays."""
    entry = F.struct("at", "w")
    rows = weights.join(at, "feature").groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select("row_id", F.col("e.at").alias("at"), F.col("e.w").alias("w"))


def _products(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which entries belong to which row, their features and weights, and the rows times the basis."""
    at, w = batch.column("at"), batch.column("w")
    ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    cells, weight = at.flatten().to_numpy(), w.flatten().to_numpy()
    out = np.add.reduceat(np.vstack([basis[cells] * weight[:, None], np.zeros((1, basis.shape[1]))]), ends[:-1], axis=0) if len(ends) > 1 else np.zeros((0, basis.shape[1]))
    out[np.diff(ends) == 0] = 0.0
    return np.repeat(np.arange(len(at)), np.diff(ends)), cells, weight, out


def _back_and_forth(rows: DataFrame, basis: np.ndarray, tasks: int) -> np.ndarray:
    """The transposed rows times the rows times the basis, one number for each feature and column of the basis."""
    n, width = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, width))
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                row, cells, weight, out = _products(batch.slice(i, 1024), shared.value)
                np.add.at(total, cells, out[row] * weight[:, None])
        yield _pieces(total, PIECE, TASKS)

    return _added_up(rows.select("at", "w").mapInArrow(run, PIECES), (n, width), tasks)


PIECES = "piece int, part int, sums binary"


def _pieces(total: np.ndarray, size: int, parts: int) -> pa.RecordBatch:
    """A task's sums, cut into pieces of ``size`` rows; pieces of zeros go."""
    part = TaskContext.get().partitionId() % parts
    pieces = [(k, total[k * size : (k + 1) * size]) for k in range(-(-len(total) // size))]
    pieces = [(k, part, piece.tobytes()) for k, piece in pieces if piece.any()]
    columns = list(zip(*pieces, strict=True)) or [[]] * 3
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "part", "sums"])


def _added_up(parts: DataFrame, shape: tuple[int, int], tasks: int) -> np.ndarray:
    """The sum of what tasks have made; the sums of many meet in a few, then in one for each piece."""

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s) for s in group["sums"].to_pylist())
        return group.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    if tasks > TASKS:
        parts = parts.groupBy("piece", "part").applyInArrow(added, PIECES).groupBy("piece").applyInArrow(added, PIECES)
    out = np.zeros(shape)
    for r in sorted(parts.collect(), key=lambda r: (r["piece"], r["part"])):
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] += np.frombuffer(r["sums"]).reshape(-1, shape[1])
    return out


def tall_triangle(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows times the basis: every task reduces its rows to a triangle, and triangles meet in pairs of stages."""
    width = basis.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                held = np.linalg.qr(np.vstack([held, _products(batch.slice(i, 4096), shared.value)[3]]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TASKS], pa.int32()), pa.array([held.tobytes()])], ["part", "r"])

    return _joined_triangles(rows.select("at", "w").mapInArrow(run, "part int, r binary"), width)


def _joined_triangles(parts: DataFrame, width: int) -> np.ndarray:
    def joined(group: pa.Table) -> pa.Table:
        held = np.zeros((0, width))
        for r in group["r"].to_pylist():
            held = np.linalg.qr(np.vstack([held, np.frombuffer(r).reshape(-1, width)]), mode="r")
        return pa.table({"part": group["part"].slice(0, 1), "r": pa.array([held.tobytes()], pa.binary())})

    held = np.zeros((0, width))
    for r in sorted(parts.groupBy("part").applyInArrow(joined, "part int, r binary").collect(), key=lambda r: r["part"]):  # ``TASKS`` triangles at most
        held = np.linalg.qr(np.vstack([held, np.frombuffer(r["r"]).reshape(-1, width)]), mode="r")
    return held


def fit_factors(weights: DataFrame, rank: int = 50, seed: int = 5) -> Factors:
    """Truncated SVD without centring, by a randomised block Krylov basis and a triangle of the rows in it.

    A random block is taken back and forth through the rows, made orthogonal to what there is, and added to the basis,
    until the leading pairs leave no residual or the basis spans all features. A pass moves features times columns of a block; no
    matrix of features by features is ever made. The singular values come from the triangle of the rows in the leading directions,
    which keeps small ones exact. Each component's sign makes its largest loading positive.
    """
    features, at = places(weights)
    n = len(features)
    size = weights.select("row_id").distinct().count()
    if not n:
        return Factors([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    tasks = -(-size // ROWS)
    rows = stored(sparse_rows(weights, at).repartition(tasks), "sparse-rows")
    width = min(rank + SPARE, n)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    while True:
        forth = _back_and_forth(rows, block, tasks)
        basis, image = np.hstack([basis, block]), np.hstack([image, forth])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:width]
        values, turn = values[order], turn[:, order]
        away = image @ turn[:, :rank] - (basis @ turn[:, :rank]) * values[:rank]
        if basis.shape[1] >= min(n, WIDEST) or np.linalg.norm(away, axis=0).max() <= RESIDUAL * max(values[0], 1e-300):
            break
        fresh = forth
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        fresh, triangle = np.linalg.qr(fresh)
        kept = np.abs(np.diag(triangle)) > 1e-12 * max(values[0], 1e-300)
        if not kept.any():  # the rows have no other direction
            break
        fresh = fresh[:, kept][:, : n - basis.shape[1]]
        block = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
    if np.linalg.norm(away, axis=0).max() > 1e-6 * max(values[0], 1e-300) and basis.shape[1] < n:
        raise ArithmeticError(f"the leading {rank} factors are not settled in {WIDEST} directions")
    lead = basis @ turn
    _, values, turn = np.linalg.svd(tall_triangle(rows, lead), full_matrices=False)
    total = weights.join(at, "feature").agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    dropped(rows)
    count = min(rank, len(values))
    right = lead @ turn[:count].T
    right *= np.where(right[np.abs(right).argmax(0), range(count)] < 0, -1, 1)
    return Factors(features, right, values[:count], values[:count] ** 2 / max(total, 1e-300))


def embed(weights: DataFrame, factors: Factors) -> DataFrame:
    """(row_id, v): rows in the factor space; features that the factors don't know go."""
    named = list(zip(factors.features, range(len(factors.features)), strict=True))
    at = weights.sparkSession.createDataFrame(named, "feature string, at int")
    shared = weights.sparkSession.sparkContext.broadcast(factors.right)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(_products(part, shared.value)[3]), pa.list_(pa.float64()))], ["row_id", "v"])

    rows = sparse_rows(weights, at)
    return rows.mapInArrow(project, f"row_id {rows.schema['row_id'].dataType.simpleString()}, v array<double>")


def reconstruction_error(weights: DataFrame, factors: Factors) -> DataFrame:
    """One row: what the factors leave of the weights, relative to their norm, and the root mean square over all cells.

    The factors are orthogonal, so what is left is the norm of the weights without that of the projections.
    """
    held = embed(weights, factors).agg(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("held"))
    known = weights.agg(F.sum(F.col("w") * F.col("w")).alias("total"), (F.count_distinct("row_id") * F.count_distinct("feature")).alias("cells"))
    left = F.greatest(F.col("total") - F.col("held"), F.lit(0.0))
    return known.crossJoin(held).select(  # two one-row tables
        F.sqrt(F.try_divide(left, "total")).alias("relative_frobenius"), F.sqrt(F.try_divide(left, "cells")).alias("rmse")
    )


def scree(factors: Factors, at: tuple[int, ...] = (5, 10, 30, 50)) -> dict[int, float]:
    total = np.cumsum(factors.explained)
    return {k: float(total[min(k, len(total)) - 1]) for k in at}


def top_loadings(factors: Factors, components: int = 5, k: int = 10) -> list[tuple[int, str, float]]:
    out = []
    for c in range(min(components, factors.right.shape[1])):
        order = np.argsort(-np.abs(factors.right[:, c]))[:k]
        out += [(c, factors.features[i], float(factors.right[i, c])) for i in order]
    return out


#: Columns of a table whose pairs, or whose triangle, one task and the driver hold.
COLUMNS = 2000


def imputed(x: np.ndarray, rank: int, rounds: int = 10) -> np.ndarray:
    """Missing entries from repeated truncated SVD, observed ones kept, results in [0, 1]; a block of one task."""
    known = ~np.isnan(x)
    means = np.array([x[known[:, j], j].mean() if known[:, j].any() else 0.0 for j in range(x.shape[1])])
    y = np.where(known, x, means)
    for _ in range(rounds):
        _, _, v = np.linalg.svd(y, full_matrices=False)
        y = _once_more(x, known, y, v[:rank])
    return y


def _once_more(x: np.ndarray, known: np.ndarray, y: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(known, x, np.clip((y @ right.T) @ right, 0, 1))


def _wide(column: pa.Array) -> np.ndarray:
    """Rows of arrays as a matrix, null entries as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def imputed_rows(rows: DataFrame, rank: int, rounds: int = 10) -> DataFrame:
    """(row_id, x) of (row_id, x), x being arrays of one length with nulls: ``imputed``, for rows in any number of tasks.

    A round needs the leading directions of the rows as they are, which the triangle of all rows gives. Rows aren't written
    again: a task starts from the means and goes through the directions of all rounds so far, each a product of fixed size.
    """
    width = rows.select(F.size("x").alias("n")).agg(F.max("n")).first()[0] or 0
    if not 0 < width <= COLUMNS:
        if width > COLUMNS:
            raise ValueError(f"more than {COLUMNS} columns")
        return rows
    found = rows.agg(*[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(width)]).first()
    means, held = np.array([m if m is not None else 0.0 for m in found]), []

    def now(x: np.ndarray, directions: list[np.ndarray]) -> np.ndarray:
        known = ~np.isnan(x)
        y = np.where(known, x, means)
        for right in directions:
            y = _once_more(x, known, y, right)
        return y

    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(list(held))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((0, width))
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    y = now(_wide(batch.column(0).slice(i, 4096)), shared.value)
                    total = np.linalg.qr(np.vstack([total, y]), mode="r")
            if len(total):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % TASKS], pa.int32()), pa.array([total.tobytes()])], ["part", "r"])

        triangle = _joined_triangles(rows.select("x").mapInArrow(run, "part int, r binary"), width)
        held.append(np.linalg.svd(triangle, full_matrices=False)[2][:rank])
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                y = now(_wide(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["row_id", "x"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.select("row_id", "x").mapInArrow(fill, f"row_id {kind}, x array<double>")


def correlations(cells: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Features in order, and for each pair of them the number of rows that have both and their correlation there.

    ``cells`` is long: (row_id, feature, w). Rows are centred on the features' means before products are taken; a task
    adds up the products of its rows, and no pair of rows or of cells is made. A pair without spread has NaN.
    """
    features, at = places(cells)
    n = len(features)
    if n > COLUMNS:
        raise ValueError(f"more than {COLUMNS} features")
    if not n:
        return [], np.zeros((0, 0)), np.zeros((0, 0))
    means = {r["feature"]: r["m"] for r in cells.groupBy("feature").agg(F.avg("w").alias("m")).collect()}
    centre = np.array([means[f] for f in features])
    size = cells.select("row_id").distinct().count()
    tasks = -(-size // ROWS)
    rows = stored(sparse_rows(cells, at).repartition(tasks), "feature-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 * n, n))
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                places_, weights = some.column("at"), some.column("w")
                row = np.repeat(np.arange(len(places_)), places_.value_lengths().to_numpy())
                cell = places_.flatten().to_numpy()
                there, x = np.zeros((len(places_), n)), np.zeros((len(places_), n))
                there[row, cell], x[row, cell] = 1.0, weights.flatten().to_numpy() - centre[cell]
                total += np.vstack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield _pieces(total, PIECE, TASKS)

    count, sums, squares, products = _added_up(rows.select("at", "w").mapInArrow(run, PIECES), (4 * n, n), tasks).reshape(4, n, n)
    dropped(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = sums / count
        spread = np.maximum(squares / count - mean * mean, 0)
        r = (products / count - mean * mean.T) / np.sqrt(spread * spread.T)
        small = spread <= 1e-14 * np.maximum(np.nan_to_num(squares / count), 1e-300)
    return features, count, np.where(small | small.T, np.nan, np.clip(r, -1, 1))


def linkage(away: np.ndarray) -> list[tuple[int, int, float]]:
    """Average linkage by the nearest-neighbour chain: merges (a, b, height) of groups named by their smallest member, by height.

    A chain goes from a group to its nearest one until two are nearest to each other; these merge, whatever the rest
    looks like, since a merge brings no group nearer than its parts were.
    """
    n = len(away)
    d = np.array(away, float)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            last = chain[-1]
            near = int(d[last].argmin())
            if len(chain) > 1 and d[last, chain[-2]] <= d[last, near]:
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        merges.append((a, b, float(d[a, b])))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[2])


def linked_features(correlation: np.ndarray, cut: float = 0.8) -> list[int]:
    """Average-linkage clusters on 1 - |r|, cut where groups are less alike than ``cut``; numbered by their first member."""
    n = len(correlation)
    over = list(range(n))

    def top(i: int) -> int:
        while over[i] != i:
            i = over[i]
        return i

    for a, b, height in linkage(1 - np.abs(np.nan_to_num(correlation))) if n else []:
        if height <= 1 - cut + 1e-12:
            a, b = top(a), top(b)
            over[max(a, b)] = min(a, b)
    first = {r: k for k, r in enumerate(sorted({top(i) for i in range(n)}))}
    return [first[top(i)] for i in range(n)]


def feature_communities(spark: SparkSession, features: list[str], correlation: np.ndarray, least: float = 0.3) -> dict[str, str]:
    """The Louvain community of each feature in the graph of correlations of at least ``least``, by its first feature."""
    i, j = np.nonzero(np.triu(np.abs(np.nan_to_num(correlation)) >= least, 1))
    found = graphs.communities(len(features), i, j, np.abs(correlation[i, j]))  # a matrix of ``COLUMNS`` at most, in memory already
    first: dict[int, str] = {}
    return {f: first.setdefault(c, f) for f, c in zip(features, found, strict=True)}
