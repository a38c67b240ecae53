"""Support vector regression with a Gaussian kernel, as a linear fit on random Fourier features.

Random waves stand in for the kernel, so rows never meet rows: a row becomes ``width`` numbers, and a fit is sums over them.
The loss is the square of what a residual exceeds ``epsilon`` by. It is a square on the rows beyond, so each
step solves the least-squares problem of the rows that are beyond now, from one pass that adds up their products; steps
go on until the objective stands still, and a step that would raise it is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Random features, and steps after which a fit counts as one that does not settle; ten are usual.
WIDTH, STEPS = 1024, 100
#: An objective that falls by less than this share has settled.
STILL = 1e-9


@dataclass
class KernelModel:
    """Directions of the waves, the weights of their cosines and sines, and the mean of the target."""

    directions: np.ndarray
    weights: np.ndarray
    mean: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        turn = x @ self.directions
        return np.hstack([np.cos(turn), np.sin(turn)]) * np.sqrt(1 / turn.shape[1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.mean + self.lifted(x) @ self.weights


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sums(rows: DataFrame, model: KernelModel, epsilon: float, all_rows: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss at the present weights, and the products of the rows beyond epsilon with themselves and their targets."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, loss, gram, right = shared.value, 0.0, np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                z, y = m.lifted(_matrix(part.column(0))), part.column(1).to_numpy() - m.mean
                away = y - z @ m.weights
                over = np.maximum(np.abs(away) - epsilon, 0)
                loss += float((over**2).sum())
                beyond = np.ones(len(y), bool) if all_rows else over > 0
                gram += z[beyond].T @ z[beyond]
                right += z[beyond].T @ (y[beyond] - (0 if all_rows else epsilon * np.sign(away[beyond])))
        whole = np.concatenate([[loss], right, gram[np.triu_indices(width)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), pa.array(whole)], ["at", "x"])

    found = rows.select("x", "y").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(1 + width + width * (width + 1) // 2)
    total[found["at"].to_numpy()] = found["x"].to_numpy()  # as many as the products of one row have
    gram = np.zeros((width, width))
    i, j = np.triu_indices(width)
    gram[i, j] = gram[j, i] = total[1 + width :]
    return float(total[0]), gram, total[1 : 1 + width]


def directions(dims: int, count: int, seed: int) -> np.ndarray:
    """Columns with the law of normal vectors, orthogonal within each block of as many as there are dimensions, which spreads them more evenly."""
    rng, out = np.random.default_rng(seed), []
    while sum(b.shape[1] for b in out) < count:
        turned = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        out.append(turned * np.sqrt(rng.chisquare(dims, dims)))
    return np.hstack(out)[:, :count]


def fit(rows: DataFrame, gamma: float, ridge: float, epsilon: float, width: int = WIDTH, seed: int = 3) -> KernelModel:
    """A model of (x array<double>, y double) for the kernel exp(-gamma |x - x'|^2); ridge weighs the norm against the mean loss.

    Rows with a null or non-finite target take no part; an empty table gives a model that says 0.
    """
    rows = rows.where("y is not null and not isnan(y)")
    n, mean, dims = rows.agg(F.count("*"), F.avg("y"), F.max(F.size("x"))).first()
    width += width % 2
    model = KernelModel(directions(dims or 1, width // 2, seed) * np.sqrt(2 * gamma), np.zeros(width), mean or 0.0)
    if not n:
        return model
    penalty = ridge * n
    _, gram, right = _sums(rows, model, epsilon, True)
    before, best = model.weights, None
    model.weights = np.linalg.solve(gram + penalty * np.eye(width), right)
    for _ in range(STEPS):
        loss, gram, right = _sums(rows, model, epsilon, False)
        value = loss + penalty * float(model.weights @ model.weights)
        if best is not None and value > best:
            model.weights = (before + model.weights) / 2
            if np.abs(model.weights - before).max() <= 1e-12 * max(1.0, np.abs(before).max()):
                return model
            continue
        if best is not None and best - value <= STILL * max(best, 1e-300):
            return model
        before, best = model.weights, value
        model.weights = np.linalg.solve(gram + penalty * np.eye(width), right)
    raise ArithmeticError(f"the fit has not settled in {STEPS} steps")


def predicted(rows: DataFrame, model: KernelModel) -> DataFrame:
    """Rows with ``x`` replaced by a ``guess``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    own = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                guess = pa.array(shared.value.predict(_matrix(part.column("x"))))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], guess], [*own, "guess"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "guess double"]))
