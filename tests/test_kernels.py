"""Kernel regression over partitions against an exact kernel solve."""

from __future__ import annotations

import numpy as np
import pytest

from pricewright.operators import kernels


def exact(x, y, gamma, ridge, epsilon):
    """Coefficients of the kernel expansion for the same loss: least squares of the rows beyond epsilon, until they stay the same."""
    k = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    n, mean = len(y), y.mean()
    alpha = np.linalg.solve(k + ridge * n * np.eye(n), y - mean)
    seen = None
    for _ in range(200):
        away = y - mean - k @ alpha
        beyond = np.abs(away) > epsilon
        state = (beyond.tobytes(), np.sign(away[beyond]).tobytes())
        if state == seen:
            break
        seen, alpha = state, np.zeros(n)
        target = y[beyond] - mean - epsilon * np.sign(away[beyond])
        alpha[beyond] = np.linalg.solve(k[np.ix_(beyond, beyond)] + ridge * n * np.eye(beyond.sum()), target)
    return lambda q: mean + np.exp(-gamma * ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ alpha


def test_errors_are_those_of_the_exact_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (1400, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] / 2 + 5 + rng.normal(0, 0.2, 1400)
    train = spark.createDataFrame([([float(c) for c in r], float(v)) for r, v in zip(x[:1000], y[:1000], strict=True)], "x array<double>, y double").repartition(4)
    model = kernels.fit(train, 0.5, 1e-3, 0.1)
    theirs = exact(x[:1000], y[:1000], 0.5, 1e-3, 0.1)(x[1000:])
    rows = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x[1000:])], "id long, x array<double>")
    ours = np.array([r.guess for r in kernels.predicted(rows, model).orderBy("id").collect()])
    error = lambda guess: np.abs(guess - y[1000:]).mean()
    assert error(ours) <= 1.02 * error(theirs) and error(theirs) < 0.2
    assert np.allclose(ours, model.predict(x[1000:]))


def test_fits_of_nothing_and_of_constants(spark):
    schema = "x array<double>, y double"
    assert kernels.fit(spark.createDataFrame([], schema), 1.0, 0.1, 0.1, 8).predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
    flat = spark.createDataFrame([([float(i)], 4.0) for i in range(9)] + [([1.0], None)], schema)
    assert kernels.fit(flat, 1.0, 0.1, 0.1, 16).predict(np.array([[3.0]]))[0] == pytest.approx(4.0)
