"""Factors over partitions against NumPy on the whole matrix."""

from __future__ import annotations

import numpy as np
import pytest

from pricewright.operators import factors


def long(spark, x):
    rows = [(int(i), f"f{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "row_id long, feature string, w double").repartition(3)


def sparse(seed, n, m, share):
    rng = np.random.default_rng(seed)
    x = rng.random((n, m)) * (rng.random((n, m)) < share)
    x[:, 0] += 0.01  # no empty row
    return x


@pytest.mark.parametrize(("rows", "tasks", "piece"), [(20_000, 32, 4096), (40, 2, 16)])
def test_fifty_factors_are_those_of_the_whole_matrix(spark, monkeypatch, rows, tasks, piece):
    monkeypatch.setattr(factors, "ROWS", rows)
    monkeypatch.setattr(factors, "TASKS", tasks)
    monkeypatch.setattr(factors, "PIECE", piece)
    x = sparse(1, 300, 140, 0.15)
    fit = factors.fit_factors(long(spark, x), 50)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(fit.values - s[:50]).max() < 1e-6 and fit.right.shape == (140, 50)
    assert np.abs(fit.right.T @ fit.right - np.eye(50)).max() < 1e-9
    assert np.abs(np.abs((fit.right * v[:50].T).sum(axis=0)) - 1).max() < 1e-6
    assert np.allclose(fit.explained, s[:50] ** 2 / (s**2).sum())
    assert (fit.right[np.abs(fit.right).argmax(0), range(50)] > 0).all()


def test_embedding_and_reconstruction(spark):
    x = sparse(2, 120, 30, 0.3)
    weights = long(spark, x)
    fit = factors.fit_factors(weights, 6)
    got = {r.row_id: np.array(r.v) for r in factors.embed(weights, fit).collect()}
    assert np.allclose([got[i] for i in range(120)], x @ fit.right)
    low = x @ fit.right @ fit.right.T
    row = factors.reconstruction_error(weights, fit).first()
    assert row.relative_frobenius == pytest.approx(np.linalg.norm(x - low) / np.linalg.norm(x))
    assert row.rmse == pytest.approx(np.sqrt(((x - low) ** 2).mean()))
    assert factors.scree(fit, (2, 6))[6] == pytest.approx(fit.explained.sum())
    c, feature, loading = factors.top_loadings(fit, 2, 3)[3]
    assert c == 1 and loading == pytest.approx(np.abs(fit.right[:, 1]).max()) and feature == fit.features[np.abs(fit.right[:, 1]).argmax()]


def test_few_features_low_rank_and_none(spark):
    x = np.outer(np.arange(1, 9), [1.0, 2.0, 3.0])
    fit = factors.fit_factors(long(spark, x), 50)
    assert fit.values[0] == pytest.approx(np.linalg.norm(x)) and np.abs(fit.values[1:]).max(initial=0) < 1e-9
    assert factors.fit_factors(long(spark, x).where("false"), 5).features == []


def test_wide_matrices_stop_before_all_features(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 4)) * [9, 7, 5, 3]) @ rng.normal(size=(4, 400)) + 0.01 * rng.normal(size=(200, 400))
    fit = factors.fit_factors(long(spark, x), 4)
    assert np.abs(fit.values - np.linalg.svd(x, compute_uv=False)[:4]).max() < 1e-6
    monkeypatch.setattr(factors, "FEATURES", 399)
    with pytest.raises(ValueError):
        factors.places(long(spark, x))


def test_imputation_over_partitions_is_that_of_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.clip(rng.random((90, 3)) @ rng.random((3, 7)) / 2, 0, 1)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:, 6] = np.nan
    expected = factors.imputed(x, 2)
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    frame = spark.createDataFrame(rows, "row_id long, x array<double>").repartition(5)
    monkeypatch.setattr(factors, "TASKS", 2)
    got = {r.row_id: r.x for r in factors.imputed_rows(frame, 2).collect()}
    assert np.allclose([got[i] for i in range(90)], expected, atol=1e-8)
    there = ~np.isnan(x)
    assert np.array_equal(np.array([got[i] for i in range(90)])[there], x[there])
    assert factors.imputed_rows(frame.where("false"), 2).count() == 0


def plain_linkage(away, cut):
    """Groups by merging the nearest two, by the mean of all distances between them, again and again."""
    groups = [[i] for i in range(len(away))]
    while len(groups) > 1:
        best = min((away[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > 1 - cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("cut", [0.3, 0.6, 0.8])
def test_linkage_is_that_of_nearest_pairs(cut):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 40)) + 0.6 * rng.normal(size=(200, 40))
    r = np.corrcoef(x.T)
    labels = factors.linked_features(r, cut)
    groups = sorted(sorted(np.flatnonzero(np.array(labels) == c).tolist()) for c in set(labels))
    assert groups == plain_linkage(1 - np.abs(r), cut) and labels[0] == 0
    assert factors.linked_features(np.zeros((0, 0))) == []


def test_correlations_of_rows_that_have_both(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6)) + 1000
    x[:, 5] = 3.0
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(150) for j in range(6) if not np.isnan(x[i, j])]
    features, count, r = factors.correlations(spark.createDataFrame(rows, "row_id long, feature string, w double").repartition(3))
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert count[i, j] == both.sum()
            if 5 in (i, j):
                assert np.isnan(r[i, j])
            else:
                assert r[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])
    two = np.array([[1, 0.9, 0.0], [0.9, 1, 0.1], [0.0, 0.1, 1]])
    assert factors.feature_communities(spark, ["a", "b", "c"], two) == {"a": "a", "b": "a", "c": "c"}


def test_communities_of_features_take_no_jobs():
    r = np.eye(6)
    for a, b, w in ((0, 2, 0.9), (0, 4, -0.8), (2, 4, 0.7), (1, 5, 0.6), (4, 5, 0.1), (3, 1, np.nan)):
        r[a, b] = r[b, a] = w
    found = factors.feature_communities(None, list("abcdef"), r)  # no session
    assert found == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "a", "f": "b"}
    assert factors.feature_communities(None, [], np.zeros((0, 0))) == {}
