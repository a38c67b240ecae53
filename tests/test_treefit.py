"""Trees grown over partitions against those grown in memory on the same bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pricewright.operators import boosting, treefit


def same(a: boosting.Node, b: boosting.Node) -> None:
    assert a.value == pytest.approx(b.value, abs=1e-9) and a.cover == pytest.approx(b.cover)
    assert (a.left is None) == (b.left is None)
    if a.left is not None:
        assert (a.feature, a.cut, a.missing_left) == (b.feature, b.cut, b.missing_left)
        same(a.left, b.left)
        same(a.right, b.right)


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(11)
    n = 1600
    rows = pd.DataFrame({"price": rng.uniform(5, 20, n), "rank": rng.integers(0, 40, n).astype(float), "gap": rng.normal(size=n), "model": rng.choice(["a", "b"], n)})
    rows.loc[rng.random(n) < 0.1, "gap"] = np.nan
    rows["y"] = 2 - 0.1 * rows["price"] + 0.02 * rows["rank"] + np.where(rows["gap"].fillna(0) > 0.5, 0.4, 0) + rng.normal(0, 0.05, n) + (rows["model"] == "b")
    rows["n"] = 1.0
    return rows


FEATURES = ["price", "rank", "gap"]


@pytest.mark.parametrize(("tasks", "keep", "rows"), [(64, 10, 50_000), (1, 3, 300)])
def test_trees_are_those_in_memory(spark, panel, monkeypatch, tasks, keep, rows):
    monkeypatch.setattr(treefit, "TASKS", tasks)
    monkeypatch.setattr(treefit, "KEEP", keep)
    monkeypatch.setattr(treefit, "ROWS", rows)
    how = {"rounds": 8, "depth": 3, "min_leaf": 15, "monotone": {"price": -1}}
    edges = {m: boosting.quantile_edges(part[FEATURES].to_numpy()) for m, part in panel.groupby("model")}
    got = treefit.grow(spark.createDataFrame(panel), FEATURES, edges=edges, **how)
    for m, part in panel.groupby("model"):
        expected = boosting.grow(part[FEATURES].to_numpy(), part["y"].to_numpy(), FEATURES, **how)
        assert len(got[m].trees) == len(expected.trees) == 8
        for a, b in zip(got[m].trees, expected.trees, strict=True):
            same(a, b)


def test_logistic_counted_and_limited_models(spark, panel):
    rows = panel.assign(y=(panel["y"] > panel["y"].median()).astype(float), n=np.arange(len(panel)) % 3 + 1.0)
    frame = spark.createDataFrame(rows)
    got = treefit.grow(frame, FEATURES, 5, logistic=["a"], counted=True, allowed={"a": ["price"], "b": FEATURES})
    part = rows[rows["model"] == "a"]
    whole = part[FEATURES].to_numpy()
    expected = boosting.grow(np.where([True, False, False], whole, np.nan), part["y"].to_numpy(), FEATURES, 5, logistic=True, count=part["n"].to_numpy())
    assert got["a"].logistic and not got["b"].logistic
    assert np.allclose(got["a"].predict(whole), expected.predict(np.where([True, False, False], whole, np.nan)), atol=1e-9)
    guess = treefit.predicted(frame, got).select("model", "y", "guess").toPandas()
    assert np.allclose(sorted(guess[guess["model"] == "a"]["guess"]), sorted(got["a"].predict(whole)))
    shares = {(r.model, r.feature): r.importance for r in treefit.attributed(frame, got, "n").collect()}
    mean = np.average(np.abs(got["a"].attributions(whole)[:, :-1]), axis=0, weights=part["n"])
    assert [shares["a", f] for f in FEATURES] == pytest.approx(mean.tolist())


def test_class_trees_are_those_in_memory(spark, panel):
    rows = panel.assign(label=np.where(panel["y"] > 1.6, "WON", np.where(panel["y"] < 0.9, "LOST", "MIXED")))
    edges = {m: boosting.quantile_edges(part[FEATURES].to_numpy()) for m, part in rows.groupby("model")}
    got = treefit.grow_classes(spark.createDataFrame(rows), FEATURES, 4, 40, edges)
    for m, part in rows.groupby("model"):
        assert got[m] == boosting.rule_tree(part[FEATURES].to_numpy(), part["label"].tolist(), FEATURES, 4, 40)


def test_no_rows_and_constant_targets(spark, panel):
    frame = spark.createDataFrame(panel)
    assert treefit.grow(frame.where("false"), FEATURES) == {} and treefit.grow_classes(frame.where("false").withColumnRenamed("model", "label").selectExpr("label", "label as model", *FEATURES), FEATURES) == {}
    flat = treefit.grow(frame.selectExpr("model", *FEATURES, "0.25D as y", "n"), FEATURES, 3)
    assert flat["a"].trees == [] and flat["a"].base == pytest.approx(0.25)


@pytest.mark.parametrize(("own", "passes"), [(50_000, 0), (900, 10), (0, 10)])
def test_models_of_few_rows_grow_in_a_task_and_others_over_partitions(spark, panel, monkeypatch, own, passes):
    rows = pd.concat([panel[panel["model"] == "a"], panel[panel["model"] == "b"], panel[panel["model"] == "b"].assign(y=lambda x: x["y"] + 0.1 * x["gap"].fillna(0))])
    made = []
    real = treefit._summed
    monkeypatch.setattr(treefit, "OWN", own)
    monkeypatch.setattr(treefit, "KEEP", 2)
    monkeypatch.setattr(treefit, "ROWS", 400)
    monkeypatch.setattr(treefit, "_summed", lambda *a: made.append(1) or real(*a))
    edges = {m: boosting.quantile_edges(part[FEATURES].to_numpy()) for m, part in rows.groupby("model")}
    got = treefit.grow(spark.createDataFrame(rows), FEATURES, 5, depth=2, min_leaf=15, edges=edges, monotone={"price": -1}, allowed={"a": ["price", "gap"], "b": FEATURES}, logistic=["a"])
    assert len(made) == passes  # a pass is a job
    for m, part in rows.groupby("model"):
        x = np.where([True, m == "b", True], part[FEATURES].to_numpy(), np.nan)
        expected = boosting.grow(x, part["y"].to_numpy(), FEATURES, 5, depth=2, min_leaf=15, monotone={"price": -1}, logistic=m == "a")
        assert len(got[m].trees) == len(expected.trees) == 5
        for a, b in zip(got[m].trees, expected.trees, strict=True):
            same(a, b)
