"""Forecasts of share and conversion: features ranked by attribution, a constrained refit on the best, bundles that keep it.

``ranked``, ``fitted`` and ``refitted`` work on rows in memory. The same on a table, for all its models (markets, trials) at once, are
``ranked_models``, ``fitted_models`` and ``refitted_models``, which grow their trees over partitions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.columns import ratio
from pricewright.operators import boosting, metrics, treefit
from pricewright.operators.market import price_gap, rule_share
from pricewright.sources.sinks import write_json
from pricewright.sources.tables import json_sidecar

#: The direction in which a price or cost may move the share.
SIGNS = {"price": -1, "own_landed": -1, "own_shipping": -1, "price_vs_lowest": -1, "price_vs_bb": -1, "landed_vs_bb": -1,
         "lowest_price": 1, "min_landed": 1}
#: Features kept, and the least share of filled rows.
TOP, FILLED = 15, 0.02
#: A category of more levels than this is no category.
LEVELS = 1000


@dataclass
class Forecast:
    """A model with its columns, and the levels of its categories in the order they are coded in."""

    trees: boosting.Trees
    columns: list[str]
    levels: dict[str, list[str]]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        """The columns as numbers; a column that is not there and a level that is new count as missing."""
        out = np.full((len(rows), len(self.columns)), np.nan)
        for j, c in enumerate(self.columns):
            if c not in rows:
                continue
            if c in self.levels:
                code = {v: float(k) for k, v in enumerate(self.levels[c])}
                out[:, j] = [code.get(str(v), np.nan) if pd.notna(v) else np.nan for v in rows[c]]
            else:
                out[:, j] = pd.to_numeric(rows[c], errors="coerce")
        return out

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        return self.trees.predict(self.matrix(rows))

    def to_json(self) -> str:
        return json.dumps({"model": self.trees.to_json(), "columns": self.columns, "levels": self.levels})

    @staticmethod
    def from_json(text: str) -> Forecast:
        data = json.loads(text)
        return Forecast(boosting.Trees.from_json(data["model"]), data["columns"], data["levels"])


def kept_or_fitted(spark: SparkSession, path: str, fit: Callable[[], Forecast]) -> Forecast:
    """The forecast kept at a path; where there is none or it cannot be read, a new fit, which is kept."""
    try:
        return Forecast.from_json(json.dumps(json_sidecar(spark, path)))
    except Exception:  # noqa: BLE001 - whatever makes it unreadable, the answer is a new fit
        made = fit()
        write_json(json.loads(made.to_json()), spark, path)
        return made


def fitted(rows: pd.DataFrame, y: np.ndarray, columns: Sequence[str], categories: Sequence[str], signs: dict[str, int] | None = None,
           rounds: int = 200, rate: float = 0.08, depth: int = 5, min_leaf: int = 10, ridge: float = 0.5, logistic: bool = False) -> Forecast:
    """A model on raw columns. The levels of a category are coded in the order of the mean target, in which the best split of
    the levels into two sets is one cut."""
    levels = {}
    for c in categories:
        if c in columns:
            means = pd.Series(y).groupby(rows[c].astype(str).where(rows[c].notna()).to_numpy()).mean()
            levels[c] = [str(v) for v in means.sort_values(kind="stable").index]
    model = Forecast(boosting.Trees([], [], 0.0, 1.0, False), list(columns), levels)
    model.trees = boosting.grow(model.matrix(rows), y, columns, rounds, rate, depth, min_leaf, ridge, logistic, signs)
    return model


def ranked(rows: pd.DataFrame, y: np.ndarray, columns: Sequence[str], categories: Sequence[str], rounds: int = 60) -> pd.Series:
    """Mean absolute attributions of columns and of single levels (``column_level``), the largest first; nearly empty ones go."""
    wide = {c: pd.to_numeric(rows[c], errors="coerce").to_numpy(float) for c in columns if c not in categories}
    for c in categories:
        for v in sorted(rows[c].dropna().astype(str).unique())[1:]:
            wide[f"{c}_{v}"] = (rows[c].astype(str) == v).to_numpy(float)
    x = pd.DataFrame(wide)
    x = x[[c for c in x if x[c].notna().mean() >= FILLED]]
    model = boosting.grow(x.to_numpy(float), y, list(x), rounds)
    shares = np.abs(model.attributions(x.to_numpy(float))[:, :-1]).mean(0)
    return pd.Series(shares, index=list(x)).sort_values(ascending=False, kind="stable")


def best_columns(ranking: pd.Series, categories: Sequence[str], top: int = TOP) -> list[str]:
    """The raw columns behind the first ``top`` of a ranking, each once, in its order."""
    parent = lambda f: next((c for c in categories if f == c or f.startswith(f"{c}_")), f)
    return list(dict.fromkeys(parent(f) for f in ranking.index[:top]))


def refitted(rows: pd.DataFrame, y: np.ndarray, columns: Sequence[str], categories: Sequence[str], signs: dict[str, int] = SIGNS,
             top: int = TOP, **how) -> Forecast:
    """Rank, keep the best columns, and fit them again under the constraints."""
    kept = best_columns(ranked(rows, y, columns, categories), categories, top)
    return fitted(rows, y, kept, categories, signs, **how)


def scores(y: np.ndarray, guess: np.ndarray, half: float = 0.5) -> dict[str, float]:
    """R2, MSE and MAE of a holdout, and the AUC of passing ``half``; missing where it has one class."""
    err = guess - y
    spread = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    label = y >= half
    ranks = pd.Series(guess).rank().to_numpy()
    n, m = label.sum(), (~label).sum()
    auc = (ranks[label].sum() - n * (n + 1) / 2) / (n * m) if n and m else float("nan")
    return {"r2": 1 - float((err**2).sum() / spread) if spread else float("nan"), "mse": float((err**2).mean()), "mae": float(np.abs(err).mean()), "auc": float(auc)}


def chained_share(price: Column, bb_price: Column, lowest_price: Column, fba: float = 1.0, prime: float = 1.0, feedback: float = 4.5) -> Column:
    """The share by the stated rule as a feature of conversion; a competitor's price that is missing or 0 gives no gap."""
    gap = F.when(price.isNotNull(), price_gap(price, bb_price))
    abs_gap = F.when(price.isNotNull(), price_gap(price, lowest_price))
    return F.when(price.isNotNull(), rule_share(gap, abs_gap, F.lit(fba), F.lit(prime), F.lit(feedback)))


# ---- the same on tables, for all models at once ----


def _levels(rows: DataFrame, category: str) -> list[str]:
    found = [r[0] for r in rows.select(F.col(category).cast("string")).where(F.col(category).isNotNull()).distinct().limit(LEVELS + 1).collect()]
    if len(found) > LEVELS:
        raise ValueError(f"{category} has more than {LEVELS} levels")
    return sorted(found)


def ranked_models(rows: DataFrame, columns: Sequence[str], categories: Sequence[str], rounds: int = 60) -> dict[str, pd.Series]:
    """``ranked`` for each ``model`` of rows with a target ``y``: attributions are averaged over all its rows."""
    wide = {c: F.col(c).cast("double") for c in columns if c not in categories}
    for c in (c for c in categories if c in columns):
        wide |= {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for v in _levels(rows, c)[1:]}
    names = {f"x{k}": label for k, label in enumerate(wide)}
    table = rows.select("model", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("n"), *[c.alias(k) for k, c in zip(names, wide.values(), strict=True)])
    filled = table.groupBy("model").agg(*[F.avg(F.col(k).isNotNull().cast("double")).alias(k) for k in names]).collect()
    allowed = {r["model"]: [k for k in names if r[k] >= FILLED] for r in filled}
    models = treefit.grow(table, list(names), rounds, allowed=allowed)
    out = {m: pd.Series({names[k]: 0.0 for k in allowed[m]}) for m in models}
    for r in treefit.attributed(table, models).collect() if models else []:  # one row for each model and feature
        if r["feature"] in allowed[r["model"]]:
            out[r["model"]][names[r["feature"]]] = r["importance"]
    return {m: s.sort_values(ascending=False, kind="stable") for m, s in out.items()}


def _narrowed(trees: boosting.Trees, columns: Sequence[str], every: Sequence[str]) -> boosting.Trees:
    """The trees with only the features they may use, named by column."""
    place = {every.index(c): k for k, c in enumerate(columns)}

    def of(node: boosting.Node) -> boosting.Node:
        if node.left is None:
            return node
        return boosting.Node(node.value, node.cover, place[node.feature], node.cut, node.missing_left, of(node.left), of(node.right))

    edges = [trees.edges[every.index(c)] for c in columns]
    return boosting.Trees(list(columns), edges, trees.base, trees.rate, trees.logistic, [of(t) for t in trees.trees])


def fitted_models(rows: DataFrame, chosen: Mapping[str, Sequence[str]], categories: Sequence[str], signs: dict[str, int] | None = None,
                  rounds: int = 200, rate: float = 0.08, depth: int = 5, min_leaf: int = 10, ridge: float = 0.5) -> dict[str, Forecast]:
    """``fitted`` for each ``model`` of rows with a target ``y``, on the columns chosen for it."""
    every = list(dict.fromkeys(c for columns in chosen.values() for c in columns))
    levels: dict[str, dict[str, list[str]]] = {m: {} for m in chosen}
    for c in (c for c in categories if c in every):
        _levels(rows, c)
        means = rows.where(F.col(c).isNotNull()).groupBy("model", F.col(c).cast("string").alias("level")).agg(F.avg("y").alias("mean"))
        for r in sorted(means.collect(), key=lambda r: (r["mean"], r["level"])):
            levels.setdefault(r["model"], {}).setdefault(c, []).append(r["level"])
    names = [f"x{k}" for k in range(len(every))]

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = boosting.Trees([], [], 0.0, 1.0, False)
        for part in parts:
            for m, own in part.groupby("model"):
                codes = {c: levels.get(m, {}).get(c, []) for c in categories if c in every}
                out = pd.DataFrame(Forecast(blank, every, codes).matrix(own), columns=names)
                yield out.assign(model=m, y=own["y"].to_numpy(float), n=1.0)

    schema = ", ".join([*[f"{k} double" for k in names], "model string", "y double", "n double"])
    table = rows.select("model", "y", *every).mapInPandas(coded, schema)
    allowed = {m: [names[every.index(c)] for c in columns] for m, columns in chosen.items()}
    monotone = {names[every.index(c)]: s for c, s in (signs or {}).items() if c in every}
    models = treefit.grow(table, names, rounds, rate, depth, min_leaf, ridge, monotone=monotone, allowed=allowed)
    return {
        m: Forecast(_narrowed(t, list(chosen[m]), every), list(chosen[m]), {c: levels[m][c] for c in categories if c in chosen[m] and c in levels[m]})
        for m, t in models.items()
    }


def refitted_models(rows: DataFrame, columns: Sequence[str], categories: Sequence[str], signs: dict[str, int] = SIGNS,
                    top: int = TOP, **how) -> dict[str, Forecast]:
    """Rank, keep the best columns of each model, and fit them again under the constraints."""
    chosen = {m: best_columns(ranking, categories, top) for m, ranking in ranked_models(rows, columns, categories).items()}
    return fitted_models(rows, chosen, categories, signs, **how)


def guessed(rows: DataFrame, models: Mapping[str, Forecast], *own: str) -> DataFrame:
    """(model, y, own columns, guess) of the rows that have a model."""
    shared = rows.sparkSession.sparkContext.broadcast({m: f.to_json() for m, f in models.items()})
    used = list(dict.fromkeys(c for f in models.values() for c in f.columns))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {m: Forecast.from_json(f) for m, f in shared.value.items()}
        for part in parts:
            for m, rows in part.groupby("model"):
                if m in made:
                    yield rows[["model", "y", *own]].assign(guess=made[m].predict(rows))

    table = rows.select("model", F.col("y").cast("double").alias("y"), *own, *[c for c in used if c not in own])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.select("model", "y", *own).schema.fields]
    return table.mapInPandas(run, ", ".join([*kinds, "guess double"]))


def evaluated(rows: DataFrame, half: Column | None = None) -> DataFrame:
    """(model, n, r2, mse, mae, auc) of guesses: the AUC is that of passing ``half``; missing where it has one class."""
    err, known = F.col("guess") - F.col("y"), rows.where("y is not null and guess is not null")
    means = known.groupBy("model").agg(F.avg("y").alias("_mean"))
    spread = F.sum((F.col("y") - F.col("_mean")) ** 2)
    fit = known.join(means, "model").groupBy("model").agg(
        F.count("*").alias("n"), (1 - ratio(F.sum(err * err), spread)).alias("r2"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae")
    )
    marked = known.withColumn("_passed", F.col("y") >= (F.lit(0.5) if half is None else half))
    return fit.join(metrics.roc_auc(marked, F.col("_passed"), "guess", ["model"]), "model", "left")
