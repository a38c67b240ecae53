"""Back-tests of predicted demand, inferred sample sizes and redundancy-weighted agreement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.operators.market import draw


def demand_draws(rows: DataFrame, mean: str, dispersion: str, key: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """Add the 10, 50 and 90 % points of simulated demand; the seed of a row comes from its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = []
            for m, r, k in zip(batch[mean], batch[dispersion], batch[key], strict=True):
                rng = np.random.default_rng([seed, int(k) & 0x7FFFFFFF])
                points.append(np.quantile(draw(rng, float(m), float(r), draws), [0.1, 0.5, 0.9]))
            cols = np.array(points).reshape(-1, 3).T
            yield batch.assign(p10=cols[0], p50=cols[1], p90=cols[2])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, p10 double, p50 double, p90 double")


def inferred_sizes(rows: DataFrame, share: str, most: int = 30) -> DataFrame:
    """(share, n, denominator): the sample of at most ``most`` that a share comes nearest to, per distinct share.

    Distances count to twelve digits, and of equal ones the smallest sample is taken: 59 of 60 is as far from 1 as from 29 of 30.
    """
    distinct = rows.where(F.col(share).isNotNull()).groupBy(share).agg(F.count("*").alias("n"))

    def sample(k: Column) -> Column:
        nearest = F.floor(F.col(share) * k + 0.5) / k
        return F.struct(F.floor(F.abs(F.col(share) - nearest) * 1e12 + 0.5).alias("away"), k.alias("k"))

    sizes = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(most).cast("long")), sample)
    return distinct.select(share, "n", F.array_min(sizes)["k"].alias("denominator"))


def agreement(pairs: DataFrame, columns: Sequence[str], clusters: Sequence[int], gamma: float = 1.0) -> Column:
    """A Gaussian agreement of two rows (columns ``a_x`` and ``b_x``), each feature weighing one over its cluster's size,
    cubed."""
    sizes = {c: list(clusters).count(c) for c in clusters}
    total, weights = F.lit(0.0), 0.0
    for name, c in zip(columns, clusters, strict=True):
        away = F.col(f"a_{name}") - F.col(f"b_{name}")
        total = total + F.exp(-F.lit(float(gamma)) * away * away) / sizes[c]
        weights += 1 / sizes[c]
    return (total / weights) ** 3


def grid(values_k: Sequence[int], resolutions: Sequence[float], score) -> tuple[tuple[int, float], dict[tuple[int, float], float]]:
    """The best setting of a grid by a score that is taken from that setting's own clustering."""
    table = {(k, r): float(score(k, r)) for k in values_k for r in resolutions}
    return max(sorted(table), key=lambda s: table[s]), table
