"""Evaluation as aggregates: regression metrics, rank AUC, average precision, confusion tables, buckets, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.columns import ratio


def correlated(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r): for each pair of columns of a wide table the rows that have both and their correlation there; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(sorted(columns)) for b in sorted(columns)[i + 1 :]]
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    r = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both(a, b).alias("n"), r(a, b).alias("r")) for a, b in pairs]
    return rows.agg(F.array(*each).alias("pairs")).select(F.inline("pairs"))


def regression(rows: DataFrame, truth: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE, RMSE, MedAE, MAPE, sMAPE, Bias % and Hit20 of each group, in one aggregate after the group's mean."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    known = rows.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    means = known.groupBy(*by).agg(F.avg(y).alias("_mean"))
    known = known.join(means, list(by)) if by else known.crossJoin(F.broadcast(means))  # one row without keys
    err = p - y
    return known.groupBy(*by).agg(
        (1 - ratio(F.sum(err * err), F.sum((y - F.col("_mean")) ** 2))).alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.percentile(F.abs(err), F.lit(0.5)).alias("medae"),
        (F.avg(ratio(F.abs(err), F.abs(y))) * 100).alias("mape"),
        (F.avg(ratio(2 * F.abs(err), F.abs(y) + F.abs(p))) * 100).alias("smape"),
        (ratio(F.sum(err), F.sum(y)) * 100).alias("bias_pct"),
        (F.avg((F.abs(err) <= 0.2 * F.abs(y)).cast("double")) * 100).alias("hit20"),
    )


#: Ranges of a value between its ends, within which running sums are taken side by side.
RANGES = 4096


def _joined(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(table, list(by)) if by else rows.crossJoin(F.broadcast(table))  # one row without keys


def with_sums_below(counts: DataFrame, value: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``{column}_below``: the sum of a column over smaller values, and ``{column}_total``, over all of a group.

    ``counts`` has one row for each value. The span of the values is cut into ranges; the sums of whole ranges are few, and
    the rest is a running sum inside a range, so no task sorts a group. A null is below every value.
    """
    x = F.col(value).cast("double")
    ends = counts.groupBy(*by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), *[F.sum(c).alias(f"{c}_total") for c in columns])
    step = (x - F.col("_low")) / (F.col("_high") - F.col("_low")) * RANGES
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(step), F.lit(RANGES - 1))).otherwise(F.lit(0))
    placed = _joined(counts, ends, by).withColumn("_range", F.when(x.isNull(), F.lit(-1)).otherwise(place))
    ranges = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    ranges = ranges.select(*by, "_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return placed.join(ranges, [*by, "_range"]).withColumns(below).drop("_low", "_high", "_range", *[f"_{c}" for c in columns])


def average_ranks(rows: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the mean rank of ties of a value."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = with_sums_below(counts, value, ["_n"], by).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], (F.col("_n_below") + (F.col("_n") + 1) / 2).alias(name)
    )
    same = F.lit(True)
    for i, c in enumerate([*by, value]):
        same = same & rows[c].eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ranks, same).select(*rows.columns, name)


def spearman(rows: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    ranked = average_ranks(average_ranks(rows.select(*by, left, right), left, "_a", by), right, "_b", by)
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("spearman"))


def roc_auc(rows: DataFrame, label: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The chance that a positive outranks a negative, ties counting half.

    Scores are counted per value first, so the sums below go over distinct scores.
    """
    marked = rows.groupBy(*by, score).agg(F.sum(label.cast("long")).alias("_p"), F.sum(1 - label.cast("long")).alias("_n"))
    won = with_sums_below(marked, score, ["_n"], by).withColumn("_won", F.col("_p") * (F.col("_n_below") + F.col("_n") / 2))
    return won.groupBy(*by).agg(ratio(F.sum("_won"), F.sum("_p") * F.sum("_n")).alias("auc"))


def average_precision(rows: DataFrame, label: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The mean of the precision at each positive, in descending order of distinct scores."""
    marked = rows.groupBy(*by, score).agg(F.sum(label.cast("long")).alias("_p"), F.count("*").alias("_n"))
    held = with_sums_below(marked, score, ["_p", "_n"], by)
    precision = (F.col("_p_total") - F.col("_p_below")) / (F.col("_n_total") - F.col("_n_below"))
    held = held.withColumn("_gain", F.col("_p") * precision)
    return held.groupBy(*by).agg(ratio(F.sum("_gain"), F.sum("_p")).alias("average_precision"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def classification_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    cells = confusion(rows, truth, guess)
    hits = cells.where(F.col(truth) == F.col(guess)).select(F.col(truth).alias("class"), F.col("n").alias("hit"))
    said = cells.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("said"))
    there = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"))
    table = there.join(said, "class", "left").join(hits, "class", "left")
    hit = F.coalesce("hit", F.lit(0))
    precision, recall = F.coalesce(ratio(hit, F.col("said")), F.lit(0.0)), ratio(hit, F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return table.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def bucketed_error(rows: DataFrame, truth: str, guess: str, edges: Sequence[float] = (-0.01, 0.2, 0.8, 1.01)) -> DataFrame:
    """n, MAE and mean bias by bucket of the truth; buckets are open on the left."""
    bucket = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bucket = F.when((F.col(truth) > low) & (F.col(truth) <= high), F.lit(i)).otherwise(bucket)
    err = F.col(guess) - F.col(truth)
    table = rows.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket")
    return table.agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"))


def baselines(train: DataFrame, test: DataFrame, key: str, value: str) -> DataFrame:
    """Test rows with the mean of all training rows and that of their key, the former where the key is new."""
    whole = train.agg(F.avg(value).alias("constant"))
    means = train.groupBy(key).agg(F.avg(value).alias("_mean"))
    joined = test.join(means, key, "left").crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn("by_key", F.coalesce("_mean", "constant")).drop("_mean")


def bands(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The 5, 25, 50, 75 and 95 % points of a value at each step."""
    points = F.percentile(value, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q")
    table = rows.groupBy(by).agg(points)
    return table.select(by, *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


def summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))],
    )


def reconstruction(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Relative Frobenius error, RMSE and MAE of a reconstructed table in long form."""
    err = F.col(guess) - F.col(truth)
    return rows.agg(
        ratio(F.sqrt(F.sum(err * err)), F.sqrt(F.sum(F.col(truth) * F.col(truth)))).alias("relative_frobenius"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
    )
