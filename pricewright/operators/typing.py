"""Column typing, robust scaling and codes over tables and long feature frames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import parse
from pricewright.operators.panel import coverage

#: Words in a header that mark identifiers, and those that mark counts.
ID_WORDS = ("id", "ean", "asin", "upc", "serial", "barcode", "isbn", "gtin", "sku", "code", "model", "mpn")
COUNT_WORDS = r"(?i)number of|quantity|\bcount\b|\bqty\b|nombre|numero"


@dataclass(frozen=True)
class Scale:
    center: float
    scale: float
    method: str


def scale_parameters(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """center and scale: the median, and the first non-zero of quartile range, 1.4826 MAD and deviation, else 1."""
    keyed = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    first = keyed.groupBy(*by).agg(
        F.percentile("_x", F.lit(0.5)).alias("center"),
        (F.percentile("_x", F.lit(0.75)) - F.percentile("_x", F.lit(0.25))).alias("iqr"),
        F.stddev_pop("_x").alias("deviation"),
    )
    joined = keyed.join(first, list(by)) if by else keyed.crossJoin(F.broadcast(first))  # one row without keys
    mad = joined.groupBy(*by, "center", "iqr", "deviation").agg(
        F.percentile(F.abs(F.col("_x") - F.col("center")), F.lit(0.5)).alias("mad")
    )
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).when(F.col("mad") > 0, 1.4826 * F.col("mad"))
    scale = scale.when(F.col("deviation") > 0, F.col("deviation")).otherwise(F.lit(1.0))
    return mad.select(*by, "center", scale.alias("scale"))


def robust_scaled(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``{value}_scaled`` = (x - center) / scale."""
    fitted = scale_parameters(rows, value, by)
    joined = rows.join(fitted, list(by), "left") if by else rows.crossJoin(F.broadcast(fitted))
    scaled = (F.col(value).cast("double") - F.col("center")) / F.col("scale")
    return joined.withColumn(f"{value}_scaled", scaled).drop("center", "scale")


def scaled(rows: DataFrame, value: str, by: Sequence[str] = (), method: str = "robust") -> DataFrame:
    """Add ``{value}_scaled`` by one of three methods: robust, zscore (mean and deviation) or minmax.

    Values that are not finite take no part in the fit and stay as they are; a scale of 0 counts as 1.
    """
    x = F.col(value).cast("double")
    finite = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if method == "robust":
        fitted = scale_parameters(finite, value, by)
    elif method == "zscore":
        fitted = finite.groupBy(*by).agg(F.avg(x).alias("center"), F.stddev_pop(x).alias("scale"))
    elif method == "minmax":
        fitted = finite.groupBy(*by).agg(F.min(x).alias("center"), (F.max(x) - F.min(x)).alias("scale"))
    else:
        raise ValueError(f"unknown method: {method}")
    joined = rows.join(fitted, list(by), "left") if by else rows.crossJoin(F.broadcast(fitted))  # one row without keys
    step = F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))
    return joined.withColumn(f"{value}_scaled", (x - F.col("center")) / step).drop("center", "scale")


def log_target(value: Column, least: float = 1e-6) -> Column:
    """The logarithm of a target, held above ``least``; ``exp`` takes it back."""
    return F.log(F.greatest(value.cast("double"), F.lit(least)))


def levels(rows: DataFrame, value: str) -> list[str]:
    """The levels of a column as they are at fit, in order: the size of a schema's domain."""
    return sorted(r[0] for r in rows.where(F.col(value).isNotNull()).select(value).distinct().collect())


def with_levels(rows: DataFrame, value: str, fitted: Sequence[str]) -> DataFrame:
    """Add ``{value}_level`` and ``{value}_code``: the fitted levels and their places; others are missing, with code -1."""
    known = F.array(*[F.lit(v) for v in fitted]).cast("array<string>")
    place = F.coalesce(F.array_position(known, F.col(value)), F.lit(0)).cast("int") - 1
    return rows.withColumn(f"{value}_level", F.when(place >= 0, F.col(value))).withColumn(f"{value}_code", place)


def top_contributions(parts: dict[str, Column], n: int) -> Column:
    """array<struct<size, feature, value>> of the ``n`` parts of a row that are largest by size, ties by name."""
    each = [F.struct((-F.abs(v)).alias("size"), F.lit(k).alias("feature"), v.alias("value")) for k, v in parts.items()]
    return F.slice(F.array_sort(F.array(*each)), 1, n)


class Normaliser:
    """Fit on a long frame (row_id, section, feature, value) one scale for each numeric feature, whatever its section."""

    def __init__(self, numeric_share: float = 0.9, least: int = 2):
        self.numeric_share, self.least = numeric_share, least
        self.parameters: dict[str, Scale | None] = {}

    def fit(self, long: DataFrame) -> Normaliser:
        """Features of which enough values are numbers get a scale; the table of features has the size of the schema."""
        read = long.where("value is not null").withColumn("_x", parse.number(F.col("value")))
        kinds = read.groupBy("feature").agg(F.avg(F.col("_x").isNotNull().cast("double")).alias("share"), F.count("_x").alias("n"))
        numeric = kinds.where((F.col("share") >= self.numeric_share) & (F.col("n") >= self.least)).select("feature")
        scales = {r["feature"]: r for r in scale_parameters(read.join(numeric, "feature", "left_semi"), "_x", ["feature"]).collect()}
        self.parameters = {
            r["feature"]: Scale(scales[r["feature"]]["center"], scales[r["feature"]]["scale"], "robust") if r["feature"] in scales else None
            for r in kinds.collect()
        }
        return self

    def transform(self, long: DataFrame) -> DataFrame:
        """Add scaled for numeric features and label, the canonical spelling, for the others."""
        fitted = [(f, s.center, s.scale) for f, s in self.parameters.items() if s]
        table = long.sparkSession.createDataFrame(fitted, "feature string, center double, scale double")
        joined = long.join(F.broadcast(table), "feature", "left")  # one row for each feature of the schema
        number = parse.number(F.col("value"))
        label = F.when(F.col("scale").isNull(), parse.canonical(F.col("value")))
        return joined.select(*long.columns, ((number - F.col("center")) / F.col("scale")).alias("scaled"), label.alias("label"))

    def to_json(self) -> str:
        known = {f: None if s is None else {"type": "numeric", "center": s.center, "scale": s.scale} for f, s in self.parameters.items()}
        return json.dumps({"method": "robust", "numeric_min_frac": self.numeric_share, "min_non_null": self.least, "params": known})

    @staticmethod
    def from_json(text: str) -> Normaliser:
        data = json.loads(text)
        out = Normaliser(data["numeric_min_frac"], data["min_non_null"])
        out.parameters = {f: None if p is None else Scale(p["center"], p["scale"], "robust") for f, p in data["params"].items()}
        return out


def column_types(long: DataFrame) -> DataFrame:
    """feature, type and confidence from the values of a long frame (feature, value): one aggregate and one decision."""
    x = parse.number(F.col("value"))
    stats = long.where("value is not null").withColumn("_x", x).groupBy("feature").agg(
        F.count("*").alias("n"),
        F.countDistinct("value").alias("n_unique"),
        F.avg(F.col("_x").isNotNull().cast("double")).alias("numeric_share"),
        F.avg(F.when(F.col("_x").isNotNull(), (F.col("_x") % 1 != 0).cast("double"))).alias("fraction_share"),
    )
    words = F.split(F.trim(F.regexp_replace(F.lower("feature"), "[^a-z0-9]+", " ")), " ")
    measure = (F.col("numeric_share") >= 0.98) & (F.coalesce("fraction_share", F.lit(0.0)) > 0.02)
    key_named = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ID_WORDS]))
    verdict = lambda kind, sure: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    decided = (
        F.when(F.array_contains(words, "url"), verdict("identifier", 0.99))
        .when(~measure & (F.col("n_unique") / F.col("n") >= 0.98), verdict("identifier", 0.95))
        .when(~measure & key_named & (F.col("n_unique") > 100), verdict("identifier", 0.9))
        .when(F.col("numeric_share") < 0.98, verdict("categorical", 0.99))
        .when(measure, verdict("numeric", 0.99))
        .when(F.array_join(words, " ").rlike(COUNT_WORDS), verdict("numeric", 0.9))
        .when(F.col("n_unique") <= 10, verdict("categorical", 0.9))
        .when(F.col("n_unique") >= 50, verdict("numeric", 0.85))
        .otherwise(verdict("ambiguous", 0.0))
    )
    return stats.withColumn("_d", decided).select("feature", "n", "n_unique", "_d.type", "_d.confidence")


def resolved_types(types: DataFrame, cache: dict[str, dict], judge=None) -> dict[str, dict]:
    """Verdicts by feature: cached ones first, then the rules, then a judge for ambiguous ones, else categorical."""
    out = dict(cache)
    for r in types.collect():  # one row for each feature of the schema
        if r["feature"] in out:
            continue
        kind, sure, source = r["type"], r["confidence"], "rules"
        if kind == "ambiguous":
            asked = judge(r["feature"]) if judge else None
            kind, sure, source = (asked, 0.5, "judge") if asked else ("categorical", 0.0, "fallback")
        out[r["feature"]] = {"type": kind, "confidence": sure, "source": source}
    return out


def coalesced(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One column for each concept that the headers name: the first non-null, best filled columns first."""
    filled = {r["column"]: r["share"] for r in coverage(rows, columns).collect()}
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(parse.concept(c), []).append(c)
    others = [F.col(c) for c in rows.columns if c not in columns]
    best_first = lambda names: sorted(names, key=lambda c: -(filled[c] or 0))
    merged = [F.coalesce(*[F.col(c) for c in best_first(names)]).alias(name) for name, names in groups.items()]
    return rows.select(*others, *merged)


def without_extremes(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Null values ten times beyond the first or last percentile, where there are 30 values or more."""
    limits = rows.groupBy(*by).agg(
        F.count(value).alias("_n"),
        (F.percentile(value, F.lit(0.01)) / 10).alias("_low"),
        (F.percentile(value, F.lit(0.99)) * 10).alias("_high"),
    )
    joined = rows.join(limits, list(by), "left") if by else rows.crossJoin(F.broadcast(limits))
    keep = (F.col("_n") < 30) | F.col(value).between(F.col("_low"), F.col("_high"))
    return joined.withColumn(value, F.when(keep, F.col(value))).drop("_n", "_low", "_high")


def quantile_codes(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Add ``{value}_code``: 0-based quantile bins with equal edges merged, -1 for missing values."""
    distinct = rows.agg(F.countDistinct(value)).first()[0] or 1
    q = max(1, min(bins, distinct))
    edges = rows.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)]))).alias("_edges"))
    joined = rows.crossJoin(F.broadcast(edges))  # one row
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    code = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return joined.withColumn(f"{value}_code", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(code)).drop("_edges")


def soft_codes(rows: DataFrame, value: str, numeric: bool, order: str) -> DataFrame:
    """Add ``{value}_soft`` in [0, 1]: the scaled number, or the code in order of first appearance over the last code."""
    if numeric:
        x = F.col(value).cast("double")
        ends = rows.agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
        spread = F.when(F.col("_high") > F.col("_low"), (x - F.col("_low")) / (F.col("_high") - F.col("_low")))
        soft = spread.when(x.isNotNull(), F.lit(0.5))
        return rows.crossJoin(F.broadcast(ends)).withColumn(f"{value}_soft", soft).drop("_low", "_high")  # one row
    firsts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    codes = firsts.select(value, (F.row_number().over(Window.orderBy("_first")) - 1).alias("_code"))
    top = F.max("_code").over(Window.partitionBy())
    codes = codes.withColumn("_soft", F.when(top > 0, F.col("_code") / top).otherwise(F.lit(0.0))).drop("_code")
    return rows.join(codes, value, "left").withColumnRenamed("_soft", f"{value}_soft")


def levels_with_rare(rows: DataFrame, value: str, train: Column, least: int = 20) -> DataFrame:
    """Add ``{value}_level``: levels frequent among training rows keep their name, others are infrequent, missing null."""
    frequent = rows.where(train).groupBy(value).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(value, F.lit(True).alias("_keep"))
    level = F.when(F.col(value).isNull(), None).when(F.col("_keep"), F.col(value)).otherwise(F.lit("infrequent"))
    return rows.join(frequent, value, "left").withColumn(f"{value}_level", level).drop("_keep")


def one_hot(rows: DataFrame, value: str, levels: Sequence[str]) -> DataFrame:
    """A 0/1 column for each level but the first in order; missing and unknown values have zeros."""
    marks = {f"{value}_{v}": F.coalesce((F.col(value) == v).cast("int"), F.lit(0)) for v in sorted(levels)[1:]}
    return rows.withColumns(marks)


def feature_weight(feature: str, weights: dict[str, float], banned: Sequence[str] = ("day",), text_weight: float = 0.75,
                   text_stats: Sequence[str] = ()) -> float | None:
    """A feature's say in votes: an override, less for writing style, 1 otherwise; none for banned ones."""
    if feature in banned:
        return None
    return weights.get(feature, text_weight if feature in text_stats else 1.0)
