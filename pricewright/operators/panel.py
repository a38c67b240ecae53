"""Weekly panels: rollups, fact joins, filling of gaps, snapshots and column hygiene."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.columns import month_start, ratio, week_of_52, week_start


def weekly(facts: DataFrame, keys: Sequence[str], at: str, **measures: Column) -> DataFrame:
    """One row for each key and Monday with the given aggregates."""
    return facts.groupBy(*keys, week_start(F.col(at)).alias("week")).agg(*[m.alias(n) for n, m in measures.items()])


def monthly(facts: DataFrame, keys: Sequence[str], at: str, **measures: Column) -> DataFrame:
    return facts.groupBy(*keys, month_start(F.col(at)).alias("month")).agg(*[m.alias(n) for n, m in measures.items()])


def attach(spine: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join facts by plain equality of each key, so null keys match nothing."""
    renamed = facts
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & (spine[key] == renamed[f"_{key}"])
    return spine.join(renamed, condition, how).drop(*[f"_{key}" for key in keys])


def attach_monthly(spine: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread the facts of a month over the weeks that start in it."""
    return attach(spine.withColumn("month", month_start(F.col("week"))), facts, [*keys, "month"]).drop("month")


def filled(panel: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Fill gaps in a series from the row before, and at its start from the row after."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # a frame that ends unbounded costs a pass over the rest for each row
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    fills = {c: F.coalesce(F.last(c, True).over(past), F.last(c, True).over(ahead)) for c in columns}
    return panel.withColumns(fills)


def price_relations(panel: DataFrame) -> DataFrame:
    """Prices against the lowest and the featured one, landed price, days of supply, margin and net sentiment.

    A relation is added where its columns are there; a divisor of 0 gives null.
    """
    has = set(panel.columns).issuperset
    c = F.col
    added: dict[str, Column] = {}
    if has({"price", "lowest_price"}):
        added["price_vs_lowest"] = ratio(c("price"), c("lowest_price"))
    if has({"price", "bb_price"}):
        added["price_vs_bb"] = ratio(c("price"), c("bb_price"))
    if has({"price", "own_shipping"}):
        added["own_landed"] = c("price") + F.coalesce(c("own_shipping"), F.lit(0.0))
        if has({"bb_price"}):
            added["landed_vs_bb"] = ratio(added["own_landed"], c("bb_price"))
    if has({"fulfillable", "units"}):
        added["days_of_supply"] = ratio(c("fulfillable") * 7, c("units"))
    if has({"price", "fba_fee", "commission"}):
        added["est_margin"] = c("price") + F.coalesce(c("fba_fee"), F.lit(0.0)) + F.coalesce(c("commission"), F.lit(0.0))
    if has({"positive_share", "negative_share"}):
        added["net_sentiment"] = c("positive_share") - c("negative_share")
    return panel.withColumns(added) if added else panel


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a full order."""
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_place = 1").drop("_place")


def top_levels(rows: DataFrame, keys: Sequence[str], column: str, most: int) -> DataFrame:
    """(keys, column, n, share): the commonest levels of each group, ties in their order, and their shares of all its rows."""
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumns({"share": F.col("n") / F.sum("n").over(group), "_place": F.row_number().over(group.orderBy(F.desc("n"), column))})
    return counts.where(F.col("_place") <= most).drop("_place")


def mapped(rows: DataFrame, column: str, names: Mapping[object, object], to: str) -> DataFrame:
    """Rows with what a fixed map gives for a column; rows that it lacks go."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(to, F.try_element_at(table, F.col(column))).where(F.col(to).isNotNull())


def distinct_ignoring_case(rows: DataFrame, column: str) -> DataFrame:
    """One spelling, the smallest in byte order, of values that agree in lower case; blank ones go."""
    kept = rows.where(F.col(column).isNotNull() & (F.trim(column) != ""))
    return kept.groupBy(F.lower(column).alias("_low")).agg(F.min(column).alias(column)).drop("_low")


def since(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest one."""
    newest = rows.agg(F.max(at).alias("_newest"))
    joined = rows.crossJoin(F.broadcast(newest))  # one row
    return joined.where(F.col(at) >= F.date_sub(F.col("_newest"), days)).drop("_newest")


def seasonal_index(rows: DataFrame, at: str, value: str, least_weeks: int = 26) -> DataFrame:
    """week 1..52 and the mean value in it over the mean of all weeks; empty weeks count as the mean, 1 for all if
    fewer than ``least_weeks`` weeks are known."""
    by_week = rows.groupBy(week_of_52(F.col(at)).alias("week")).agg(F.avg(value).alias("mean"))
    known = by_week.agg(F.count("*").alias("n"), F.avg("mean").alias("whole"))
    weeks = rows.sparkSession.range(1, 53).select(F.col("id").cast("int").alias("week"))
    table = weeks.join(by_week, "week", "left").crossJoin(F.broadcast(known))  # one row
    full = F.coalesce("mean", "whole")
    season = ratio(full, F.avg(full).over(Window.partitionBy()))
    return table.select("week", F.when(F.col("n") >= least_weeks, season).otherwise(F.lit(1.0)).alias("season"))


def dispersion(value: Column) -> Column:
    """Aggregate: the negative-binomial r = m^2 / (v - m); 10 without overdispersion, 1 below eight values."""
    m, v = F.avg(value), F.var_pop(value)
    return F.when(F.count(value) < 8, F.lit(1.0)).when(v <= m, F.lit(10.0)).otherwise(m * m / (v - m))


def coverage(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The share of non-null values of each column, from one pass."""
    columns = list(columns or rows.columns)
    one = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns]))
    return one.select(pairs.alias("p")).select("p.column", "p.share")


def covered_columns(rows: DataFrame, least: float = 0.02, columns: Sequence[str] | None = None) -> list[str]:
    """Columns filled in at least that share of rows; the result has the size of the schema."""
    return [r["column"] for r in coverage(rows, columns).where(F.col("share") >= least).collect()]


def useful_columns(rows: DataFrame, least: float = 0.25, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at least that share of values that are neither null nor a number equal to 0."""
    columns = list(columns or rows.columns)
    zero = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double") == 0, F.lit(False))
    one = rows.agg(*[F.avg((F.col(c).isNotNull() & ~zero(c)).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if one[c] is not None and one[c] >= least]


def informative_columns(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Numeric columns with 50 values or more and five distinct ones, categorical ones with two distinct or more."""
    aggs = [F.count(c).alias(f"n_{c}") for c in numeric] + [F.countDistinct(c).alias(f"d_{c}") for c in [*numeric, *categorical]]
    one = rows.agg(*aggs).first()
    kept = [c for c in numeric if one[f"n_{c}"] >= 50 and one[f"d_{c}"] >= 5]
    return kept + [c for c in categorical if one[f"d_{c}"] >= 2]


def conform(rows: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """The trained columns in the trained order: missing ones are null, others go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema])


def pivot_first(rows: DataFrame, index: str, column: str, values: Sequence[str], measures: Sequence[str], order: str | None = None) -> DataFrame:
    """A wide table ``{value}_{measure}`` with the first non-null of each cell, for a fixed list of values.

    The first is the one with the smallest ``order``; without an order, which is for cells of one row, the smallest value.
    """

    def cell(v: str, m: str) -> Column:
        here = (F.col(column) == v) & F.col(m).isNotNull()
        if order is None:
            return F.min(F.when(here, F.col(m)))
        return F.min(F.when(here, F.struct(F.col(order), F.col(m).alias("_value"))))["_value"]

    cells = [cell(v, m).alias(f"{v}_{m}") for v in values for m in measures]
    return rows.groupBy(index).agg(*cells)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin 1..bins and its count, for equal bins of [low, high] with the right edge in the last one."""
    place = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    inside = rows.where(F.col(value).between(low, high))
    return inside.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are on either side, on both, and on the left alone, and the share that is covered."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    marks = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full")
    both = F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1))
    return marks.agg(
        F.count("_l").alias("n_left"),
        F.count("_r").alias("n_right"),
        both.alias("n_both"),
        (F.count("_l") - both).alias("n_left_only"),
        ratio(both * 100, F.count("_l")).alias("covered_pct"),
    )
