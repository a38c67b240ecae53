"""Nearest-in-time joins that cost one sort of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(
    left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], sequence: str
) -> DataFrame:
    """Add to each left row the values of the right row with the same keys that is nearest in time.

    An equal distance goes to the earlier row. Of right rows at one time, looking back takes the last by ``sequence``
    and looking ahead the first. Both sides are put into one series, and two running windows find the candidates, so a
    key costs a sort of its rows and not a product of them. Left rows without a match keep nulls.
    """
    kept = [c for c in left.columns if c not in by and c != on]
    carried = F.struct(F.col(on).alias("at"), *[F.col(v) for v in values])
    blank = F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)
    lefts = left.select(
        *by, F.col(on), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"),
        F.struct(*kept).alias("_kept") if kept else F.lit(None).alias("_kept"), blank.alias("_row"),
    )
    nothing = F.lit(None).cast(lefts.schema["_kept"].dataType)
    rights = right.select(
        *by, F.col(on), F.lit(0).alias("_side"), F.col(sequence).cast("long").alias("_seq"), nothing.alias("_kept"),
        carried.alias("_row"),
    )
    series = lefts.unionByName(rights)
    back = Window.partitionBy(*by).orderBy(on, "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    # the order turned round, since Spark goes through all the rest again for each row of a frame that ends unbounded
    ahead = Window.partitionBy(*by).orderBy(F.desc(on), "_side", F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    series = series.withColumn("_back", F.last("_row", True).over(back))
    series = series.withColumn("_next", F.last("_row", True).over(ahead)).where("_side = 1")
    since = F.col(on).cast("timestamp").cast("double") - F.col("_back.at").cast("timestamp").cast("double")
    until = F.col("_next.at").cast("timestamp").cast("double") - F.col(on).cast("timestamp").cast("double")
    earlier = F.col("_back").isNotNull() & (F.col("_next").isNull() | (since <= until))
    chosen = F.when(earlier, F.col("_back")).otherwise(F.col("_next"))
    return series.withColumn("_chosen", chosen).select(
        *by, on, *[F.col(f"_kept.{c}").alias(c) for c in kept],
        F.col("_chosen.at").alias(f"{on}_matched"), *[F.col(f"_chosen.{v}").alias(v) for v in values],
    )
