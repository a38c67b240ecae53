"""The weekly rollup as a stream: windows that begin on Mondays, with a watermark for late rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly_stream(rows: DataFrame, at: str, keys: Sequence[str], late: str = "7 days", **measures: Column) -> DataFrame:
    """One row for each key and Monday once the watermark has passed its week; later rows of it are left out.

    The time column is cast to a zoned timestamp first, which watermarks need; epoch weeks begin on Thursdays, so the
    windows start four days in.
    """
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", "7 days", "7 days", "4 days")
    table = timed.groupBy(*keys, window.alias("_w")).agg(*[m.alias(n) for n, m in measures.items()])
    return table.select(*keys, F.to_date("_w.start").alias("week"), *measures)
