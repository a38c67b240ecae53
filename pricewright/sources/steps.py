"""Tables between the steps of an iteration, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pricewright.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return a reader of it, which cuts the lineage: a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` has made and nothing reads again; others are left alone."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            table.stored_at = None
