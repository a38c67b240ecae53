"""Sinks: panels, two-row-header CSV, review tables, JSON sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_panel(panel: DataFrame, path: str, by: str | None = None) -> None:
    writer = panel.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_two_row_csv(wide: DataFrame, path: str) -> None:
    """Columns ``section__feature`` as CSV with a line of sections and a line of features on top.

    The header lines and the rows are sorted by a place column into one ordered output; each part file but the first
    starts with data.
    """
    names = wide.columns
    sections = [n.split("__")[0] if "__" in n else "" for n in names]
    features = [n.split("__", 1)[-1] for n in names]
    spark = wide.sparkSession
    text = wide.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    head = spark.createDataFrame([(0, *sections), (1, *features)], ["_place", *text.columns])
    rows = head.unionByName(text.withColumn("_place", F.lit(2).cast("long"))).orderBy("_place")
    rows.drop("_place").write.mode("overwrite").option("header", False).csv(path)


def write_labels(rows: DataFrame, labels: DataFrame, key: str, community: str, path: str) -> None:
    """Rows with their community, in its order."""
    rows.join(labels, key).orderBy(community, key).write.mode("overwrite").option("header", True).csv(path)


def review_table(clusters: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    """(cluster, place, column): column clusters as a long table for review."""
    rows = [(c, i, n) for c, names in sorted(clusters.items()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "cluster string, place int, column string")


def write_json(value: dict, spark: SparkSession, path: str) -> None:
    """A small JSON document, in any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    finally:
        out.close()
