"""Seeded samples and splits by keyed hashes, so that they don't depend on how the rows are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_hash(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))


def undersampled(rows: DataFrame, positive: Column, key: str, seed: str) -> DataFrame:
    """All positive rows and as many of the others, those with the smallest hashes.

    The others are cut at a hash bound found from counts by hash prefix, and only the rows that share the prefix of the
    cut are put in order, so no task sorts the majority.
    """
    marked = rows.withColumn("_positive", positive).withColumn("_hash", keyed_hash(key, seed))
    need = marked.where("_positive").agg(F.count("*").alias("_need"))
    others = marked.where("not _positive").withColumn("_prefix", F.substring("_hash", 1, 3))
    counts = others.groupBy("_prefix").agg(F.count("*").alias("_n"))  # at most 4096 rows
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).crossJoin(F.broadcast(need))
    counts = counts.where("_before < _need")
    placed = others.join(F.broadcast(counts), "_prefix")
    order = Window.partitionBy("_prefix").orderBy("_hash", key)
    placed = placed.withColumn("_place", F.col("_before") + F.row_number().over(order)).where("_place <= _need")
    return marked.where("_positive").select(*rows.columns).unionByName(placed.select(*rows.columns))


def stratified(rows: DataFrame, stratum: str, key: str, fraction: float, seed: str) -> DataFrame:
    """Add train: the given fraction of each stratum, rounded up, by smallest hashes.

    Counts by hash prefix say in which prefix a stratum's cut lies; only the rows with that prefix are put in order.
    """
    marked = rows.withColumn("_hash", keyed_hash(key, seed)).withColumn("_prefix", F.substring("_hash", 1, 3))
    counts = marked.groupBy(stratum, "_prefix").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(stratum).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)  # 4096 prefixes
    need = F.ceil(F.lit(fraction) * F.sum("_n").over(Window.partitionBy(stratum)))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0))).withColumn("_need", need)
    cuts = counts.where("_before < _need").groupBy(F.col(stratum).alias("_stratum"))
    cuts = cuts.agg(F.max(F.struct("_prefix", "_before", "_need")).alias("_cut"))
    joined = marked.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    there = F.coalesce(F.col("_prefix") == F.col("_cut._prefix"), F.lit(False))
    apart = joined.where(~there).withColumn("train", F.coalesce(F.col("_prefix") < F.col("_cut._prefix"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_hash", key))
    edge = joined.where(there).withColumn("train", F.col("_cut._before") + place <= F.col("_cut._need"))
    return apart.unionByName(edge).select(*rows.columns, "train")


def split(rows: DataFrame, key: str, holdout: float, seed: str = "0") -> DataFrame:
    """Add train by a hash of the key alone."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000))
    return rows.withColumn("train", bucket >= int(holdout * 10_000))
