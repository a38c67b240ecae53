"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pricewright.session import shared_folder

#: The tables written so far.
_PATHS: list[str] = []
#: Spark deletes a query's shuffle files at its end while this holds.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    The lineage is cut: a lost executor costs a re-read, not a recomputation. The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` has made and nothing will read again; others are left alone."""
    for path in [t.written_to for t in tables if getattr(t, "written_to", None) in _PATHS]:
        _delete(next(t for t in tables if t is not None).sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this process has written, once all results that rest on them have been consumed."""
    while _PATHS:
        _delete(spark, _PATHS[-1])


def _delete(spark: SparkSession, path: str) -> None:
    _PATHS.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lean(least: int = 1 << 20) -> None:
    """Have the C library give every freed block of ``least`` bytes or more back to the system.

    Its own threshold grows with use, after which a worker that has once held large arrays keeps their memory. Blocks
    below it are used again, which spares the system the work of clearing fresh pages.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, which bounds what a Python worker holds as objects at once."""
    lean()
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where a text column reaches ``size`` bytes or ``rows`` rows; a longer text is a block of its own."""
    lean(8 << 20)
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            full = (upto[at - 1] if at else 0) + size
            end = min(max(at + 1, int(np.searchsorted(upto, full, "right"))), at + rows)
            yield batch.slice(at, end - at)
            at = end
