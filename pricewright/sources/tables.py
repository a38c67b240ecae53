"""Scans: driver tables, two-row-header CSV, flat panels, JDBC, lookup of files and JSON sidecars."""

from __future__ import annotations

import datetime
import json
import math
import os
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that a search term may be matched on.
LEVELS = ("Segmentation_level_1", "Segmentation_level_2", "Segmentation_level_3")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_literal(value: object) -> str:
    """A value as a literal that every database reads; what has no plain form is refused."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int) or (isinstance(value, float) and math.isfinite(value)):
        return repr(value)
    if isinstance(value, str) and "\x00" not in value:
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, datetime.date):
        return f"'{value.isoformat()}'"
    raise ValueError(f"no literal for {value!r}")


def bound(query: str, **parameters: object) -> str:
    """A query with each ``:name`` outside quotes replaced by its value as a literal; names without a value are an error."""
    parts = re.split(r"('(?:[^']|'')*')", query)

    def value(match: re.Match) -> str:
        if match[1] not in parameters:
            raise KeyError(f"no value for :{match[1]}")
        return sql_literal(parameters[match[1]])

    return "".join(p if i % 2 else re.sub(r"(?<![:\w]):([A-Za-z_]\w*)", value, p) for i, p in enumerate(parts))


def jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    parameters: Mapping[str, object] | None = None,
    split: tuple[str, int, int, int] | None = None,
    rows: int | None = None,
    **options: str,
) -> DataFrame:
    """A query at a database; filters and column choices of the frame are pushed into it by Spark.

    ``parameters`` are bound to ``:name`` marks. ``split`` is (column, lowest, highest, parts): as many tasks each read a
    range of the column, rows beyond the ends with the outer ranges. ``rows`` bounds the scan, as a limit that the database applies.
    """
    options = {"url": url, "dbtable": f"({bound(query, **(parameters or {}))}) part_of_query", **options}
    if split:
        column, low, high, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    table = spark.read.format("jdbc").options(**options).load()
    return table if rows is None else table.limit(rows)


def two_row_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV whose first two lines are sections and features; columns become ``section__feature``, as strings.

    A blank section repeats the one before. The two lines are left out by their place, the start of the first file in
    order of names, so data lines equal to them stay. ``rows`` bounds the scan.
    """
    plain = spark.read.option("header", False).csv(path)
    files = sorted(plain.inputFiles())
    first = next((f for f in files if not os.path.basename(f).startswith(("_", "."))), None)
    head = [list(r) for r in spark.read.option("header", False).csv(first).limit(2).collect()] if first else []
    if len(head) < 2:
        raise ValueError(f"{path} has no two header rows")
    section, names = "", []
    for top, feature in zip(*head, strict=True):
        section = top if top else section
        names.append(f"{section}__{feature}")
    seen: dict[str, int] = {}
    unique = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}.{seen[n] - 1}")
    schema = ", ".join(f"`_c{i}` string" for i in range(len(unique)))
    data = spark.read.option("header", False).schema(schema).csv(path)
    place = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")  # local paths come with one slash or three
    starts = (place == re.sub("^file:/+", "file:/", first)) & (F.col("_metadata.file_block_start") == 0)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = 2  # the first block is one task's, in order; no other task has rows here
        for batch in batches:
            skip = min(left, batch.num_rows)
            left -= skip
            yield batch.slice(skip)

    opening = data.where(starts).mapInArrow(rest, schema)
    whole = opening.unionByName(data.where(~starts)).toDF(*unique)
    return whole if rows is None else whole.limit(rows)


def feature_name(column: str) -> str:
    """The bare feature of a two-level or suffixed column name."""
    return column.split("__")[-1].split(".")[0]


def panel_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def estimated_rows(total_bytes: int, sample_bytes: int, sample_rows: int, budget_bytes: int) -> int:
    """How many rows fit a budget of bytes, by the mean row of a sample; never more than the file seems to hold."""
    if sample_rows <= 0 or sample_bytes <= 0:
        return 0
    per_row = sample_bytes / sample_rows
    return int(min(total_bytes, budget_bytes) // per_row)


def keys_of(rows: DataFrame, column: str) -> DataFrame:
    """Distinct keys, trimmed, without blank ones."""
    value = F.trim(F.col(column).cast("string"))
    return rows.select(value.alias(column)).where(F.col(column) != "").distinct()


def find_dataset(spark: SparkSession, folder: str, term: str, suffix: str = "") -> str | None:
    """The first path, in order, whose name has the term in it; any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*{term}*{suffix}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found or [])
    return names[0] if names else None


def json_sidecar(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A small JSON document, or the default where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return dict(default or {})
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def union_of(frames: Iterable[DataFrame]) -> DataFrame:
    """Frames one under another by column name; columns that one lacks are null."""
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def matching(rows: DataFrame, column: str, term: str, allowed: Sequence[str] = LEVELS) -> DataFrame:
    """Rows whose column holds the term, in any case; only listed columns may be searched."""
    if column not in allowed:
        raise ValueError(f"{column!r} is not one of {', '.join(allowed)}")
    safe = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.where(F.col(column).ilike(f"%{safe}%"))


def database_options(spark: SparkSession, name: str = "API_DATABASE_URL", path: str = ".env", timeout: int = 20) -> dict[str, str]:
    """Options of ``jdbc`` from an environment variable, or else from a line ``NAME=value`` of a settings file."""
    url = os.environ.get(name)
    if not url:
        lines = (r[0] for r in spark.read.text(path).where(F.trim("value").startswith(name)).limit(1).collect())
        found = next(lines, None)
        if found is None:
            raise KeyError(f"{name} is neither in the environment nor in {path}")
        url = found.split("=", 1)[1].strip().strip("\"'")
    return {"url": url if url.startswith("jdbc:") else f"jdbc:{url}", "connectTimeout": str(timeout)}
