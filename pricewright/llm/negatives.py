"""Hard negatives by bit-sliced integer products.

Vectors become whole numbers, and the components of candidates are taken apart into bit-planes in two's complement. A score is
the anchor's product with the planes, most significant first: after each plane it lies between what the planes so far give
plus the remaining bits times the anchor's negative components, and the same with its positive ones. Candidates whose interval can no longer
qualify go, and once few are left only theirs are tightened further; the last plane makes intervals exact scores.

Two searches use that. The first finds each anchor's best rows of its own label, where a candidate goes when as many as wanted
surely score more. The second finds, for each of these positives, the best rows of other labels within a window below its
score, where a candidate goes when it surely lies outside all of the anchor's windows, or when as many as wanted that surely lie inside
all of them surely score more.

Rows and anchors are dealt into blocks by a hash of their place in a written table, so labels and ids of many rows make no
task longer, and each block of rows meets each block of anchors in one task of bounded size. A task hands out no more than the
best of its rows for each anchor.

Defined cases: rows with a null label, no vec_id, a null or empty vector, a null or non-finite component, another length than
most, or a component too large for exact scores (2^24 on the grid for 64 dimensions) take no part; rows that repeat a vec_id, exact copies too,
are rows of their own, each an anchor and each a candidate of all but itself; ties go to the smaller vec_id; a positive that
scores below zero has an empty window and gives no rows, one that scores zero takes negatives of zero; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.scratch import written

#: A component c becomes floor(GRID * c).
GRID = 256
#: Positives of an anchor, and negatives of each positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores at least and at most so many hundredths of the positive.
LEAST, MOST = 50, 95
#: Components of the rows, and of the anchors, that one task holds.
CELLS = 1 << 21
#: Small tables are dealt into blocks of so many rows, up to so many blocks.
ROWS, BLOCKS = 1024, 64
#: Pairs of an anchor and a row held at once, and the share of them that may stay when only those are tightened further.
PAIRS, FEW = 1 << 20, 0.08


def planes_of(x: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(weight, largest value of the bits below, plane) of whole numbers in two's complement, most significant plane first."""
    width = 1
    while x.size and not (-(1 << (width - 1)) <= x.min() and x.max() < 1 << (width - 1)):
        width += 1
    out = []
    for bit in range(width - 1, -1, -1):
        weight = -(1 << bit) if bit == width - 1 else 1 << bit
        out.append((weight, (1 << bit) - 1, ((x >> bit) & 1).astype(np.uint8)))
    return out


def firsts(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of each owner, best first, ties to smaller ids."""
    order = np.lexsort((ids, -scores, owner))
    sorted_owner = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner) < k]


def _kth(owner: np.ndarray, values: np.ndarray, k: int, owners: int) -> np.ndarray:
    """The k-th largest value of each owner, minus infinity where it has fewer."""
    order = np.lexsort((-values, owner))
    sorted_owner = owner[order]
    last = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner) == k - 1
    out = np.full(owners, -np.inf)
    out[sorted_owner[last]] = values[order[last]]
    return out


def qualifying(anchors: np.ndarray, planes: list, barred: np.ndarray, k: int, windows: np.ndarray | None = None):
    """(anchor, row, score) of the pairs whose exact score can be among the best ``k``, and perhaps others.

    ``barred`` marks pairs that may not meet. ``windows`` has (least, most) for each anchor and window, empty ones as (1, 0);
    without it all scores qualify.
    """
    some, count = anchors.shape[0], barred.shape[1]
    kind = np.float32 if np.abs(anchors).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    left = anchors.astype(kind)
    up, down = np.maximum(anchors, 0).sum(axis=1).astype(float), np.minimum(anchors, 0).sum(axis=1).astype(float)
    if windows is None:
        floor, roof, inner = np.full(some, -np.inf), np.full(some, np.inf), (np.full(some, -np.inf), np.full(some, np.inf))
    else:
        real = windows[:, :, 0] <= windows[:, :, 1]
        low, high = windows[:, :, 0].astype(float), windows[:, :, 1].astype(float)
        floor, roof = np.where(real, low, np.inf).min(axis=1), np.where(real, high, -np.inf).max(axis=1)
        inner = np.where(real, low, -np.inf).max(axis=1), np.where(real, high, np.inf).min(axis=1)
    part = np.zeros((some, count))
    part[barred] = -np.inf
    owner = row = None
    for weight, rest, plane in planes:
        if owner is None:
            part += weight * (left @ plane.T.astype(kind))
            who = np.arange(some)[:, None]
        else:
            for i in range(0, len(owner), 1 << 16):
                at = slice(i, i + (1 << 16))
                part[at] += weight * np.einsum("ij,ij->i", left[owner[at]], plane[row[at]].astype(kind))
            who = owner
        # part + rest * down <= score <= part + rest * up
        sure = part if windows is None else np.where(
            (part >= (inner[0] - rest * down)[who]) & (part <= (inner[1] - rest * up)[who]), part, -np.inf
        )
        if owner is not None:
            reached = _kth(owner, sure, k, some)
        else:
            reached = np.partition(sure, count - k, axis=1)[:, count - k] if count >= k else np.full(some, -np.inf)
        floor = np.maximum(floor, reached + rest * down)
        stay = (part >= (floor - rest * up)[who]) & (part <= (roof - rest * down)[who]) & (part > -np.inf)
        if owner is not None:
            owner, row, part = owner[stay], row[stay], part[stay]
        elif np.count_nonzero(stay) <= FEW * stay.size or rest == 0:
            owner, row = np.nonzero(stay)
            part = part[stay]
    return owner, row, part.astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(whole), -1)


FOUND = "anchor long, goal long, vec_id long, score long"


def _found(columns: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "goal", "vec_id", "score"])


def _joined(parts: list[list[np.ndarray]]) -> pa.Table:
    return _found([np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 4)


def _positives(k: int):
    """The best ``k`` rows of its own label for each anchor, among one block of rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _joined([])
        label = rows["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        label, ids, place = label[order], rows["vec_id"].to_numpy()[order], rows["place"].to_numpy()[order]
        planes = [(w, rest, plane[order]) for w, rest, plane in planes_of(_matrix(rows["x"]))]
        wanted, own, x = anchors["label"].to_numpy(), anchors["place"].to_numpy(), _matrix(anchors["x"])
        parts = []
        for kind in np.intersect1d(label, wanted):
            a, b = np.searchsorted(label, kind), np.searchsorted(label, kind, "right")
            mine, those = np.flatnonzero(wanted == kind), [(w, rest, plane[a:b]) for w, rest, plane in planes]
            step = max(1, PAIRS // (b - a))
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                owner, row, score = qualifying(x[some], those, own[some][:, None] == place[None, a:b], k)
                best = firsts(owner, score, ids[a + row], k)
                parts.append([own[some[owner[best]]], np.zeros(len(best), np.int64), ids[a + row[best]], score[best]])
        return _joined(parts)

    return run


def window_of(score: np.ndarray, least: int, most: int) -> np.ndarray:
    """(least, most) of the whole scores of negatives for each positive's score; (1, 0) where there are none."""
    low, high = -((-least * score) // 100), (most * score) // 100
    return np.stack([np.where(low <= high, low, 1), np.where(low <= high, high, 0)], axis=-1)


def _negatives(k: int, least: int, most: int):
    """The best ``k`` rows of other labels within the window of each of an anchor's goals, among one block of rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _joined([])
        label, ids, planes = rows["label"].to_numpy(), rows["vec_id"].to_numpy(), planes_of(_matrix(rows["x"]))
        mine, own, x = anchors["label"].to_numpy(), anchors["place"].to_numpy(), _matrix(anchors["x"])
        goals = anchors["goals"].to_pylist()
        wide = max(map(len, goals))
        goal = np.array([g + [-1] * (wide - len(g)) for g in goals], np.int64)  # below zero: an empty window
        windows = window_of(goal, least, most)
        parts, step = [], max(1, PAIRS // len(ids))
        for i in range(0, len(own), step):
            some = slice(i, i + step)
            owner, row, score = qualifying(x[some], planes, mine[some][:, None] == label[None, :], k, windows[some])
            for w in range(wide):
                inside = windows[some][owner, w]
                at = np.flatnonzero((inside[:, 0] <= score) & (score <= inside[:, 1]))
                best = at[firsts(owner[at], score[at], ids[row[at]], k)]
                parts.append([own[some][owner[best]], goal[some][owner[best], w], ids[row[best]], score[best]])
        return _joined(parts)

    return run


def whole(vectors: DataFrame, label: Column, column: str = "embedding") -> DataFrame:
    """(place, vec_id, label, x) of the rows that take part, as a written table; x holds whole numbers."""
    rows = vectors.select("vec_id", label.cast("long").alias("label"), F.col(column).alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = rows.where((F.size("x") > 0) & ~odd)
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 1
    bits = (55 - (size - 1).bit_length()) // 2  # a hundred times a sum of so many products fits a long
    large = F.exists("x", lambda v: F.abs(v.cast("double")) * GRID >= float(1 << bits))
    rows = rows.where((F.size("x") == size) & ~large)
    x = F.transform("x", lambda v: F.floor(v.cast("double") * GRID).cast("int"))
    return written(rows.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", x.alias("x")), "whole-vectors")


def _met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], run) -> DataFrame:
    """What ``run`` finds in each block of rows for each block of anchors."""
    numbers = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
    dealt = [F.pmod(F.xxhash64("place"), F.lit(n)).cast("int") for n in blocks]
    left = rows.withColumns({"block": dealt[0], "group": numbers[1]})
    right = anchors.withColumns({"group": dealt[1], "block": numbers[0]})
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` holds for."""
    if not 0 <= least <= most:
        raise ValueError("least must lie between 0 and most")
    rows = whole(vectors, label, column)
    asking = rows.where(anchors)
    n, cells, asked = rows.agg(F.count("*"), F.sum(F.size("x")), F.count_if(anchors)).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], RESULT)
    blocks = max(-(-cells // CELLS), min(BLOCKS, -(-n // ROWS))), -(-asked * cells // (n * CELLS))
    best = _best(_met(rows, asking, blocks, _positives(positives)), positives)
    best = written(best.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal")), "positives")
    goals = best.where("goal >= 0").groupBy("anchor").agg(F.collect_set("goal").alias("goals"))  # ``positives`` at most
    goals = asking.join(goals.withColumnRenamed("anchor", "place"), "place")
    found = _best(_met(rows, goals, blocks, _negatives(negatives, least, most)), negatives)
    named = best.join(asking.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(found, ["anchor", "goal"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op12_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


OP12_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scored AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, a.label = r.label AS same, r.place, r.vec_id,
         CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.vec_id % 50 = 0 AND a.place <> r.place),
positives AS (
  SELECT anchor, anchor_id, place AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
