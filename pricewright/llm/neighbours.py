"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split by 2-means until every part is small, which gives centroids of balanced lists. A graph over the
centroids, held in memory, finds the nearest ones of any vector. Each vector goes to its nearest list, and a vector near
a border also to others: those within a distance ratio, unless their centroid nearly coincides with one it already has.
A query reads the lists within a distance ratio of its nearest centroid, and of them a certain number at most; the fit finds
the true neighbours of ``TRIALS`` sampled vectors in the whole table and chooses the pair of limits that reaches ``RECALL``
on them with the fewest lists. A list holds about a
quarter of the root of the number of vectors, so there are more lists and longer ones as the table grows. Lists that grow
large are cut into slices, each searched on its own, so a hot list costs more tasks and not longer ones; queries are dealt
into blocks, so that no task holds more of them than fit.

Nearness is the largest inner product. It becomes the smallest distance once each vector gets one more component that
lifts it to the largest norm in the table, so the lists serve vectors of any norms. Scores are exact inner products of
the original vectors in double precision.

Bounds: the fit reads at most ``SAMPLE`` vectors, and so the broadcast model holds at most a quarter as many centroids, the
number that about 1.5 million vectors ask for; beyond that lists grow in proportion to the table, in more slices.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part, nor do rows without a vec_id; rows that repeat a vec_id count as one candidate with its best score, and none of
them is a candidate of its own query; with fewer candidates than asked for, all found are returned; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.scratch import sliced, written

SAMPLE = 20_000
#: A list has at least so many vectors, and at least this share of the root of their number.
LIST_ROWS, ROOT_SHARE = 24, 0.25
#: Sampled vectors for each list at least.
PER_LIST = 4
#: Rows of a list searched in one task.
SLICE = 4096
#: Rows of lists, on average, and queries that one task holds.
SHARD, QUERIES = 65_536, 32_768
#: Above the slices of any list.
PARTS = 1 << 32
#: A vector is copied to lists at most this much farther than its nearest, and to this many in all.
COPY_RATIO, COPIES = 1.2, 4
#: A copy needs a centroid that is this share of its distance away from those of the lists it is in.
SPREAD = 0.25
#: The recall that the fit asks for, and from how many sampled queries it measures it.
RECALL, TRIALS = 0.96, 256
#: Rounds in which centroids move to the means of their vectors.
LLOYD = 6
#: Rows of a matrix of distances to all centroids that are held at once.
ROWS = 1024
#: Links of a centroid, centroids kept and opened in a step of the walk, and where it starts.
LINKS, BEAM, OPENED, ENTRIES = 24, 24, 4, 32


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _apart(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centroids."""
    return np.maximum(_norms(x)[:, None] + _norms(centroids)[None, :] - 2 * x @ centroids.T, 0)


def split_balanced(x: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Centroids of about ``parts`` parts of near-equal size, by 2-means on the largest part again and again."""
    rng = np.random.default_rng(seed)
    limit = max(1, -(-len(x) // max(parts, 1)))
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= limit:
            done.append(rows)
            continue
        part = x[rows]
        a, b = part[rng.integers(len(rows))], part[rng.integers(len(rows))]
        side = None
        for _ in range(8):
            lean = part @ (b - a) - (b @ b - a @ a) / 2
            # the median split keeps the two halves within a quarter of each other
            cut = np.clip(0.0, *np.quantile(lean, [0.375, 0.625]))
            new = lean > cut
            if side is not None and (new == side).all():
                break
            side = new
            if not new.any() or new.all():
                break
            a, b = part[~new].mean(0), part[new].mean(0)
        if side is None or not side.any() or side.all():
            done.append(rows)
            continue
        todo += [rows[~side], rows[side]]
    return np.array([x[rows].mean(0) for rows in done])


@dataclass
class Index:
    """Centroids, the graph over them, and the largest squared norm that vectors are lifted to."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    top: float
    ratio: float = 1.0
    reads: int = 1

    @staticmethod
    def build(sample: np.ndarray, lists: int, top: float) -> Index:
        lifted = lift(sample, top)
        centroids = split_balanced(lifted, lists)
        for _ in range(LLOYD):
            nearest = np.concatenate([_apart(lifted[i : i + ROWS], centroids).argmin(1) for i in range(0, len(lifted), ROWS)])
            sums = np.zeros_like(centroids)
            np.add.at(sums, nearest, lifted)
            count = np.bincount(nearest, minlength=len(centroids))
            centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
        width = min(LINKS, len(centroids))
        links = [
            np.argpartition(_apart(centroids[i : i + ROWS], centroids), width - 1, axis=1)[:, :width]
            for i in range(0, len(centroids), ROWS)
        ]
        links = np.concatenate(links)
        entries, reach = [0], _apart(centroids[:1], centroids)[0]
        while len(entries) < min(ENTRIES, len(centroids)):
            entries.append(int(np.argmax(reach)))
            reach = np.minimum(reach, _apart(centroids[entries[-1:]], centroids)[0])
        return Index(centroids, links, np.array(entries), top)

    def reach(self, queries: np.ndarray, owner: np.ndarray, near: np.ndarray) -> None:
        """Set the limits by trial queries and their true neighbours ``near``, each with the number of its query."""
        ratios = np.sqrt(_apart(lift(queries, self.top), self.centroids))
        ratios /= np.maximum(ratios.min(1, keepdims=True), 1e-12)
        place = ratios.argsort(1, kind="stable").argsort(1, kind="stable")
        ordered = np.sort(ratios, axis=1)
        needed = []
        for i in range(0, len(near), ROWS):
            for j, lists in enumerate(self.lists_of(near[i : i + ROWS])):
                best = lists[place[owner[i + j], lists].argmin()]
                needed.append((place[owner[i + j], best] + 1, ratios[owner[i + j], best]))
        places, ratio = (np.array(c) for c in zip(*needed, strict=True))
        most, best = int(np.ceil(RECALL * len(places))), (np.inf, 0, 0.0)
        for limit in np.unique(np.quantile(places, np.linspace(RECALL, 1, 9), method="higher")).tolist():
            within = np.sort(ratio[places <= limit])
            if len(within) >= most:
                bound = within[most - 1] * (1 + 1e-9)
                read = float(np.minimum((ordered <= bound).sum(1), limit).mean())
                best = min(best, (read, int(limit), float(bound)))
        _, self.reads, self.ratio = best

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and squared distances of about the ``width`` nearest centroids, nearest first, by a walk over the graph."""
        n, k = len(x), len(self.centroids)
        width = min(max(width, 1), k)
        squares = _norms(self.centroids)
        own = _norms(x)

        def distance(nodes: np.ndarray) -> np.ndarray:
            return np.maximum(own[:, None] + squares[nodes] - 2 * np.einsum("nd,nkd->nk", x, self.centroids[nodes]), 0)

        nodes = np.tile(self.entries, (n, 1))
        apart = distance(nodes)
        beam = min(max(BEAM, width + OPENED), k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        seen[rows, nodes] = True
        opened = np.zeros(nodes.shape, bool)
        while True:
            step = min(OPENED, nodes.shape[1])
            open_apart = np.where(opened, np.inf, apart)
            best = np.argpartition(open_apart, step - 1, axis=1)[:, :step]
            last = min(width, apart.shape[1]) - 1
            worst = np.partition(apart, last, axis=1)[:, last] if apart.shape[1] >= width else np.full(n, np.inf)
            active = np.take_along_axis(open_apart, best, 1) <= np.minimum(worst, 1e300)[:, None]
            if not active.any():
                break
            opened[rows, best] |= active
            fresh = np.sort(np.where(active[:, :, None], self.links[nodes[rows, best]], k).reshape(n, -1), axis=1)
            new = (fresh < k) & np.concatenate([np.ones((n, 1), bool), fresh[:, 1:] != fresh[:, :-1]], axis=1)
            fresh = np.where(new, fresh, 0)
            new &= ~seen[rows, fresh]
            seen[np.broadcast_to(rows, fresh.shape)[new], fresh[new]] = True
            far = np.where(new, distance(fresh), np.inf)
            nodes, apart, opened = np.c_[nodes, fresh], np.c_[apart, far], np.c_[opened, ~new]
            if nodes.shape[1] > beam:
                keep = np.argpartition(apart, beam - 1, axis=1)[:, :beam]
                nodes, apart = np.take_along_axis(nodes, keep, 1), np.take_along_axis(apart, keep, 1)
                opened = np.take_along_axis(opened, keep, 1)
        order = np.argsort(apart, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(apart, order, 1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector."""
        near, apart = self.search(lift(x, self.top), 2 * COPIES)
        close = self.centroids[near]
        squares = np.einsum("nid,nid->ni", close, close)
        between = squares[:, :, None] + squares[:, None, :] - 2 * close @ close.transpose(0, 2, 1)
        chosen = np.zeros(near.shape, bool)
        chosen[:, 0] = True
        for j in range(1, near.shape[1]):
            spread = (between[:, j] > SPREAD**2 * apart[:, j, None]) | ~chosen
            chosen[:, j] = (apart[:, j] <= COPY_RATIO**2 * apart[:, 0]) & (chosen.sum(1) < COPIES) & spread.all(1)
        return [lists[take] for lists, take in zip(near, chosen, strict=True)]

    def lists_for(self, x: np.ndarray, rows: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """The lists that each query reads: those within the ratio, and further ones while these have under ``least`` rows."""
        rows = np.full(len(self.centroids), least) if rows is None else rows
        width = self.reads
        while True:
            near, apart = self.search(lift(x, self.top), width)
            upto = np.cumsum(rows[near], axis=1)
            if width >= len(self.centroids) or (upto[:, -1] >= least).all():
                break
            width *= 4
        short = np.c_[np.zeros(len(x), np.int64), upto[:, :-1]] < least
        inside = apart <= self.ratio**2 * apart[:, :1] + 1e-12
        return [lists[take] for lists, take in zip(near, short | inside, strict=True)]


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, which gives each the squared norm ``top``."""
    return np.c_[x, np.sqrt(np.maximum(top - _norms(x), 0))]


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = vectors.where("vec_id is not null").where(_usable(F.col("embedding"))).select("vec_id", "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["size"] if sizes else 0))


def fit(rows: DataFrame, k: int = 20) -> Index | None:
    """An index from a bounded sample: the rows with the smallest hashes of their vec_id."""
    top = F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    total, largest = rows.agg(F.count("*"), top).first()
    if not total:
        return None
    place = F.xxhash64(F.lit("index"), F.col("vec_id"))
    picked = rows.select(place.alias("place"), "vec_id", "embedding").orderBy("place", "vec_id").limit(SAMPLE).toPandas()
    sample, ids = np.array(picked["embedding"].tolist(), float), picked["vec_id"].to_numpy()
    index = Index.build(sample, min(lists_of_rows(total), max(1, len(sample) // PER_LIST)), float(largest))
    trials = slice(0, TRIALS)  # the sample is in the order of a hash
    owner, near = _neighbours_of(rows, ids[trials], sample[trials], k)
    if len(near):
        index.reach(sample[trials], owner, near)
    return index


def _neighbours_of(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` true neighbours of each of a few queries in the whole table: the number of the query, and the vector.

    Each task hands out the best of its rows, and only the vectors of the best of all are fetched, in a second pass.
    """
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in sliced(batches, 2048):
            found = nearest_in(_matrix(batch.column(1)), batch.column(0).to_numpy(), q, own, k)
            held = list(best_of(*[np.concatenate(c) for c in zip(held, found, strict=True)], k))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (held[0], held[1], -held[2])], ["query", "vec_id", "away"])

    best = rows.mapInArrow(run, "query long, vec_id long, away double").groupBy("query", "vec_id").agg(F.min("away").alias("away"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("away", "vec_id"))
    best = best.withColumn("place", place).where(F.col("place") <= k).select("query", "vec_id").toPandas()
    wanted = rows.sparkSession.createDataFrame(best[["vec_id"]].drop_duplicates(), "vec_id long")  # at most TRIALS * k rows
    found = rows.join(F.broadcast(wanted), "vec_id", "left_semi").dropDuplicates(["vec_id"]).toPandas()
    vectors = dict(zip(found["vec_id"], found["embedding"], strict=True))
    near = np.array([vectors[v] for v in best["vec_id"]], float).reshape(len(best), -1)
    return best["query"].to_numpy(), near


def lists_of_rows(total: int) -> int:
    """The number of lists for so many vectors."""
    return max(1, int(total // max(LIST_ROWS, ROOT_SHARE * total**0.5)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _held(rows: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, embedding): each vector in its lists."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = shared.value.lists_of(_matrix(batch.column(1)))
            take = pa.array(np.repeat(np.arange(len(lists)), [len(c) for c in lists]))
            homes = pa.array(np.concatenate(lists).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [homes, *[c.take(take) for c in batch.columns]], ["list", "vec_id", "embedding"]
            )

    return rows.mapInArrow(run, f"list int, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")


def shard_of(lists: np.ndarray, slices: np.ndarray, shards: int) -> np.ndarray:
    """The task that searches a slice of a list."""
    return (lists * 7919 + slices * 104729) % shards


def _asked(rows: DataFrame, index: Index, sizes: dict[int, int], slices: dict[int, int], shards: int, k: int) -> DataFrame:
    """(shard, vec_id, embedding, parts): each query once for each shard that has parts of its lists."""
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    shared = rows.sparkSession.sparkContext.broadcast((index, held, slices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, slices = shared.value
        for batch in sliced(batches):
            place, shard, parts = [], [], []
            # each row may be in COPIES lists, and one is the query itself
            for i, lists in enumerate(index.lists_for(_matrix(batch.column(1)), held, COPIES * (k + 1))):
                counts = np.array([slices.get(int(c), 0) for c in lists])
                whole = np.repeat(lists, counts)
                part = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                task, code = shard_of(whole, part, shards), whole * PARTS + part
                for t in np.unique(task).tolist():
                    place.append(i)
                    shard.append(t)
                    parts.append(code[task == t])
            take = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), *[c.take(take) for c in batch.columns], pa.array(parts, pa.list_(pa.int64()))],
                ["shard", "vec_id", "embedding", "parts"],
            )

    vector = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"shard int, vec_id long, embedding {vector}, parts array<long>")


def nearest_in(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(index of query, id, score) of the best ``k`` rows of each query and all that tie with them, its own id left out.

    A product of matrices picks the rows that can be among the best; their scores are then summed in one fixed order, so
    that equal vectors get equal scores.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width = min(k + 12, len(x))
    for i in range(0, len(q), 128):
        part, mine = q[i : i + 128], own[i : i + 128]
        rough = part @ x.T
        rough[mine[:, None] == ids[None, :]] = -np.inf
        near = np.argpartition(rough, len(x) - width, axis=1)[:, len(x) - width :] if width < len(x) else np.tile(np.arange(width), (len(part), 1))
        values = np.take_along_axis(rough, near, 1)
        if width < len(x):
            ordered = np.sort(values, axis=1)
            tied = ordered[:, 0] >= ordered[:, width - k] - 1e-9 * np.maximum(1.0, np.abs(ordered[:, width - k]))
        else:
            tied = np.zeros(len(part), bool)
        row = np.repeat(np.flatnonzero(~tied), width)
        column = near[~tied].reshape(-1)
        for j in np.flatnonzero(tied).tolist():
            least = np.partition(rough[j], len(x) - k)[len(x) - k]
            more = np.flatnonzero(rough[j] >= least - 1e-9 * max(1.0, abs(least)))
            row, column = np.r_[row, np.full(len(more), j)], np.r_[column, more]
        real = np.isfinite(rough[row, column])
        row, column = row[real], column[real]
        found.append((row + i, ids[column], (x[column] * part[row]).sum(axis=1)))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` of each query, each id once with its best score, ties to smaller ids."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])]) if len(query) else np.zeros(0, bool)
    query, ids, scores = query[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], scores[place < k]


FOUND = "query_id long, vec_id long, away double"


def _search(k: int):
    """The best ``k`` of each query in one shard.

    A product of matrices scores each list roughly. A list with ``k`` distinct ids bounds the query's k-th best score from
    below, and only rows that reach the bound are scored in one fixed order and kept.
    """

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "away": pa.array([], pa.float64())})
        code, ids, x = rows["code"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
        order = np.argsort(code, kind="stable")
        code, ids, x = code[order], ids[order], x[order]
        own, q, parts = queries["vec_id"].to_numpy(), _matrix(queries["embedding"]), queries["parts"].combine_chunks()
        sizes = parts.value_lengths().to_numpy(zero_copy_only=False)
        wanted, reader = parts.flatten().to_numpy(), np.repeat(np.arange(len(own)), sizes)
        by_code = np.argsort(wanted, kind="stable")
        wanted, reader = wanted[by_code], reader[by_code]
        least = np.full(len(own), -np.inf)
        slack = lambda bound: bound - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(bound), bound, 0)))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        fresh: list[tuple[np.ndarray, ...]] = []
        size = 0

        def settled() -> tuple[np.ndarray, ...]:
            if not fresh:
                return held
            query, row, rough = (np.concatenate(c) for c in zip(*fresh, strict=True))
            near = rough >= slack(least[query])
            query, row = query[near], row[near]
            scores = np.concatenate([np.zeros(0), *((x[row[i : i + 65536]] * q[query[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536))])
            fresh.clear()
            return best_of(*(np.concatenate(c) for c in zip(held, (query, ids[row], scores), strict=True)), k)

        for c in np.unique(code):
            a, b = np.searchsorted(code, [c, c + 1])
            readers = reader[slice(*np.searchsorted(wanted, [c, c + 1]))]
            distinct = b - a >= k and len(np.unique(ids[a:b])) == b - a
            for i in range(0, len(readers), 256):
                part = readers[i : i + 256]
                rough = q[part] @ x[a:b].T
                rough[own[part][:, None] == ids[None, a:b]] = -np.inf
                if distinct:
                    least[part] = np.maximum(least[part], np.partition(rough, b - a - k, axis=1)[:, b - a - k])
                at, near = np.nonzero((rough >= slack(least[part])[:, None]) & (rough > -np.inf))
                fresh.append((part[at], a + near, rough[at, near]))
                size += len(at)
                if size > 1_000_000:
                    held, size = settled(), 0
        query, near, scores = settled()
        return pa.table({"query_id": own[query], "vec_id": near, "away": -scores})

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``queries`` holds for."""
    rows = usable(vectors)
    index = fit(rows, k)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = written(_held(rows, index), "posting-lists")
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    counted = sizes.collect()  # one row for each list, as many as the model has centroids
    slices = {r["list"]: r["slices"] for r in counted}
    shards = max(1, -(-sum(r["n"] for r in counted) // SHARD))
    asking = rows.where(queries)
    blocks = max(1, -(-asking.count() // QUERIES))
    part = F.pmod(F.xxhash64("vec_id"), F.col("slices"))
    whole = F.col("list").cast("long")
    shard = ((whole * 7919 + part * 104729) % shards).cast("int").alias("shard")
    held = lists.join(F.broadcast(sizes.select("list", "slices")), "list")
    held = held.select(shard, (whole * PARTS + part).alias("code"), "vec_id", "embedding")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = _asked(asking, index, {r["list"]: r["n"] for r in counted}, slices, shards, k)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), FOUND)
    # a vec_id may come from several lists or rows: its best score counts
    found = found.groupBy("query_id", "vec_id").agg(F.min("away").alias("away"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("away", "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (-F.col("away")).alias("score"))


def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
