"""SimHash near-duplicates: 64-bit fingerprints, linked by BK-trees within shards.

Fingerprints that differ in at most ``radius`` bits agree on some ``blocks - radius`` of ``blocks`` bit blocks, so every
linked pair meets in the shard of at least one such combination. Each shard holds its distinct fingerprints in BK-trees
(children keyed by their Hamming distance to the parent); a search follows only edges whose key lies within the radius
of the distance at hand. A shard hands out the links of a spanning forest of its part of the graph, never all pairs,
and shards too large for one tree are searched slice by slice, in as many tasks.

The trees travel through the shuffle to the tasks that search them: the fingerprints of all documents have no bound that
would let them be broadcast.

Defined cases: null and blank texts have fingerprint zero and link like any other; under three words the whole sequence
is one shingle; equal fingerprints meet before any search; rows that repeat a ``doc_id`` are all kept, and a null
``doc_id`` belongs to its fingerprint's component without naming it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.components import components
from pricewright.llm.scratch import sliced, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints in one tree; larger shards are searched slice by slice.
TREE = 4096


def fingerprint_text(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: bit b is set if it is set in over half of the shingle hashes."""
    # bytes.lower() changes A to Z alone, and bytes.split() cuts at the six characters of the word rule
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = ends[shingle - 1 :] - 1 if len(found) >= shingle else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), last.tolist(), strict=False)
    return majority(np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(last)))


def majority(hashes: np.ndarray) -> int:
    """The word of the bits that over half of the 64-bit words have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        values = np.fromiter((fingerprint_text(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(values)], [*kept, "fp"])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) for each row, the fingerprint as a signed 64-bit number, with more columns in between."""
    rows = docs.select("doc_id", *more, "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


class BKTree:
    """A BK-tree over distinct 64-bit words in arrays, searched for many words at a time."""

    def __init__(self, words: np.ndarray):
        self.words = np.asarray(words, np.uint64)
        n = len(self.words)
        self.child: dict[int, int] = {}
        plain = [int(w) for w in self.words]
        for k in range(1, n):
            at, word = 0, plain[k]
            while True:
                key = at * 65 + (plain[at] ^ word).bit_count()
                below = self.child.get(key)
                if below is None:
                    self.child[key] = k
                    break
                at = below
        keys = np.fromiter(self.child, np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys, kind="stable")
        self.edge_key, self.edge_node = keys[order], nodes[order]

    def within(self, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``words``, node) at most ``radius`` apart, level by level."""
        words = np.asarray(words, np.uint64)
        query = np.arange(len(words) if len(self.words) else 0)
        node = np.zeros(len(query), np.int64)
        found_q, found_n = [], []
        while len(query):
            apart = np.bitwise_count(words[query] ^ self.words[node]).astype(np.int64)
            hit = apart <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.edge_key, node * 65 + np.maximum(apart - radius, 1), "left")
            high = np.searchsorted(self.edge_key, node * 65 + np.minimum(apart + radius, 64), "right")
            count = np.maximum(high - low, 0)
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            query, node = np.repeat(query, count), self.edge_node[at]
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


class Forest:
    """Union-find that says which unions joined two parts."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def small_links(words: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links of a small shard: each word searches the tree of those before it, then joins that tree."""
    forest, out, children = Forest(len(words)), [], [{}]
    for k in range(1, len(words)):
        word, stack = words[k], [0]
        while stack:
            node = stack.pop()
            apart = (words[node] ^ word).bit_count()
            if apart <= radius and forest.join(node, k):
                out.append((words[node], word))
            stack += [below for key, below in children[node].items() if apart - radius <= key <= apart + radius]
        at = 0
        while (key := (words[at] ^ word).bit_count()) in children[at]:
            at = children[at][key]
        children[at][key] = k
        children.append({})
    return out


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph between the words of ``left`` and the BK-tree of ``right``."""
    words = np.unique(np.concatenate([left, right]))
    tree, forest, out = BKTree(right), Forest(len(words)), []
    place = np.searchsorted(words, right)
    part_of = np.arange(len(words))
    for i in range(0, len(left), 256):
        part = left[i : i + 256]
        query, node = tree.within(part, radius)
        x, y = np.searchsorted(words, part)[query], place[node]
        fresh = part_of[x] != part_of[y]
        for u, v in zip(x[fresh].tolist(), y[fresh].tolist(), strict=True):
            if forest.join(u, v):
                out.append((u, v))
        if fresh.any():
            part_of = np.fromiter(map(forest.root, range(len(words))), np.int64, len(words))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return words[pairs[:, 0]], words[pairs[:, 1]]


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of ``blocks - radius`` blocks out of ``blocks`` near-equal ones."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [sum(1 << bit for bit in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(each, blocks - radius)]


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose shards hold about 64 unrelated fingerprints or fewer; more blocks mean more copies."""
    for blocks in range(radius + 1, radius + 4):
        if count <= 64 << (64 * (blocks - radius) // blocks):
            return blocks
    return radius + 4


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE, blocks: int | None = None) -> DataFrame:
    """(a, b) links that span every group of fingerprints within ``radius`` of each other in a shard.

    ``distinct`` has one column fp without repeats. Shards of one fingerprint end before the search; a shard of several
    slices is searched once for each pair of them.
    """
    if blocks is None:
        blocks = blocks_for(distinct.count(), radius)
    masks = [_signed(m) for m in block_masks(blocks, radius)]
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "block")
    )
    sizes = keyed.groupBy("mask", "block").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["mask", "block"]).withColumn("slices", F.ceil(F.col("n") / tree).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("partner")
    dealt = keyed.select("mask", "block", "own", "fp", partner).select(
        "mask",
        "block",
        F.least("own", "partner").alias("x"),
        F.greatest("own", "partner").alias("y"),
        "own",
        "fp",
    )
    keys = ["mask", "block", "x", "y"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_shard_links(radius), "a long, b long")


def _shard_links(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, fp in _runs(batches):
            if len(fp) <= 48:
                words = fp.view(np.uint64)
                pairs = small_links(words.tolist(), radius)
                found = np.array(pairs, np.uint64).reshape(-1, 2)
                a, b = found[:, 0], found[:, 1]
            else:
                words = fp.view(np.uint64)
                a, b = spanning_links(words[own == key[2]], words[own == key[3]], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in search(batches):
            held.append(batch)
            if len(held) >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The runs of equal (mask, block, x, y) in sorted batches, also across their borders; at most two slices each."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        if rest is not None:
            now = [np.concatenate([r, c]) for r, c in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        changed = np.zeros(len(now[0]) - 1, bool)
        for c in now[:4]:
            changed |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(c[i] for c in now[:4]), now[4][i:j], now[5][i:j]
        rest = [c[edges[-1] :] for c in now]
    if rest is not None and len(rest[0]):
        yield tuple(c[0] for c in rest[:4]), rest[4], rest[5]


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) for each fingerprint of (doc_id, fp) rows."""
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    member = components(links(groups.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = groups.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.select("fp", "component").join(ids, "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): documents reachable over links, named by the smallest doc_id of them."""
    rows = written(fingerprints(docs), "simhash")
    return rows.join(_classes(rows, radius).select("fp", "component_id"), "fp")


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row, in which a null differs from every value."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    parts = [x for c in ("doc_id", "text") for x in (F.col(c), F.col(c).isNull())]
    parts += [F.to_json(F.struct(*others))] if others else []
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in (("a", "_row_a"), ("b", "_row_b"))]


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns: one with the doc_id that names the group.

    Where several rows of the group have that doc_id, or none has any, the hash of the whole row decides; of rows that
    agree in every column one stays. Groups are made up from fingerprints and hashes; texts move once, to meet the hashes
    of the rows that stay.
    """
    hashed = docs.select("*", *_row_hashes(docs))
    rows = written(fingerprints(hashed, "_row_a", "_row_b"), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row_a", "_row_b")).alias("least")
    groups = written(rows.groupBy("fp").agg(least), "simhash-distinct")
    member = components(links(groups.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = groups.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("least").alias("least")).select("least._row_a", "least._row_b")
    kept = hashed.join(first, ["_row_a", "_row_b"], "left_semi")
    return kept.dropDuplicates(["_row_a", "_row_b"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
