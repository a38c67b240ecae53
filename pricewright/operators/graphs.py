"""Graphs as edge tables: components, communities and their quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pricewright.sources.steps import dropped, stored


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): summed weights of a node's edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, by contracting each node into the smallest of its neighbours and itself.

    Nodes follow these to a node that has no smaller neighbour, and the edges between what they end at, each once, are the next
    round's. At least one end of every edge is merged in a round, so the loop ends, and the edges that move get fewer from
    round to round.
    """
    ends = F.explode(F.array("src", "dst")).alias("node")
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    links = stored(edges.select(*pair).distinct(), "component-links")
    member = stored(links.select(ends).where("node is not null").distinct().withColumn("component", F.col("node")), "component-members")
    while True:
        apart = links.where("src <> dst")
        near = apart.select(ends, "src").groupBy("node").agg(F.min("src").alias("label"))
        label = _followed(stored(near, "component-labels"))
        if label.isEmpty():
            dropped(links, label)
            return member
        to = label.select(F.col("node").alias("component"), "label")
        old, member = member, stored(member.join(to, "component", "left").select("node", F.coalesce("label", "component").alias("component")), "component-members")
        a, b = (label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
        between = apart.join(a, "src").join(b, "dst").where("_src <> _dst")
        between = between.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct()
        gone, links = links, stored(between, "component-links")
        dropped(old, gone, label)


def _followed(label: DataFrame) -> DataFrame:
    """(node, label) where a label is the last of its chain, by jumps that double."""
    while True:
        far = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = stored(label.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "component-labels")
        moved = not fresh.where("moved").isEmpty()
        dropped(label)
        label = fresh.select("node", "label")
        label.stored_at = fresh.stored_at
        if not moved:
            return label


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition."""
    degree = degrees(edges).join(labels, "node")
    by_group = degree.groupBy("community").agg(F.sum("degree").alias("degree"))
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").agg(
        F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside")
    )
    squares = by_group.agg(F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    value = F.col("inside") / F.col("m") - resolution * F.col("squares") / (4 * F.col("m") * F.col("m"))
    return inner.crossJoin(squares).select(value.alias("modularity"))  # two one-row tables


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, conductance: the weight that leaves over the smaller of the volumes inside and outside; 0 if isolated."""
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    joined = edges.join(a, "src").join(b, "dst")
    leaving = joined.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community"), "weight")
    cut = leaving.groupBy("community").agg(F.sum("weight").alias("cut"))
    volume = degrees(edges).join(labels, "node").groupBy("community").agg(F.sum("degree").alias("volume"))
    total = volume.agg(F.sum("volume").alias("total"))
    table = volume.join(cut, "community", "left").crossJoin(F.broadcast(total))  # one row
    least = F.least("volume", F.col("total") - F.col("volume"))
    value = F.when(least > 0, F.coalesce("cut", F.lit(0.0)) / least).otherwise(F.lit(0.0))
    return table.select("community", value.alias("conductance"))


def largest_share(labels: DataFrame) -> DataFrame:
    """One row: the share of nodes in the largest community."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("share"))


def unified_score(modularities: list[float], conductances: list[float], largest: float) -> float:
    """Mean modularity times the largest share, over mean conductance and both spreads."""
    m, c = np.array(modularities), np.array(conductances)
    return float(m.mean() * largest / (c.mean() + c.std() + m.std() + 1e-5))


#: Nodes are dealt into so many colours, which move one after the other; a sweep that gains less ends a level.
COLOURS, LEAST_GAIN = 2, 1e-9
#: Edges, of the graph itself or between communities, that are few enough to finish in memory: 24 MB of columns, and some 250 MB while nodes move.
FEW_EDGES = 1_000_000
#: Edges of a task, each counted at both ends, while nodes move.
EDGES = 100_000


def louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community): greedy modularity moves over partitions, then the same on the graph of communities, until none gains.

    Nodes move in phases by colour, a hash of their id. Of those of one colour that want to move, a node waits for a
    neighbour that comes first by another hash and wants to where the node is, or away from where it wants to; so no move takes from another
    what it goes for. Nodes that join one community at
    once may take more of its gain than there is; so a sweep over all colours has to raise the modularity, or it is undone
    and ends the level. Each level starts from the edges between communities, summed. A graph of
    few edges, at the start or once it is one of communities, is finished in memory, where nodes move one by one. Above that everything is joins and
    sums, whatever the size of a component or the degree of a node, and it ends, as modularity is bounded. Runs agree; a community is named by
    its smallest node.
    """
    links = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    links = stored(links.where("weight > 0"), "louvain-links")
    if links.count() <= FEW_EDGES:
        labels = stored(_finished(links, resolution), "louvain-members")
        dropped(links)
        return labels
    total = links.agg(F.sum("weight")).first()[0] or 1.0
    member = stored(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node")), "louvain-members")
    level = 0
    while True:
        few = level and links.count() <= FEW_EDGES
        labels = _finished(links, resolution) if few else _moved(links, total, resolution, level)
        if labels is None:
            break
        to = labels.select(F.col("node").alias("community"), F.col("community").alias("new"))
        old, member = member, stored(member.join(to, "community").select("node", F.col("new").alias("community")), "louvain-members")
        dropped(old)
        a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
        b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
        joined = links.join(a, "src").join(b, "dst")
        between = joined.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))
        old, links = links, stored(between, "louvain-links")
        dropped(old, labels)
        level += 1
        if few:
            break
    dropped(links)
    names = member.groupBy("community").agg(F.min("node").alias("first"))
    return member.join(names, "community").select("node", F.col("first").alias("community"))


def _finished(links: DataFrame, resolution: float) -> DataFrame:
    """(node, community) of a graph with ``FEW_EDGES`` edges at most, by moves one by one; a community is named by its smallest node."""
    table = links.toArrow()
    src, dst, weight = (table[c].to_numpy() for c in ("src", "dst", "weight"))
    nodes = np.unique(np.r_[src, dst])
    found = np.array(communities(len(nodes), np.searchsorted(nodes, src), np.searchsorted(nodes, dst), weight, resolution), np.int64)
    _, first = np.unique(found, return_index=True)
    return links.sparkSession.createDataFrame(pa.table({"node": nodes, "community": nodes[first[found]]}))


def _quality(links: DataFrame, state: DataFrame, total: float, resolution: float) -> float:
    """The modularity of a state."""
    a = state.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = state.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = links.join(a, "src").join(b, "dst").where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    mass = state.groupBy("community").agg(F.sum("degree").alias("mass")).agg(F.sum(F.col("mass") * F.col("mass")).alias("squares"))
    found = inside.crossJoin(mass).first()  # two one-row tables
    return found["inside"] / total - resolution * (found["squares"] or 0.0) / (4 * total * total)


def _moved(links: DataFrame, total: float, resolution: float, level: int) -> DataFrame | None:
    """(node, community) after local moves of single nodes, or None where none gains.

    Edges lie where the state of their ``dst`` comes to, and know the degree and colour of their ``src``. Each node has one to
    itself, without weight. Since neighbours never move together, the weight that comes inside is the sum of what each move brings.
    """
    apart = links.where("src <> dst")
    degree = degrees(links)
    itself = degree.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("weight"))
    both = apart.unionByName(apart.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).unionByName(itself)
    colour = F.pmod(F.xxhash64("src", F.lit(f"colour {level}")), F.lit(COLOURS)).cast("int")
    both = stored(both.join(degree.withColumnRenamed("node", "src"), "src").withColumn("colour", colour), "louvain-both")
    placed = both.repartition(-(-both.count() // EDGES) or 1, "dst").persist()
    state, sweep = stored(degree.withColumn("community", F.col("node")), "louvain-state"), 0
    best, gained = _quality(links, state, total, resolution), False
    while True:
        before = state
        for c in range(COLOURS):
            fresh = _phase(placed, state, c, total, resolution, sweep)
            if fresh is not None and state is not before:
                dropped(state)
            state = state if fresh is None else fresh
        value = best if state is before else _quality(links, state, total, resolution)
        if value <= best + LEAST_GAIN:
            dropped(both, state if state is not before else None)
            placed.unpersist()
            return before if gained else None
        dropped(before)
        best, gained, sweep = value, True, sweep + 1


#: The moves of one colour. A node's edge to itself brings what it is. Sides are merged, not broadcast: edges are dealt out by ``dst`` already.
_MOVES = """
WITH mass AS (SELECT community, sum(degree) AS mass FROM {state} GROUP BY community),
told AS (SELECT /*+ MERGE(mass) */ node AS dst, community, mass FROM {state} JOIN mass USING (community)),
near AS (SELECT /*+ MERGE(told), REPARTITION(src) */ src, degree, community, mass, weight, src = dst AS own FROM {both} JOIN told USING (dst) WHERE colour = :colour),
around AS (SELECT src, degree, community, mass, sum(weight) AS weight, bool_or(own) AS home FROM near GROUP BY src, degree, community, mass),
gains AS (SELECT src, community, home, round(weight - :resolution * degree * (mass - if(home, degree, 0D)) / (2 * :total), 12) AS gain FROM around),
chosen AS (
  SELECT src, max(struct(gain, -community AS place, community)) AS best, max(if(home, gain, NULL)) AS gain, max(if(home, community, NULL)) AS home
  FROM gains GROUP BY src),
want AS (
  SELECT src AS node, home, best.community AS to, xxhash64(src, :turn) AS turn FROM chosen WHERE best.gain > gain + 1e-12D AND best.community <> home),
met AS (
  SELECT /*+ MERGE(a), MERGE(b) */ a.node, a.to, (b.to = a.home OR b.home = a.to) AND struct(b.turn, b.node) < struct(a.turn, a.node) AS waits
  FROM {both} e JOIN want b ON e.dst = b.node JOIN want a ON e.src = a.node WHERE e.colour = :colour),
moves AS (SELECT node, to FROM met GROUP BY node, to HAVING NOT bool_or(waits))
SELECT /*+ MERGE(moves) */ node, degree, coalesce(to, community) AS community, to FROM {state} LEFT JOIN moves USING (node)
"""


def _phase(both: DataFrame, state: DataFrame, colour: int, total: float, resolution: float, sweep: int) -> DataFrame | None:
    """The state after the moves of one colour; None if none of it wants to move."""
    given = {"colour": colour, "resolution": float(resolution), "total": float(total), "turn": f"turn {sweep}"}
    seen = Observation()
    fresh = state.sparkSession.sql(_MOVES, given, both=both, state=state).observe(seen, F.count("to").alias("moves"))
    fresh = stored(fresh.drop("to"), "louvain-state")
    if seen.get["moves"]:
        return fresh
    dropped(fresh)
    return None


def communities(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, resolution: float = 1.0) -> list[int]:
    """Community of each node of a graph in memory: local moves one by one until none gains, then the same on the graph of communities."""
    total = float(weight.sum()) or 1.0
    mapping = np.arange(n)
    while True:
        a, b, weight = _summed(a, b, weight)
        label, improved = _one_by_one(n, a, b, weight, resolution / (2 * total))
        names = {c: k for k, c in enumerate(dict.fromkeys(label))}
        named = np.array([names[c] for c in label], np.int64)
        mapping = named[mapping]
        if not improved:
            return mapping.tolist()
        n, a, b = len(names), named[a], named[b]


def _summed(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each edge once, with the weight of all that join its ends."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b, weight = a[order], b[order], weight[order].astype(float)
    if not len(a):
        return a, b, weight
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[heads], b[heads], np.add.reduceat(weight, heads)


def _one_by_one(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, scale: float) -> tuple[list[int], bool]:
    """The label of each node once no move gains, and whether any did; a node's edges lie side by side."""
    degree = (np.bincount(a, weight, n) + np.bincount(b, weight, n)).tolist()
    apart = a != b
    src, dst, w = np.r_[a[apart], b[apart]], np.r_[b[apart], a[apart]], np.r_[weight[apart], weight[apart]]
    order = np.lexsort((dst, src))
    first, ends, weights = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist(), w[order].tolist()
    label, mass = list(range(n)), degree.copy()
    improved, moving = False, True
    while moving:
        moving = False
        for i in range(n):
            x, y = first[i], first[i + 1]
            around: dict[int, float] = {}
            for j, v in zip(ends[x:y], weights[x:y], strict=True):
                c = label[j]
                around[c] = around[c] + v if c in around else v
            home, own = label[i], degree[i]
            mass[home] -= own
            best, most = home, around.get(home, 0.0) - scale * own * mass[home]
            for c in sorted(around):
                gain = around[c] - scale * own * mass[c]
                if gain > most + 1e-12:
                    best, most = c, gain
            mass[best] += own
            if best != home:
                label[i] = best
                moving = improved = True
    return label, improved
