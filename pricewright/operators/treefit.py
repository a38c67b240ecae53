"""Trees grown over partitions: histograms of every level as one pass over the rows, splits chosen from their sums.

Rows are put into bins once and written with their target. A pass adds up, in every task, what each bin of each open node
holds (gradients, curvatures and counts, or counts of classes); the sums of tasks meet, over two exchanges where there are many,
and the driver, which sees sums but no rows, picks the splits as ``boosting`` does for rows in memory. A level of all models
(markets, trials, stages) is one pass, so a tree costs as many passes as it is deep, whatever the number of models or rows.
Finished trees travel with the passes, and every ``KEEP`` rounds the rows are written anew with their scores so far.
Boosted models of up to ``OWN`` rows need no passes: each grows in a task of its own, by the same sums and splits.

Edges of bins are quantiles by a sketch of bounded size; rows with counts, which stand for many, get exact ones. Models and
features are a few hundred at most: their histograms are what the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.operators import boosting
from pricewright.operators.boosting import BINS, Node, Trees
from pricewright.sources.steps import dropped, stored

#: Rows of one task; tasks whose sums come to the driver as they are; rounds between tables of scores.
ROWS, TASKS, KEEP = 10_000, 64, 10
#: Rows of a model that one task may hold, a byte for each feature; models of more grow over partitions.
OWN = 50_000


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Columns as numbers, missing ones as NaN."""
    return np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])


def quantile_edges(rows: DataFrame, features: Sequence[str], counted: bool) -> dict[str, list[list[float]]]:
    """For each model, the edges of each feature's bins."""
    points = [float(p) for p in np.linspace(0, 1, BINS)[1:-1]]
    at = F.array(*[F.lit(p) for p in points])
    each = [F.percentile(F.col(f), at, F.col("n").cast("long")) if counted else F.percentile_approx(F.col(f), at, 10_000) for f in features]
    found = rows.groupBy("model").agg(*[e.cast("array<double>").alias(f"e{k}") for k, e in enumerate(each)]).collect()
    return {r["model"]: [np.unique(r[f"e{k}"] or []).tolist() for k in range(len(features))] for r in found}


def binned(rows: DataFrame, features: Sequence[str], edges: Mapping[str, list[list[float]]], names: Sequence[str]) -> DataFrame:
    """(model, bins, y, n, raw) of (model, features, y, n): the model's place in ``names``, and a byte for each feature."""
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array([place.get(m, -1) for m in batch.column("model").to_pylist()], np.int32)
            x, out = _matrix(batch, features), np.zeros((batch.num_rows, len(features)), np.uint8)
            for k in np.unique(models[models >= 0]):
                mine = models == k
                out[mine] = Trees(list(features), edges[names[k]], 0.0, 1.0, False).binned(x[mine])
            keep = pa.array(models >= 0)
            bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
            y, n = batch.column("y").cast(pa.float64()), batch.column("n").cast(pa.float64())
            table = [pa.array(models), bins, y, n, pa.array(np.zeros(len(out)))]
            yield pa.RecordBatch.from_arrays(table, ["model", "bins", "y", "n", "raw"]).filter(keep)

    return rows.select("model", *features, "y", "n").mapInArrow(run, "model int, bins binary, y double, n double, raw double")


class Growing:
    """A model on the way: its trees, those that the rows' scores don't hold yet, and the open nodes of the present one."""

    def __init__(self, model: Trees, starts: np.ndarray, allowed: np.ndarray | None):
        self.model, self.starts, self.allowed = model, starts, allowed
        self.fresh: list[Node] = []
        self.root: Node | None = None
        self.open: list[tuple[Node, tuple, tuple]] = []
        self.ended = False


def _slots(node: Node, b: np.ndarray, slot: Mapping[int, int]) -> np.ndarray:
    """The open node that each row is in, -1 for rows in closed ones; ``slot`` goes by the order of leaves from the left."""
    out, leaves = np.full(len(b), -1, np.int64), iter(range(1 << 30))

    def walk(node: Node, rows: np.ndarray) -> None:
        if node.left is None:
            out[rows] = slot.get(next(leaves), -1)
            return
        left = boosting._goes_left(node, b[rows, node.feature])
        walk(node.left, rows[left])
        walk(node.right, rows[~left])

    walk(node, np.arange(len(b)))
    return out


def _open_slots(growing: Growing) -> dict[int, int]:
    """Place among the leaves -> number of the open node."""
    place = {id(node): k for k, (node, _, _) in enumerate(growing.open)}
    found, leaves = {}, iter(range(1 << 30))

    def walk(node: Node) -> None:
        if node.left is None:
            at = next(leaves)
            if id(node) in place:
                found[at] = place[id(node)]
            return
        walk(node.left)
        walk(node.right)

    walk(growing.root)
    return found


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    models = batch.column(0).to_numpy()
    bins = batch.column(1)
    b = np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(bins), -1).astype(np.int64)
    return models, b, *[batch.column(k).to_numpy() for k in (2, 3, 4)]


def _scores(trees: Sequence[Node], rate: float, b: np.ndarray, raw: np.ndarray) -> np.ndarray:
    for tree in trees:
        raw = raw + rate * boosting._walk(tree, b)
    return raw


def _add(sums: np.ndarray, inside: np.ndarray, b: np.ndarray, weights: Sequence[np.ndarray], starts: np.ndarray) -> None:
    """Add rows, each in one of the open nodes, to the histograms."""
    at = ((inside * starts[-1])[:, None] + b + starts[:-1]).reshape(-1)
    for s, w in enumerate(weights):
        sums[s] += np.bincount(at, weights=np.repeat(w, b.shape[1]), minlength=sums.shape[1])


def _summed(table: DataFrame, growing: list[Growing], rate: float, stats: int, weigh: Callable, tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """The histogram of each (model, open node)."""
    held = [
        (k, g.fresh, g.root, _open_slots(g), g.starts, len(g.open)) for k, g in enumerate(growing) if g.open
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((stats, width * int(starts[-1]))) for k, _, _, _, starts, width in held}
        for batch in batches:
            models, b, y, n, raw = _rows(batch)
            for k, fresh, root, slot, starts, width in held:
                mine = np.flatnonzero(models == k)
                if not len(mine):
                    continue
                inside = _slots(root, b[mine], slot)
                mine, inside = mine[inside >= 0], inside[inside >= 0]
                weights = weigh(k, y[mine], n[mine], _scores(fresh, rate, b[mine], raw[mine]))
                _add(sums[k], inside, b[mine], weights, starts)
        task, out = TaskContext.get().partitionId(), []
        for k, _, _, _, starts, width in held:
            cube = sums[k].reshape(stats, width, int(starts[-1]))
            out += [(k, s, task % TASKS, cube[:, s].tobytes()) for s in range(width) if cube[:, s].any()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["model", "slot", "part", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s) for s in group["sums"].to_pylist())
        return group.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "model int, slot int, part int, sums binary"
    parts = table.mapInArrow(run, schema)
    if tasks > TASKS:
        parts = parts.groupBy("model", "slot", "part").applyInArrow(added, schema).groupBy("model", "slot").applyInArrow(added, schema)
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["model"], r["slot"], r["part"])):
        sums = np.frombuffer(r["sums"]).reshape(stats, -1)
        at = r["model"], r["slot"]
        out[at] = out[at] + sums if at in out else sums
    return out


def _prepared(rows: DataFrame, features: Sequence[str], edges: Mapping[str, list[list[float]]] | None, counted: bool):
    edges = edges or quantile_edges(rows, features, counted)
    names = sorted(edges)
    size = rows.where(F.col("model").isin(names)).count()
    tasks = max(1, -(-size // ROWS))
    return edges, names, tasks, stored(binned(rows, features, edges, names).repartition(tasks), "tree-rows")


def grow(
    rows: DataFrame,
    features: Sequence[str],
    rounds: int = 100,
    rate: float = 0.1,
    depth: int = 4,
    min_leaf: int = 20,
    ridge: float = 1.0,
    logistic: Sequence[str] = (),
    monotone: Mapping[str, int] | None = None,
    allowed: Mapping[str, Sequence[str]] | None = None,
    edges: Mapping[str, list[list[float]]] | None = None,
    counted: bool = False,
) -> dict[str, Trees]:
    """One boosted model for each ``model`` of rows with its name, features, target ``y`` and count ``n``.

    ``logistic`` names the models on the logistic scale, ``allowed`` what features each may split on. Parameters are those of
    ``boosting.grow``, and so are the trees, on the same bins. Rows without a model or a target take no part.
    """
    rows = rows.where("model is not null and y is not null and not isnan(y)")
    edges, names, tasks, table = _prepared(rows, features, edges, counted)
    if not names:
        return {}
    means = {r["model"]: r["mean"] for r in rows.groupBy("model").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("mean")).collect()}
    signs = np.array([(monotone or {}).get(f, 0) for f in features])
    growing = []
    for name in names:
        held = min(max(means[name], 1e-6), 1 - 1e-6)
        base = float(np.log(held / (1 - held))) if name in logistic else float(means[name])
        may = None if allowed is None else np.isin(list(features), list(allowed.get(name, ())))
        growing.append(Growing(Trees(list(features), edges[name], base, rate, name in logistic), boosting.starts_of(edges[name]), may))
    bases, on_log = [g.model.base for g in growing], [g.model.logistic for g in growing]

    def weigh(k: int, y: np.ndarray, n: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        raw = raw + bases[k]
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) if on_log[k] else raw
        return (y - p) * n, (np.maximum(p * (1 - p), 1e-6) if on_log[k] else np.ones(len(y))) * n, n

    stored_rows, counts = table, table.groupBy("model").count().collect()
    alone = [r["model"] for r in counts if r["count"] <= OWN]

    def whole(group: pa.Table) -> pa.Table:
        k = group["model"][0].as_py()
        _grow_alone(growing[k], group, lambda *rows: weigh(k, *rows), rounds, depth, min_leaf, ridge, signs)
        return pa.table({"model": pa.array([k], pa.int32()), "trees": pa.array([growing[k].model.to_json()])})

    if alone:
        own = table.where(F.col("model").isin(alone)).repartitionByRange(len(alone), "model")
        for r in own.groupBy("model").applyInArrow(whole, "model int, trees string").collect():  # a model each
            growing[r["model"]].model, growing[r["model"]].ended = Trees.from_json(r["trees"]), True
        table = table.where(~F.col("model").isin(alone))

    for round_ in range(0 if len(alone) == len(counts) else rounds):
        for g in growing:
            g.root = None if g.ended else Node(0.0, 0.0)
            g.open = [] if g.ended else [(g.root, None, (-np.inf, np.inf))]
        for _ in range(depth):
            if not any(g.open for g in growing):
                break
            sums = _summed(table, growing, rate, 3, weigh, tasks)
            for k, g in enumerate(growing):
                g.open = [child for s, node in enumerate(g.open) for child in _split(g, node, sums.get((k, s)), min_leaf, ridge, signs)]
        for g in growing:
            if g.root is not None and g.root.left is not None:
                g.model.trees.append(g.root)
                g.fresh.append(g.root)
            else:
                g.ended = True
            g.open = []
        if all(g.ended for g in growing):
            break
        if len(max((g.fresh for g in growing), key=len)) >= KEEP and round_ < rounds - 1:
            old, table = table, stored(_rescored(table, growing, rate), "tree-rows")
            dropped(old)
            for g in growing:
                g.fresh = []
    dropped(stored_rows, table)
    return {name: g.model for name, g in zip(names, growing, strict=True)}


def _grow_alone(g: Growing, rows: pa.Table, weigh: Callable, rounds: int, depth: int, min_leaf: int, ridge: float, signs: np.ndarray) -> None:
    """Grow a model on rows that are all here, by the steps of the passes."""
    b = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    y, n, raw = (rows[c].to_numpy() for c in ("y", "n", "raw"))
    width = int(g.starts[-1])
    for _ in range(rounds):
        g.root = Node(0.0, 0.0)
        g.open = [(g.root, None, (-np.inf, np.inf))]
        weights = weigh(y, n, raw)
        for _ in range(depth):
            if not g.open:
                break
            inside, sums = _slots(g.root, b, _open_slots(g)), np.zeros((len(weights), len(g.open) * width))
            for i in range(0, len(b), ROWS):
                at = i + np.flatnonzero(inside[i : i + ROWS] >= 0)
                _add(sums, inside[at], b[at].astype(np.int64), [w[at] for w in weights], g.starts)
            cube = sums.reshape(len(weights), -1, width)
            found = [cube[:, s] if cube[:, s].any() else None for s in range(len(g.open))]
            g.open = [child for s, node in enumerate(g.open) for child in _split(g, node, found[s], min_leaf, ridge, signs)]
        if g.root.left is None:
            break
        g.model.trees.append(g.root)
        raw = _scores([g.root], g.model.rate, b, raw)


def _split(g: Growing, opened: tuple, sums: np.ndarray | None, min_leaf: int, ridge: float, signs: np.ndarray) -> list[tuple]:
    """The children of an open node, after it has got its split; none where it stays a leaf."""
    node, total, bounds = opened
    if sums is None:
        return []
    if total is None:  # the root: any feature's bins hold all rows
        total = tuple(float(x) for x in sums[:, : g.starts[1]].sum(axis=1))
        node.value, node.cover = boosting.leaf_value(*total[:2], ridge, *bounds), total[2]
    if total[2] < 2 * min_leaf:
        return []
    found = boosting.best_split(sums, g.starts, node, total, bounds, min_leaf, ridge, signs, g.allowed)
    if found is None:
        return []
    node.feature, node.cut, node.missing_left, left, right = found
    below = boosting.bounds_below(signs[node.feature], left[3], right[3], *bounds)
    out = []
    for side, (gs, hs, ns, _), held in (("left", left, below[0]), ("right", right, below[1])):
        child = Node(boosting.leaf_value(gs, hs, ridge, *held), float(ns))
        setattr(node, side, child)
        if ns >= 2 * min_leaf:
            out.append((child, (float(gs), float(hs), float(ns)), held))
    return out


def _rescored(table: DataFrame, growing: list[Growing], rate: float) -> DataFrame:
    """The rows with scores that hold all trees so far."""
    held = [g.fresh for g in growing]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, b, _, _, raw = _rows(batch)
            new = raw.copy()
            for k in np.unique(models):
                mine = models == k
                new[mine] = _scores(held[k], rate, b[mine], raw[mine])
            yield batch.set_column(4, "raw", pa.array(new))

    return table.mapInArrow(run, table.schema)


def grow_classes(rows: DataFrame, features: Sequence[str], depth: int = 5, min_leaf: int = 200, edges=None) -> dict[str, dict]:
    """One class tree for each ``model`` of rows with its name, features and ``label``, as ``boosting.rule_tree`` grows it."""
    rows = rows.where("model is not null and label is not null")
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1 if classes else F.lit(0)
    coded = rows.select("model", *features, code.cast("double").alias("y"), F.lit(1.0).alias("n"))
    edges, names, tasks, table = _prepared(coded, features, edges, False)
    growing = [Growing(Trees(list(features), edges[name], 0.0, 1.0, False), boosting.starts_of(edges[name]), None) for name in names]
    known: list[dict[int, dict]] = [{} for _ in names]
    mine: list[list[str]] = [[] for _ in names]
    for g in growing:
        g.root = Node(0.0, 0.0)
        g.open = [(g.root, None, None)]

    def weigh(k: int, y: np.ndarray, n: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        return [(y == c).astype(float) for c in range(len(classes))]

    for level in range(depth + 1):
        if not any(g.open for g in growing):
            break
        sums = _summed(table, growing, 1.0, len(classes), weigh, tasks) if level < depth else {}
        for k, g in enumerate(growing):
            children = []
            for s, (node, counts, _) in enumerate(g.open):
                if counts is None:
                    counts = sums[k, s][:, : g.starts[1]].sum(axis=1)
                    mine[k] = [c for c, n in zip(classes, counts, strict=True) if n > 0]
                named = [n for c, n in zip(classes, counts, strict=True) if c in mine[k]]
                leaf = known[k].setdefault(id(node), boosting.class_leaf(np.array(named), mine[k]))
                if level == depth or counts.sum() < 2 * min_leaf:
                    continue
                found = boosting.best_class_split(sums[k, s], g.starts, counts, min_leaf)
                if found is None:
                    continue
                node.feature, node.cut, node.missing_left, left, right = found
                node.left, node.right = Node(0.0, 0.0), Node(0.0, 0.0)
                leaf |= boosting.class_split(found, features, g.model.edges)
                children += [(node.left, left, None), (node.right, right, None)]
            g.open = children
    dropped(table)

    def told(k: int, node: Node) -> dict:
        own = known[k][id(node)]
        return own if node.left is None else own | {"yes": told(k, node.left), "no": told(k, node.right)}

    return {name: told(k, g.root) for k, (name, g) in enumerate(zip(names, growing, strict=True))}


def predicted(rows: DataFrame, models: Mapping[str, Trees], name: str = "guess", features: Sequence[str] | None = None) -> DataFrame:
    """Add the prediction of each row's ``model``, null where there is none; the models are broadcast."""
    used = list(features or next(iter(models.values())).features)
    shared = rows.sparkSession.sparkContext.broadcast({k: m.to_json() for k, m in models.items()})
    wanted = [c for c in rows.columns if c not in used or c == "model"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {k: Trees.from_json(m) for k, m in shared.value.items()}
        for batch in batches:
            whose, x = np.array([m or "" for m in batch.column("model").to_pylist()], object), _matrix(batch, used)
            guess = np.full(batch.num_rows, np.nan)
            for m in set(whose) & set(trees):
                at = whose == m
                guess[at] = trees[m].predict(x[at])
            own = [batch.column(c) for c in wanted]
            yield pa.RecordBatch.from_arrays([*own, pa.array(guess, from_pandas=True)], [*wanted, name])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in wanted], f"`{name}` double"]))


def attributed(rows: DataFrame, models: Mapping[str, Trees], weight: str | None = None) -> DataFrame:
    """(model, feature, importance): the mean absolute attribution of each feature over all rows of a model."""
    used = list(next(iter(models.values())).features)
    shared = rows.sparkSession.sparkContext.broadcast({k: m.to_json() for k, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, total, size = {k: Trees.from_json(m) for k, m in shared.value.items()}, {}, {}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                whose, x = np.array([m or "" for m in part.column("model").to_pylist()], object), _matrix(part, used)
                n = part.column(weight).cast(pa.float64()).to_numpy() if weight else np.ones(part.num_rows)
                for m in set(whose) & set(trees):
                    at = whose == m
                    total[m] = total.get(m, 0) + n[at] @ np.abs(trees[m].attributions(x[at])[:, :-1])
                    size[m] = size.get(m, 0) + n[at].sum()
        out = [(m, f, float(t), float(size[m])) for m in total for f, t in zip(used, total[m], strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["model", "feature", "total", "n"])

    parts = rows.mapInArrow(run, "model string, feature string, total double, n double")
    return parts.groupBy("model", "feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
