"""Gradient-boosted trees on binned columns, with missing values, monotone constraints and exact attributions.

``grow`` is for rows that one task holds; ``treefit`` grows the same trees over partitions, with the splits chosen here.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

BINS = 64
MISSING = 0


@dataclass
class Node:
    value: float
    cover: float
    feature: int = -1
    cut: int = 0
    missing_left: bool = True
    left: Node | None = None
    right: Node | None = None


@dataclass
class Trees:
    """A sum of trees over binned features, on the identity or the logistic scale."""

    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    logistic: bool
    trees: list[Node] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin 0 for missing values, then one more than the number of edges below."""
        out = np.zeros(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            known = ~np.isnan(x[:, j])
            out[known, j] = 1 + np.searchsorted(e, x[known, j], "left")
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(np.asarray(x, float))
        total = np.full(len(b), self.base)
        for tree in self.trees:
            total += self.rate * _walk(tree, b)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30))) if self.logistic else raw

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Additive shares of each feature in the raw score, one row each, with the expected value last.

        Shapley values of the path-dependent game: absent features follow both branches by their cover.
        """
        b = self.binned(np.asarray(x, float))
        out = np.zeros((len(b), len(self.features) + 1))
        out[:, -1] = self.base
        for tree in self.trees:
            out[:, -1] += self.rate * _expected(tree)
            out[:, :-1] += self.rate * _shapley(tree, b, len(self.features))
        return out

    def to_json(self) -> str:
        def plain(n: Node | None):
            return None if n is None else [n.value, n.cover, n.feature, n.cut, n.missing_left, plain(n.left), plain(n.right)]

        return json.dumps([self.features, self.edges, self.base, self.rate, self.logistic, [plain(t) for t in self.trees]])

    @staticmethod
    def from_json(text: str) -> Trees:
        def node(p) -> Node | None:
            return None if p is None else Node(*p[:5], node(p[5]), node(p[6]))

        *head, trees = json.loads(text)
        return Trees(*head, [node(t) for t in trees])


def _goes_left(node: Node, bins: np.ndarray) -> np.ndarray:
    return np.where(bins == MISSING, node.missing_left, bins <= node.cut)


def _walk(node: Node, b: np.ndarray) -> np.ndarray:
    if node.left is None:
        return np.full(len(b), node.value)
    left = _goes_left(node, b[:, node.feature])
    out = np.empty(len(b))
    out[left], out[~left] = _walk(node.left, b[left]), _walk(node.right, b[~left])
    return out


def _expected(node: Node) -> float:
    if node.left is None:
        return node.value
    return (node.left.cover * _expected(node.left) + node.right.cover * _expected(node.right)) / node.cover


def _shapley(tree: Node, b: np.ndarray, n_features: int) -> np.ndarray:
    """Each leaf is a product game over the features on its path: its value counts for a subset if the row satisfies the
    path's conditions on the subset, and by cover for the rest. The Shapley value of a product game has weights that
    depend on subset sizes alone, which a small polynomial over the path's features gives, for all rows at once."""
    out = np.zeros((len(b), n_features))

    def leaf(value: float, path: dict[int, tuple[np.ndarray, float]]) -> None:
        items = list(path.items())
        m = len(items)
        weight = [_choose_weight(m, k) for k in range(m)]
        for i, (feature, (one, zero)) in enumerate(items):
            poly = [np.ones(len(b))]
            for j, (_, (o, z)) in enumerate(items):
                if j != i:
                    poly = [x * z + y * o for x, y in zip([*poly, 0.0], [0.0, *poly], strict=True)]
            out[:, feature] += value * (one - zero) * sum(w * x for w, x in zip(weight, poly, strict=True))

    def walk(node: Node, path: dict[int, tuple[np.ndarray, float]]) -> None:
        if node.left is None:
            leaf(node.value, path)
            return
        goes_left = _goes_left(node, b[:, node.feature]).astype(float)
        one, zero = path.get(node.feature, (np.ones(len(b)), 1.0))
        for child, hit in ((node.left, goes_left), (node.right, 1 - goes_left)):
            walk(child, path | {node.feature: (one * hit, zero * child.cover / node.cover)})

    walk(tree, {})
    return out


def _choose_weight(m: int, s: int) -> float:
    from math import factorial

    return factorial(s) * factorial(m - s - 1) / factorial(m)


def quantile_edges(x: np.ndarray, bins: int = BINS, count: np.ndarray | None = None) -> list[list[float]]:
    """Quantiles of each column; with counts, those of the rows each repeated so many times."""
    out = []
    count = np.ones(len(x), np.int64) if count is None else count
    for j in range(x.shape[1]):
        there = ~np.isnan(x[:, j])
        order = np.argsort(x[there, j], kind="stable")
        known, upto = x[there, j][order], np.cumsum(count[there][order])
        if not len(known):
            out.append([])
            continue
        at = np.linspace(0, 1, bins)[1:-1] * (upto[-1] - 1)
        low, high = (known[np.searchsorted(upto, k, "right")] for k in (np.floor(at), np.ceil(at)))
        out.append(np.unique(low + (high - low) * (at - np.floor(at))).tolist())
    return out


def grow(
    x: np.ndarray,
    y: np.ndarray,
    features: Sequence[str],
    rounds: int = 100,
    rate: float = 0.1,
    depth: int = 4,
    min_leaf: int = 20,
    ridge: float = 1.0,
    logistic: bool = False,
    monotone: dict[str, int] | None = None,
    count: np.ndarray | None = None,
) -> Trees:
    """Boost trees on squared or logistic loss.

    With ``count``, a row stands for so many rows of equal features and ``y`` is the mean of theirs; both losses depend on
    no more than that, so the model is the one of all those rows.

    A feature with sign -1 never raises the prediction and one with +1 never lowers it: a split on it must order its
    leaves that way, and each side stays beyond the middle of the two for all splits below.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    count = np.ones(len(y)) if count is None else np.asarray(count)
    edges = quantile_edges(x, count=count)
    mean = float(np.average(y, weights=count)) if len(y) else 0.0
    held = min(max(mean, 1e-6), 1 - 1e-6)
    model = Trees(list(features), edges, float(np.log(held / (1 - held))) if logistic else mean, rate, logistic)
    b = model.binned(x)
    signs = np.array([(monotone or {}).get(f, 0) for f in features])
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) if logistic else raw
        gradient, curve = (y - p) * count, (np.maximum(p * (1 - p), 1e-6) if logistic else np.ones(len(y))) * count
        tree = _grow_node(b, gradient, curve, count, np.arange(len(y)), depth, min_leaf, ridge, signs, starts_of(edges), -np.inf, np.inf)
        if tree.left is None:
            break
        model.trees.append(tree)
        raw += rate * _walk(tree, b)
    return model


def leaf_value(g: float, h: float, ridge: float, low: float, high: float) -> float:
    return float(min(max(g / (h + ridge), low), high))


def starts_of(edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Where each feature's bins begin in one row of all bins, with the number of all at the end."""
    return np.concatenate([[0], np.cumsum([len(e) + 2 for e in edges])]).astype(np.int64)


def histogram(b: np.ndarray, weights: Sequence[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Sums of each weight in each bin of each feature, one row for each weight."""
    at = (b + starts[:-1]).reshape(-1)
    return np.array([np.bincount(at, weights=np.repeat(w, b.shape[1]), minlength=int(starts[-1])) for w in weights])


def best_split(sums: np.ndarray, starts: np.ndarray, node: Node, total: tuple[float, float, float], bounds: tuple[float, float],
               min_leaf: int, ridge: float, signs: np.ndarray, allowed: np.ndarray | None = None):
    """The best (feature, cut, missing_left), and (sum of gradients, curvatures and counts, value) of each side; None without gain."""
    (total_g, total_h, total_n), (low, high) = total, bounds
    # one row for each feature, as wide as the widest; padding repeats the last sum and cuts there leave nothing on the right
    widths = np.diff(starts)
    at = starts[:-1, None] + np.arange(widths.max(initial=1))
    table = np.where(np.arange(at.shape[1]) < widths[:, None], sums[:, np.minimum(at, int(starts[-1]) - 1)], 0.0)
    below, missing = np.cumsum(table[:, :, 1:], axis=2), table[:, :, :1]
    may = np.ones(len(widths), bool) if allowed is None else np.asarray(allowed, bool)
    best = (1e-9, None)
    for missing_left in (True, False):
        gl, hl, nl = below + missing if missing_left else below
        gr, hr, nr = total_g - gl, total_h - hl, total_n - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
            gain = (gl * vl - 0.5 * (hl + ridge) * vl**2) + (gr * vr - 0.5 * (hr + ridge) * vr**2)
        gain -= total_g * node.value - 0.5 * (total_h + ridge) * node.value**2
        ok = (nl >= min_leaf) & (nr >= min_leaf) & may[:, None]
        # missing values take no part in the order, so they may not decide a constrained split
        ok &= (signs[:, None] == 0) | (signs[:, None] * (vr - vl) >= 0)
        if not missing_left:
            ok &= missing[2] > 0
        gain = np.where(ok, gain, -np.inf)
        if not gain.size:
            continue
        j, k = divmod(int(gain.argmax()), gain.shape[1])
        # of equal gains the first feature counts, and missing values go left
        if gain[j, k] > best[0] or (best[1] is not None and gain[j, k] == best[0] and j < best[1][0]):
            sides = [tuple(float(x[j, k]) for x in side) for side in ((gl, hl, nl, vl), (gr, hr, nr, vr))]
            best = (float(gain[j, k]), (j, k + 1, missing_left, *sides))
    return best[1]


def bounds_below(sign: int, vl: float, vr: float, low: float, high: float) -> list[tuple[float, float]]:
    """What the values on both sides of a split are held in: beyond the middle if the feature is constrained."""
    if not sign:
        return [(low, high), (low, high)]
    middle = (vl + vr) / 2
    return [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]


def _grow_node(b, g, h, count, rows, depth, min_leaf, ridge, signs, starts, low, high) -> Node:
    total = g[rows].sum(), h[rows].sum(), count[rows].sum()
    node = Node(leaf_value(*total[:2], ridge, low, high), float(total[2]))
    if depth == 0 or total[2] < 2 * min_leaf:
        return node
    sums = histogram(b[rows], (g[rows], h[rows], count[rows]), starts)
    found = best_split(sums, starts, node, total, (low, high), min_leaf, ridge, signs)
    if found is None:
        return node
    node.feature, node.cut, node.missing_left = found[:3]
    left = _goes_left(node, b[rows, node.feature])
    below = bounds_below(signs[node.feature], found[3][3], found[4][3], low, high)
    node.left = _grow_node(b, g, h, count, rows[left], depth - 1, min_leaf, ridge, signs, starts, *below[0])
    node.right = _grow_node(b, g, h, count, rows[~left], depth - 1, min_leaf, ridge, signs, starts, *below[1])
    return node


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1)
    return n - (counts**2).sum(-1) / np.maximum(n, 1)


def class_leaf(counts: np.ndarray, names: Sequence[str]) -> dict:
    return {"n": int(counts.sum()), "counts": dict(zip(names, counts.astype(int).tolist(), strict=True)), "class": names[int(counts.argmax())]}


def best_class_split(sums: np.ndarray, starts: np.ndarray, counts: np.ndarray, min_leaf: int):
    """The best (feature, cut, missing_left) by Gini gain, and the class counts of each side; None without gain."""
    best = (1e-9, None)
    for j in range(len(starts) - 1):
        table = sums[:, starts[j] : starts[j + 1]].T
        for missing_left in (True, False) if table[0].sum() else (True,):
            below = np.cumsum(table[1:], axis=0) + (table[0] if missing_left else 0)
            above = counts - below
            gain = _gini(counts) - _gini(below) - _gini(above)
            gain = np.where((below.sum(1) >= min_leaf) & (above.sum(1) >= min_leaf), gain, -1)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, k + 1, missing_left, below[k], above[k]))
    return best[1]


def class_split(found: tuple, features: Sequence[str], edges: Sequence[Sequence[float]]) -> dict:
    j, cut, missing_left = found[:3]
    edge = edges[j][cut - 1] if cut - 1 < len(edges[j]) else float("inf")
    return {"feature": features[j], "at_most": edge, "missing_left": missing_left}


def rule_tree(x: np.ndarray, labels: Sequence[str], features: Sequence[str], depth: int = 5, min_leaf: int = 200):
    """A shallow class tree by Gini gain, with missing values routed to the better side; leaves hold class counts."""
    x = np.asarray(x, float)
    names = sorted(set(labels))
    y = np.searchsorted(names, np.asarray(labels))
    edges = quantile_edges(x)
    model = Trees(list(features), edges, 0.0, 1.0, False)
    b = model.binned(x)

    starts = starts_of(edges)

    def build(rows: np.ndarray, left_depth: int) -> dict:
        counts = np.bincount(y[rows], minlength=len(names)).astype(float)
        leaf = class_leaf(counts, names)
        if left_depth == 0 or len(rows) < 2 * min_leaf:
            return leaf
        found = best_class_split(histogram(b[rows], [y[rows] == k for k in range(len(names))], starts), starts, counts, min_leaf)
        if found is None:
            return leaf
        left = _goes_left(Node(0, 0, *found[:3]), b[rows, found[0]])
        return leaf | class_split(found, features, edges) | {"yes": build(rows[left], left_depth - 1), "no": build(rows[~left], left_depth - 1)}

    return build(np.arange(len(y)), depth)


def rule_lines(tree: dict, said: tuple[str, ...] = ()) -> list[str]:
    """One line for each leaf: its conditions, class and counts."""
    if "feature" not in tree:
        return [f"{' and '.join(said) or 'always'} -> {tree['class']} {tree['counts']}"]
    also = " or missing"
    yes = f"{tree['feature']} <= {tree['at_most']:.6g}{also if tree['missing_left'] else ''}"
    no = f"{tree['feature']} > {tree['at_most']:.6g}{'' if tree['missing_left'] else also}"
    return rule_lines(tree["yes"], (*said, yes)) + rule_lines(tree["no"], (*said, no))
