"""SentencePiece encoding and decoding with distinct sampled segmentations: Gumbel top-k without replacement.

The segmentations of a text are the paths through its lattice of pieces, with probabilities that a backward sum over the
lattice normalises. Every set of paths has a perturbed score, its log probability plus Gumbel noise, and the largest
perturbed scores are a sample without replacement. An A-star search finds them: the agenda holds subtrees of paths with
the exact perturbed maximum of each; the best one is popped, followed down the lattice to a path, and what it leaves at
each node goes back on the agenda, its maximum drawn under the condition that it lies below that of the popped one. What
is left beyond the first ``DEPTH`` nodes of a descent is one entry, which is split by its nodes only if it is popped. The
best entry left at the end is the threshold of the inclusion scores.

All noise is a hash of the row key, the sample and the place in the text, and lattices hold nothing that depends on what
else is in them, so a row gets the same sample in any batch. Texts are taken up in blocks of about ``BLOCK`` characters,
or one text where it is longer; the lattices of pre-tokens are kept from block to block until there are ``KEPT`` of them,
then those that both of the last two blocks used.

Defined cases: the row key is the doc_id with a hash of the text, so rows that repeat both get the same samples; null and
empty texts have one, empty segmentation; texts with fewer segmentations than asked for give all they have, with inclusion
score 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from pricewright.llm.pieces import DEFAULT_MODEL, Pieces, pre_tokens
from pricewright.llm.scratch import blocks

SAMPLES = 2
#: Inverse temperature of the piece scores.
SHARPNESS = 1.0
#: Nodes of a descent whose leftovers are entries of their own.
DEPTH = 24
#: Bytes of text taken up at once.
BLOCK = 350_000
#: Pre-tokens whose lattices a task holds from block to block.
KEPT = 60_000
#: Running sums of chances are whole multiples of this, so that they come out the same next to any others.
GRAIN = 2.0**-48


# ---- the lattice of distinct pre-tokens ---------------------------------------------------------------------------


class Walker:
    """The pieces as a trie in arrays: transitions over the commonest characters in a table, others by binary search."""

    def __init__(self, pieces: Pieces, common: int = 128):
        self.pieces = pieces
        states: dict[tuple[int, str], int] = {}
        ends: list[tuple[int, str]] = []
        n = 1
        for text in pieces.scores:
            at = 0
            for c in text:
                below = states.get((at, c))
                if below is None:
                    below = states[(at, c)] = n
                    n += 1
                at = below
            ends.append((at, text))
        self.score = np.full(n, np.nan)
        self.piece = np.full(n, -1, np.int32)
        for at, text in ends:
            self.score[at], self.piece[at] = pieces.scores[text], pieces.ids[text]
        uses: dict[str, int] = {}
        for _, c in states:
            uses[c] = uses.get(c, 0) + 1
        ranked = sorted(uses, key=lambda c: (-uses[c], c))[: common - 1]
        self.group = np.zeros(0x110000, np.uint8)
        for k, c in enumerate(ranked, 1):
            self.group[ord(c)] = k
        self.table = np.zeros((n, common), np.int32)
        rare = []
        for (at, c), below in states.items():
            if self.group[ord(c)]:
                self.table[at, self.group[ord(c)]] = below
            else:
                rare.append((at << 21 | ord(c), below))
        self.common, self.flat = common, self.table.reshape(-1)
        rare.sort()
        self.rare_key = np.array([k for k, _ in rare] or [-1], np.int64)
        self.rare_to = np.array([v for _, v in rare] or [0], np.int32)

    def step(self, at: np.ndarray, group: np.ndarray, chars: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The states after one more character, the one at each place; 0 where there is none."""
        own = group.take(place)
        below = self.flat.take(at * self.common + own)
        odd = np.flatnonzero(own == 0)
        if len(odd):
            key = at[odd].astype(np.int64) << 21 | chars[place[odd]].astype(np.int64)
            found = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            below[odd] = np.where(self.rare_key[found] == key, self.rare_to[found], 0)
        return below


@dataclass
class Lattice:
    """All paths of a batch of distinct texts: nodes between characters, edges for pieces, in order of their nodes."""

    node_of: np.ndarray
    edge_from: np.ndarray
    edge_to: np.ndarray
    edge_id: np.ndarray
    first: np.ndarray
    chance: np.ndarray
    running: np.ndarray

    @staticmethod
    def build(walker: Walker, tokens: list[str], sharpness: float = SHARPNESS) -> Lattice:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        node_of = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = np.repeat(np.arange(len(tokens)), sizes)
        node = np.arange(len(chars)) + inside
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
        at, where = np.zeros(len(chars), np.int32), np.arange(len(chars))
        group, parts, single, length = walker.group[chars], [], np.zeros(len(chars), bool), 0
        while len(where):
            at = walker.step(at, group, chars, where + length)
            length += 1
            alive = np.flatnonzero(at)
            where, at = where.take(alive), at.take(alive)
            piece = walker.piece.take(at)
            hit = np.flatnonzero(piece >= 0)
            first = where.take(hit)
            if length == 1:
                single[first] = True
            parts.append((node.take(first), np.full(len(hit), length), piece.take(hit), walker.score.take(at.take(hit))))
            longer = np.flatnonzero(room.take(where) > length)
            where, at = where.take(longer), at.take(longer)
        alone = np.flatnonzero(~single)
        unknown = np.full(len(alone), walker.pieces.unknown)
        parts.append((node[alone], np.ones(len(alone), np.int64), -1 - chars[alone].astype(np.int64), unknown))
        start, size, ids, score = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.argsort(start, kind="stable")
        start, size, ids, score = start[order], size[order], ids[order], score[order] * sharpness
        n_nodes = int(node_of[-1])
        first = np.searchsorted(start, np.arange(n_nodes + 1))
        total = np.zeros(n_nodes)
        left = np.zeros(n_nodes, np.int64)
        left[node] = room
        longest = int(left.max(initial=0))
        ahead = left[start].astype(np.uint16 if longest < 1 << 16 else np.int64)
        level = np.argsort(ahead, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ahead, minlength=longest + 1)[1:])])
        end = start + size
        from_, to, gain = start.take(level), end.take(level), score.take(level)
        heads = np.flatnonzero(np.concatenate([[True], from_[1:] != from_[:-1]])) if len(from_) else np.zeros(0, np.int64)
        spread, owner = np.diff(np.concatenate([heads, [len(from_)]])), from_.take(heads)
        groups = np.searchsorted(heads, bounds)
        for a, b, g, h in zip(bounds[:-1].tolist(), bounds[1:].tolist(), groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if a == b:
                continue
            values = gain[a:b] + total.take(to[a:b])
            top = np.maximum.reduceat(values, heads[g:h] - a)
            mass = np.add.reduceat(np.exp(values - np.repeat(top, spread[g:h])), heads[g:h] - a)
            total[owner[g:h]] = top + np.log(mass)
        chance = np.exp(score + total.take(end) - total.take(start))
        # whole numbers add up exactly, and a sum that wraps around is right again after the subtraction
        running = np.concatenate([[0], np.cumsum(np.rint(chance / GRAIN).astype(np.int64))])
        running = (running[1:] - running.take(first.take(start))) * GRAIN
        return Lattice(node_of, start, end, ids, first, chance, running)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type, start: tuple = ()):
        self.size = len(start)
        self.data = np.empty(1 << 16, kind)
        self.data[: self.size] = start

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.empty(max(need, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need

    def all(self) -> np.ndarray:
        return self.data[: self.size]


class Store:
    """Lattices of pre-tokens, kept for the next blocks."""

    def __init__(self, walker: Walker, sharpness: float = SHARPNESS, kept: int = KEPT):
        self.walker, self.sharpness, self.kept = walker, sharpness, kept
        self._clear()

    def _clear(self) -> None:
        # a counter and not the length, which would tie the dictionary to itself and keep it until the garbage is collected
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.built = 0
        self.recent = [np.zeros(0, np.int64)] * 2
        self.node_of, self.first = Grown(np.int64, (0,)), Grown(np.int64, (0,))
        self.edges = [Grown(np.int32), Grown(np.int32), Grown(np.int32), Grown(np.float64), Grown(np.float64)]

    def numbers(self, tokens_of_texts: Iterable[list[str]]) -> np.ndarray:
        """The number of each pre-token of a block, in order."""
        if len(self.number) > self.kept:
            both = np.intersect1d(*self.recent)
            tokens = list(self.number) if len(both) <= self.kept // 2 else []
            self._clear()
            for i in both.tolist() if tokens else []:
                self.number[tokens[i]]
        used = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens_of_texts)), np.int64)
        seen = np.zeros(len(self.number), bool)
        seen[used] = True
        self.recent = [self.recent[1], np.flatnonzero(seen)]
        return used

    def lattice(self) -> Lattice:
        """The lattice of all pre-tokens that have a number."""
        tokens = list(islice(self.number, self.built, None))
        if tokens:
            new = Lattice.build(self.walker, tokens, self.sharpness)
            nodes, edges = int(self.node_of.data[self.node_of.size - 1]), self.edges[0].size
            self.node_of.add(new.node_of[1:] + nodes)
            self.first.add(new.first[1:] + edges)
            if nodes + len(new.first) >= 1 << 31:
                raise OverflowError("a block of over 2**31 places")
            columns = (new.edge_from + nodes, new.edge_to + nodes, new.edge_id, new.chance, new.running)
            for column, values in zip(self.edges, columns, strict=True):
                column.add(values)
            self.built = len(self.number)
        return Lattice(self.node_of.all(), *(c.all() for c in self.edges[:3]), self.first.all(), *(c.all() for c in self.edges[3:]))


# ---- noise --------------------------------------------------------------------------------------------------------


#: What a place in a row, and a purpose, add to the row key before it is mixed.
PLACE, PURPOSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def uniform(key: np.ndarray, place: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers in (0, 1) from a 64-bit mix of the row key, a place in the row and the purpose."""
    with np.errstate(over="ignore"):
        return _mixed(key + (place.astype(np.uint64) + np.uint64(1)) * PLACE + np.uint64(purpose + 1) * PURPOSE)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64 bits, whose array is used up."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out /= float(1 << 52)
    return out


def below(top: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel number of that location under the condition that it is below ``top``."""
    with np.errstate(invalid="ignore"):
        drawn = -np.logaddexp(-top, np.log(-np.log(u)) - location)
    return np.where(np.isneginf(location), -np.inf, drawn)


# ---- the search ---------------------------------------------------------------------------------------------------


@dataclass
class Texts:
    """A batch of texts as occurrences of distinct pre-tokens, with places counted in characters of the batch."""

    key: np.ndarray
    start: np.ndarray
    occurrence: np.ndarray
    place: np.ndarray
    row: np.ndarray
    lattice: Lattice
    size: int


@dataclass
class Entry:
    """A subtree on the agenda: paths that follow sample ``origin`` up to a place and take none of ``taken`` there."""

    bound: float
    origin: int
    place: int
    before: float
    taken: list[int]


def lay_out(store: Store, keys: np.ndarray, texts: list[str]) -> Texts:
    split = [pre_tokens(text) for text in texts]
    chars = [len(text) + 1 if text else 0 for text in texts]
    occurrence = store.numbers(split)
    lattice = store.lattice()
    sizes = np.diff(lattice.node_of)[occurrence] - 1
    place = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(occurrence) else occurrence
    start = np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(tokens) for tokens in split])
    return Texts(keys, start, occurrence, place, row, lattice, int(start[-1]))


def descend(texts: Texts, path: np.ndarray, row: np.ndarray, node: np.ndarray, end: np.ndarray, place: np.ndarray,
            sample: int) -> None:
    """Follow the lattice from each node to the end of its pre-token, and write the edges taken into ``path``."""
    lattice = texts.lattice
    first, running = lattice.first, lattice.running
    with np.errstate(over="ignore"):  # what stays the same of a pre-token's hashes as it goes on
        base = (texts.key - (texts.start[:-1].astype(np.uint64) - np.uint64(1)) * PLACE + np.uint64(2 * sample + 1) * PURPOSE).take(row)
    while len(node):
        u = _mixed(base + place.astype(np.uint64) * PLACE)
        edge = first.take(node)
        last = first.take(node + 1) - 1
        wait = np.flatnonzero((u > running.take(edge)) & (edge < last))
        if len(wait):
            at, u, last = edge.take(wait), u.take(wait), last.take(wait)
            while len(wait):
                at += 1
                more = (u > running.take(at)) & (at < last)
                done = ~more
                edge[wait[done]] = at[done]
                wait, at, u, last = wait[more], at[more], u[more], last[more]
        path[place] = edge
        reached = lattice.edge_to.take(edge)
        place = place + (reached - node)
        node = reached
        more = node < end
        if not more.all():
            base, node, end, place = base[more], node[more], end[more], place[more]


def sample_paths(texts: Texts, samples: int = SAMPLES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Paths by sample, as the edge at each place where a piece starts, else -1; perturbed and log probabilities, one
    column for each sample and -inf where there is none; and the threshold of each text."""
    lattice, n = texts.lattice, len(texts.key)
    rows = np.arange(n)
    ends = lattice.node_of[texts.occurrence + 1] - 1
    starts = lattice.node_of[texts.occurrence]
    paths: list[np.ndarray] = []
    perturbed, logp = np.full((n, samples), -np.inf), np.full((n, samples), -np.inf)
    width = DEPTH + 1
    agenda = np.full((n, samples * width), -np.inf)
    node_place = np.full((n, samples * width), -1, np.int64)
    before = np.zeros((n, samples * width))
    left_out: dict[tuple[int, int], list[int]] = {}
    split: dict[int, list[Entry]] = {}
    for s in range(samples):
        path = np.full(texts.size, -1, np.int64) if s == 0 else paths[-1].copy()
        if s == 0:
            top = -np.log(-np.log(uniform(texts.key, np.zeros(n), 1)))
            descend(texts, path, texts.row, starts, ends, texts.place, 0)
            fresh_from = texts.start[:-1].copy()
            alive = np.ones(n, bool)
        else:
            entry = agenda.argmax(1)
            top = agenda[rows, entry]
            for i, entries in split.items():
                top[i] = max(top[i], *(x.bound for x in entries))
            alive = top > -np.inf
            fresh_from = texts.start[1:].copy()
            pivot = []
            for i in np.flatnonzero(alive).tolist():
                e = int(entry[i])
                a, b = texts.start[i], texts.start[i + 1]
                if i in split and top[i] > agenda[i, e]:
                    popped = max(split[i], key=lambda x: x.bound)
                    split[i].remove(popped)
                    index = None
                elif e % width == DEPTH:
                    popped = _split_tail(texts, paths, i, e, width, node_place[i, e], before[i, e], top[i], split, samples)
                    agenda[i, e] = -np.inf
                    index = None
                else:
                    here = int(node_place[i, e])
                    taken = left_out.get((i, e), [int(paths[e // width][here])])
                    popped = Entry(top[i], e // width, here, before[i, e], taken)
                    index = e
                here = popped.place
                path[a:b] = paths[popped.origin][a:b]
                u = uniform(np.repeat(texts.key[i], 2), np.array([here - a, here - a]), 2 * s + 1)
                edge, rest = _other_edge(lattice, popped.taken, float(u[0]))
                again = uniform(texts.key[i : i + 1], np.array([here - a]), 8 * samples + s)
                with np.errstate(divide="ignore"):
                    bound = below(top[i : i + 1], np.array([popped.before + np.log(rest)]), again)[0]
                if index is not None:
                    left_out[(i, index)] = [*popped.taken, edge]
                    agenda[i, index] = bound
                elif bound > -np.inf:
                    split[i].append(Entry(bound, popped.origin, here, popped.before, [*popped.taken, edge]))
                if i in split and not split[i]:
                    del split[i]
                path[here:b] = -1
                path[here] = edge
                fresh_from[i] = here + 1
                pivot.append((i, here, edge))
            if pivot:
                row, here, edge = (np.array(c, np.int64) for c in zip(*pivot, strict=True))
                at = np.searchsorted(texts.place, here, "right") - 1
                reached = lattice.edge_to[edge]
                open_ = reached < ends[at]
                later = np.flatnonzero((texts.place >= fresh_from[texts.row]) & alive[texts.row])
                descend(
                    texts,
                    path,
                    np.concatenate([row[open_], texts.row[later]]),
                    np.concatenate([reached[open_], starts[later]]),
                    np.concatenate([ends[at][open_], ends[later]]),
                    np.concatenate([(here + reached - lattice.edge_from[edge])[open_], texts.place[later]]),
                    s,
                )
        paths.append(path)
        taken_at = np.flatnonzero(path >= 0)
        chosen = path[taken_at]
        gain = np.log(np.minimum(lattice.chance[chosen], 1.0))
        row_of = np.repeat(rows, np.diff(np.searchsorted(taken_at, texts.start)))
        sums = np.bincount(row_of, gain, n)
        perturbed[:, s] = np.where(alive, top, -np.inf)
        logp[:, s] = np.where(alive, sums, -np.inf)
        _leave(texts, s, width, taken_at, chosen, gain, row_of, fresh_from, alive, top, sums, agenda,
               node_place, before, samples)
    threshold = agenda.max(1)
    for i, entries in split.items():
        threshold[i] = max(threshold[i], *(x.bound for x in entries))
    return paths, perturbed, logp, threshold


def _leave(texts, s, width, taken_at, chosen, gain, row_of, fresh_from, alive, top, sums, agenda, node_place, before,
           samples) -> None:
    """Put what a descent leaves on the agenda: at each of its first nodes the other edges, and all beyond as one entry."""
    lattice, n = texts.lattice, len(texts.key)
    running = np.cumsum(gain) - gain
    head = np.searchsorted(taken_at, texts.start[:-1])
    base = np.where(head < len(running), running[np.minimum(head, len(running) - 1)], 0.0) if len(running) else np.zeros(n)
    fresh = np.searchsorted(taken_at, fresh_from)
    step = np.arange(len(taken_at)) - fresh[row_of] if len(taken_at) else np.zeros(0, np.int64)
    near = np.flatnonzero((step >= 0) & (step <= DEPTH) & alive[row_of])
    i, t = row_of[near], s * width + step[near]
    prefix = running[near] - base[i]
    chance = lattice.chance[chosen[near]]
    degree = lattice.first[lattice.edge_from[chosen[near]] + 1] - lattice.first[lattice.edge_from[chosen[near]]]
    rest = np.where(degree > 1, np.maximum(1 - chance, 0), 0)
    tail = step[near] == DEPTH
    with np.errstate(divide="ignore"):
        beyond = np.log(np.maximum(-np.expm1(np.minimum(sums[i] - prefix, 0)), 0))
        place = prefix + np.where(tail, beyond, np.log(rest))
    u = uniform(texts.key[i], t, 4 * samples + samples + s)
    agenda[i, t] = below(top[i], place, u)
    node_place[i, t] = taken_at[near]
    before[i, t] = prefix


def _other_edge(lattice: Lattice, taken: list[int], u: float) -> tuple[int, float]:
    """An edge of the same node outside ``taken``, and the chance of all that are then still left out."""
    node = lattice.edge_from[taken[0]]
    edges = [e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in taken]
    chances = lattice.chance[edges]
    at = min(int(np.searchsorted(np.cumsum(chances), u * chances.sum())), len(edges) - 1)
    return edges[at], float(chances.sum() - chances[at]) if len(edges) > 1 else 0.0


def _split_tail(texts, paths, i, e, width, here, prefix, top, split, samples) -> Entry:
    """Split a far entry by the node where its paths leave the known one; the node that gets its maximum is returned."""
    lattice, origin = texts.lattice, paths[e // width]
    a, b = texts.start[i], texts.start[i + 1]
    places = here + np.flatnonzero(origin[here:b] >= 0)
    chances = lattice.chance[origin[places]]
    before = prefix + np.cumsum(np.log(np.minimum(chances, 1.0))) - np.log(np.minimum(chances, 1.0))
    node = lattice.edge_from[origin[places]]
    rest = np.where(lattice.first[node + 1] - lattice.first[node] > 1, np.maximum(1 - chances, 0), 0)
    mass = np.exp(before - prefix) * rest
    u = uniform(texts.key[i : i + 1], np.array([e]), 9 * samples)[0]
    at = min(int(np.searchsorted(np.cumsum(mass), u * mass.sum())), len(places) - 1)
    with np.errstate(divide="ignore"):
        location = before + np.log(rest)
    bounds = below(np.full(len(places), top), location, uniform(np.repeat(texts.key[i], len(places)), places - a, 10 * samples + e))
    entry = lambda j: Entry(bounds[j], e // width, int(places[j]), before[j], [int(origin[places[j]])])
    bounds[at] = -np.inf
    # each sample takes one entry and the threshold one more, so no more than these can ever be asked for
    most = min(samples + 1, len(places))
    best = np.argpartition(bounds, len(places) - most)[len(places) - most :]
    split.setdefault(i, []).extend(entry(j) for j in best.tolist() if bounds[j] > -np.inf)
    return entry(at)


def inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The log probability that a path's perturbed score passes the threshold."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        gap = np.exp(np.minimum(logp - threshold, 700))
        value = np.where(gap < 1e-8, logp - threshold, np.log(-np.expm1(-gap)))
    return np.where(np.isneginf(threshold), 0.0, value)


# ---- ids and decoding ---------------------------------------------------------------------------------------------


class Codec:
    """Piece ids of paths, and the bytes of ids."""

    def __init__(self, pieces: Pieces):
        self.byte_ids = np.array(pieces.byte_ids, np.int32)
        top = max([*pieces.ids.values(), *pieces.byte_ids]) + 1
        parts = [b""] * top
        for text, i in pieces.ids.items():
            parts[i] = text.encode()
        for value, i in enumerate(pieces.byte_ids):
            parts[i] = bytes([value])
        self.sizes = np.fromiter(map(len, parts), np.int64, top)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def ids(self, edge_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for edges, unknown characters as their bytes, and how many ids each edge has."""
        counts = np.ones(len(edge_ids), np.int64)
        odd = np.flatnonzero(edge_ids < 0)
        if not len(odd):
            return edge_ids.astype(np.int32), counts
        coded = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in edge_ids[odd].tolist()]
        counts[odd] = [len(c) for c in coded]
        out = np.repeat(edge_ids, counts)
        out[np.repeat(edge_ids < 0, counts)] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out.astype(np.int32), counts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        starts = self.offsets[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else sizes
        return self.flat[np.repeat(starts, sizes) + np.arange(int(sizes.sum()))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of an encoded one: the bytes of its pieces without the space in front."""
        return self.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "surrogatepass")[1:]


IDS = {"array": "ids array<int>", "packed": "ids binary", "hash": "ids_hash string", "both": "ids binary, ids_hash string"}
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def encoded(
    docs: DataFrame,
    samples: int = SAMPLES,
    model: str = DEFAULT_MODEL,
    sharpness: float = SHARPNESS,
    ids: str = "array",
) -> DataFrame:
    """One row for each text and sample: piece ids, probabilities, and whether decoding restores the text.

    ``ids`` is "array" for integers, "packed" for their little-endian 32-bit words compressed by zstandard, "hash" for
    a 128-bit hash of those words, or "both" for the two last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model, tails=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, codec = _tools(shared.value)
        store = Store(walker, sharpness)
        for batch in blocks(batches, "text", BLOCK):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield encode_block(store, codec, batch.column(0).to_pylist(), texts, samples, ids)

    return docs.select("doc_id", "text").mapInArrow(run, f"{SCHEMA}, {IDS[ids]}")


def _tools(pieces: Pieces) -> tuple[Walker, Codec]:
    """The walker and the codec of a broadcast vocabulary, made once in a worker and kept with it for its next tasks."""
    if pieces.tools is None:
        pieces.tools = (Walker(pieces), Codec(pieces))
    return pieces.tools


def row_key(doc_id: int | None, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) ^ xxhash.xxh64_intdigest(str(doc_id), 11)


def encode_block(store: Store, codec: Codec, doc_ids: list, texts: list[str], samples: int, kind: str) -> pa.RecordBatch:
    keys = np.fromiter((row_key(d, t) for d, t in zip(doc_ids, texts, strict=True)), np.uint64, len(texts))
    laid = lay_out(store, keys, texts)
    paths, perturbed, logp, threshold = sample_paths(laid, samples)
    raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    whole = np.frombuffer(b"".join(raw), np.uint8)
    row_bytes = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rows: list[tuple] = []
    small = zstandard.ZstdCompressor(level=1)
    forms = {
        "array": lambda own: own,
        "packed": lambda own: small.compress(own.astype("<i4").tobytes()),
        "hash": lambda own: xxhash.xxh3_128_hexdigest(own.astype("<i4").tobytes()),
    }
    form = [forms[f] for f in (("packed", "hash") if kind == "both" else (kind,))]
    for s, path in enumerate(paths):
        alive = perturbed[:, s] > -np.inf
        taken = np.flatnonzero(path >= 0)
        ids, counts = codec.ids(laid.lattice.edge_id[path[taken]])
        edge_at = np.searchsorted(taken, laid.start)
        id_at = np.concatenate([[0], np.cumsum(counts)])[edge_at]
        decoded = codec.bytes_of(ids)
        size_at = np.concatenate([[0], np.cumsum(codec.sizes[ids])])[id_at]
        if len(decoded) == len(whole):
            wrong = np.concatenate([[0], np.cumsum(decoded != whole)])
            same = (np.diff(wrong[row_bytes]) == 0) & (np.diff(size_at) == np.diff(row_bytes))
        else:
            same = np.array([decoded[a:b].tobytes() == r for a, b, r in zip(size_at[:-1], size_at[1:], raw, strict=True)])
        score = inclusion(logp[:, s], threshold)
        for i in np.flatnonzero(alive).tolist():
            own = ids[id_at[i] : id_at[i + 1]]
            rows.append(
                (doc_ids[i], s, len(own), logp[i, s], perturbed[i, s], score[i], bool(same[i]),
                 *(f(own) for f in form))
            )
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    types += {"array": [pa.list_(pa.int32())], "packed": [pa.binary()], "hash": [pa.string()], "both": [pa.binary(), pa.string()]}[kind]
    names = [c.split()[0] for c in f"{SCHEMA}, {IDS[kind]}".split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def unpacked(ids: list[int] | bytes | None) -> np.ndarray:
    """Ids from either form of the column."""
    if isinstance(ids, bytes):
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<i4").astype(np.int64)
    return np.array(ids or [], np.int64)


def decoded(rows: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``rows`` with the text that their ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [codec.decode(unpacked(ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts)], [*batch.schema.names, "decoded"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, columns + ", decoded string")


def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every whole text: their ids, which ``decoded`` turns into the text again, and a hash of these."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, ids="both")
