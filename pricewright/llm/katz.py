"""Language-model scoring by Katz backoff over word trigrams.

Counts are discounted by Good-Turing up to ``CUTOFF``, for each order of n-grams by itself: the numbers of items seen once,
twice and so on are smoothed by a straight line through their logarithms, each divided by the width of the gap around it,
and the line's slope gives the discount ratios. What the discounts free in a context goes to the words not seen after it, in
proportion to their probabilities one order lower, with a weight that makes the context's probabilities sum to one exactly.
Unigrams leave their freed mass to one class of unknown words. A token's probability is evaluated recursively: the trigram if
it was seen, otherwise the weight of its two-word context times the bigram's probability, which goes on to the unigram in the
same way. The first token of a text has one mark before it and starts at the bigram.

No table of n-grams has a bound, so none is broadcast. Texts are tokenised once into a written table of chunks: word ids
local to the chunk and the hashes of its words. Each chunk then asks, in packed sorted runs of 64-bit keys, for the counts of
its distinct words and bigrams; keys are dealt by range into buckets, and one task sums a bucket and answers every chunk. It
asks in the same way for trigrams, but for those that the counts of their two bigrams settle: none without either bigram, and
one if it stands here and one of them occurs once in all training texts, unless a held-out text elsewhere may have to know. A third exchange of the same form sums, for each
context from which a held-out text may back off, what its seen words take up, and returns its weight; all that is summed are
whole numbers, how many of them have each count up to the cutoff and the counts above it, here and one order lower. Scores are then sums inside a chunk. Frequent words cost one entry for each chunk, however often they
occur. Only runs that hold a key are sent. Beyond ``DIRECT`` buckets both ways lead over wide ranges of about the square root
of their number, where sets of chunks meet, so that a chunk sends no more runs than that.

N-grams are known by 64-bit hashes: with a billion of them a single collision has odds of about one in forty.

Defined cases: null and blank texts consist of the end token; rows that repeat a doc_id are all scored, and learned from
alike; a null doc_id is never held out; a slope above ``FLATTEST``, at which Good-Turing would not discount, counts as that,
and if fewer than two different counts occur the slope is Zipf's, -2; whatever occurs more than ``CUTOFF`` times, contexts
and the whole corpus, has one more in its denominator, since its counts may all lie above the cutoff; without training rows
every token is unknown, at probability one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.scratch import lean, sliced, written

FOLDS, HELD_OUT = 7, 2
#: Counts above this are not discounted.
CUTOFF = 5
#: The line through the numbers of items of one count looks at counts up to this, and is at least so steep.
FITTED, FLATTEST, ZIPF = 64, -1.05, -2.0
#: Tokens in a chunk, but for the last document's; a task holds a few arrays of this length.
CHUNK_TOKENS = 1_250_000
#: Tokens of the corpus for each bucket of keys.
BUCKET_TOKENS = 1_250_000
#: Up to so many buckets a chunk sends its runs to them directly.
DIRECT = 2048
#: Hashes of two marks that no word equals, since they hold a space.
END, BEGIN = (xxhash.xxh64_intdigest(mark) for mark in (b" end", b" begin"))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def pack(values: np.ndarray) -> bytes:
    """Zstandard over the planes of equal bytes: the high bytes of small or sorted numbers cost next to nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Unsigned keys as their differences, which wrap around wherever the keys do not rise."""
    with np.errstate(over="ignore"):
        return pack(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


# ---- chunks -----------------------------------------------------------------------------------------------------

CHUNK = "chunk long, n_tokens long, doc_ids array<long>, lengths binary, held binary, ids binary, words binary"


def _tokenised(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 24, 0
        state = _Builder()
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                state.add(doc_id, text.as_py() or b"")
                if state.n_tokens >= chunk_tokens:
                    yield state.batch(base + number)
                    state, number = _Builder(), number + 1
        if state.doc_ids:
            yield state.batch(base + number)

    return run


class _Builder:
    """Collects documents as ids into a vocabulary of its own; 0 is the end mark and 1 the mark before a text."""

    def __init__(self) -> None:
        # a counter and not the length, which would tie the dictionary to itself and keep it until the garbage is collected
        self.place: defaultdict[bytes, int] = defaultdict(count(2).__next__)
        self.doc_ids: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        # bytes.lower() changes A to Z alone, and bytes.split() cuts at the six characters of the word rule
        found = list(map(self.place.__getitem__, text.lower().split()))
        found.append(0)
        self.doc_ids.append(doc_id)
        self.ids.append(np.array(found, np.int32))
        self.n_tokens += len(found)

    def batch(self, chunk: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        digest = xxhash.xxh64_intdigest
        words = np.fromiter((digest(w) for w in self.place), np.uint64, len(self.place))
        words = np.concatenate([np.array([END, BEGIN], np.uint64), words])
        values = [
            pa.array([chunk], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([self.doc_ids], pa.list_(pa.int64())),
            pa.array([pack(np.array([len(x) for x in self.ids], np.int32))], pa.binary()),
            pa.array([pack(np.array([held_out(d) for d in self.doc_ids], np.uint8))], pa.binary()),
            pa.array([pack(ids)], pa.binary()),
            pa.array([pack(words)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in CHUNK.split(", ")])


def _distinct(codes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, how many training entries each has, and the place of every entry's code among them."""
    order = np.argsort(codes)
    ordered = codes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(codes) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    counts = np.add.reduceat(trained[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    at = np.empty(len(codes), np.int32)
    at[order] = np.cumsum(new) - 1
    return ordered[first], counts, at


@dataclass
class Chunk:
    """A chunk's tokens with its distinct words, bigrams and trigrams, and the order of all their keys."""

    doc_ids: list
    lengths: np.ndarray
    held: np.ndarray
    ids: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(row: dict) -> Chunk:
        return Chunk(
            row["doc_ids"],
            unpack(row["lengths"], np.int32).astype(np.int64),
            unpack(row["held"], np.uint8).astype(bool),
            unpack(row["ids"], np.int32),
            unpack(row["words"], np.uint64),
        )

    def __post_init__(self) -> None:
        n = len(self.words)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = 1
        trained = np.repeat(~self.held, self.lengths)
        pairs, pair_counts, self.pair_at = _distinct(before.astype(np.int64) * n + self.ids, trained)
        self.left, self.right = np.divmod(pairs, n)
        inner = np.ones(len(self.ids), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        context = self.pair_at[self.inner - 1].astype(np.int64)
        triples, triple_counts, self.triple_at = _distinct(context * n + self.ids[self.inner], trained[self.inner])
        self.context, self.last = np.divmod(triples, n)
        # the bigram that a trigram backs off to: every trigram ends in one that stands in the text
        self.shorter = np.empty(len(triples), np.int32)
        self.shorter[self.triple_at] = self.pair_at[self.inner]
        word_counts = np.bincount(self.ids[trained], minlength=n)
        word_counts[1] = (~self.held).sum()
        pair_keys = mixed(self.words[self.left], self.words[self.right])
        keys = np.concatenate([self.words, pair_keys])
        self.triple_keys = mixed(pair_keys[self.context], self.words[self.last])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.n_words, self.counts, self.triple_counts = n, np.concatenate([word_counts, pair_counts]), triple_counts
        #: contexts that this chunk may back off from
        self.need = np.zeros(len(keys), bool)
        self.need[self.left[pair_counts == 0]] = True
        self.need[n + self.context[triple_counts == 0]] = True

    def told(self, ordered: np.ndarray) -> np.ndarray:
        """Values in the order of the keys, by word and bigram."""
        out = np.empty_like(ordered)
        out[self.order] = ordered
        return out

    def open(self, pairs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The trigrams to ask for, in the order of their keys: those whose counts the bigrams leave open, here or in a
        chunk that may back off from their context."""
        least = np.minimum(pairs[self.context], pairs[self.shorter])
        asked = (self.triple_counts == 0) | wanted[self.n_words + self.context]
        left = np.flatnonzero((least > 1) | ((least == 1) & asked))
        return left[np.argsort(self.triple_keys[left])]


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit key for an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + right
        for factor in (0xD6E8FEB86659FD93, 0xCA9B0C7EBA1DA115):
            x ^= x >> np.uint64(32)
            x *= np.uint64(factor)
        return x ^ (x >> np.uint64(32))


# ---- the exchange -------------------------------------------------------------------------------------------------

#: Runs of keys with their values, each from one chunk, one after the other.
PARTS = "part int, chunks array<long>, sizes array<long>, data array<binary>"
ANSWERS = "chunk long, part int, data array<binary>"


@dataclass(frozen=True)
class Ranges:
    """The ranges of keys that are a bucket each, and the wide ones of ``per`` buckets that lead to them."""

    buckets: int
    per: int
    sets: int

    @staticmethod
    def over(tokens: int, chunks: int, bucket_tokens: int, direct: int) -> Ranges:
        buckets = max(1, -(-tokens // bucket_tokens))
        per = 1 if buckets <= direct else isqrt(buckets)
        return Ranges(buckets, per, max(1, -(-chunks // per)))

    def edges(self, first: int, last: int, step: int) -> np.ndarray:
        return np.array([(min(b, self.buckets) << 64) // self.buckets for b in range(first, last, step)], np.uint64)

    def sent(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, start, end) of the runs of sorted keys that a chunk sends, none of them empty."""
        return _runs(keys, self.edges(0, self.buckets, self.per), 0)


def _runs(keys: np.ndarray, edges: np.ndarray, first: int) -> list[tuple[int, int, int]]:
    at = np.concatenate([np.searchsorted(keys, edges), [len(keys)]]).tolist()
    return [(first + i, a, b) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


#: The type of a run's values and how many each key has.
Kind = tuple[type, int]


def _packed(keys: np.ndarray, values: list[np.ndarray]) -> list[bytes]:
    return [pack_sorted(keys), *(pack(v.T) for v in values)]


def _values(data: bytes, kind: Kind) -> np.ndarray:
    """Values by key; several of them in columns."""
    flat = unpack(data, kind[0])
    return flat if kind[1] == 1 else flat.reshape(kind[1], -1).T


def _unpacked(data: list[bytes], kinds: tuple[Kind, ...]) -> list[np.ndarray]:
    return [unpack_sorted(data[0]), *(_values(d, k) for d, k in zip(data[1:], kinds, strict=True))]


def _parts(rows: list[tuple]) -> pa.Table:
    return _table(rows, PARTS)


def _narrow(ranges: Ranges, kinds: tuple[Kind, ...]):
    """From one wide range to its buckets, for a set of chunks."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        found: dict[int, tuple[list, list, list]] = {}
        told = table.to_pylist()
        for r in sorted((r for r in told if r["chunks"]), key=lambda r: r["chunks"]):
            columns, first = _unpacked(r["data"], kinds), r["part"] * ranges.per
            edges = ranges.edges(first, min(first + ranges.per, ranges.buckets), 1)
            for part, a, b in _runs(columns[0], edges, first):
                chunks, sizes, held = found.setdefault(part, ([], [], []))
                chunks.append(r["chunks"][0])
                sizes.append(b - a)
                held.append([c[a:b] for c in columns])
        joined = {p: [np.concatenate(c) for c in zip(*held, strict=True)] for p, (_, _, held) in found.items()}
        rows = [(p, found[p][0], found[p][1], _packed(c[0], c[1:])) for p, c in joined.items()]
        return _parts(rows + [(r["part"], None, r["sizes"], None) for r in told if not r["chunks"]])

    return run


def _widen(ranges: Ranges, kinds: tuple[Kind, ...]):
    """Answers of a wide range's buckets, put together for each chunk of a set."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        found: dict[int, list] = {}
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            columns = [_values(d, k) for d, k in zip(r["data"], kinds, strict=True)]
            ends = np.cumsum(r["sizes"]).tolist()
            for chunk, a, b in zip(r["chunks"], [0, *ends[:-1]], ends, strict=True):
                found.setdefault(chunk, []).append([c[a:b] for c in columns])
        wide = table["part"][0].as_py() // ranges.per if table.num_rows else 0
        rows = [(c, wide, [pack(np.concatenate(v)) for v in zip(*held, strict=True)]) for c, held in found.items()]
        return _table(rows, ANSWERS)

    return run


def _set(ranges: Ranges):
    return F.pmod(F.xxhash64(F.get("chunks", F.lit(0))), F.lit(ranges.sets))


def to_buckets(sent: DataFrame, ranges: Ranges, kinds: tuple[Kind, ...]) -> DataFrame:
    if ranges.per == 1:
        return sent
    return sent.groupBy("part", _set(ranges).alias("set")).applyInArrow(_narrow(ranges, kinds), PARTS)  # null: a set too


def to_chunks(answers: DataFrame, ranges: Ranges, kinds: tuple[Kind, ...]) -> DataFrame:
    if ranges.per == 1:
        return answers.select(F.get("chunks", F.lit(0)).alias("chunk"), "part", "data")
    # the set is that of the run's first chunk, as on the way here
    wide = F.floor(F.col("part") / ranges.per).alias("wide")
    return answers.groupBy(wide, _set(ranges).alias("set")).applyInArrow(_widen(ranges, kinds), ANSWERS)




def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<binary>": pa.list_(pa.binary()), "boolean": pa.bool_(), "double": pa.float64()}
    names = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(names, columns, strict=True)})


# ---- counts -----------------------------------------------------------------------------------------------------

ORDERS = 3


def _sent_by(chunk: int, ranges: Ranges, keys: np.ndarray, values: list[np.ndarray]) -> list[tuple]:
    """Rows of ``PARTS`` with the runs of sorted keys and their values."""
    return [(p, [chunk], [b - a], _packed(keys[a:b], [v[a:b] for v in values])) for p, a, b in ranges.sent(keys)]


def _ask(ranges: Ranges):
    """Every word and bigram with its training count, its order and whether the chunk may back off from it, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk.of(row)
                order = (np.arange(len(chunk.keys)) >= chunk.n_words).astype(np.int64)
                values = (chunk.counts << 3 | order << 1 | chunk.need)[chunk.order]
                yield from _parts(_sent_by(row["chunk"], ranges, chunk.keys, [values])).combine_chunks().to_batches()

    return run


def _ask_triples(ranges: Ranges):
    """Trigrams with open counts, and one row without chunks that counts those settled as occurring once."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        out = []
        for row in chunks.to_pylist():
            chunk = Chunk.of(row)
            counts, wanted, _ = _short(chunk, answers.to_pylist())
            left = chunk.open(counts[chunk.n_words :], wanted)
            values = chunk.triple_counts[left] << 3 | 2 << 1
            out += _sent_by(row["chunk"], ranges, chunk.triple_keys[left], [values])
            settled = int((chunk.triple_counts > 0).sum() - (chunk.triple_counts[left] > 0).sum())
            stats = [0] * (2 + ORDERS * FITTED)
            stats[2 + 2 * FITTED] = settled
            out.append((0, None, stats, None))
        return _parts(out)

    return run


@dataclass
class Totals:
    """The entries of many runs by key: their order, where each key starts in it, and each entry's key number."""

    order: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    number: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Totals:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return Totals(order, first, ordered[first], np.cumsum(new) - 1)

    def sum(self, values: np.ndarray, add: np.ufunc = np.add) -> np.ndarray:
        return add.reduceat(values[self.order], self.first) if len(self.first) else values[:0]

    def each(self, by_key: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), by_key.dtype)
        out[self.order] = by_key[self.number]
        return out


def _answer(table: pa.Table) -> pa.Table:
    """The total of each key, whether any chunk may back off from it, and which chunk speaks for it, as one number."""
    lean()
    told = table.to_pylist()
    rows = sorted((r for r in told if r["chunks"]), key=lambda r: r["chunks"])
    out = [(r["part"], None, r["sizes"], None) for r in told if not r["chunks"]]
    if not rows:
        return _parts(out)
    columns = [_unpacked(r["data"], COUNTS) for r in rows]
    keys, values = (np.concatenate([c[k] for c in columns]) for k in range(2))
    del columns
    totals = Totals.of(keys)
    sums = totals.sum(values >> 3)
    order = (values[totals.order[totals.first]] >> 1) & 3
    wanted = totals.sum(values & 1, np.bitwise_or)
    real = totals.keys != np.uint64(BEGIN)
    stats = [int(sums[real & (order == 0)].sum()), int((sums[real & (order == 0)] > 0).sum())]
    for k in range(ORDERS):
        own = sums[real & (order == k)]
        stats += np.bincount(own[own <= FITTED].astype(np.int64), minlength=FITTED + 1)[1:].tolist()
    answer = totals.each(sums << 2 | wanted << 1)
    answer[totals.order[totals.first]] |= 1
    out.append((rows[0]["part"], None, stats, None))
    at = 0
    for r in rows:
        upto = at + sum(r["sizes"])
        out.append((r["part"], r["chunks"], r["sizes"], [pack(answer[at:upto])]))
        at = upto
    return _parts(out)


# ---- the model --------------------------------------------------------------------------------------------------


def slope(counts: list[int]) -> float:
    """The slope of the line through the logarithms of r and of the number of items that occur r times, from r = 1 on."""
    n = np.array(counts, float)
    r = np.flatnonzero(n) + 1
    if len(r) < 2:
        return ZIPF
    before, after = np.r_[0, r[:-1]], np.r_[r[1:], 2 * r[-1] - r[-2]]
    x, y = np.log(r), np.log(n[r - 1] / ((after - before) / 2))
    return min(float(np.polyfit(x, y, 1)[0]), FLATTEST)


def good_turing(counts: list[int]) -> tuple[float, ...]:
    """Katz's discount ratios for counts 1 to ``CUTOFF`` from the numbers of items that occur once, twice and so on.

    On the line n_r is in proportion to r**b, so Turing's (r + 1) n_(r+1) / n_r over r is (1 + 1/r)**(b + 1). Below a
    slope of -1 that lies between the share that Katz takes away, (CUTOFF + 1)**(b + 1), and 1.
    """
    power = slope(counts) + 1
    share = (CUTOFF + 1) ** power
    return tuple(((1 + 1 / r) ** power - share) / (1 - share) for r in range(1, CUTOFF + 1))


def reserve(counts: np.ndarray) -> np.ndarray:
    """The denominators of contexts."""
    return counts + (counts > CUTOFF)


@dataclass(frozen=True)
class Model:
    """The numbers that hold for the whole corpus."""

    tokens: int
    distinct: int
    ratios: tuple[tuple[float, ...], ...]
    unknown: float

    @staticmethod
    def of(stats: list[int]) -> Model:
        tokens, distinct, spectra = stats[0], stats[1], [stats[2 + k * FITTED : 2 + (k + 1) * FITTED] for k in range(ORDERS)]
        ratios = tuple(map(good_turing, spectra))
        freed = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(spectra[0], ratios[0], strict=False), 1))
        total = int(reserve(np.int64(tokens)))
        return Model(tokens, distinct, ratios, (freed + total - tokens) / total if tokens else 1.0)

    def discounted(self, counts: np.ndarray, order: int) -> np.ndarray:
        table = np.array([0.0, *self.ratios[order], 1.0])
        return table[np.minimum(counts, CUTOFF + 1)] * counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """The probability of words by their training counts; those of count 0 are one class."""
        seen = self.discounted(counts, 0) / max(int(reserve(np.int64(self.tokens))), 1)
        return np.where(counts > 0, seen, self.unknown)

    def seen(self, counts: np.ndarray, context: np.ndarray, order: int) -> np.ndarray:
        """The probabilities of n-grams that were seen, by their counts and those of their contexts; 0 for others."""
        return self.discounted(counts, order) / np.maximum(reserve(context), 1)


COUNTS: tuple[Kind, ...] = ((np.int64, 1),)
#: Of a context's seen words, how many have each count up to the cutoff, in the context and one order lower; and the sums of
#: the counts above it, likewise, with the count of the shorter context (0: that has no words).
SUMS: tuple[Kind, ...] = ((np.uint32, 2 * CUTOFF), (np.uint64, 3))
WEIGHTS: tuple[Kind, ...] = ((np.float64, 1),)


def _spectra(context: np.ndarray, n: int, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two arrays of ``SUMS`` for ``n`` contexts, from their seen words' counts."""
    small, large = np.zeros((n, 2 * CUTOFF), np.uint32), np.zeros((n, 3), np.uint64)
    for k, values in enumerate((counts, lower)):
        few = values <= CUTOFF
        cell = context[few].astype(np.int64) * CUTOFF + values[few] - 1
        small[:, k * CUTOFF : (k + 1) * CUTOFF] = np.bincount(cell, minlength=n * CUTOFF).reshape(n, CUTOFF)
        np.add.at(large[:, k], context[~few], values[~few].astype(np.uint64))
    return small, large


def _value(answers: list[dict]) -> np.ndarray:
    """The answers of one exchange in the order of their keys."""
    answers = sorted(answers, key=lambda r: r["part"])
    return np.concatenate([np.zeros(0, np.int64), *(unpack(r["data"][0], np.int64) for r in answers)])


def _short(chunk: Chunk, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in the corpus of the chunk's words and bigrams, whether they are backed off from, and whether the chunk speaks
    for them."""
    value = chunk.told(_value(answers))
    return value >> 2, (value & 2) > 0, (value & 1) > 0


def _long(chunk: Chunk, pairs: np.ndarray, wanted: np.ndarray, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Counts in the corpus of the chunk's trigrams, and whether the chunk speaks for them."""
    left = chunk.open(pairs, wanted)
    counts, mine = chunk.triple_counts.copy(), np.ones(len(chunk.triple_counts), bool)
    value = _value(answers)
    counts[left], mine[left] = value >> 2, (value & 1) > 0
    return counts, mine & (counts > 0)


def _sent(chunk: Chunk, counts: np.ndarray, wanted: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """The places, in the order of keys, of the contexts that the chunk sends and is answered for: those that it may back
    off from, and wanted ones with bigrams or trigrams that it speaks for."""
    send = chunk.need & (counts > 0)
    n = chunk.n_words
    send[chunk.left[pairs & wanted[chunk.left]]] = True
    send[n + chunk.context[triples & wanted[n + chunk.context]]] = True
    return np.flatnonzero(send[chunk.order])


@dataclass
class Told:
    """What the first two exchanges tell a chunk."""

    words: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    wanted: np.ndarray
    own_pairs: np.ndarray
    own_triples: np.ndarray
    sent: np.ndarray

    @staticmethod
    def of(chunk: Chunk, answers: list[dict]) -> Told:
        counts, wanted, mine = _short(chunk, [r for r in answers if r["step"] == 0])
        words, pairs = np.split(counts, [chunk.n_words])
        triples, own_triples = _long(chunk, pairs, wanted, [r for r in answers if r["step"] == 1])
        own_pairs = (mine & (counts > 0))[chunk.n_words :]
        sent = _sent(chunk, counts, wanted, own_pairs, own_triples)
        return Told(words, pairs, triples, wanted, own_pairs, own_triples, sent)


def _context_sums(ranges: Ranges):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        out = []
        for row in chunks.to_pylist():
            chunk = Chunk.of(row)
            told = Told.of(chunk, answers.to_pylist())
            words, pairs, n, n_pairs = told.words, told.pairs, chunk.n_words, len(told.pairs)
            use = np.flatnonzero(told.own_pairs & told.wanted[chunk.left])
            after_one = _spectra(chunk.left[use], n, pairs[use], words[chunk.right[use]])
            use = np.flatnonzero(told.own_triples & told.wanted[n + chunk.context])
            after_two = _spectra(chunk.context[use], n_pairs, told.triples[use], pairs[chunk.shorter[use]])
            asked = chunk.need[n:] & (pairs > 0)
            after_two[1][asked, 2] = words[chunk.right[asked]]
            at = chunk.order[told.sent]
            values = [np.concatenate(x)[at] for x in zip(after_one, after_two, strict=True)]
            out += _sent_by(row["chunk"], ranges, chunk.keys[told.sent], values)
        return _parts(out)

    return run


def backoff(model: Model, small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The weights of contexts by the sums over their seen words: what these leave free, here and one order lower."""
    r = np.arange(1, CUTOFF + 1)
    here, lower = small[:, :CUTOFF].astype(np.int64), small[:, CUTOFF:].astype(np.int64)
    context = here @ r + large[:, 0].astype(np.int64)
    pair = large[:, 2] > 0
    shorter = np.where(pair, large[:, 2].astype(np.int64), model.tokens)
    ratio = np.array(model.ratios)
    share = lambda counts, order: counts @ (ratio[order] * r)
    taken = np.where(pair, share(here, 2), share(here, 1)) + large[:, 0]
    seen = np.where(pair, share(lower, 1), share(lower, 0)) + large[:, 1]
    left = 1 - taken / np.maximum(reserve(context), 1)
    return np.maximum(left, 0) / np.maximum(1 - seen / np.maximum(reserve(shorter), 1), 1e-300)


def _weights(model: Model):
    """The backoff weight of each context that was sent."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        rows = sorted(table.to_pylist(), key=lambda r: r["chunks"])
        columns = [_unpacked(r["data"], SUMS) for r in rows]
        keys, small, large = (np.concatenate([c[k] for c in columns]) for k in range(3))
        del columns
        totals = Totals.of(keys)
        sums = totals.sum(large)
        # those that ask know the count of the shorter context; the others send 0
        sums[:, 2] = totals.sum(large[:, 2], np.maximum)
        weight = totals.each(backoff(model, totals.sum(small.astype(np.uint64)), sums))
        out, at = [], 0
        for r in rows:
            upto = at + sum(r["sizes"])
            out.append((r["part"], r["chunks"], r["sizes"], [pack(weight[at:upto])]))
            at = upto
        return _parts(out)

    return run


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, n_seen_pairs long, n_seen_triples long")  # fmt: skip


def _scores(model: Model):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        out = []
        for row in chunks.to_pylist():
            chunk, answered = Chunk.of(row), answers.to_pylist()
            told = Told.of(chunk, answered)
            words, pairs, triples = told.words, told.pairs, told.triples
            weight = np.ones(len(chunk.keys))
            back = sorted((r for r in answered if r["step"] == 2), key=lambda r: r["part"])
            if back:
                weight[chunk.order[told.sent]] = np.concatenate([unpack(r["data"][0], np.float64) for r in back])
            word_weight, pair_weight = np.split(weight, [chunk.n_words])
            base = np.log10((words + 1) / (model.tokens + (model.distinct + 1)))
            unigram = model.unigram(words)
            bigram = np.where(pairs > 0, model.seen(pairs, words[chunk.left], 1), word_weight[chunk.left] * unigram[chunk.right])
            context = pairs[chunk.context]
            trigram = np.where(triples > 0, model.seen(triples, context, 2), pair_weight[chunk.context] * bigram[chunk.shorter])
            score = np.log10(np.maximum(bigram, 1e-300))[chunk.pair_at]
            score[chunk.inner] = np.log10(np.maximum(trigram, 1e-300))[chunk.triple_at]
            seen_triples = np.zeros(len(chunk.ids), np.int64)
            seen_triples[chunk.inner] = (triples > 0)[chunk.triple_at]
            add = lambda values: np.add.reduceat(values, chunk.starts).tolist()
            columns = (
                chunk.doc_ids,
                chunk.held.tolist(),
                chunk.lengths.tolist(),
                add((words[chunk.ids] > 0).astype(np.int64)),
                [model.tokens] * len(chunk.doc_ids),
                add(base[chunk.ids]),
                add(score),
                add((pairs > 0)[chunk.pair_at].astype(np.int64)),
                add(seen_triples),
            )
            out += zip(*columns, strict=True)
        return _table(out, SCORES)

    return run


def scores(
    docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, direct: int = DIRECT
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_seen_pairs and n_seen_triples of each row."""
    text = F.coalesce("text", F.lit(""))
    chunks = written(docs.select("doc_id", text).mapInArrow(_tokenised(chunk_tokens), CHUNK), "lm-chunks")
    tokens, n_chunks = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    ranges = Ranges.over(tokens, n_chunks, bucket_tokens, direct)
    by_chunk = chunks.groupBy("chunk")
    exchanged = lambda sent, kinds, answer, name: written(
        to_buckets(sent, ranges, kinds).groupBy("part").applyInArrow(answer, PARTS), name
    )
    counted = exchanged(chunks.mapInArrow(_ask(ranges), PARTS), COUNTS, _answer, "lm-counts")
    short = to_chunks(counted.where("chunks is not null"), ranges, COUNTS)
    asked = by_chunk.cogroup(short.groupBy("chunk")).applyInArrow(_ask_triples(ranges), PARTS)
    longer = exchanged(asked, COUNTS, _answer, "lm-triples")
    stats = counted.unionByName(longer).where("chunks is null")
    sums = stats.agg(*[F.sum(F.get("sizes", F.lit(i))) for i in range(2 + ORDERS * FITTED)]).first()
    model = Model.of([int(x or 0) for x in sums])
    step = lambda told, k: told.withColumn("step", F.lit(k))
    counts = step(short, 0).unionByName(step(to_chunks(longer.where("chunks is not null"), ranges, COUNTS), 1))
    sent = by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(_context_sums(ranges), PARTS)
    weights = to_chunks(exchanged(sent, SUMS, _weights(model), "lm-weights"), ranges, WEIGHTS)
    every = counts.unionByName(step(weights, 2))
    return by_chunk.cogroup(every.groupBy("chunk")).applyInArrow(_scores(model), SCORES)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
