"""Quality rules: counts of words, symbols and repeats, and robust multivariate outliers among the texts that pass them.

The base rule fails texts of few words or many repeated ones. The rest become vectors of ``NAMES``: logarithms of sizes and
square roots of shares, which bring counts near a normal shape. Each language and source gets a minimum-covariance-determinant
estimate of its own, and a text is rejected when its Mahalanobis distance from that is beyond what a normal shape would ever show
(``TAIL``).

The estimate takes concentration steps over all vectors of a group at once, as joins and sums: distances from the present
centre, a histogram of them (``FINE`` bins for each doubling) that gives the cut below which the share ``CORE`` lies, and the
moments of the vectors below it. Three starts (medians with a diagonal shape, with that of squashed and of unit vectors) go on as long
as their determinant falls, and the smallest one is taken. Its vectors within the 97.5 % ellipsoid give the final mean and
covariance. So nothing is drawn at random, no task holds a group, and only a group's moments come together.

A shape that most texts share exactly (no symbol at all, say) has no spread; ``FLOOR`` is added to each statistic's variance,
so that a trace of it is no outlier. Each distinct vector of a group counts once, so copies can't be the core on their own.

Defined cases: a null text has no words and fails; null languages and sources are groups like others; a group of fewer than
``LEAST`` distinct vectors uses the estimate of its language, a language of fewer that of all texts, and where these are
fewer too, no text is rejected; repeated rows get equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.scratch import blocks, discard, written
from pricewright.llm.words import WORD_RE

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window that may repeat.
WINDOW = 8
#: The base rule: at least so many words, and at most so many hundredths of them repeated.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The statistics, and the spread that each has at least.
NAMES = ("words", "word_length", "symbols", "repeats", "capitals", "dup_lines", "variety", "marks")
FLOOR = (0.3, 0.03, 0.05, 0.1, 0.05, 0.1, 0.02, 0.05)
#: The share of a group that its core holds, and the distinct vectors that an estimate needs.
CORE, LEAST = 0.75, 100
#: Texts this improbable under a normal shape are rejected; tails of real statistics are heavier.
TAIL = 1e-9
#: Share of normal vectors that the final moments keep.
INNER = 0.975
#: A step counts if it lowers the logarithm of the determinant by so much.
FALL = 1e-3
FINE = 256
#: Bytes of text that a worker holds as words at once.
BLOCK = 1 << 20


def words_of(text: str) -> list[str]:
    """The words of a text; the quick split is taken where it lost no other kind of space."""
    words = text.split()
    if sum(map(len, words)) + sum(map(text.count, SPACES)) == len(text):
        return words
    return WORD_RE.findall(text)


def repeated_words(words: list[str]) -> tuple[int, int]:
    """How many words lie in windows that occur twice or more, and how many words differ.

    Numbers of words become numbers of runs of two, four and eight by pairs; a text whose shorter runs all differ ends there.
    """
    number: dict[str, int] = {}
    runs = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(words) < WINDOW:
        return 0, len(number)
    step = 1
    while step < WINDOW:
        if runs.max() == len(runs) - 1:  # all differ
            return 0, len(number)
        pairs = runs[:-step] * (runs.max() + 1) + runs[step:]
        runs = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    again = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges))), len(number)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_types", "n_capitals", "n_marks")


def counts_of(text: str) -> tuple[int, ...]:
    """``COUNTS`` of a text: lines and their repeats have a word; capitals are words of two letters or more; marks end words."""
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats, types = repeated_words(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        types,
        sum(len(w) > 1 for w in words if w.isupper()),
        sum(not w[-1].isalnum() for w in words),
    )


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source) and ``COUNTS`` of every whole text."""
    rows = docs.select("doc_id", "lang", "source", F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            found = np.array([counts_of(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c) for c in found.T]], ["doc_id", "lang", "source", *COUNTS]
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3]]
    return rows.mapInArrow(run, ", ".join([*kinds, *[f"{c} long" for c in COUNTS]]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """The vector of a counted text with words, as columns of ``NAMES``, to six digits."""
    n = F.col("n_words")
    of = {
        "words": F.ln(n),
        "word_length": F.ln(F.col("word_chars") / n),
        "symbols": F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "capitals": F.sqrt(F.col("n_capitals") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        "variety": F.ln(F.col("n_types")) / F.ln(F.greatest(n, F.lit(2))),
        "marks": F.sqrt(F.col("n_marks") / n),
    }
    return {k: F.round(c, 6) for k, c in of.items()}


# ---- the chi-square law, for cuts and for what a cut takes from a covariance ----


def chi_square(x: float, freedom: float) -> float:
    """The probability of at most ``x``, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def quantile(probability: float, freedom: float) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, freedom) < probability:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < probability else (low, middle)
    return high


def correction(share: float, freedom: int) -> float:
    """What the covariance of the inner ``share`` of normal vectors is multiplied by to be that of all."""
    return share / chi_square(quantile(share, freedom), freedom + 2)


# ---- moments and estimates of groups ----


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def distance(names: tuple[str, ...]) -> Column:
    """The squared Mahalanobis distance from the columns ``mean`` and ``inverse`` (upper triangle by rows)."""
    away = [F.col(n) - F.get("mean", F.lit(i)) for i, n in enumerate(names)]
    terms = [(1 if i == j else 2) * F.get("inverse", F.lit(k)) * away[i] * away[j] for k, (i, j) in enumerate(_pairs(len(names)))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _moments(values: list[Column]) -> list[Column]:
    """Number, sums, and sums of products of values, as aggregates ``n``, ``sums``, ``products``."""
    products = [F.sum(values[i] * values[j]) for i, j in _pairs(len(values))]
    return [F.count("*").alias("n"), F.array(*[F.sum(v) for v in values]).alias("sums"), F.array(*products).alias("products")]


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _square(upper: np.ndarray, p: int) -> np.ndarray:
    i, j = np.triu_indices(p)
    out = np.zeros((len(upper), p, p))
    out[:, i, j] = out[:, j, i] = upper
    return out


#: What is known of a group's estimate; the determinant is a logarithm.
STATE = "key string, start int, mean array<double>, inverse array<double>, determinant double"


def _state(key: pa.Array, start: pa.Array, mean: np.ndarray, cover: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(mean.shape[1])
    inverse = np.linalg.inv(cover)[:, i, j]
    determinant = np.linalg.slogdet(cover)[1]
    columns = [key, start, pa.array(list(mean)), pa.array(list(inverse)), pa.array(determinant)]
    return pa.RecordBatch.from_arrays(columns, ["key", "start", "mean", "inverse", "determinant"])


def _estimates(moments: DataFrame, floor: tuple[float, ...], factor: float) -> DataFrame:
    """``STATE`` from moments about the former ``mean``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, sums, before = (_rows(batch.column(c)) for c in ("n", "sums", "mean"))
            shift = sums / n
            cover = _square(_rows(batch.column("products")) / n, len(floor)) - shift[:, :, None] * shift[:, None, :]
            yield _state(batch.column("key"), batch.column("start"), before + shift, cover * factor + np.diag(np.square(floor)))

    return moments.select("key", "start", "n", "sums", "products", "mean").mapInArrow(run, STATE)


def _starts(vectors: DataFrame, names: tuple[str, ...], floor: tuple[float, ...]) -> DataFrame:
    """The three first states of each group: its medians, with three shapes."""
    middle = [F.percentile_approx(n, 0.5, 1000).alias(f"m_{n}") for n in names]
    medians = written(vectors.groupBy("key").agg(*middle), "mcd-medians")
    away = vectors.join(medians, "key").select("key", *[f"m_{n}" for n in names], *[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names])
    spread = [
        F.greatest(1.4826 * F.percentile_approx(F.abs(n), 0.5, 1000), F.lit(f)).alias(f"s_{n}") for n, f in zip(names, floor, strict=True)
    ]
    spreads = written(away.groupBy("key", *[f"m_{n}" for n in names]).agg(*spread), "mcd-spreads")
    scaled = vectors.join(spreads, "key").select("key", *[((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")).alias(n) for n in names])
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    shapes = []
    for start, of in ((1, [F.tanh(n) for n in names]), (2, [F.coalesce(F.try_divide(F.col(n), length), F.lit(0.0)) for n in names])):
        shapes.append(scaled.groupBy("key").agg(*_moments(of)).withColumn("start", F.lit(start)))
    m, s = F.array(*[f"m_{n}" for n in names]).alias("mean"), F.array(*[f"s_{n}" for n in names]).alias("spread")
    both = shapes[0].unionByName(shapes[1]).join(spreads.select("key", m, s), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, sums, mean, spread = (_rows(batch.column(c)) for c in ("n", "sums", "mean", "spread"))
            shift = sums / n
            cover = _square(_rows(batch.column("products")) / n, len(names)) - shift[:, :, None] * shift[:, None, :]
            cover += 1e-3 * np.eye(len(names))
            scale = 1 / np.sqrt(np.diagonal(cover, axis1=1, axis2=2))
            shape = cover * scale[:, :, None] * scale[:, None, :] * spread[:, :, None] * spread[:, None, :]
            yield _state(batch.column("key"), batch.column("start"), mean, shape)
            first = pa.array(np.flatnonzero(batch.column("start").to_numpy() == 1))
            plain = spread[first.to_numpy(), :, None] ** 2 * np.eye(len(names))
            zero = pa.array(np.zeros(len(first)), pa.int32())
            yield _state(batch.column("key").take(first), zero, mean[first.to_numpy()], plain)

    return written(both.select("key", "start", "n", "sums", "products", "mean", "spread").mapInArrow(run, STATE), "mcd-states")


def _step(vectors: DataFrame, states: DataFrame, names: tuple[str, ...], floor: tuple[float, ...], core: float) -> DataFrame:
    """The estimates of the vectors that lie nearest under each state."""
    rows = vectors.join(states.select("key", "start", "mean", "inverse"), "key")
    rows = rows.withColumn("bin", F.floor(F.log2(F.greatest(distance(names), F.lit(1e-12))) * FINE).cast("int"))
    bins = rows.groupBy("key", "start", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "start")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = bins.withColumns({"upto": upto, "all": F.sum("n").over(group)}).where(F.col("upto") >= F.ceil(F.col("all") * core))
    cuts = held.groupBy("key", "start").agg(F.min("bin").alias("cut"))
    inner = rows.join(cuts, ["key", "start"]).where("bin <= cut")
    away = [F.col(n) - F.get("mean", F.lit(i)) for i, n in enumerate(names)]
    moments = inner.groupBy("key", "start").agg(*_moments(away), F.first("mean").alias("mean"))
    return written(_estimates(moments, floor, 1.0), "mcd-states")


def minimum_determinant(vectors: DataFrame, floor: tuple[float, ...], core: float = CORE) -> DataFrame:
    """``STATE`` of each ``key``: the reweighted minimum-covariance-determinant estimate of its vectors (columns beside key)."""
    names = tuple(c for c in vectors.columns if c != "key")
    p, held = len(names), ["key", "start", "determinant"]
    states = going = _starts(vectors, names, floor)
    best = None
    while going.limit(1).count():
        new = _step(vectors, going, names, floor, core)
        if best is None:  # a start's own determinant is not one of a core
            best = going = new
            continue
        old = going.select("key", "start", F.col("determinant").alias("before"))
        fallen = written(new.join(old, ["key", "start"]).where(F.col("determinant") < F.col("before") - FALL).drop("before"), "mcd-states")
        kept = best.join(fallen.select("key", "start"), ["key", "start"], "left_anti")
        best, going = written(kept.unionByName(fallen), "mcd-states"), fallen
    if best is None:
        return states
    first = F.row_number().over(Window.partitionBy("key").orderBy("determinant", "start"))
    raw = written(best.withColumn("place", first).where("place = 1").drop("place"), "mcd-raw")
    scale = correction(core, p)
    rows = vectors.join(raw.select(*held[:2], "mean", "inverse"), "key").where(distance(names) / scale <= quantile(INNER, p))
    away = [F.col(n) - F.get("mean", F.lit(i)) for i, n in enumerate(names)]
    moments = rows.groupBy("key", "start").agg(*_moments(away), F.first("mean").alias("mean"))
    final = written(_estimates(moments, floor, correction(INNER, p)), "mcd-estimates")
    discard(states, best, raw)
    return final


# ---- verdicts ----


def _key(level: int, *names: str) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *names))


LEVELS = (("lang", "source"), ("lang",), ())


def judged(counts: DataFrame, least: int = LEAST, core: float = CORE, tail: float = TAIL) -> DataFrame:
    """Add base_failed, level (the columns that its estimate goes by; null without one), distance and kept to counted texts."""
    of = statistics()
    passed = counts.where(~base_failed()).select("lang", "source", *[c.alias(n) for n, c in of.items()])
    distinct = written(passed.distinct(), "rules-vectors")
    levels = [distinct.select(_key(k, *names).alias("key"), *NAMES).distinct() for k, names in enumerate(LEVELS)]
    sizes = [rows.groupBy("key").agg(F.count("*").alias(f"n_{k}")) for k, rows in enumerate(levels)]
    plan = distinct.select("lang", "source").distinct().select(*[_key(k, *names).alias(f"key_{k}") for k, names in enumerate(LEVELS)])
    for k, size in enumerate(sizes):
        plan = plan.join(size.withColumnRenamed("key", f"key_{k}"), f"key_{k}")
    chosen = F.coalesce(*[F.when(F.col(f"n_{k}") >= least, F.struct(F.lit(k).alias("level"), F.col(f"key_{k}").alias("key"))) for k in range(3)])
    plan = written(plan.select("key_0", chosen.alias("of")).select("key_0", "of.level", "of.key"), "rules-plan")
    vectors = levels[0].unionByName(levels[1]).unionByName(levels[2])
    vectors = written(vectors.join(plan.select("key").distinct(), "key", "left_semi"), "rules-vectors")
    found = minimum_determinant(vectors, FLOOR, core).select("key", "mean", "inverse")
    counts = counts.withColumns({"base_failed": base_failed(), "key_0": _key(0, "lang", "source")})
    rows = counts.join(plan, "key_0", "left").join(found, "key", "left")
    rows = rows.withColumns({n: F.when(~F.col("base_failed"), c) for n, c in of.items()}).withColumn("distance", distance(NAMES))
    rows = rows.withColumn("distance", F.when(~F.col("base_failed") & F.col("mean").isNotNull(), F.col("distance")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - tail, len(NAMES)), F.lit(True))
    level = F.get(F.array(*[F.lit(" ".join(names) or "all") for names in LEVELS]), "level")
    return rows.withColumns({"kept": kept, "level": level}).drop("key", "key_0", "mean", "inverse", *NAMES)


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rules-counts")
    rows = judged(counts)
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "kept", "lang", "source", "level", "distance")
