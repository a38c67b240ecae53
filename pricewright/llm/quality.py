"""Quality classifier by compression: two zstandard dictionaries, one from good text and one from bad.

A text is compressed with either dictionary and with none. The difference of the first two sizes over the plain one, the
normalised compressed-size difference, is the evidence; a logistic curve turns it into a probability that the label is 1. The
curve also has terms for the difference over the text's length, for how compressible and for how long the text is, held near
zero by ``SHRINK``, as by so many rows that speak against them, so that a small fit rests on the evidence alone.

The fit reads a bounded sample: of either label at most ``PER_CLASS`` rows, those with the smallest hashes of their doc_id,
among all labelled training rows. One half of them trains the dictionaries, on at most ``PIECES`` pieces of ``PIECE`` bytes
of either label, again those with the smallest hashes, so that a long text takes part like a short one; that and the four
numbers measured on each row of the other half are all that the driver gets. Scoring reads whole texts and nothing else.

Defined cases: null text counts as empty, in the fit as well, and gets a score like any other; a doc_id labelled both ways
trains nothing; of rows that repeat doc_id and text one trains, and rows that repeat the doc_id alone share its label; if one
label has fewer than four rows in the sample, every score is the share of label 1 in it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.scratch import sliced

PER_CLASS = 3000
PIECES, PIECE = 4096, 8192
SHRINK = 2.0
DICTIONARY = 65_536
LEVEL = 3
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None

    def scorer(self):
        """A function from a list of encoded texts to their scores."""
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        measure = evidence(self.good, self.bad)
        mean, spread, weights = (np.array(x) for x in (self.mean, self.spread, self.weights))

        def score(texts: list[bytes]) -> np.ndarray:
            values = (_terms(measure(texts)) - mean) / spread
            return 1 / (1 + np.exp(-np.clip(values @ weights[:-1] + weights[-1], -30, 30)))

        return score


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


def evidence(good: bytes, bad: bytes):
    """A function from encoded texts to rows of size difference over length and over plain size, plain ratio, log length."""
    with_good = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(good))
    with_bad = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(bad))
    plain = zstandard.ZstdCompressor(level=LEVEL)

    def measure(texts: list[bytes]) -> np.ndarray:
        sizes = np.array(
            [(len(with_good.compress(t)), len(with_bad.compress(t)), len(plain.compress(t)), max(len(t), 1)) for t in texts],
            float,
        ).reshape(-1, 4)
        gain = sizes[:, 1] - sizes[:, 0]
        return np.c_[gain / sizes[:, 3], gain / sizes[:, 2], sizes[:, 2] / sizes[:, 3], np.log(sizes[:, 3])]

    return measure


def _terms(values: np.ndarray) -> np.ndarray:
    return np.c_[values, values**2, values[:, :1] * values[:, 3:]]


#: The column of the terms that holds the normalised size difference.
MAIN = 1


def curve(good: bytes, bad: bytes, values: np.ndarray, labels: np.ndarray, steps: int = 60) -> Model:
    """A model with the curve fitted to measured evidence by penalised Newton steps."""
    values = _terms(values)
    mean, spread = values.mean(0), values.std(0) + 1e-9
    x = np.c_[(values - mean) / spread, np.ones(len(values))]
    weights, ridge = np.zeros(x.shape[1]), np.r_[np.full(values.shape[1], SHRINK), 1e-6]
    ridge[MAIN] = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - labels) + ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        weights = weights - np.linalg.solve(bend, slope)
    return Model(good, bad, tuple(mean), tuple(spread), tuple(weights))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Row]:
    """(doc_id, text_key, quality, half) of the bounded sample of labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    known = known.where(~held_out(F.col("doc_id"))).withColumn("place", F.xxhash64(F.lit("quality"), F.col("doc_id")))
    rows = docs.select("doc_id", _key().alias("text_key")).join(known.select("doc_id", "quality", "place"), "doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "text_key"), F.lit(2)).alias("half")
    found = []
    for quality in (1, 0):
        side = rows.where(F.col("quality") == quality).distinct().orderBy("place", "text_key").limit(per_class)
        found += side.select("doc_id", "text_key", "quality", half).collect()
    return found


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    chosen = sampled(docs, labels, per_class)
    counts = [sum(r["quality"] == q for r in chosen) for q in (1, 0)]
    if min(counts) < 4:
        return Model(b"", b"", constant=counts[0] / sum(counts) if sum(counts) else 0.5)
    spark = docs.sparkSession
    schema = "doc_id long, text_key long, quality int, half long"
    table = spark.createDataFrame([tuple(r) for r in chosen], schema)  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key().alias("text_key"))
    rows = rows.join(F.broadcast(table), ["doc_id", "text_key"])
    texts = rows.where("half = 0").select("doc_id", "text_key", "quality", F.col("text").cast("binary").alias("text"))
    pieces = texts.dropDuplicates(["doc_id", "text_key"]).select(
        "quality", "doc_id", "text_key", F.posexplode(_pieces("text")).alias("number", "piece")
    )
    place = F.xxhash64(F.lit("piece"), "doc_id", "text_key", "number")
    words: dict[int, list[bytes]] = {}
    for quality in (1, 0):
        side = pieces.where(F.col("quality") == quality).select(place.alias("place"), "piece")
        words[quality] = [bytes(r["piece"]) for r in side.orderBy("place").limit(PIECES).collect()]
    good, bad = _dictionary(words[1]), _dictionary(words[0])
    shared = spark.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = evidence(*shared.value)
        for batch in sliced(batches):
            values = measure([t.encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, values.T)], NAMES)

    other = rows.where("half = 1").select("quality", "doc_id", "text_key", "text")
    seen = other.mapInArrow(run, MEASURED).distinct().collect()  # at most 2 * per_class rows
    seen = np.array(sorted(tuple(r) for r in seen), float).reshape(-1, len(NAMES))
    if not 0 < seen[:, 0].sum() < len(seen):
        return Model(b"", b"", constant=counts[0] / sum(counts))
    return curve(good, bad, seen[:, 3:], seen[:, 0])


MEASURED = "quality int, doc_id long, text_key long, by_length double, by_size double, plain double, length double"
NAMES = [c.split()[0] for c in MEASURED.split(", ")]


def _pieces(text: str) -> Column:
    """A binary column cut into pieces of ``PIECE`` bytes; an empty one has one empty piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1)), F.lit(PIECE))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(PIECE)))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score and predicted, in place of any of that name; the score reads the text alone."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in sliced(batches):
            texts = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
            values = score(texts)
            columns = [*batch.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return scored(whole, model, threshold).where("predicted = 1").select("_row.*")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = scored(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
