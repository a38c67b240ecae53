"""The corpus pipeline: five stages from raw documents to sampled encodings.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept. All but the last return the
columns of ``documents``.

Defined cases, for every stage: a null or empty text is a text like any other; rows that repeat a doc_id, or have none, are
rows of their own; further columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import mixing, pii, quality, segmentations, simhash
from pricewright.llm.scratch import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier, fitted on the labels of these documents, rejects.

    Without labels of both kinds every text has the same score, the share of good ones, and all stay or go by that.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates: the smallest doc_id, then the smallest hash of the row.

    Texts without words are near-duplicates of each other; of equal rows one stays.
    """
    return simhash.keep_first(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and keys by their kind, and count the characters anew; a null text stays null."""
    return pii.redact(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave out documents so that each source comes near its target.

    The null source is one like the others, last in order; texts without words are taken as their rank has it, since they
    change no size.
    """
    return mixing.mix(docs).select(*docs.columns)


def encode_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as packed piece ids; a text with one segmentation has one row."""
    return segmentations.encoded(docs, ids="packed")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_of_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_samples),
]

#: The classifier, the fingerprints and the sampling have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
