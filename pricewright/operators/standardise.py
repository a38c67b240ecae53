"""Typing of catalogue columns: one decision for each concept, and its cells converted to match.

Cells come long, as (row_id, concept, value). They are counted by value, and a value is parsed once, however many cells have
it. One aggregate over the values and one over the units in them decide what a concept is; the decisions, one row for each
concept, meet the values, and what these were read as meets the cells. The order of the decisions is: triples of
sides, measures with a unit, yes and no, colours by name, identifiers and free text, which go, and categories.

Defined cases: null cells count only against coverage; a concept filled in less than ``COVERAGE`` of the rows goes, and so
does a produced feature; of dimensions that fit a concept equally well the first in the lexicon counts; measures far beyond
the bulk of their feature become null; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions import parse
from pricewright.functions.units import NO_UNIT, lexicon_table
from pricewright.operators.typing import without_extremes
from pricewright.sources.steps import dropped, stored

#: Shares of cells from which a concept is of a kind, and the longest and most varied categories.
TRIPLES, NUMERIC, JUNK_UNITS, FITTING, RANGES, FLAGS = 0.4, 0.5, 0.3, 0.5, 0.05, 0.6
CODES, ARTICLES, DISTINCT, LONG_TEXT = 0.3, 0.5, 0.9, 120
COVERAGE = 0.02
#: Forms of product codes and of article numbers.
CODE, ARTICLE = r"(?i)^b0[a-z0-9]{8}$", r"^[0-9]{8,14}$"


def identifier_statistics(value: Column) -> dict[str, Column]:
    """Aggregates that tell identifiers and free text from categories: shares of two code forms, distinctness, length."""
    share = lambda form: F.avg(value.rlike(form).cast("double"))
    distinct = F.countDistinct(value) / F.count(value)
    return {"codes": share(CODE), "articles": share(ARTICLE), "distinct": distinct, "length": F.avg(F.length(value))}


def value_counts(cells: DataFrame) -> DataFrame:
    """(concept, value, n): how many cells have each value."""
    return cells.groupBy("concept", "value").agg(F.count("*").alias("n"))


def unit_counts(cells: DataFrame) -> DataFrame:
    """(concept, unit, n): how often each word stands after a number."""
    return _counted_units(value_counts(cells))


def _counted_units(values: DataFrame) -> DataFrame:
    units = values.select("concept", "n", F.explode(parse.pairs(F.col("value"))).alias("pair"))
    return units.groupBy("concept", F.col("pair.unit").alias("unit")).agg(F.sum("n").alias("n"))


def dimensions(counts: DataFrame) -> DataFrame:
    """(concept, dimension, fitting, junk): the dimension that knows the largest share of a concept's units."""
    totals = counts.groupBy("concept").agg(
        F.sum("n").alias("total"), (F.sum(F.when(F.col("unit").isin(*NO_UNIT), F.col("n")).otherwise(0)) / F.sum("n")).alias("junk")
    )
    known = counts.join(F.broadcast(lexicon_table(counts.sparkSession)), "unit")  # the lexicon, of fixed size
    fits = known.groupBy("concept", "dimension", "priority").agg(F.sum("n").alias("known"))
    best = fits.groupBy("concept").agg(F.max(F.struct("known", -F.col("priority"), "dimension")).alias("best"))
    found = totals.join(best, "concept", "left")
    share = F.coalesce(F.col("best.known") / F.col("total"), F.lit(0.0))
    return found.select("concept", F.col("best.dimension").alias("dimension"), share.alias("fitting"), "junk")


def verdicts(values: DataFrame, n_rows: int, coverage: float = COVERAGE) -> DataFrame:
    """One row for each concept of (concept, value, n): what it is, its dimension if it is a measure, and the figures that say so."""
    value, n = F.col("value"), F.col("n")
    mean = lambda x: F.sum(n * x.cast("long")) / F.sum(n)
    stats = values.groupBy("concept").agg(
        F.sum(n).alias("n"),
        mean(value.rlike(r"^\s*[+-]?[0-9]")).alias("numeric"),
        mean(value.rlike(parse.TRIPLE)).alias("triples"),
        mean(parse.flag(value).isNotNull()).alias("flags"),
        mean(value.rlike(CODE)).alias("codes"),
        mean(value.rlike(ARTICLE)).alias("articles"),
        (F.count("*") / F.sum(n)).alias("distinct"),
        mean(F.length(value)).alias("length"),
    )
    stats = stats.where(F.col("n") >= coverage * n_rows).join(dimensions(_counted_units(values)), "concept", "left")
    number = F.col("numeric") >= NUMERIC
    free = (F.col("codes") > CODES) | (F.col("articles") > ARTICLES) | (F.col("distinct") > DISTINCT) | (F.col("length") > LONG_TEXT)
    kind = (
        F.when(F.col("triples") > TRIPLES, "sides")
        .when(number & (F.col("junk") > JUNK_UNITS), "no measure")
        .when(number & (F.col("fitting") >= FITTING), "measure")
        .when(F.col("flags") >= FLAGS, "bool")
        .when(F.col("concept").rlike("colou?r"), "color")
        .when(free, "identifier")
        .otherwise("category")
    )
    return stats.withColumn("kind", kind).withColumn("coverage", F.col("n") / n_rows)


@dataclass
class Standardised:
    """Long typed features (row_id, feature, number, flag, label), a dictionary of them, and a verdict for each concept."""

    features: DataFrame
    dictionary: DataFrame
    report: DataFrame


#: A typed cell of a concept: its feature, and the value in the column of its type.
_EMPTY = {"number": "double", "flag": "boolean", "label": "string"}


def _typed(rows: DataFrame, key: str, name: Column, column: str, value: Column) -> DataFrame:
    parts = [(value if c == column else F.lit(None)).cast(t).alias(c) for c, t in _EMPTY.items()]
    return rows.select(key, "concept", "kind", name.alias("feature"), *parts)


def _read_measures(values: DataFrame) -> DataFrame:
    """Values of measures with the first, least and largest of their numbers in the base unit.

    The factors come by a join with the lexicon, of fixed size; numbers with units of other dimensions go.
    """
    each = values.select("concept", "kind", "dimension", F.col("value").alias("cell"), F.posexplode(parse.pairs(F.col("value"))).alias("at", "pair"))
    each = each.select("concept", "kind", "dimension", "cell", "at", "pair.value", "pair.unit")
    known = each.join(F.broadcast(lexicon_table(values.sparkSession)), ["dimension", "unit"])
    value = F.col("value") * F.col("factor")
    return known.groupBy("concept", "kind", "dimension", F.col("cell").alias("value")).agg(
        F.min("at").alias("at"), F.min_by(value, "at").alias("first"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def _measured(cells: DataFrame, read: DataFrame) -> DataFrame:
    """Rows with the first, least and largest of a measure's numbers, over all cells that a row has for it."""
    return cells.join(read, ["concept", "value"]).groupBy("row_id", "concept", "kind", "dimension").agg(
        F.min_by("first", "at").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _measures(rows: DataFrame, is_range: Column) -> DataFrame:
    ends = F.when(is_range, F.array(*[F.struct(F.lit(e).alias("end"), F.col(c).alias("x")) for e, c in (("_min", "low"), ("_max", "high"))]))
    whole = F.array(F.struct(F.lit("").alias("end"), F.col("first").alias("x")))
    each = rows.withColumn("f", F.explode(F.coalesce(ends, whole)))
    return _typed(each, "row_id", F.concat("concept", F.lit("__"), "dimension", "f.end"), "number", F.col("f.x"))


def _sides(values: DataFrame) -> DataFrame:
    rows = values.where("kind = 'sides'").withColumn("s", parse.triple_mm(F.col("value"))).where("s is not null")
    each = rows.select("value", "concept", "kind", F.posexplode("s").alias("at", "x"))
    names = F.array(*[F.lit(f"__{s}_mm") for s in ("depth", "width", "height")])
    return _typed(each, "value", F.concat("concept", F.get(names, F.col("at"))), "number", F.col("x"))


def _flags(values: DataFrame) -> DataFrame:
    return _typed(values.where("kind = 'bool'"), "value", F.concat("concept", F.lit("__bool")), "flag", parse.flag(F.col("value")))


def _labels(values: DataFrame) -> DataFrame:
    colours = _typed(values.where("kind = 'color'"), "value", F.concat("concept", F.lit("__color")), "label", parse.colour(F.col("value")))
    return colours.unionByName(_typed(values.where("kind = 'category'"), "value", F.col("concept"), "label", parse.unaccented(F.col("value"))))


def standardised(cells: DataFrame, n_rows: int, coverage: float = COVERAGE) -> Standardised:
    """Typed features of long cells (row_id, concept, value) of a table with ``n_rows`` rows."""
    cells = stored(cells.where("value is not null").select("row_id", "concept", "value"), "cells")
    values = stored(value_counts(cells), "values")
    found = stored(verdicts(values, n_rows, coverage), "concepts")  # read by all that follows, so that values are parsed once for it
    # decisions are one row for each concept of the schema
    placed = values.join(F.broadcast(found.select("concept", "kind", "dimension")), "concept")
    read = stored(_read_measures(placed.where("kind = 'measure'")), "read-measures")
    measured = stored(_measured(cells, read), "measured-cells")
    ranges = measured.groupBy("concept").agg((F.count_if(F.col("high") > F.col("low")) / n_rows).alias("ranges"))
    ranges = stored(ranges, "ranges")  # one row for each concept
    is_range = F.coalesce(F.col("ranges") > RANGES, F.lit(False))
    numbers = _measures(measured.join(F.broadcast(ranges), "concept", "left"), is_range)
    # a select for each kind keeps each one's code small enough to be compiled
    rest = stored(_sides(placed).unionByName(_flags(placed)).unionByName(_labels(placed)), "read-values")
    known = "number is not null or flag is not null or label is not null"
    rest = cells.join(rest.where(known), ["concept", "value"]).select(*numbers.columns)
    long = without_extremes(numbers, "number", ["feature"]).select(*numbers.columns).unionByName(rest)
    long = stored(long.where(known), "typed-cells")
    dropped(cells, values, read, measured)
    filled = long.groupBy("feature", "concept").agg((F.count("*") / n_rows).alias("coverage")).where(F.col("coverage") >= coverage)
    kind = F.when(F.col("feature").contains("__"), F.substring_index("feature", "__", -1)).otherwise(F.lit("categorical"))
    dictionary = filled.select("feature", "concept", kind.alias("type"), F.round("coverage", 3).alias("coverage"))
    features = long.join(F.broadcast(filled.select("feature")), "feature", "left_semi").drop("concept", "kind")
    report = found.join(ranges, "concept", "left").select(
        "concept", F.when((F.col("kind") == "measure") & is_range, F.lit("range")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind") == "measure", F.col("dimension")).alias("dimension"), "coverage", "fitting",
    )
    return Standardised(features, dictionary, report)
