"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the mix: its target over its size is the rate, the copies that a document of it gets on average.
The whole part of that is certain for every document, and the rest goes to a Pareto order sample of unequal inclusion
probabilities: longer documents are likelier and shorter ones less so, about a mean that, weighed by size, is the fraction
left of the rate. Documents are ranked by the odds of a uniform number over the odds of their inclusion probability, and the
sample takes ranks until it has the words asked for. The cut in the ranks is found from histograms that are refined around it,
so no task sorts a source.

Probability: chance + lean * (q - mean of q), where q = size / (size + ``HALF``) rises from 0 to 1, its mean over the source
is weighed by size, and lean is the smaller of chance and 1 - chance, so all probabilities lie within (0, 1).

Defined cases: null text has size 0; the null source comes last; the uniform number is a hash of doc_id and text, so rows that
share one of them get numbers of their own, and rows that share both (exact copies, null ids included) are ranked together:
where the cut falls among them, the first ones in the order of reading are taken, which are like the others; a document is
added whole if that brings the source nearer its target; sources without words get a target of 0; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.scratch import written
from pricewright.llm.words import word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix over the size of all documents.
SHARE = 1.5
#: No document is taken more often than this.
MOST = 2
#: Each refinement splits a range of ranks into so many.
BINS = 4096
SEED = "mix-1"
#: Words of the document that lies half way between the least and the most likely.
HALF = 512
#: Whole parts in which q is counted, so that its sums are exact.
PARTS = 1 << 20


def text_key(text: Column) -> Column:
    """The hash of a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def uniform(doc_id: Column, text_hash: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the document alone: 48 bits of MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_hash)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def leaning(size: Column) -> Column:
    """q of a size in words, in whole parts."""
    return F.floor(size * PARTS / (size + HALF))


def probability(size: Column, chance: Column, mean: Column) -> Column:
    """The inclusion probability of a document of that size; ``chance`` where that is 0."""
    return chance + F.least(chance, 1 - chance) * (leaning(size) / PARTS - mean)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size and target for each source of (source, size) rows.

    Targets are in proportion to the weights until a source would pass ``most`` times its size; what it can't take goes
    to the others in the same proportion. In order of size over weight, the capped sources come first, so one running
    sum over the table of sources finds the level of the rest.
    """
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(names)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(position - 1, F.lit(len(weights))) + 1)
    table = by_source.withColumn("position", position).withColumn("weight", weight)
    table = table.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * float(share)
    table = table.withColumn(
        "level",
        (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    free = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "position", "level"))
    table = table.withColumn("free", F.min(free).over(whole))
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("free.level"), F.col("cap")))
    return table.select("source", "source_size", target.alias("target"))


def _of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table with one row for each source, null included; Spark broadcasts it while it is small."""
    renamed = table.withColumnRenamed("source", "_source")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _ranked(rows: DataFrame) -> DataFrame:
    """Add the Pareto rank, as odds / (1 + odds) in (0, 1), and its place in the two histograms."""
    rows = rows.withColumn("_u", uniform(F.col("doc_id"), F.col("text_key")))
    rows = rows.withColumn("_p", probability(F.col("size"), F.col("chance"), F.col("mean")))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_odds", F.when(F.col("chance") > 0, odds))
    rows = rows.withColumn("rank", F.coalesce(F.col("_odds") / (1 + F.col("_odds")), F.lit(1.0)))
    rows = rows.withColumn("bin_1", F.floor(F.col("rank") * BINS))
    return rows.withColumn("bin_2", F.floor((F.col("rank") * BINS - F.col("bin_1")) * BINS)).drop("_u", "_p", "_odds")


def _cut(bins: DataFrame, name: str) -> DataFrame:
    """The bin of each source in which its sample ends, and the size taken before it."""
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("bin_size").over(order), F.lit(0))
    return (
        bins.withColumn("before", F.col("base") + running)
        .where("before + bin_size >= need")
        .groupBy("source")
        .agg(F.min(F.struct("bin", "before")).alias("cut"))
        .select("source", F.col("cut.bin").alias(name), F.col("cut.before").alias("base"))
    )


#: What the plan knows of a source beyond its size and target.
CUT = ("sure", "chance", "mean", "cut_1", "cut_2", "last_rank", "tie_rank", "tie_rows")


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each source of (doc_id, source, size, text_key) rows: its target and where its sample ends in the ranks.

    ``BINS`` bins of the ranks, then ``BINS`` bins of the one where the sample ends, leave about one row in 16 million
    of a source for the last, exact step. All of ranks up to ``last_rank`` are in the sample; if it ends among exact
    copies, ``tie_rows`` of those with rank ``tie_rank`` are too.
    """
    table = source_targets(sizes, weights, share, most)
    q = sizes.groupBy("source").agg(F.sum(F.col("size") * leaning(F.col("size"))).alias("weighed"))
    table = _of_source(table, q)
    table = table.withColumn("mean", F.coalesce(F.try_divide(F.col("weighed"), F.col("source_size") * PARTS), F.lit(0.0)))
    table = table.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    table = table.withColumn("sure", F.floor("rate").cast("int"))
    table = table.withColumn("chance", F.col("rate") - F.col("sure"))
    table = table.withColumn("need", F.col("target") - F.col("sure") * F.col("source_size"))
    table = written(table, "mix-targets")
    rows = _ranked(_of_source(sizes, table.where("chance > 0").select("source", "chance", "mean", "need")))
    weight = F.sum("size").alias("bin_size")
    bins = rows.groupBy("source", "need", F.col("bin_1").alias("bin")).agg(weight).withColumn("base", F.lit(0))
    first = written(_cut(bins, "cut_1"), "mix-cut")
    rows = _of_source(rows, first).where("bin_1 = cut_1")
    bins = rows.groupBy("source", "need", "base", F.col("bin_2").alias("bin")).agg(weight)
    second = written(_cut(bins, "cut_2"), "mix-cut")
    rows = _of_source(rows.drop("base"), second).where("bin_2 = cut_2")
    running = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ties = rows.groupBy("source", "need", "base", "rank").agg(weight, F.count("*").alias("rows"))
    ties = ties.withColumn("before", F.col("base") + F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
    empty = F.when(F.col("before") <= F.col("need"), F.col("rows")).otherwise(0)
    wanted = F.coalesce(F.try_divide((F.col("need") - F.col("before")) * F.col("rows"), "bin_size"), empty)
    ties = ties.withColumn("wanted", F.floor(F.least(wanted + 0.5, F.col("rows"))))
    part = F.when((F.col("wanted") > 0) & (F.col("wanted") < F.col("rows")), F.struct("rank", "wanted"))
    third = ties.groupBy("source").agg(
        F.max(F.when(F.col("wanted") == F.col("rows"), F.col("rank"))).alias("last_rank"), F.min(part).alias("part")
    )
    third = third.select(
        "source", "last_rank", F.col("part.rank").alias("tie_rank"), F.col("part.wanted").alias("tie_rows")
    )
    cuts = _left_of_source(_of_source(first.drop("base"), second.drop("base")), third)
    return written(_left_of_source(table, cuts), "mix-plan")


def _left_of_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    renamed = table.withColumnRenamed("source", "_source")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _last_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, last_part, last_place): where in the order of reading the copies end that a source takes of its tied rows.

    ``rows`` has the place of each row, whose high bits are its partition: partitions are counted first, then the rows of
    the one in which the copies end.
    """
    tied = planned.where("tie_rows is not null")
    rows = _ranked(_of_source(rows, tied.select("source", "chance", "mean", "tie_rank", "tie_rows"))).where("rank = tie_rank")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy("source", "tie_rows", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("before < tie_rows")
    ends = parts.groupBy("source", "tie_rows").agg(F.max(F.struct("part", "before")).alias("end"))
    ends = ends.select("source", F.col("end.part").alias("last_part"), (F.col("tie_rows") - F.col("end.before")).alias("more"))
    rows = _of_source(rows.select("source", "part", "place"), ends).where("part = last_part")
    number = F.row_number().over(Window.partitionBy("source").orderBy("place"))
    last = rows.withColumn("number", number).where("number = more")
    return last.select("source", F.col("place").alias("last_place"))


def with_copies(rows: DataFrame, planned: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Add source_size, target and copies to rows with doc_id, source, size and text_key.

    ``rows`` has a place in the order of reading, and ``kept`` the same rows as a written table, if a sample ends among
    exact copies.
    """
    rows = _ranked(_of_source(rows, planned.select("source", "source_size", "target", *CUT)))
    at_edge = (F.col("bin_2") == F.col("cut_2")) & (F.col("rank") <= F.col("last_rank"))
    inside = (F.col("bin_1") == F.col("cut_1")) & ((F.col("bin_2") < F.col("cut_2")) | at_edge)
    if kept is not None:
        rows = _left_of_source(rows, written(_last_copies(kept, planned), "mix-copies"))
        inside |= (F.col("rank") == F.col("tie_rank")) & (F.col("place") <= F.col("last_place"))
        rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(False))).drop("last_place")
    else:
        rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(False)))
    taken = (F.col("chance") > 0) & (F.col("cut_1").isNull() | (F.col("bin_1") < F.col("cut_1")) | F.col("_inside"))
    chosen = rows.withColumn("copies", F.col("sure") + F.coalesce(taken, F.lit(False)).cast("int"))
    return chosen.drop(*CUT, "rank", "bin_1", "bin_2", "_inside")


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, text_key) of documents, and more columns."""
    text = F.col("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"), text_key(text).alias("text_key"), *more)


def _among_copies(planned: DataFrame) -> bool:
    return planned.where("tie_rows is not null").limit(1).count() > 0


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    planned = plan(written(sized(docs), "mix-sizes"), weights, share, most)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    place = F.monotonically_increasing_id().alias("place")
    whole, kept = sized(docs, own, place), None
    if _among_copies(planned):
        whole = kept = written(whole, "mix-rows")  # both passes have to agree on the places
    rows = with_copies(whole, planned, kept if kept is None else kept.drop("_row"))
    # a condition on the copies would be worked into the join, where it repeats the rank's expression many times over; one on
    # what explode gives stays above it
    each = F.explode_outer(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")
    return rows.select("_row", each).where("_copy is not null").select("_row.*")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = written(sized(docs, F.monotonically_increasing_id().alias("place")), "mix-sizes")
    planned = plan(sizes)
    rows = with_copies(sizes, planned, sizes if _among_copies(planned) else None)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


OP7_SQL = """
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         coalesce(CAST(sum(size * CAST(floor(size * 1048576.0::DOUBLE / (size + 512)) AS BIGINT)) AS DOUBLE)
                  / nullif(sum(size) * 1048576.0::DOUBLE, 0), 0) AS mean,
         row_number() OVER (ORDER BY source NULLS LAST) AS position
  FROM sizes GROUP BY source),
capped AS (
  SELECT *, CASE (position - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM weighed),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped),
one AS (SELECT arg_min(level, position_in_order) AS level FROM (
  SELECT level, ratio, row_number() OVER (ORDER BY ratio, position) AS position_in_order FROM levels) WHERE ratio > level),
targets AS (
  SELECT source, source_size, mean, least(cap, coalesce(weight * one.level, cap)) AS target FROM levels, one),
rated AS (
  SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM targets),
needs AS (
  SELECT *, CAST(floor(rate) AS INTEGER) AS sure, rate - floor(rate) AS chance,
         target - floor(rate) * source_size AS need FROM rated),
drawn AS (
  SELECT d.doc_id, d.source, d.size, n.source_size, n.target, n.sure, n.chance, n.need,
         n.chance + least(n.chance, 1 - n.chance) * (floor(d.size * 1048576.0::DOUBLE / (d.size + 512)) / 1048576.0::DOUBLE - n.mean) AS p,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.text_key), 1, 12) AS BIGINT)
          + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sizes d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source),
odds AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM drawn),
ranked AS (
  SELECT *, coalesce(odds / (1 + odds), 1.0) AS rank FROM odds),
ties AS (
  SELECT source, rank, need, sum(size) AS tied, count(*) AS n,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked WHERE chance > 0 GROUP BY source, rank, need),
wanted AS (
  SELECT source, rank, floor(least(coalesce((need - before) * n / nullif(tied, 0), CASE WHEN before <= need THEN n ELSE 0 END) + 0.5::DOUBLE, n)) AS wanted FROM ties),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, rank) AS number FROM ranked)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.sure + CASE WHEN r.chance > 0 AND r.number <= w.wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       r.source, r.sure + CASE WHEN r.chance > 0 AND r.number <= w.wanted THEN 1 ELSE 0 END AS copies
FROM numbered r LEFT JOIN wanted w ON r.source IS NOT DISTINCT FROM w.source AND r.rank = w.rank
"""
