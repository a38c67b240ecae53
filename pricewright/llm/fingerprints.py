"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every distinct 64-bit hash of a five-word shingle that lies in the lowest ``fraction`` of the hash
range. The rule looks at one hash at a time, so the sketch of a union is the union of sketches, and the share of one
sketch found in another estimates containment however unequal the two texts are. A text none of whose hashes is that
low keeps its smallest one, so only a text without words has an empty sketch.

Defined cases: null text counts as empty; under five words the whole sequence is one shingle; repeated shingles count
once; likeness of two empty sketches is 1, of an empty and another 0; rows with the same ``doc_id`` are ordered by
the hash of their text, then the text; a null ``doc_id`` sorts first; an id of many rows is dealt out by ranges of that hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.scratch import written
from pricewright.llm.words import text_or_empty, word_array

SHINGLE = 5
#: One hash in two: about five for a text of 15 words, 290 for one of 580.
FRACTION = 0.5
#: Neighbours in ``doc_id`` order meet in buckets of 2**BUCKET_BITS consecutive ids.
BUCKET_BITS = 9
#: Groups of buckets that one task puts in order.
GROUPS = 4096
#: An id of more rows than this has ranges of its own.
HOT = 1024
#: The columns of a bucket.
BUCKET = ("_bucket", "_place", "_range")
#: Buckets with such ids that are broadcast; each holds at most 2**BUCKET_BITS of them.
FEW = 1000


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 over each run of ``shingle`` words, repeats included."""
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(shingle)]),
    )
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def with_sketch(rows: DataFrame, text: str, name: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of a text column: sorted distinct hashes in the lowest ``fraction`` of the range, or the smallest.

    Each step is a column that the next one uses more than once, so that Spark evaluates it once for a row.
    """
    bound = _bound(fraction)
    rows = rows.withColumn("_words", word_array(F.col(text)))
    rows = rows.withColumn("_hashes", shingle_hashes(F.col("_words"), shingle))
    rows = rows.withColumn("_low", F.filter("_hashes", lambda h: h <= bound))
    least = F.filter(F.array(F.array_min("_hashes")), lambda h: h.isNotNull())
    kept = F.when(F.size("_low") > 0, F.col("_low")).otherwise(least)
    return rows.withColumn(name, F.sort_array(F.array_distinct(kept))).drop("_words", "_hashes", "_low")


def _bound(fraction: float) -> Column:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    return F.lit(min(-(2**63) + int(fraction * 2**64), 2**63 - 1))


def _kept(hashes: Column, fraction: float) -> Column:
    """The hashes below the bound, or the smallest one if there is none."""
    low = F.filter(hashes, lambda h: h <= _bound(fraction))
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.when(F.size(low) > 0, low).otherwise(least)


def merge(left: Column, right: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles taken together: the smallest hash of a text without low ones goes if the other has
    any, and else the smaller of the two is the union's smallest."""
    return F.sort_array(_kept(F.array_union(left, right), fraction))


def containment(left: Column, right: Column) -> Column:
    """The estimated share of the smaller text's shingles that the other holds, 0 to 1."""
    least = F.least(F.size(left), F.size(right))
    both = F.size(F.array_intersect(left, right))
    return F.when(least > 0, both / least).otherwise((F.size(left) == F.size(right)).cast("double"))


def resemblance(left: Column, right: Column) -> Column:
    """The estimated Jaccard index of the two shingle sets."""
    both = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - both
    return F.when(total > 0, both / total).otherwise(F.lit(1.0))


def as_string(kept: Column) -> Column:
    """A sketch as text: its hashes as signed decimals in order, comma-joined."""
    return F.array_join(kept.cast("array<string>"), ",")


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text and its sketch for each row of ``docs``."""
    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    return with_sketch(rows, "text", "sketch", shingle, fraction)


def _bucket() -> Column:
    """Consecutive ids share a bucket; null ids come first, in one of their own."""
    return F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.lit(-(2**62)))


def _hot(rows: DataFrame) -> DataFrame:
    """(bucket, hot): the ids of a bucket that have more than ``HOT`` rows, in order, and how many ranges each of them gets."""
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    ids = F.sort_array(F.collect_list(F.struct("doc_id", F.ceil(F.col("n") / HOT).alias("ranges")))).alias("hot")
    return counts.groupBy(_bucket().alias("_bucket")).agg(ids)


def _placed(rows: DataFrame) -> DataFrame:
    """Add the columns ``BUCKET`` of each row: its ids, the place among their hot ones, and the range, in the order of
    (doc_id, hash, text). They stay apart, since Spark would deal out a struct anew for the join.

    The table of hot ids is written and counted first. Mostly it is empty, and no join moves the texts; up to ``FEW`` buckets
    of it are broadcast; a larger one is joined like any other table.
    """
    hot = written(_hot(rows), "hot-ids")
    buckets = hot.count()
    rows = rows.withColumn("_bucket", _bucket())
    if not buckets:
        return rows.withColumns({"_place": F.lit(0), "_range": F.lit(0).cast("long")})
    joined = rows.join(F.broadcast(hot) if buckets <= FEW else hot, "_bucket", "left")
    own = F.filter("hot", lambda h: h["doc_id"].eqNullSafe(F.col("doc_id")))
    before = F.filter("hot", lambda h: h["doc_id"] < F.col("doc_id"))
    # monotone in the hash, as a double is in a whole number
    part = F.floor((F.col("hash").cast("double") / float(2**64) + 0.5) * F.get(own, F.lit(0))["ranges"])
    is_own = F.coalesce(F.size(own) > 0, F.lit(False))
    place = 2 * F.greatest(F.coalesce(F.size(before), F.lit(0)), F.lit(0)) + is_own.cast("int")
    place, part = F.when(F.col("hot").isNull(), 0).otherwise(place), F.when(is_own, part).otherwise(0).cast("long")
    return joined.withColumns({"_place": place, "_range": part}).drop("hot")


def _next_groups(groups: DataFrame) -> DataFrame:
    """(over, next_group) of (over, first_of_group): the first of the group after each, that of the first group for the last.

    Up to ``GROUPS`` of them are put in order by one task. More are groups in turn, by the higher bits of their numbers, so
    that ids far apart, each in a bucket and a group of its own, make no task longer either.
    """
    groups = written(groups, "bucket-groups")
    if groups.count() <= GROUPS:
        whole = Window.orderBy("over")
        after = F.coalesce(F.lead("first_of_group").over(whole), F.first("first_of_group").over(whole))
        return groups.select("over", after.alias("next_group"))
    groups = groups.withColumn("above", F.shiftright("over", BUCKET_BITS))
    higher = groups.groupBy(F.col("above").alias("over")).agg(F.min("first_of_group").alias("first_of_group"))
    higher = _next_groups(higher).select(F.col("over").alias("above"), F.col("next_group").alias("next_above"))
    inside = Window.partitionBy("above").orderBy("over")
    follows = groups.withColumn("after", F.lead("first_of_group").over(inside)).join(higher, "above")
    return follows.select("over", F.coalesce("after", "next_above").alias("next_group"))


def _following(firsts: DataFrame) -> DataFrame:
    """For each bucket, the one after it; the first one after the last. In levels, so that no task sorts all buckets."""
    over, bucket = F.shiftright(F.col("_bucket"), BUCKET_BITS), F.struct(*BUCKET)
    groups = _next_groups(firsts.groupBy(over.alias("over")).agg(F.min(bucket).alias("first_of_group")))
    inside = Window.partitionBy("over").orderBy(*BUCKET)
    follows = firsts.select(*BUCKET, over.alias("over")).withColumn("next_bucket", F.lead(bucket).over(inside)).join(groups, "over")
    after = follows.withColumn("after", F.coalesce("next_bucket", "next_group"))
    return after.select(*BUCKET, *[F.col(f"after.{c}").alias(f"next{c}") for c in BUCKET])


def with_next(rows: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Give each row (doc_id, text, sketch) the text and sketch of the next in order, the last those of the first.

    Texts are dealt out once, by bucket; only the first row of each bucket also travels to the bucket before it.
    """
    rows = _placed(rows.withColumn("hash", F.xxhash64("text")))
    row = F.min(F.struct("doc_id", "hash", "text")).alias("row")
    firsts = rows.select(*BUCKET, "doc_id", "hash", "text").groupBy(*BUCKET).agg(row)
    firsts = firsts.select(*BUCKET, F.col("row.text").alias("text"))
    firsts = written(with_sketch(firsts, "text", "sketch", shingle, fraction), "bucket-firsts")
    named = [F.col(c).alias(f"next{c}") for c in BUCKET]
    tails = _following(firsts).join(firsts.select(*named, F.struct("text", "sketch").alias("tail")), [f"next{c}" for c in BUCKET])
    order = Window.partitionBy(*BUCKET).orderBy("doc_id", "hash", "text")
    return (
        rows.withColumn("after_text", F.lead("text").over(order))
        .withColumn("after_sketch", F.lead("sketch").over(order))
        .join(tails.select(*BUCKET, "tail"), list(BUCKET))
        .withColumn("next_text", F.coalesce("after_text", "tail.text"))
        .withColumn("next_sketch", F.coalesce("after_sketch", "tail.sketch"))
        .drop("after_text", "after_sketch", "tail", *BUCKET, "hash")
    )


def compare_edited(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness.

    The edited text has the last quarter of the code points replaced by the start of the next text.
    """
    rows = with_next(fingerprint(docs, shingle, fraction), shingle, fraction)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut),
            F.substring("next_text", F.lit(1), cut),
        ),
    )
    rows = with_sketch(rows, "edited", "edited_sketch", shingle, fraction)
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(own).alias("fingerprint"),
        as_string(edited).alias("edited_fingerprint"),
        containment(own, edited).alias("near_edited"),
        containment(own, after).alias("near_next"),
        resemblance(own, edited).alias("resemblance_edited"),
        resemblance(own, after).alias("resemblance_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
