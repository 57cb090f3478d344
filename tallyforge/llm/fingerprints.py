"""Fingerprints of texts: all hashes of five-word shingles below a fixed share of the hash range.

What is kept grows with the text, and how much of one fingerprint lies in another estimates containment also between texts of very
different length. Copies have equal fingerprints. A text whose shingles all lie above the threshold keeps its smallest hash, so only texts without
words have an empty fingerprint. Fingerprints merge (:func:`merge`): that of all shingles of two texts is made of theirs alone. All of
it is Spark functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One hash in so many is kept.
SHARE = 8
#: Quantiles that cut the ids into intervals, each cut again into equal steps.
QUANTILES = 64

_SEPARATORS = r"[\x20\x09-\x0D]+"
THRESHOLD = -(1 << 63) + (1 << 64) // SHARE


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five words of a text (null: empty), of all words if there are fewer; none without words."""
    words = F.filter(F.split(text, _SEPARATORS), lambda w: w != "")
    every = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        size = F.size(h)
        last = F.when(size >= WORDS, size - WORDS).otherwise(0)
        five = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(size > 0, five).otherwise(F.array().cast("array<long>"))

    return F.element_at(F.transform(F.array(every), runs), 1)


def sketch(hashes: Column) -> Column:
    """The fingerprint as a sorted array of distinct hashes."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < THRESHOLD)))
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.element_at(F.transform(F.array(low), lambda s: F.when(F.size(s) > 0, s).otherwise(least)), 1)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of the shingles of two texts together, from their fingerprints; exact, in any order and any grouping.

    A hash above the threshold stands for a text that has none below it, so it goes where there is one below, and else the smallest stays.
    """
    return sketch(F.array_distinct(F.concat(a, b)))


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all of both; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has too; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def id_buckets(docs: DataFrame, steps: int) -> Column:
    """Number of the interval of ``doc_id``, rising with it: quantiles (a bounded list), each cut into equal steps; null: -1."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()[0] or [0]
    cuts = sorted(set(cuts))
    low = F.array(*(F.lit(c).cast("long") for c in cuts))
    high = F.array(*(F.lit(c).cast("long") for c in [*cuts[1:], cuts[-1] + 1]))
    interval = F.greatest(F.size(F.filter(low, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0))

    def within(i: Column) -> Column:
        width = (F.get(high, i).cast("double") - F.get(low, i)) / steps
        step = F.floor((F.col("doc_id").cast("double") - F.get(low, i)) / width)
        return i.cast("long") * steps + F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1))

    return F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(F.element_at(F.transform(F.array(interval), within), 1))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``kept`` (fingerprint) and the ``next_text``, ``next_kept`` of the next row by id and text; the last row's is the first's.

    Rows are ordered inside intervals of the id; the first row of an interval, of which there is but one each, follows
    the last of the interval before.
    """
    steps = max(1, -(-4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // QUANTILES))
    rows = docs.withColumn("bucket", id_buckets(docs, steps)).withColumn("hashes", shingle_hashes(F.col("text")))
    rows = rows.select("bucket", "doc_id", "text", sketch(F.col("hashes")).alias("kept"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    after = F.lead(F.struct(F.col("text").alias("next_text"), F.col("kept").alias("next_kept"))).over(inside)
    followed = rows.withColumn("after", after)

    firsts = docs.withColumn("bucket", id_buckets(docs, steps))
    least = firsts.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    few = F.broadcast(least.withColumnRenamed("bucket", "b"))  # a row an interval, whose number follows the settings, not the data
    firsts = firsts.join(few, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first")))
    firsts = firsts.groupBy("bucket").agg(F.min("text").alias("text")).withColumn("hashes", shingle_hashes(F.col("text")))
    firsts = firsts.select("bucket", F.struct(F.col("text").alias("next_text"), sketch(F.col("hashes")).alias("next_kept")).alias("head"))
    # One row for each interval, whose number is bounded by the shuffle partitions: what precedes each, the last before the first.
    order = least.agg(F.array_sort(F.collect_list("bucket")).alias("all")).select(F.explode(
        F.transform("all", lambda b, i: F.struct(b.alias("bucket"), F.coalesce(F.get("all", i - 1), F.element_at("all", -1)).alias("before")))
    ).alias("o")).select("o.*")
    heads = firsts.join(order, "bucket").select(F.col("before").alias("bucket"), "head")
    return followed.join(heads, "bucket", "left").select("doc_id", "text", "kept", F.coalesce("after", "head").alias("n")).select("doc_id", "text", "kept", "n.*")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited, kept, edited_kept, next_kept`` of every row.

    ``edited`` is the text whose last floor(n_chars / 2) characters are replaced by the first as many, or all, of the next text.
    Null texts count as empty ones. Rows with equal ids follow one another by text, null ids come first; the same row
    twice follows itself. Extra columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    out = with_next(rows).select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "kept", "next_kept")
    out = out.withColumn("hashes", shingle_hashes(F.col("edited")))
    return out.withColumn("edited_kept", sketch(F.col("hashes"))).drop("hashes")
