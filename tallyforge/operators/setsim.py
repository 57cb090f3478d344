"""Exact join of sets by Jaccard similarity, with size bounds and prefixes of rarest members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLACK = 1e-9  # keeps a product that should be whole from being rounded up


def least_overlap(size: Column, threshold: float) -> Column:
    """Members a set shares with any set at least that similar; also the least size of that set."""
    return F.ceil(size * F.lit(float(threshold)) - F.lit(_SLACK))


def prefix_length(size: Column, threshold: float) -> Column:
    """Of a set's members in any fixed order, one among the first so many is shared with every set at least that similar."""
    return size - least_overlap(size, threshold) + 1


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left_id``, ``right_id``, ``similarity`` of all pairs of sets (``id``, ``members``: array of distinct longs) at least that similar.

    Made for many sets on the left against fewer on the right, such as a corpus. Members are ordered by the number of right sets that hold
    them, rarest first (left members that none holds are rarer still), and pairs meet by an equi-join on prefixes in that
    order: common members, which would pair everything with everything, are hardly ever in a prefix. Of these pairs those of fitting size are
    compared whole. Ids are distinct on both sides and not null; empty sets are similar to nothing; the threshold is above 0.
    """
    held = right.where(F.size("members") > 0).select(F.col("id").alias("right_id"), F.size("members").alias("_m"), F.col("members").alias("_right"))
    frequency = held.select(F.explode("_right").alias("_member")).groupBy("_member").agg(F.count(F.lit(1)).alias("_f"))

    def rarest_first(sets: DataFrame, key: str, size: str, members: str) -> DataFrame:
        """Members that a right set holds and that are in the prefix; those that none holds come first and use it up."""
        known = sets.select(key, size, F.explode(members).alias("_member")).join(frequency, "_member")
        ordered = known.groupBy(key, size).agg(F.array_sort(F.collect_list(F.struct("_f", "_member"))).alias("_known"))
        unknown = F.col(size) - F.size("_known")
        first = F.greatest(prefix_length(F.col(size), threshold) - unknown, F.lit(0)).cast("int")
        return ordered.select(key, size, F.explode(F.slice("_known", F.lit(1), first)).alias("_first")).select(key, size, F.col("_first._member").alias("_member"))

    asked = left.where(F.size("members") > 0).select(F.col("id").alias("left_id"), F.size("members").alias("_n"), F.col("members").alias("_left"))
    fits = (F.col("_n") >= least_overlap(F.col("_m"), threshold)) & (F.col("_m") >= least_overlap(F.col("_n"), threshold))
    pairs = (
        rarest_first(asked, "left_id", "_n", "_left").join(rarest_first(held, "right_id", "_m", "_right"), "_member")
        .where(fits).select("left_id", "right_id").distinct()
    )
    met = pairs.join(asked, "left_id").join(held, "right_id").withColumn("_common", F.size(F.array_intersect("_left", "_right")))
    similarity = F.col("_common") / (F.col("_n") + F.col("_m") - F.col("_common"))
    return met.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
