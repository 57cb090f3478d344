"""Connected components of a graph given by its edges, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import stage


def _tangled(edges: DataFrame) -> bool:
    """Whether some node hangs under two others, or hangs and has others under it; if none does, stars are left."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return seen.where("up > 1 OR up > 0 AND down > 0").limit(1).count() > 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``label`` of every node that has an edge (columns ``a``, ``b``): the smallest node it reaches.

    Rounds of large-star and small-star (Kiveris et al. 2014): every round hangs each node under the smallest of its
    neighbours, in a number of rounds that grows with the logarithm of the size. Each round is written to the shared
    folder, so a lost executor costs one round. A node with very many neighbours only ever meets a minimum, which is
    combined before the shuffle, and a join whose skewed side adaptive execution splits. Nulls and loops are left out.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(now.distinct(), name)
    while _tangled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        hung = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
