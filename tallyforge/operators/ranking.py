"""Top rows per key that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.first_rows import By, first_per_key

SPREAD_BUCKETS = 200


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    count: int,
    *,
    spread: Sequence[str] = (),
    buckets: int = SPREAD_BUCKETS,
    rank_column: str | None = None,
) -> DataFrame:
    """Exactly the first ``count`` rows of each key by ``order``, which must be total.

    With ``spread`` columns the rows of a key are first ranked inside hash buckets of these columns,
    each a task of its own, and only the best of every bucket meet in the final ranking: at most
    ``count * buckets`` rows of one key. Spark drops rows beyond ``count`` before each shuffle
    (window group limit).
    """
    rank = rank_column or "_rank"
    if spread:
        bucket = F.pmod(F.xxhash64(*spread), F.lit(buckets))
        inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        df = (
            df.withColumn("_bucket", bucket)
            .withColumn(rank, F.row_number().over(inner))
            .filter(F.col(rank) <= count)
            .drop(rank, "_bucket")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= count)
    return ranked if rank_column else ranked.drop(rank)


#: Order of a provider's commit listing: its position, else newest first; the hash breaks ties.
LISTING = [By("seq"), By("ts", "instant", descending=True), By("hash", "text")]
#: Limits up to which Spark itself drops rows before a ranking's shuffle (its default threshold).
PRUNED = 1000


def listing_order() -> list[Column]:
    """Sort columns of a provider's commit listing."""
    return [by.sort() for by in LISTING]


def limit_commits(commits: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` commits of each repository in listing order; 0 keeps all.

    A small limit is ranked in buckets, one beyond ``PRUNED`` is selected by counting; the result is the same.
    """
    if limit <= 0:
        return commits
    if limit > PRUNED:
        return first_per_key(commits, ["repo"], LISTING, limit)
    return top_per_key(commits, ["repo"], listing_order(), limit, spread=["hash"])
