"""Commits and their change counts; a count that could not be had is a partial error, not a loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text of a partial error when no reason was landed.
MISSING_STATS = "no statistics"


def with_stats(commits: DataFrame, commit_stats: DataFrame) -> DataFrame:
    """Every commit with its additions and deletions; ``stats_error`` tells why they are missing."""
    stats = commit_stats.select(
        "repo",
        "hash",
        F.when(F.col("error").isNull(), F.col("additions")).alias("additions"),
        F.when(F.col("error").isNull(), F.col("deletions")).alias("deletions"),
        F.coalesce("error", F.lit("")).alias("_error"),
    )
    error = F.when(F.col("_error").isNull(), F.lit(MISSING_STATS)).otherwise(F.nullif(F.col("_error"), F.lit("")))
    return commits.join(stats, ["repo", "hash"], "left").withColumn("stats_error", error).drop("_error")


def partial_error_message(hash_: Column, error: Column) -> Column:
    """Message of a commit whose statistics are missing."""
    return F.concat(F.lit("CommitStats "), hash_, F.lit(": "), error)


def partial_errors(commits_with_stats: DataFrame, category: str) -> DataFrame:
    """Diagnostics of the commits without statistics."""
    return commits_with_stats.filter(F.col("stats_error").isNotNull()).select(
        F.lit(category).alias("category"),
        "repo",
        partial_error_message(F.col("hash"), F.col("stats_error")).alias("message"),
    )
