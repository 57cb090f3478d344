"""File churn and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ranking import limit_commits, top_per_key

# Commits scanned (0: all), files and hotspots kept per repository unless told otherwise.
DEFAULT_COMMIT_LIMIT = 0
TOP_FILES = 20
TOP_HOTSPOTS = 10


def file_churn(commits: DataFrame, commit_files: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Changes and changed lines per repository and path; a path twice in one commit counts twice.

    The commits only decide which file rows count, so they are a semi join: the many rows of one large
    commit can be split by the adaptive skew join, and sums are combined before the second shuffle.
    """
    scanned = limit_commits(commits, limit).select("repo", "hash")
    return (
        commit_files.join(scanned, ["repo", "hash"], "left_semi")
        .groupBy("repo", "path")
        .agg(
            F.count(F.lit(1)).alias("changes"),
            F.sum("additions").alias("additions"),
            F.sum("deletions").alias("deletions"),
        )
    )


def top_files(churn: DataFrame, count: int = TOP_FILES) -> DataFrame:
    """Most changed files of each repository, ranked; ties by path."""
    return top_per_key(churn, ["repo"], [F.col("changes").desc(), F.col("path").asc()], count, rank_column="rank")


def scanned_commits(commits: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Number of commits scanned per repository, whether or not their files are known."""
    return limit_commits(commits, limit).groupBy("repo").agg(F.count(F.lit(1)).alias("total_commits"))


def hotspots(churn: DataFrame, complexity: DataFrame, count: int = TOP_HOTSPOTS) -> DataFrame:
    """Files with the highest product of changes and complexity; files without complexity are left out.

    ``churn`` should be that of all files: the most changed ones need not be the hottest.
    """
    known = complexity.filter(F.col("complexity") > 0).select("repo", "path", "complexity")
    scored = churn.join(known, ["repo", "path"]).withColumn(
        "hotspot", F.col("changes").cast("double") * F.col("complexity").cast("double")
    )
    order = [F.col("hotspot").desc(), F.col("path").asc()]
    return top_per_key(scored, ["repo"], order, count if count > 0 else TOP_HOTSPOTS, rank_column="rank")
