"""AI authorship of commits, per repository and over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.authorship import ai_signals, is_ai_flagged
from tallyforge.functions.text import first_line, percent
from tallyforge.operators.commits import partial_errors, with_stats
from tallyforge.operators.ranking import limit_commits

# Commits looked at per repository unless told otherwise; 0 stands for all.
DEFAULT_COMMIT_LIMIT = 0
PARTIAL_CATEGORY = "ai-estimate-detail"


def commit_signals(commits: DataFrame) -> DataFrame:
    """Every commit with its array of signals."""
    return commits.withColumn("signals", ai_signals(F.col("author"), F.col("message")))


def looked_at(commits: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """First ``limit`` commits, each with ``flagged`` and, only if so, author, first message line and signals.

    Messages are judged where they are read. What the ranking shuffles of most commits is their key.
    """
    flagged = F.col("flagged")
    judged = commits.withColumn("flagged", is_ai_flagged(F.col("author"), F.col("message"))).select(
        "repo", "hash", "ts", "seq", "flagged",
        F.when(flagged, F.col("author")).alias("author"),
        F.when(flagged, first_line(F.col("message"))).alias("message"),
        F.when(flagged, ai_signals(F.col("author"), F.col("message"))).alias("signals"),
    )
    return limit_commits(judged, limit)


def flagged_commits(commits: DataFrame, commit_stats: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Flagged commits among the first ``limit``, with their statistics where known.

    Commits without a signal are dropped before the join: they need no statistics.
    """
    return with_stats(looked_at(commits, limit).filter("flagged"), commit_stats)


def ai_details(commits: DataFrame, commit_stats: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Flagged commits with statistics, one row each, with the first message line."""
    return details_of(flagged_commits(commits, commit_stats, limit))


def details_of(judged: DataFrame) -> DataFrame:
    """The flagged ones with statistics among judged commits."""
    known = judged.filter(F.col("flagged") & F.col("stats_error").isNull())
    return known.select("repo", "hash", "author", "message", "signals", "additions", "deletions", "ts", "seq")


def ai_partial_errors(commits: DataFrame, commit_stats: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Diagnostics of flagged commits without statistics."""
    return partial_errors(flagged_commits(commits, commit_stats, limit), PARTIAL_CATEGORY)


def ai_by_repo(
    repos: DataFrame, commits: DataFrame, commit_stats: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT
) -> DataFrame:
    """Commits, flagged commits, their share and their additions per repository.

    A flagged commit without statistics counts as flagged but adds no lines. A repository without
    commits appears with zeros. The commits are read once: those without a signal pass the join
    unmatched, by key and flag, so that they spread over all tasks.
    """
    keyed = looked_at(commits, limit).select("repo", "hash", "flagged")
    stats = commit_stats.filter(F.col("error").isNull()).select("repo", "hash", "additions", F.lit(True).alias("flagged"))
    return sums_of(repos, keyed.join(stats, ["repo", "hash", "flagged"], "left"))


def sums_of(repos: DataFrame, judged: DataFrame) -> DataFrame:
    """The same from judged commits, read once."""
    flagged = F.col("flagged")
    per_repo = judged.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_if(flagged).alias("ai_commits"), F.sum(F.when(flagged, F.col("additions"))).alias("ai_additions")
    )
    zero = F.lit(0).cast("long")
    return (
        repos.select("repo")
        .join(per_repo, "repo", "left")
        .select(
            "repo",
            F.coalesce("total_commits", zero).alias("total_commits"),
            F.coalesce("ai_commits", zero).alias("ai_commits"),
            F.coalesce(percent(F.col("ai_commits"), F.col("total_commits")), F.lit(0.0)).alias("commit_percent"),
            F.coalesce("ai_additions", zero).alias("ai_additions"),
        )
    )


def ai_over_all(by_repo: DataFrame) -> DataFrame:
    """Sums over the repositories and the share of the sums; no row when there is no estimate at all."""
    sums = by_repo.agg(
        F.count(F.lit(1)).alias("_repos"),
        *[F.sum(c).alias(c) for c in ["total_commits", "ai_commits", "ai_additions"]],
    )
    share = percent(F.col("ai_commits"), F.col("total_commits")).alias("commit_percent")
    return sums.filter(F.col("_repos") > 0).select("total_commits", "ai_commits", share, "ai_additions")
