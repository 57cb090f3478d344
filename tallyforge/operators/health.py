"""Repository health: activity class, age windows, bus factor and velocity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.authorship import author_identity
from tallyforge.functions.calendar import (
    WINDOW_PREVIOUS,
    WINDOW_RECENT,
    activity_class,
    as_instant,
    commit_window,
    elapsed_days,
    rfc3339,
)
from tallyforge.functions.text import percent
from tallyforge.operators.commits import partial_errors, with_stats
from tallyforge.operators.ranking import limit_commits

# Commits read for details unless told otherwise (0: all), and the fixed categories in report order.
DEFAULT_COMMIT_LIMIT = 0
FAILED = "failed"
CATEGORIES = ["active", "maintained", "abandoned", FAILED]
PARTIAL_CATEGORY = "health-details"
FAILURE_CATEGORY = "health"


def last_commits(commits: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Newest instant per repository among the first ``limit`` listed commits (0: all).

    With a limit of 1 only the first listed commit speaks, whatever its date; that is an aggregate
    with partial results, not a ranking.
    """
    if limit == 1:
        place = F.struct(
            F.coalesce("seq", F.lit(2**62)), F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit(2**62)), "hash"
        )
        return commits.groupBy("repo").agg(F.min_by("ts", place).alias("last_commit"))
    return limit_commits(commits, limit).groupBy("repo").agg(F.max("ts").alias("last_commit"))


def repo_health(
    repos: DataFrame,
    commits: DataFrame,
    now: Column | str,
    *,
    failures: DataFrame | None = None,
    limit: int = DEFAULT_COMMIT_LIMIT,
) -> DataFrame:
    """Category, last commit and age per repository.

    Without any dated commit a repository is abandoned with -1 days. A repository whose commits could
    not be listed (``failures``: repo, error) becomes a row of category failed, it is not dropped.
    """
    now = as_instant(now)
    health = repos.select("repo").join(last_commits(commits, limit), "repo", "left")
    if failures is None:
        health = health.withColumn("error", F.lit(None).cast("string"))
    else:
        first = failures.groupBy("repo").agg(F.min("error").alias("error"))
        health = health.join(first, "repo", "left")
    failed, last = F.col("error").isNotNull(), F.col("last_commit")
    days = F.when(failed | last.isNull(), F.lit(-1)).otherwise(elapsed_days(last, now))
    return health.select(
        "repo",
        F.when(failed, F.lit(FAILED))
        .when(last.isNull(), F.lit("abandoned"))
        .otherwise(activity_class(elapsed_days(last, now)))
        .alias("category"),
        F.when(failed | last.isNull(), F.lit("")).otherwise(rfc3339(last)).alias("last_commit_date"),
        days.cast("int").alias("days_since_commit"),
        "error",
    )


def failure_diagnostics(failures: DataFrame) -> DataFrame:
    """Diagnostics of repositories whose commits could not be listed."""
    return failures.select(F.lit(FAILURE_CATEGORY).alias("category"), "repo", F.col("error").alias("message"))


def author_windows(commits: DataFrame, commit_stats: DataFrame, now: Column | str, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Commits and changed lines per repository, age window and author: the base of all details.

    Everything below adds up these rows, so the commits are joined and shuffled once. A commit without
    statistics stays, with no changed lines.
    """
    known = with_stats(limit_commits(commits, limit), commit_stats)
    return windows_of(known.withColumns({"window": commit_window(F.col("ts"), as_instant(now)), "identity": author_identity(F.col("author"))}))


def windows_of(judged: DataFrame) -> DataFrame:
    """The same from judged commits."""
    return judged.groupBy("repo", "window", F.col("identity").alias("author")).agg(
        F.count(F.lit(1)).alias("commits"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
    )


def window_details(authors: DataFrame) -> DataFrame:
    """Authors, commits and changed lines per repository and window; empty windows have no row."""
    return (
        authors.groupBy("repo", "window")
        .agg(
            F.count(F.lit(1)).alias("authors"),  # one row per author and window
            F.sum("commits").alias("commits"),
            F.sum("additions").alias("additions"),
            F.sum("deletions").alias("deletions"),
        )
        .withColumn("net_churn", F.col("additions") - F.col("deletions"))
    )


def bus_factor(authors: DataFrame) -> DataFrame:
    """Share of the busiest author in all commits of a repository, in percent."""
    per_author = authors.groupBy("repo", "author").agg(F.sum("commits").alias("commits"))
    return per_author.groupBy("repo").agg(
        (F.max("commits") / F.sum("commits") * 100).alias("bus_factor"),
    )


def velocity(authors: DataFrame) -> DataFrame:
    """Recent commits per commit of the window before, 0 when that one is empty."""
    recent = F.sum(F.when(F.col("window") == WINDOW_RECENT, F.col("commits")).otherwise(0))
    previous = F.sum(F.when(F.col("window") == WINDOW_PREVIOUS, F.col("commits")).otherwise(0))
    return (
        authors.groupBy("repo")
        .agg(recent.alias("_recent"), previous.alias("_previous"))
        .select(
            "repo",
            F.when(F.col("_previous") > 0, F.col("_recent") / F.nullif(F.col("_previous"), F.lit(0)))
            .otherwise(F.lit(0.0))
            .alias("velocity_trend"),
        )
    )


def health_partial_errors(commits: DataFrame, commit_stats: DataFrame, limit: int = DEFAULT_COMMIT_LIMIT) -> DataFrame:
    """Diagnostics of commits without statistics."""
    return partial_errors(with_stats(limit_commits(commits, limit), commit_stats), PARTIAL_CATEGORY)


def health_summary(health: DataFrame, totals: DataFrame) -> DataFrame:
    """Repositories and code per category, all four categories, or no row without any health.

    The share of code leaves failed repositories out of the base; they have no share themselves.
    """
    joined = health.select("repo", "category").join(totals.select("repo", "code"), "repo", "left")
    is_in = {c: F.col("category") == c for c in CATEGORIES}
    sums = joined.agg(
        F.count(F.lit(1)).alias("_repos"),
        F.coalesce(F.sum(F.when(~is_in[FAILED], F.col("code"))), F.lit(0)).alias("_base"),
        *[F.count_if(cond).alias(f"_{c}_repos") for c, cond in is_in.items()],
        *[F.coalesce(F.sum(F.when(cond, F.col("code"))), F.lit(0)).alias(f"_{c}_code") for c, cond in is_in.items()],
    ).filter(F.col("_repos") > 0)
    rows = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(c).alias("category"),
                F.col(f"_{c}_repos").alias("repos"),
                F.col(f"_{c}_code").alias("code"),
                (F.lit(0.0) if c == FAILED else percent(F.col(f"_{c}_code"), F.col("_base"))).alias("code_percent"),
            )
            for position, c in enumerate(CATEGORIES, start=1)
        ]
    )
    return sums.select(F.inline(rows))
