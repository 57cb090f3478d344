"""One narrow pass over commits, from which authorship, health, churn and their diagnostics follow without reading commits or statistics again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.authorship import ai_signals, author_identity, is_ai_flagged
from tallyforge.functions.calendar import as_instant, commit_window
from tallyforge.functions.text import first_line
from tallyforge.operators.commits import with_stats
from tallyforge.operators.ranking import limit_commits


def widest(*limits: int) -> int:
    """The limit that all others are within; 0 stands for all commits."""
    return 0 if 0 in limits else max(limits)


def judged_commits(commits: DataFrame, commit_stats: DataFrame | None, now: Column | str, limit: int = 0, ai: bool = True) -> DataFrame:
    """The first ``limit`` commits of each repository as what the analyses need of them.

    ``repo``, ``hash``, ``ts``, ``seq``; the age ``window`` and the author's ``identity``; with ``ai`` whether a commit is ``flagged``, and of a flagged one
    ``author``, first line of the ``message`` and ``signals``; with statistics ``additions``, ``deletions`` and ``stats_error``. Messages are judged
    where they are read and go no further, so what is joined with the statistics, and written once for all analyses, is narrow.
    """
    flagged = F.col("flagged")
    columns = [
        "repo", "hash", "ts", "seq", commit_window(F.col("ts"), as_instant(now)).alias("window"), author_identity(F.col("author")).alias("identity"),
    ]
    if ai:
        commits = commits.withColumn("flagged", is_ai_flagged(F.col("author"), F.col("message")))
        columns += [
            "flagged", F.when(flagged, F.col("author")).alias("author"), F.when(flagged, first_line(F.col("message"))).alias("message"),
            F.when(flagged, ai_signals(F.col("author"), F.col("message"))).alias("signals"),
        ]
    judged = limit_commits(commits.select(*columns), limit)
    return judged if commit_stats is None else with_stats(judged, commit_stats)


def among_first(judged: DataFrame, limit: int, within: int) -> DataFrame:
    """The first ``limit`` commits of each repository, of those judged within a limit at least as wide."""
    return judged if limit == within else limit_commits(judged, limit)
