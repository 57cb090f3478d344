"""History: the tree of each repository at each period end, and totals over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.calendar import first_period_covering, period_days, period_end, period_label
from tallyforge.operators.codestats import file_stats, language_stats, languages_only
from tallyforge.operators.keyfilter import possible
from tallyforge.schema import MEASURES


def period_calendar(spark: SparkSession, since: str, until: str, interval: str) -> DataFrame:
    """Numbered periods with label and end; none when the bounds or the interval are not valid."""
    return expand_periods(spark.range(1).select(F.lit(since).alias("since"), F.lit(until).alias("until")), interval)


def expand_periods(bounds: DataFrame, interval: str) -> DataFrame:
    """Calendar rows for each row of bounds (``since``, ``until``)."""
    days = period_days(F.col("since"), F.col("until"), interval)
    kept = [c for c in bounds.columns if c not in ("since", "until")]
    end = period_end(F.col("_day"), interval)
    return bounds.select(*kept, F.posexplode(days).alias("_position", "_day")).select(
        *kept,
        (F.col("_position") + 1).alias("period_no"),
        period_label(end, interval).alias("period"),
        end.alias("period_end"),
    )


def period_labels(calendar: DataFrame) -> list[str]:
    """Labels in order; as many as there are periods in the report."""
    return [row["period"] for row in calendar.orderBy("period_no").select("period").collect()]


def commits_at_periods(commits: DataFrame, since: str, until: str, interval: str) -> DataFrame:
    """Newest commit of each repository at each period end, as far as there is one.

    A commit qualifies by its author time (``author_ts`` where there is such a column, else ``ts``); of those that do, the one with the latest
    committer time is taken (as-of join with two clocks). Each commit first goes to the first period it qualifies
    for, by calendar arithmetic; there only the latest survives, which is combined before the shuffle.
    What remains are at most as many rows per repository as periods, over which a running maximum
    carries the winner on. No repository, however large, meets in one task with all its commits.
    """
    written = F.coalesce("author_ts", "ts") if "author_ts" in commits.columns else F.col("ts")
    days = period_days(F.lit(since), F.lit(until), interval)
    last_no = F.coalesce(F.size(days), F.lit(0))
    newest = (
        commits.filter(written.isNotNull())  # a commit without a date is in no period
        .select(
            "repo", "hash", "committer_ts", first_period_covering(written, F.lit(since), interval).alias("_no")
        )
        .filter(F.col("_no") <= last_no)
        .groupBy("repo", "_no")
        .agg(F.max(F.struct("committer_ts", "hash")).alias("_best"))
    )
    by_no = Window.partitionBy("repo").orderBy("_no")
    end = period_end(F.element_at(days, F.col("period_no")), interval)
    return (
        newest.withColumn("_best", F.max("_best").over(by_no.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_until", F.coalesce(F.lead("_no").over(by_no) - 1, last_no))
        .select(
            "repo", F.explode(F.sequence("_no", "_until")).alias("period_no"), F.col("_best.hash").alias("commit_hash")
        )
        .select(
            "repo", "period_no", period_label(end, interval).alias("period"), end.alias("period_end"), "commit_hash"
        )
    )


def with_tree(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Snapshots whose tree is there; one that could not be had is skipped."""
    trees = files.select("repo", "commit_hash").distinct()
    return snapshots.join(trees, ["repo", "commit_hash"], "left_semi")


def snapshot_languages(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Language sums of each repository at each period, including filtered files.

    The tree of a commit is counted once, however many periods show it, and only its sums are joined.
    Trees of other commits are left out before anything in them is counted: a filter of the wanted keys, which is small whatever
    their number, passes all wanted trees and few others, whose sums then meet no snapshot. Contents never move.
    """
    wanted = snapshots.select("repo", "commit_hash").distinct()
    by_commit = language_stats(file_stats(possible(files, wanted)), ["repo", "commit_hash"])
    return snapshots.select("repo", "period_no", "period", "commit_hash").join(by_commit, ["repo", "commit_hash"])


def _sums() -> list:
    return [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES]


def trend_repos(snapshots: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Totals per repository and period; a tree without counted files shows zeros."""
    sums = snapshot.groupBy("repo", "period_no").agg(*_sums())
    filled = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES]
    return snapshots.join(sums, ["repo", "period_no"], "left").select("period_no", "period", "repo", *filled)


def trend_languages(snapshot: DataFrame) -> DataFrame:
    """Totals per language and period, largest code first within a period."""
    grouped = languages_only(snapshot).groupBy("period_no", "period", "language").agg(*_sums())
    return grouped.orderBy("period_no", F.col("code").desc(), "language")


def trend_totals(calendar: DataFrame, by_repo: DataFrame) -> DataFrame:
    """Totals per period from those per repository, every period present, with the change of code.

    There is no change to show while the period before has no code.
    """
    sums = by_repo.groupBy("period_no").agg(F.count(F.lit(1)).alias("repos"), *_sums())
    filled = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in ["repos", *MEASURES]]
    return with_code_delta(
        calendar.select("period_no", "period").join(sums, "period_no", "left").select("period_no", "period", *filled)
    )


def with_code_delta(totals: DataFrame) -> DataFrame:
    """Change of code to the period before, null while that one has none.

    Every row is sent to its own and to the next period number, where both meet: the totals are
    computed once, and nothing is sorted in a single task.
    """
    own = F.struct(F.col("period_no"), F.struct(*totals.columns).alias("_row"), F.lit(None).cast("long").alias("_before"))
    none = F.when(F.lit(False), F.struct(*totals.columns))
    following = F.struct((F.col("period_no") + 1).alias("period_no"), none.alias("_row"), F.col("code").alias("_before"))
    met = (
        totals.select(F.inline(F.array(own, following)))
        .groupBy("period_no")
        .agg(F.any_value("_row", True).alias("_row"), F.max("_before").alias("_before"))
        .filter(F.col("_row").isNotNull())
    )
    delta = F.when(F.col("_before") > 0, F.col("_row.code") - F.col("_before"))
    return met.select("_row.*", delta.alias("code_delta"))


def code_matrix(by_period: DataFrame, row: str, periods: Sequence[str]) -> DataFrame:
    """Code per row key and period, 0 where there is none; names ascending."""
    return (
        by_period.groupBy(row).pivot("period", list(periods)).agg(F.sum("code")).na.fill(0).orderBy(row)
    )


def largest_over_time(by_period: DataFrame, row: str, count: int) -> DataFrame:
    """Row keys with the largest code in any period, largest first."""
    largest = by_period.groupBy(row).agg(F.max("code").alias("max_code")).filter(F.col("max_code") >= 0)
    return largest.orderBy(F.col("max_code").desc(), row).limit(count)
