"""Report tables: what a report shows, as frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.calendar import window_order
from tallyforge.functions.text import (
    blank_to_null,
    capitalize,
    comment_ratio,
    date_part,
    percent_label,
    report_title,
    signed,
    thousands,
    top_names,
)
from tallyforge.operators.trends import code_matrix, largest_over_time, with_code_delta

# Labels, and how many rows the short tables show.
NOTHING = "—"
FAILED_LABEL = "Failed (error)"
CATEGORY_LABELS = {
    "active": "Active (<180d)",
    "maintained": "Maintained (180-365d)",
    "abandoned": "Abandoned (>365d)",
    "failed": FAILED_LABEL,
}
SUMMARY_METRICS = [
    ("Repositories", "repos"),
    ("Files", "files"),
    ("Lines", "lines"),
    ("Code", "code"),
    ("Comments", "comments"),
    ("Blanks", "blanks"),
    ("Complexity", "complexity"),
    ("Filtered Files", "filtered_files"),
]
TOP_REPOS = 10
TOP_LANGUAGE_NAMES = 7
TREND_LANGUAGES = 10
TREND_REPOS = 20


def summary_table(totals: DataFrame) -> DataFrame:
    """Metric and value; filtered files only when there are some."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("metric"), F.col(c).cast("long").alias("value"))
            for i, (label, c) in enumerate(SUMMARY_METRICS, start=1)
        ]
    )
    shown = (F.col("metric") != "Filtered Files") | (F.col("value") > 0)
    return totals.select(F.inline(rows)).filter(shown).orderBy("position")


def heading_table(head: DataFrame) -> DataFrame:
    """What a report says at its head, one row: title, sizes, comment ratio, languages and the day it was made. Labels that are left out are blank."""

    def label(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in head.columns else F.lit("")

    totals = F.col("totals")
    sizes = {"repositories": "repos", "lines": "lines", "code": "code", "comments": "comments", "blanks": "blanks"}
    return head.select(
        report_title(label("workspace"), label("organization")).alias("title"),
        label("organization").alias("organization"),
        *[thousands(totals[c]).alias(name) for name, c in sizes.items()],
        percent_label(comment_ratio(totals["comments"], totals["code"])).alias("comment_ratio"),
        thousands(totals["complexity"]).alias("complexity"),
        top_names(F.col("by_language"), TOP_LANGUAGE_NAMES).alias("top_languages"),
        date_part(label("generated_at")).alias("generated"),
    )


def language_table(by_language: DataFrame) -> DataFrame:
    """Languages in report order."""
    columns = ["language", "files", "code", "comments", "blanks", "complexity"]
    return by_language.select(*columns).orderBy(F.col("code").desc(), "language")


def health_label(category: Column, days: Column) -> Column:
    """What the repository table says about health."""
    return (
        F.when(category.isNull(), F.lit(NOTHING))
        .when(category == "failed", F.lit(FAILED_LABEL))
        .when(days >= 0, F.format_string("%s (%dd)", capitalize(category), days))
        .otherwise(F.concat(capitalize(category), F.lit(" (no commits)")))
    )


def repository_table(
    repos: DataFrame,
    totals: DataFrame,
    licenses: DataFrame | None = None,
    health: DataFrame | None = None,
    ai: DataFrame | None = None,
) -> DataFrame:
    """One row per repository; health and AI columns only when these analyses ran."""
    table = repos.select("repo", "slug", "url", "project").join(
        totals.select("repo", "files", "code", "comments", "complexity"), "repo"
    )
    license_column = F.lit(NOTHING)
    if licenses is not None:
        table = table.join(licenses.select("repo", "license"), "repo", "left")
        license_column = F.coalesce(blank_to_null(F.col("license")), F.lit(NOTHING))
    columns = [
        "repo", F.col("slug").alias("repository"), "url", "project", license_column.alias("license"),
        "files", "code", "comments", "complexity",
    ]
    if health is not None:
        table = table.join(health.select("repo", "category", "days_since_commit"), "repo", "left")
        columns.append(health_label(F.col("category"), F.col("days_since_commit")).alias("health"))
    if ai is not None:
        table = table.join(ai.select("repo", "commit_percent", "ai_additions"), "repo", "left")
        share = F.when(F.col("commit_percent").isNotNull(), percent_label(F.col("commit_percent")))
        columns += [
            F.coalesce(share, F.lit(NOTHING)).alias("ai_commits"),
            F.coalesce(F.col("ai_additions").cast("string"), F.lit(NOTHING)).alias("ai_additions"),
        ]
    return table.select(*columns)


def health_table(summary: DataFrame) -> DataFrame:
    """Categories in order; the failed row only when there is a failed repository, and without a share."""
    label = F.col("category")
    for category, text in CATEGORY_LABELS.items():
        label = F.when(F.col("category") == category, F.lit(text)).otherwise(label)
    failed = F.col("category") == "failed"
    return (
        summary.filter(~failed | (F.col("repos") > 0))
        .select(
            "position",
            label.alias("category"),
            "repos",
            "code",
            F.when(failed, F.lit(NOTHING)).otherwise(percent_label(F.col("code_percent"))).alias("code_share"),
        )
        .orderBy("position")
    )


def health_details_table(repos: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of each repository in fixed order; only windows with commits have rows."""
    return (
        repos.select("repo", F.col("slug").alias("repository"))
        .join(windows, "repo")
        .withColumn("window_no", window_order(F.col("window")).cast("int"))
        .orderBy("repository", "repo", "window_no")
    )


def churn_table(repos: DataFrame, scanned: DataFrame, top_files: DataFrame) -> DataFrame:
    """Top files of each repository that has any, with the number of commits scanned."""
    return (
        top_files.join(scanned, "repo")
        .join(repos.select("repo", F.col("slug").alias("repository")), "repo")
        .select("repository", "repo", "total_commits", "rank", "path", "changes", "additions", "deletions")
        .orderBy("repository", "repo", "rank")
    )


def hotspot_table(repos: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Hotspots of each repository, with the score as a whole number."""
    return (
        hotspots.join(repos.select("repo", F.col("slug").alias("repository")), "repo")
        .select(
            "repository", "repo", "rank", "path", "changes", "complexity",
            F.format_string("%.0f", "hotspot").alias("hotspot_score"),
        )
        .orderBy("repository", "repo", "rank")
    )


def error_table(errors: DataFrame) -> DataFrame:
    """Repositories that failed."""
    return errors.select("repository", "error").orderBy("repository", "error")


def ai_table(ai: DataFrame) -> DataFrame:
    """Commits total, flagged and share; a row of added lines only when there are any."""
    rows = F.array(
        F.struct(
            F.lit(1).alias("position"),
            F.lit("Commits").alias("metric"),
            F.col("total_commits").cast("string").alias("total"),
            F.col("ai_commits").alias("ai_attributed"),
            percent_label(F.col("commit_percent")).alias("share"),
        ),
        F.struct(
            F.lit(2).alias("position"),
            F.lit("Line additions").alias("metric"),
            F.lit(NOTHING).alias("total"),
            F.col("ai_additions").alias("ai_attributed"),
            F.lit(NOTHING).alias("share"),
        ),
    )
    shown = (F.col("position") == 1) | (F.col("ai_attributed") > 0)
    return ai.select(F.inline(rows)).filter(shown).orderBy("position")


def sections(
    repos: DataFrame,
    ai: DataFrame | None = None,
    health: DataFrame | None = None,
    windows: DataFrame | None = None,
    top_files: DataFrame | None = None,
) -> DataFrame:
    """Which optional parts of a report there is anything to show for: one row of flags.

    Each part contributes one row of partial flags; the rows are folded, nothing is joined.
    """
    names = ["has_ai", "has_health", "has_details", "has_churn", "has_groups"]

    def flag(df: DataFrame, name: str, condition: Column) -> DataFrame:
        return df.agg(condition.alias(name)).select(
            *[(F.col(n) if n == name else F.lit(False)).alias(n) for n in names]
        )

    any_row = F.count(F.lit(1)) > 0
    projects = F.coalesce(F.max("project"), F.lit(""))
    grouped = (F.min("project") != F.max("project")) | (projects != "")
    parts = [flag(repos, "has_groups", F.coalesce(grouped, F.lit(False)))]
    for df, name in [(ai, "has_ai"), (health, "has_health"), (windows, "has_details"), (top_files, "has_churn")]:
        if df is not None:
            parts.append(flag(df, name, any_row))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.agg(*[F.bool_or(n).alias(n) for n in names])


def project_rollup(repos: DataFrame, totals: DataFrame) -> DataFrame:
    """Sums per project and over all; ``is_total`` marks the latter, as the empty project is a group too."""
    joined = repos.select("repo", "project").join(totals.select("repo", "code", "comments", "complexity"), "repo")
    return (
        joined.rollup("project")
        .agg(
            F.grouping("project").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("repos"),
            *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in ["code", "comments", "complexity"]],
        )
        .withColumn("comment_percent", comment_ratio(F.col("comments"), F.col("code")))
    )


def project_table(rollup: DataFrame) -> DataFrame:
    """Product areas, largest code first, the total last; numbers as labels."""
    name = F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("project"))
    return rollup.orderBy("is_total", F.col("code").desc(), "project").select(
        name.alias("project"),
        "is_total",
        "repos",
        thousands(F.col("code")).alias("code_lines"),
        thousands(F.col("comments")).alias("comment_lines"),
        "comment_percent",
        thousands(F.col("complexity")).alias("complexity_label"),
    )


def _repo_lines(repos: DataFrame, totals: DataFrame) -> DataFrame:
    return (
        repos.select("repo", F.col("slug").alias("repository"), "url", "project")
        .join(totals.select("repo", "code", "comments", "complexity"), "repo")
        .withColumn("comment_percent", comment_ratio(F.col("comments"), F.col("code")))
        .drop("comments")
    )


def all_repos(repos: DataFrame, totals: DataFrame) -> DataFrame:
    """All repositories, largest code first."""
    return _repo_lines(repos, totals).orderBy(F.col("code").desc(), "repository", "repo")


def top_repos(repos: DataFrame, totals: DataFrame, count: int = TOP_REPOS) -> DataFrame:
    """The largest repositories."""
    return all_repos(repos, totals).limit(count)


def repos_by_project(repos: DataFrame, totals: DataFrame) -> DataFrame:
    """Repositories under their project: projects by code, and repositories by code within.

    One sort over all rows by the project's code gives both orders; no project is gathered in one task.
    """
    lines = _repo_lines(repos, totals)
    areas = lines.groupBy("project").agg(F.sum("code").alias("project_code"), F.count(F.lit(1)).alias("project_repos"))
    return lines.join(areas, "project").orderBy(
        F.col("project_code").desc(), "project", F.col("code").desc(), "repository", "repo"
    )


def top_languages(by_language: DataFrame, count: int = TOP_LANGUAGE_NAMES) -> DataFrame:
    """The largest languages of a report."""
    return by_language.orderBy(F.col("code").desc(), "language").limit(count)


def top_language_names(by_language: DataFrame, count: int = TOP_LANGUAGE_NAMES) -> DataFrame:
    """Their names in one text."""
    few = top_languages(by_language, count).agg(
        F.collect_list(F.struct(F.col("code"), F.col("language").alias("name"))).alias("_entries")
    )
    return few.select(top_names(F.col("_entries"), count).alias("top_languages"))


def period_table(trend: DataFrame, *, separators: bool = False) -> DataFrame:
    """Periods with their totals and the change of code as a label, empty where there is none."""
    label = F.coalesce(signed(F.col("code_delta"), separators=separators), F.lit(""))
    return trend.withColumn("delta_label", label).orderBy("period_no")


def top_language_matrix(by_period: DataFrame, periods: Sequence[str], count: int = TREND_LANGUAGES) -> DataFrame:
    """Code over time of the languages that were largest at any time."""
    chosen = largest_over_time(by_period, "language", count)
    kept = by_period.join(F.broadcast(chosen.select("language")), "language")  # at most ``count`` rows
    return code_matrix(kept, "language", periods)


def top_repo_matrix(by_period: DataFrame, periods: Sequence[str], count: int = TREND_REPOS) -> DataFrame:
    """Code over time of the repositories that were largest at any time."""
    chosen = largest_over_time(by_period, "repo", count)
    kept = by_period.join(F.broadcast(chosen.select("repo")), "repo")  # at most ``count`` rows
    return code_matrix(kept, "repo", periods)


def names_over_time(by_period: DataFrame, row: str) -> DataFrame:
    """Distinct names in any period, ascending."""
    return by_period.select(row).distinct().orderBy(row)


def report_tables(frames: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """All tables of a standard report from its frames, those of an analysis or of a report that was read.

    Parts that are absent have no table; a part that is there but empty gives an empty one.
    """
    repos, totals = frames["repos"], frames["totals"]
    shown = {
        "summary": summary_table(frames["portfolio"]),
        "languages": language_table(frames["by_language"]),
        "repositories": repository_table(
            repos, totals, frames.get("licenses"), frames.get("health"), frames.get("ai")
        ),
        "projects": project_table(project_rollup(repos, totals)),
        "repositories_by_project": repos_by_project(repos, totals),
        "top_repositories": top_repos(repos, totals),
        "top_languages": top_language_names(frames["by_language"]),
        "errors": error_table(frames["errors"]),
    }
    if frames.get("ai_total") is not None:
        shown["ai"] = ai_table(frames["ai_total"])
    if frames.get("health_summary") is not None:
        shown["health"] = health_table(frames["health_summary"])
    if frames.get("windows") is not None:
        shown["health_details"] = health_details_table(repos, frames["windows"])
    if frames.get("top_files") is not None:
        shown["churn"] = churn_table(repos, frames["scanned"], frames["top_files"])
    if frames.get("hotspots") is not None:
        shown["hotspots"] = hotspot_table(repos, frames["hotspots"])
    return shown


def trend_tables(frames: dict[str, DataFrame], periods: Sequence[str]) -> dict[str, DataFrame]:
    """All tables of a trends report from its frames."""
    totals = frames["totals"]
    if "code_delta" not in totals.columns:
        totals = with_code_delta(totals)
    return {
        "periods": period_table(totals),
        "languages": code_matrix(frames["by_language"], "language", periods),
        "repositories": code_matrix(frames["by_repo"], "repo", periods),
        "top_languages": top_language_matrix(frames["by_language"], periods),
        "top_repositories": top_repo_matrix(frames["by_repo"], periods),
    }
