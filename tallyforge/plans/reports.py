"""Report rows: one nested row per repository, one head row over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import blank_to_null
from tallyforge.operators.codestats import languages_only
from tallyforge.operators.health import CATEGORIES
from tallyforge.schema import MEASURES


def split_results(repos: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories that could be read, and an error row for each of those that could not."""
    first = failures.groupBy("repo").agg(F.min("error").alias("error"))
    good = repos.join(first, "repo", "left_anti")
    errors = repos.join(first, "repo").select("repo", F.col("slug").alias("repository"), "error")
    return good, errors


def _nested(df: DataFrame, fields: Sequence[str | Column], order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows of each repository as one array in order; only for rows whose number per repository is bounded."""
    keyed = F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_row"))
    ordered = F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["_row"])
    return df.groupBy("repo").agg(ordered.alias(name))


def _measures(columns: Sequence[str] = MEASURES) -> list[Column]:
    return [F.col(m) for m in columns]


def _zero_to_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(0).cast("long"))


def language_arrays(by_language: DataFrame) -> DataFrame:
    """Languages of each repository, largest code first: at most as many as there are rules."""
    rows = languages_only(by_language).withColumn("name", F.col("language")).withColumn("_code", -F.col("code"))
    return _nested(rows, ["name", *MEASURES], ["_code", "name"], "languages")


def churn_structs(scanned: DataFrame, top_files: DataFrame, hotspots: DataFrame | None = None) -> DataFrame:
    """Churn of each repository: a bounded number of files and hotspots."""
    fields = ["path", "changes", "additions", "deletions"]
    joined = scanned.join(_nested(top_files, fields, ["rank"], "top_files"), "repo", "left")
    columns = [F.col("total_commits"), F.col("top_files")]
    if hotspots is not None:
        joined = joined.join(_nested(hotspots, [*fields, "complexity", "hotspot"], ["rank"], "hotspots"), "repo", "left")
        columns.append(F.col("hotspots"))
    return joined.select("repo", F.struct(*columns).alias("churn"))


def ai_structs(ai: DataFrame) -> DataFrame:
    """AI estimate of each repository. Flagged commits are a table of their own, as nothing bounds their number."""
    zero = F.lit(0).cast("long")
    columns = [
        F.col("total_commits"), F.col("ai_commits"), F.col("commit_percent"), zero.alias("total_additions"),
        F.col("ai_additions"), F.lit(0.0).alias("addition_percent"),
    ]
    return ai.select("repo", F.struct(*columns).alias("ai_estimate"))


def health_structs(health: DataFrame) -> DataFrame:
    """Health of each repository."""
    fields = ["category", "last_commit_date", "days_since_commit", "error"]
    return health.select("repo", F.struct(*fields).alias("health"))


def health_detail_structs(windows: DataFrame, bus_factor: DataFrame, velocity: DataFrame) -> DataFrame:
    """Details of each repository, with a map entry per window: at most three."""
    churn = F.struct("additions", "deletions", "net_churn", F.col("commits").cast("int").alias("commits"))
    maps = windows.groupBy("repo").agg(
        F.map_from_entries(F.collect_list(F.struct("window", F.col("authors").cast("int")))).alias("authors_by_window"),
        F.map_from_entries(F.collect_list(F.struct("window", churn))).alias("churn_by_window"),
    )
    fields = ["authors_by_window", "churn_by_window", "bus_factor", "velocity_trend"]
    joined = maps.join(bus_factor, "repo").join(velocity, "repo")
    return joined.select("repo", F.struct(*fields).alias("health_details"))


def repository_rows(
    repos: DataFrame, totals: DataFrame, by_language: DataFrame, *, licenses: DataFrame | None = None, **parts: DataFrame | None
) -> DataFrame:
    """One nested row per repository.

    ``parts`` are frames of ``repo`` and one struct of the same name as the argument (churn,
    ai_estimate, health, health_details). All joins are on the repository with one row on each side.
    """
    rows = (
        repos.select("repo", "slug", "project", "provider", "url")
        .join(totals, "repo")
        .join(language_arrays(by_language), "repo", "left")
    )
    columns = [
        F.col("slug").alias("repository"),
        blank_to_null(F.col("project")).alias("project"),
        F.col("provider"),
        F.col("url"),
    ]
    if licenses is not None:
        rows = rows.join(licenses.select("repo", "license"), "repo", "left")
        columns.append(blank_to_null(F.col("license")).alias("license"))
    columns += [
        F.coalesce("languages", F.array().cast(rows.schema["languages"].dataType)).alias("languages"),
        F.struct(*MEASURES).alias("totals"),
        _zero_to_null("filtered_files").alias("filtered_files"),
    ]
    for name, part in parts.items():
        if part is not None:
            rows = rows.join(part, "repo", "left")
            columns.append(F.col(name))
    return rows.select("repo", *columns)


def _fold(parts: Sequence[DataFrame]) -> DataFrame:
    """Several one-row frames side by side, without a join: a union of which every column has one value."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union.agg(*[F.any_value(c, True).alias(c) for c in union.columns])


def _language_array() -> Column:
    """Aggregate: languages as an array, largest code first; as many as there are rules at most."""
    keyed = F.struct((-F.col("code")).alias("k"), F.col("language").alias("name"), *MEASURES)
    return F.transform(
        F.array_sort(F.collect_list(keyed)),
        lambda e: F.struct(e["name"].alias("name"), *[e[m].alias(m) for m in MEASURES]),
    )


def filters_struct(projects: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """What the repositories were filtered by; empty lists are left out."""
    lists = {"projects": projects, "repos": include, "exclude": exclude}
    return F.struct(
        *[(F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>")).alias(k) for k, v in lists.items()]
    )


def report_head(
    portfolio: DataFrame,
    by_language: DataFrame,
    *,
    ai: DataFrame | None = None,
    summary: DataFrame | None = None,
    filters: Column | None = None,
    **labels: str,
) -> DataFrame:
    """One row over all repositories: labels, totals, languages, AI estimate, health summary.

    Empty labels are left out. Nothing in it grows with the number of repositories, but for the lists of names in ``filters``.
    """
    filtered = _zero_to_null("filtered_files").alias("filtered_files")
    parts = [
        portfolio.select(F.struct("repos", *MEASURES, filtered).alias("totals")),
        by_language.agg(_language_array().alias("by_language")),
    ]
    if ai is not None:
        parts.append(ai.select(F.struct("total_commits", "ai_commits", "commit_percent", "ai_additions").alias("ai_estimate")))
    if summary is not None:
        values = F.map_from_entries(F.collect_list(F.struct("category", F.struct("repos", "code", "code_percent"))))
        by_category = summary.groupBy().agg(values.alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 0")
        parts.append(by_category.select(F.struct(*[F.col("m")[c].alias(c) for c in CATEGORIES]).alias("health_summary")))
    head = _fold(parts)
    return head.select(*_labels(labels, filters), *head.columns)


def _labels(labels: dict[str, str], filters: Column | None) -> list[Column]:
    shown = [F.lit(text).alias(name) for name, text in labels.items() if text]
    return shown if filters is None else [*shown, filters.alias("filters")]


def trends_head(calendar: DataFrame, filters: Column | None = None, **labels: str) -> DataFrame:
    """One row about a trends report, with the labels of its periods in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("period_no", "period"))), lambda e: e["period"])
    return calendar.agg(ordered.alias("periods")).select(*_labels(labels, filters), "periods")


def trend_snapshots(totals: DataFrame, by_language: DataFrame) -> DataFrame:
    """One row per period with its totals and languages; a period without repositories has zeros."""
    languages = by_language.groupBy("period_no").agg(_language_array().alias("by_language"))
    joined = totals.join(languages, "period_no", "left")
    return joined.select(
        "period_no", "period", F.struct("repos", *MEASURES).alias("totals"), "by_language"
    ).orderBy("period_no")


def trend_repository_rows(repos: DataFrame, by_repo: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row per period and repository, with totals and languages."""
    arrays = snapshot.groupBy("repo", "period_no").agg(F.sum("filtered_files").alias("filtered_files"))
    languages = languages_only(snapshot).groupBy("repo", "period_no").agg(_language_array().alias("languages"))
    joined = (
        by_repo.join(arrays, ["repo", "period_no"], "left")
        .join(languages, ["repo", "period_no"], "left")
        .join(repos.select("repo", "slug", "project", "provider", "url"), "repo")
    )
    return joined.select(
        "period_no", "period", F.col("slug").alias("repository"), blank_to_null(F.col("project")).alias("project"), "provider",
        "url", "languages", F.struct(*MEASURES).alias("totals"), _zero_to_null("filtered_files").alias("filtered_files"),
    )
