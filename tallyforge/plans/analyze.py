"""The two analyses of a portfolio, from input tables to lazy result frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import authorship, churn, codestats, health, license, trends
from tallyforge.operators.commits import partial_errors
from tallyforge.operators.judged import among_first, judged_commits, widest
from tallyforge.operators.keyfilter import possible
from tallyforge.operators.selection import select_repos
from tallyforge.plans import reports
from tallyforge.plans.tables import report_tables, trend_tables
from tallyforge.schema import DIAGNOSTICS, REPO_FAILURES
from tallyforge.session import keep_keys, stage


@dataclass
class Portfolio:
    """Input tables; those an analysis does not need may be left out."""

    repos: DataFrame
    files: DataFrame | None = None
    commits: DataFrame | None = None
    commit_stats: DataFrame | None = None
    commit_files: DataFrame | None = None
    failures: DataFrame | None = None
    license_corpus: DataFrame | None = None


_AI_LIMIT = authorship.DEFAULT_COMMIT_LIMIT
_HEALTH_LIMIT = health.DEFAULT_COMMIT_LIMIT
_CHURN_LIMIT = churn.DEFAULT_COMMIT_LIMIT


@dataclass
class Options:
    """What to analyse, and of which repositories."""

    projects: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    include_archived: bool = False
    include_forks: bool = False
    owner: str | None = None
    ai: bool = False
    ai_commit_limit: int = _AI_LIMIT
    health: bool = False
    health_details: bool = False
    health_commit_limit: int = _HEALTH_LIMIT
    churn: bool = False
    churn_limit: int = _CHURN_LIMIT
    hotspots: bool = False
    materialize: bool = True


@dataclass
class Analysis:
    """Results, each a frame; absent where the analysis was not asked for."""

    repos: DataFrame
    errors: DataFrame
    totals: DataFrame
    by_repo_language: DataFrame
    by_language: DataFrame
    portfolio: DataFrame
    rows: DataFrame
    head: DataFrame
    diagnostics: DataFrame
    licenses: DataFrame | None = None
    ai: DataFrame | None = None
    ai_details: DataFrame | None = None
    ai_total: DataFrame | None = None
    health: DataFrame | None = None
    health_summary: DataFrame | None = None
    windows: DataFrame | None = None
    bus_factor: DataFrame | None = None
    velocity: DataFrame | None = None
    scanned: DataFrame | None = None
    top_files: DataFrame | None = None
    hotspots: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """Report tables."""
        return report_tables(vars(self))


def _stage_failures(failures: DataFrame, name: str) -> DataFrame:
    return failures.filter(F.col("stage") == name)


def _need(tables: Portfolio, *names: str) -> None:
    """An analysis without its table cannot run, such as churn where no file changes can be had."""
    missing = [name for name in names if getattr(tables, name) is None]
    if missing:
        raise ValueError(f"this analysis needs the tables {missing}")


def _named(diagnostics: DataFrame, repos: DataFrame) -> DataFrame:
    """Diagnostics show the slug."""
    slugs = repos.select("repo", "slug")
    return diagnostics.join(slugs, "repo").select("category", F.col("slug").alias("repo"), "message")


def analyze(tables: Portfolio, options: Options, now: Column | str, **labels: str) -> Analysis:
    """Code statistics, license and, as asked for, AI authorship, health and churn.

    Results that several others read (counts per repository and language, judged commits, authors per window) are
    written once to the shared folder when ``materialize`` is set; all of them are far smaller than their input. Commits and their statistics are
    read once, whatever is asked for. Of the trees of a repository in ``files`` only the present one is in
    the results: the one without a commit hash, else the only one; a repository of which neither holds is an error row.
    Which trees these are is told from keys alone; a filter of their keys then passes their files and few others, whose sums are
    dropped. Contents are read where they lie and never move.
    """
    _need(tables, "files")
    if options.churn:
        _need(tables, "commits", "commit_files")
    if options.ai or options.health_details:
        _need(tables, "commits", "commit_stats")
    if options.health:
        _need(tables, "commits")
    keep = stage if options.materialize else (lambda df, name: df)
    spark = tables.repos.sparkSession
    failures = tables.failures
    if failures is None:
        failures = spark.createDataFrame([], REPO_FAILURES)
    selected = select_repos(
        tables.repos, projects=options.projects, include=options.include, exclude=options.exclude,
        include_archived=options.include_archived, include_forks=options.include_forks, owner=options.owner,
    )
    files = tables.files if "commit_hash" in tables.files.columns else tables.files.withColumn("commit_hash", F.lit(None).cast("string"))
    heads, unclear = codestats.head_trees(keep(files.select("repo", "commit_hash").distinct(), "trees"))
    failed = _stage_failures(failures, "files").select("repo", "error")
    failed = failed.unionByName(unclear.join(failed, "repo", "left_anti").withColumn("error", F.lit("several trees, none of them marked as present")))
    good, errors = reports.split_results(selected, failed)
    keys = good.select("repo")
    heads = keep(heads.join(keys, "repo", "left_semi"), "heads")
    present = possible(files, heads.select("repo", F.col("head").alias("commit_hash")))
    counted = codestats.file_stats(present)
    need_paths = options.hotspots and options.churn
    if need_paths:
        counted = keep(counted, "file-stats")
    by_tree = keep(codestats.language_stats(counted, ["repo", "commit_hash"]), "language-stats")
    by_repo_language = codestats.of_heads(by_tree, heads)
    totals = codestats.repo_totals(keys, by_repo_language)
    by_language = codestats.portfolio_languages(by_repo_language)
    portfolio = codestats.portfolio_totals(totals)
    result = Analysis(
        repos=good, errors=errors, totals=totals, by_repo_language=by_repo_language, by_language=by_language,
        portfolio=portfolio, rows=good, head=portfolio, diagnostics=spark.createDataFrame([], DIAGNOSTICS),
    )
    parts: dict[str, DataFrame] = {}
    diagnostics: list[DataFrame] = []

    if tables.license_corpus is not None:
        found = license.license_matches(license.license_files(present), tables.license_corpus)
        result.licenses = license.best_license(codestats.of_heads(found, heads))

    limits = []  # of the analyses asked for
    if options.ai:
        limits.append(options.ai_commit_limit)
    if options.health or options.health_details:
        limits.append(options.health_commit_limit)
    if options.churn:
        limits.append(options.churn_limit)
    if limits:
        within = widest(*limits)
        stats = tables.commit_stats if options.ai or options.health_details else None
        judged = keep(judged_commits(keep_keys(tables.commits, selected.select("repo")), stats, now, within, options.ai), "judged-commits")

    if options.churn:
        scanned = among_first(judged, options.churn_limit, within)
        file_churn = churn.file_churn(scanned, tables.commit_files)
        result.scanned = churn.scanned_commits(scanned)
        result.top_files = churn.top_files(file_churn)
        if need_paths:
            per_path = codestats.of_heads(counted, heads).filter(F.col("complexity") > 0).groupBy("repo", "path").agg(F.sum("complexity").alias("complexity"))
            result.hotspots = churn.hotspots(file_churn, per_path)
        parts["churn"] = reports.churn_structs(result.scanned, result.top_files, result.hotspots)

    if options.ai:
        unlisted = _stage_failures(failures, "ai-estimate")
        listed = selected.select("repo").join(unlisted, "repo", "left_anti")
        commits = among_first(keep_keys(judged, listed), options.ai_commit_limit, within)
        result.ai = keep(authorship.sums_of(listed, commits), "ai-by-repo")
        result.ai_details = authorship.details_of(commits)
        result.ai_total = authorship.ai_over_all(result.ai.join(keys, "repo", "left_semi"))
        parts["ai_estimate"] = reports.ai_structs(result.ai)
        diagnostics.append(partial_errors(commits.filter("flagged"), authorship.PARTIAL_CATEGORY))
        diagnostics.append(unlisted.select(F.lit("ai-estimate").alias("category"), "repo", F.col("error").alias("message")))

    if options.health or options.health_details:
        unlisted = _stage_failures(failures, "health").select("repo", "error")
        listed = selected.select("repo").join(unlisted, "repo", "left_anti")
        commits = among_first(keep_keys(judged, listed), options.health_commit_limit, within)
        result.health = keep(health.repo_health(selected, commits, now, failures=unlisted), "health")
        result.health_summary = health.health_summary(result.health.join(keys, "repo", "left_semi"), totals)
        parts["health"] = reports.health_structs(result.health)
        diagnostics.append(health.failure_diagnostics(unlisted))
        if options.health_details:
            authors = keep(health.windows_of(commits), "author-windows")
            result.windows = health.window_details(authors)
            result.bus_factor = health.bus_factor(authors)
            result.velocity = health.velocity(authors)
            parts["health_details"] = reports.health_detail_structs(result.windows, result.bus_factor, result.velocity)
            diagnostics.append(partial_errors(commits, health.PARTIAL_CATEGORY))

    for part in diagnostics:
        result.diagnostics = result.diagnostics.unionByName(_named(part, selected))
    result.rows = reports.repository_rows(good, totals, by_repo_language, licenses=result.licenses, **parts)
    filters = reports.filters_struct(options.projects, options.include, options.exclude)
    result.head = reports.report_head(
        portfolio, by_language, ai=result.ai_total, summary=result.health_summary, filters=filters, **labels
    )
    return result


@dataclass
class Trends:
    """Results over time."""

    calendar: DataFrame
    snapshots: DataFrame
    by_repo: DataFrame
    by_language: DataFrame
    totals: DataFrame
    errors: DataFrame
    rows: DataFrame
    repository_rows: DataFrame
    head: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Report tables; collects the labels of the periods."""
        return trend_tables(vars(self), trends.period_labels(self.calendar))


def analyze_trends(
    tables: Portfolio, options: Options, since: str, until: str, interval: str, **labels: str
) -> Trends:
    """Code of every repository at every period end.

    The chosen commits and the sums of their trees are written once to the shared folder; the trees
    themselves are read once, in place.
    """
    _need(tables, "files", "commits")
    keep = stage if options.materialize else (lambda df, name: df)
    spark = tables.repos.sparkSession
    failures = tables.failures
    if failures is None:
        failures = spark.createDataFrame([], REPO_FAILURES)
    selected = select_repos(
        tables.repos, include=options.include, exclude=options.exclude,
        include_archived=options.include_archived, include_forks=options.include_forks, owner=options.owner,
    )
    good, errors = reports.split_results(selected, _stage_failures(failures, "trends"))
    commits = keep_keys(tables.commits, good.select("repo"))
    calendar = trends.period_calendar(spark, since, until, interval)
    at_periods = trends.commits_at_periods(commits, since, until, interval)
    snapshots = keep(trends.with_tree(at_periods, tables.files), "snapshots")
    sums = keep(trends.snapshot_languages(snapshots, tables.files), "snapshot-languages")
    by_repo = trends.trend_repos(snapshots, sums)
    by_language = trends.trend_languages(sums)
    totals = trends.trend_totals(calendar, by_repo)
    return Trends(
        calendar=calendar, snapshots=snapshots, by_repo=by_repo, by_language=by_language, totals=totals,
        errors=errors, rows=reports.trend_snapshots(totals, by_language),
        repository_rows=reports.trend_repository_rows(good, by_repo, sums),
        head=reports.trends_head(
            calendar, reports.filters_struct((), options.include, options.exclude),
            since=since, until=until, interval=interval, **labels,
        ),
    )
