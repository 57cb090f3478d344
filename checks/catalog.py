"""Every query over the given tables, next to the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views_sql
from checks.standin import NOW, Standin

from checks.views_sql import sql
from tallyforge.functions import text as T
from tallyforge.functions.calendar import MONTHLY, WEEKLY
from tallyforge.operators import authorship, churn, codestats, health, license, ranking, selection, trends
from tallyforge.plans import reports, tables
from tallyforge.plans.analyze import Options, analyze, analyze_trends
from tallyforge.session import shared_folder
from tallyforge.sinks.reports import diagnostic_lines, write_report, write_trends_report
from tallyforge.sources import archives, bitbucket, github, gitlab
from tallyforge.sources import reports as report_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SINCE, UNTIL = "2000-01", "2000-06"
PERIODS = ["2000-01", "2000-02", "2000-03", "2000-04", "2000-05", "2000-06"]
MEASURES = "files, lines, code, comments, blanks, complexity"


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Standin], DataFrame]], Callable]:
    """Register a query on the stand-in tables, and its SQL."""

    def register(make: Callable[[Standin], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(Standin(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return make

    return register


def rounded(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


# Selection of repositories.


@query(
    "repo_filter",
    """SELECT repo, slug, provider, project FROM repos
       WHERE NOT fork AND NOT archived AND (provider <> 'bitbucket' OR project IN ('BUILDING', 'FURNITURE'))""",
)
def repo_filter(s: Standin) -> DataFrame:
    return selection.select_repos(s.repos(), projects=["BUILDING", "FURNITURE"]).select("repo", "slug", "provider", "project")


@query(
    "repo_lists",
    """SELECT repo, slug FROM repos WHERE slug IN ('Customer-000000007', 'Customer-000000009', 'Customer-000000010')
       AND slug NOT IN ('Customer-000000009', 'customer-000000007')""",
)
def repo_lists(s: Standin) -> DataFrame:
    return selection.select_repos(
        s.repos(), include=["Customer-000000007", "Customer-000000009", "Customer-000000010"],
        exclude=["Customer-000000009", "customer-000000007"], include_archived=True, include_forks=True,
    ).select("repo", "slug")


@query("owner_scope", "SELECT repo, url FROM repos WHERE owner = 'NATION_7'")
def owner_scope(s: Standin) -> DataFrame:
    return selection.in_owner_scope(s.repos(), "NATION_7").select("repo", "url")


@query(
    "repo_url_parts",
    "SELECT repo, owner, slug AS name, owner || '/' || slug AS project_path FROM repos",
)
def repo_url_parts(s: Standin) -> DataFrame:
    url = F.col("url")
    return s.repos().select(
        "repo", T.url_owner(url).alias("owner"), T.url_name(url).alias("name"), T.url_project_path(url).alias("project_path")
    )


@query("project_list", "SELECT upper(n_name) AS key, n_name AS name FROM nation")
def project_list(s: Standin) -> DataFrame:
    return selection.pick_projects(bitbucket.projects(s.project_pages()))


# Commits.


@query(
    "commit_limit",
    """SELECT repo, hash FROM (SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS n FROM commits)
       WHERE n <= 5""",
)
def commit_limit(s: Standin) -> DataFrame:
    return ranking.limit_commits(s.commits(), 5).select("repo", "hash")


_LISTED = "(hash::BIGINT * 7919) % 100003"


@query(
    "commit_limit_large",
    f"""SELECT repo, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq NULLS LAST, ts DESC, hash) AS n
                                FROM (SELECT CASE WHEN repo::BIGINT % 3 = 1 THEN 'hot' ELSE repo END AS repo, hash, ts,
                                             CASE WHEN hash::BIGINT % 5 > 0 THEN {_LISTED} // 40 END AS seq FROM commits))
        WHERE n <= 2000""",
)
def commit_limit_large(s: Standin) -> DataFrame:
    """One repository with a third of all commits or more, listed in an order that is not that of time, and in part in none."""
    seq = F.when(F.col("hash").cast("long") % 5 > 0, F.expr(f"({_LISTED.replace('::BIGINT', '')}) div 40".replace("hash", "CAST(hash AS BIGINT)")))
    commits = s.commits().withColumn("seq", seq).withColumn("repo", F.when(F.col("repo").cast("long") % 3 == 1, "hot").otherwise(F.col("repo")))
    return ranking.limit_commits(commits, 2000).select("repo", "hash")


@query("ai_signals", "SELECT repo, hash, signals FROM signals")
def ai_signals(s: Standin) -> DataFrame:
    return authorship.commit_signals(s.commits()).select("repo", "hash", F.array_join("signals", ",").alias("signals"))


@query(
    "ai_estimate_repo",
    "SELECT repo, total_commits, ai_commits, round(commit_percent, 6) AS commit_percent, ai_additions FROM ai",
)
def ai_estimate_repo(s: Standin) -> DataFrame:
    by_repo = authorship.ai_by_repo(s.repos(), s.commits(), s.commit_stats())
    return by_repo.withColumn("commit_percent", F.round("commit_percent", 6))


def _hot(rows: DataFrame) -> DataFrame:
    """Every third repository folded into one, which then has a third of all rows."""
    return rows.withColumn("repo", F.when(F.col("repo").cast("long") % 3 == 0, "hot").otherwise(F.col("repo")))


@query(
    "ai_estimate_hot",
    """SELECT CASE WHEN s.repo::BIGINT % 3 = 0 THEN 'hot' ELSE s.repo END AS repo, count(*) AS total_commits,
              count(*) FILTER (signals <> '') AS ai_commits, coalesce(sum(additions) FILTER (signals <> ''), 0)::BIGINT AS ai_additions
       FROM signals s LEFT JOIN commit_stats x ON s.repo = x.repo AND s.hash = x.hash GROUP BY 1""",
)
def ai_estimate_hot(s: Standin) -> DataFrame:
    commits = _hot(s.commits())
    return authorship.ai_by_repo(commits.select("repo").distinct(), commits, _hot(s.commit_stats())).drop("commit_percent")


@query(
    "ai_estimate_limited",
    """SELECT repo, count(*) AS total_commits, count(*) FILTER (signals <> '') AS ai_commits,
              coalesce(sum(additions) FILTER (signals <> ''), 0)::BIGINT AS ai_additions
       FROM (SELECT s.repo, s.hash, signals, additions, row_number() OVER (PARTITION BY s.repo ORDER BY ts DESC, s.hash) AS n
             FROM signals s LEFT JOIN commit_stats x ON s.repo = x.repo AND s.hash = x.hash) WHERE n <= 4 GROUP BY repo""",
)
def ai_estimate_limited(s: Standin) -> DataFrame:
    by_repo = authorship.ai_by_repo(s.commits().select("repo").distinct(), s.commits(), s.commit_stats(), 4)
    return by_repo.drop("commit_percent")


@query(
    "ai_details",
    """SELECT s.repo, s.hash, author, first_line AS message, signals, additions, deletions
       FROM signals s JOIN commit_stats x ON s.repo = x.repo AND s.hash = x.hash WHERE signals <> ''""",
)
def ai_details(s: Standin) -> DataFrame:
    details = authorship.ai_details(s.commits(), s.commit_stats())
    return details.withColumn("signals", F.array_join("signals", ",")).drop("ts", "seq")


@query(
    "ai_estimate_org",
    """SELECT sum(total_commits)::BIGINT AS total_commits, sum(ai_commits)::BIGINT AS ai_commits,
              round(sum(ai_commits)::DOUBLE / sum(total_commits) * 100, 6) AS commit_percent,
              sum(ai_additions)::BIGINT AS ai_additions FROM ai""",
)
def ai_estimate_org(s: Standin) -> DataFrame:
    by_repo = authorship.ai_by_repo(s.repos(), s.commits(), s.commit_stats())
    return authorship.ai_over_all(by_repo).withColumn("commit_percent", F.round("commit_percent", 6))


# Health.


def _health(s: Standin, limit: int = health.DEFAULT_COMMIT_LIMIT) -> DataFrame:
    failed = s.failures().filter(F.col("stage") == "health").select("repo", "error")
    return health.repo_health(s.repos(), s.commits(), NOW, failures=failed, limit=limit)


@query("health_repo", "SELECT repo, category, last_commit_date, days_since_commit, error FROM health")
def health_repo(s: Standin) -> DataFrame:
    return _health(s)


def _listed(commits: DataFrame) -> DataFrame:
    """Commits listed in an order that is not that of time, some of them without a place in it."""
    number = F.col("hash").cast("long")
    return commits.withColumn("seq", F.when(number % 5 > 0, number * 7919 % 100003))


@query(
    "health_listed",
    """SELECT r.repo, CASE WHEN f.error IS NOT NULL THEN 'failed' WHEN last IS NULL THEN 'abandoned' WHEN days < 180 THEN 'active'
                           WHEN days < 365 THEN 'maintained' ELSE 'abandoned' END AS category,
              CASE WHEN f.error IS NOT NULL OR last IS NULL THEN -1 ELSE days END AS days_since_commit
       FROM repos r LEFT JOIN (SELECT repo, ts AS last, greatest(floor(epoch(now - ts) / 86400), 0)::INTEGER AS days
                               FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN nr % 5 > 0 THEN nr * 7919 % 100003 END NULLS LAST, ts DESC, hash) AS n
                                     FROM commits) x JOIN now_ ON n = 1) c ON r.repo = c.repo
            LEFT JOIN (SELECT * FROM failures WHERE stage = 'health') f ON r.repo = f.repo""",
)
def health_listed(s: Standin) -> DataFrame:
    """The first listed commit alone speaks, whatever its date."""
    failed = s.failures().filter(F.col("stage") == "health").select("repo", "error")
    found = health.repo_health(s.repos(), _listed(s.commits()), NOW, failures=failed, limit=1)
    return found.select("repo", "category", "days_since_commit")


@query("health_repo_details", "SELECT repo, category, last_commit_date, days_since_commit, error FROM health")
def health_repo_details(s: Standin) -> DataFrame:
    return _health(s, health.DEFAULT_COMMIT_LIMIT)


@query("health_summary", "SELECT position, category, repos, code, round(code_percent, 6) AS code_percent FROM summary")
def health_summary(s: Standin) -> DataFrame:
    return health.health_summary(_health(s), _totals(s)).withColumn("code_percent", F.round("code_percent", 6))


def _authors(s: Standin) -> DataFrame:
    return health.author_windows(s.commits(), s.commit_stats(), NOW)


@query("health_windows", 'SELECT repo, "window", authors, commits, additions, deletions, net_churn FROM windows')
def health_windows(s: Standin) -> DataFrame:
    return health.window_details(_authors(s))


@query(
    "bus_factor",
    """SELECT repo, round(max(n)::DOUBLE / sum(n) * 100, 6) AS bus_factor
       FROM (SELECT repo, identity, count(*) AS n FROM commits GROUP BY ALL) GROUP BY repo""",
)
def bus_factor(s: Standin) -> DataFrame:
    return health.bus_factor(_authors(s)).select("repo", rounded("bus_factor"))


@query(
    "velocity",
    """SELECT repo, round(CASE WHEN p > 0 THEN r::DOUBLE / p ELSE 0 END, 6) AS velocity_trend
       FROM (SELECT repo, count(*) FILTER (ts >= six) AS r, count(*) FILTER (ts < six AND ts >= twelve) AS p
             FROM commits, now_ GROUP BY repo)""",
)
def velocity(s: Standin) -> DataFrame:
    return health.velocity(_authors(s)).select("repo", rounded("velocity_trend"))


_PARTIAL = """
    SELECT 'ai-estimate-detail' AS category, s.repo, 'CommitStats ' || s.hash || ': no statistics' AS message
    FROM signals s WHERE signals <> '' AND s.hash NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem)
    UNION ALL
    SELECT 'health-details', c.repo, 'CommitStats ' || c.hash || ': no statistics'
    FROM commits c WHERE c.hash NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem)"""


@query("partial_errors", _PARTIAL)
def partial_errors(s: Standin) -> DataFrame:
    commits, stats = s.commits(), s.commit_stats()
    return authorship.ai_partial_errors(commits, stats).unionByName(health.health_partial_errors(commits, stats))


# Churn.


@query("churn_files", "SELECT repo, path, changes, additions, deletions FROM churn")
def churn_files(s: Standin) -> DataFrame:
    return churn.file_churn(s.commits(), s.commit_files())


@query("churn_top_files", "SELECT repo, path, changes, additions, deletions, rank FROM top_files")
def churn_top_files(s: Standin) -> DataFrame:
    return churn.top_files(churn.file_churn(s.commits(), s.commit_files()))


@query(
    "churn_hot",
    """SELECT CASE WHEN repo::BIGINT % 3 = 0 THEN 'hot' ELSE repo END AS repo, path, count(*) AS changes,
              sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM commit_files GROUP BY 1, 2""",
)
def churn_hot(s: Standin) -> DataFrame:
    return churn.file_churn(_hot(s.commits()), _hot(s.commit_files()))


@query(
    "hotspots_beyond_top_files",
    """SELECT * FROM (SELECT c.repo, c.path, changes, complexity, row_number() OVER (PARTITION BY c.repo ORDER BY changes * complexity DESC, c.path)::INTEGER AS rank
       FROM (SELECT 'hot' AS repo, path, count(*) AS changes FROM commit_files WHERE repo::BIGINT % 3 = 0 GROUP BY path) c
            JOIN (SELECT path, sum(complexity)::BIGINT AS complexity FROM complexity WHERE repo::BIGINT % 3 = 0 GROUP BY path) x USING (path)
       WHERE complexity > 0) WHERE rank <= 40""",
)
def hotspots_beyond_top_files(s: Standin) -> DataFrame:
    per_path = _hot(s.complexity()).where("repo = 'hot'").groupBy("repo", "path").agg(F.sum("complexity").alias("complexity"))
    return churn.hotspots(churn_hot(s), per_path, 40).select("repo", "path", "changes", "complexity", "rank")


@query("churn_scanned", "SELECT repo, count(*) AS total_commits FROM commits GROUP BY repo")
def churn_scanned(s: Standin) -> DataFrame:
    return churn.scanned_commits(s.commits())


@query(
    "hotspots",
    """SELECT * FROM (SELECT t.repo, t.path, changes, additions, deletions, complexity,
              changes::DOUBLE * complexity AS hotspot,
              row_number() OVER (PARTITION BY t.repo ORDER BY changes * complexity DESC, t.path)::INTEGER AS rank
       FROM churn t JOIN complexity c ON t.repo = c.repo AND t.path = c.path WHERE complexity > 0) WHERE rank <= 10""",
)
def hotspots(s: Standin) -> DataFrame:
    return churn.hotspots(churn.file_churn(s.commits(), s.commit_files()), s.complexity())


# Code statistics.


@query("file_flags", "SELECT repo, path, status FROM source_status")
def file_flags(s: Standin) -> DataFrame:
    return codestats.file_stats(s.documents()).select("repo", "path", "status")


@query("file_rules", "SELECT repo, path, status FROM ruled")
def file_rules(s: Standin) -> DataFrame:
    return codestats.file_stats(s.ruled_files()).select("repo", "path", "status")


@query(
    "language_candidates",
    f"""SELECT repo, CASE WHEN regexp_matches(text, '{views_sql._MARKED}') THEN NULL ELSE first(language ORDER BY total DESC, place) END AS language
       FROM (SELECT repo, a.text, language, place, sum(CASE WHEN contains(a.text, sign) THEN weight ELSE 0 END)
                    + max(CASE WHEN language = 'Prolog' AND starts_with(a.text, '#!/usr/bin/env swipl') THEN 1000000 ELSE 0 END) AS total
             FROM ambiguous a JOIN signs s ON a.extension = s.extension GROUP BY ALL) GROUP BY repo, text""",
)
def language_candidates(s: Standin) -> DataFrame:
    return codestats.file_stats(s.ambiguous_files()).select("repo", "language")


@query("line_stats", "SELECT repo, path, language, lines, code, comments, blanks, complexity FROM source_counts")
def line_stats(s: Standin) -> DataFrame:
    return codestats.file_stats(s.documents()).filter(F.col("status") == codestats.COUNTED).drop("status")


@query(
    "source_languages",
    """SELECT s.repo, lang AS language, count(*) FILTER (status = 'counted') AS files,
              coalesce(sum(code), 0)::BIGINT AS code, coalesce(sum(comments), 0)::BIGINT AS comments,
              count(*) FILTER (status = 'filtered') AS filtered_files
       FROM (SELECT repo, path, status, CASE WHEN status = 'counted' THEN lang END AS lang FROM source_status) s
            LEFT JOIN source_counts c ON s.repo = c.repo AND s.path = c.path GROUP BY s.repo, lang""",
)
def source_languages(s: Standin) -> DataFrame:
    stats = codestats.language_stats(codestats.file_stats(s.documents()))
    return stats.select("repo", "language", "files", "code", "comments", "filtered_files")


def _languages(s: Standin) -> DataFrame:
    return codestats.language_stats(codestats.file_stats(s.head_files()))


def _totals(s: Standin) -> DataFrame:
    return codestats.repo_totals(s.repos(), _languages(s))


@query("repo_languages", f"SELECT repo, language, {MEASURES}, filtered_files FROM repo_languages")
def repo_languages(s: Standin) -> DataFrame:
    return _languages(s)


@query("repo_totals", f"SELECT repo, {MEASURES}, filtered_files FROM totals")
def repo_totals(s: Standin) -> DataFrame:
    return _totals(s)


@query(
    "stats_grouping_sets",
    """SELECT repo, language, GROUPING(repo, language)::INTEGER AS level, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines,
              sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks,
              sum(complexity)::BIGINT AS complexity
       FROM repo_languages WHERE language IS NOT NULL GROUP BY GROUPING SETS ((repo, language), (repo), (language), ())""",
)
def stats_grouping_sets(s: Standin) -> DataFrame:
    return codestats.stats_cube(_languages(s))


@query("portfolio_totals", f"SELECT repos, {MEASURES}, filtered_files FROM portfolio")
def portfolio_totals(s: Standin) -> DataFrame:
    return codestats.portfolio_totals(_totals(s))


@query("language_report", f"SELECT language, {MEASURES} FROM languages")
def language_report(s: Standin) -> DataFrame:
    return codestats.portfolio_languages(_languages(s))


# License.


@query("license_match", "SELECT repo, spdx, round(confidence, 6) AS confidence FROM matches WHERE confidence >= 0.85")
def license_match(s: Standin) -> DataFrame:
    found = license.license_matches(license.license_files(s.license_candidates()), s.corpus())
    return found.select("repo", "spdx", rounded("confidence"))


@query(
    "license_repo",
    """SELECT repo, spdx AS license, round(confidence, 6) AS confidence
       FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, spdx) AS n FROM matches WHERE confidence >= 0.85)
       WHERE n = 1""",
)
def license_repo(s: Standin) -> DataFrame:
    found = license.repo_license(license.license_files(s.license_candidates()), s.corpus())
    return found.select("repo", "license", rounded("confidence"))


@query(
    "license_mentions",
    """SELECT repo, spdx, round(confidence, 6) AS confidence FROM mentions WHERE confidence >= 0.01 AND repo LIKE 'doc%'""",
)
def license_mentions(s: Standin) -> DataFrame:
    """A low threshold, at which hardly anything can be left out beforehand."""
    found = license.license_matches(s.document_files(), s.notices(), 0.01)
    return found.select("repo", "spdx", rounded("confidence"))


# Trends.


@query(
    "period_calendar",
    """SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY m)::INTEGER AS period_no, strftime(m, '%Y-%m') AS period,
              strftime(m + INTERVAL 1 MONTH - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS period_end
       FROM (SELECT repo, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS m
             FROM commits GROUP BY repo)""",
)
def period_calendar(s: Standin) -> DataFrame:
    return _calendar(s, MONTHLY, "yyyy-MM")


@query(
    "period_calendar_weekly",
    """SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY d)::INTEGER AS period_no, strftime(d, '%Y-%m-%d') AS period,
              strftime(d, '%Y-%m-%d') || ' 23:59:59' AS period_end
       FROM (SELECT repo, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 7 DAY)) AS d
             FROM commits GROUP BY repo)""",
)
def period_calendar_weekly(s: Standin) -> DataFrame:
    return _calendar(s, WEEKLY, "yyyy-MM-dd")


def _calendar(s: Standin, interval: str, pattern: str) -> DataFrame:
    bounds = s.commits().groupBy("repo").agg(
        F.date_format(F.min("ts"), pattern).alias("since"), F.date_format(F.max("ts"), pattern).alias("until")
    )
    periods = trends.expand_periods(bounds, interval)
    return periods.withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd HH:mm:ss"))


@query("asof_commits", "SELECT repo, period_no, period, commit_hash FROM snapshots")
def asof_commits(s: Standin) -> DataFrame:
    return trends.commits_at_periods(s.commits(), SINCE, UNTIL, MONTHLY).drop("period_end")


@query(
    "asof_commits_weekly",
    """SELECT repo, w.period_no, w.period,
              arg_max(hash, strftime(committer_ts, '%Y-%m-%dT%H:%M:%S.%f') || '#' || hash) AS commit_hash
       FROM (SELECT (i + 1)::INTEGER AS period_no, strftime(TIMESTAMP '1999-11-03' + to_days((7 * i)::INTEGER), '%Y-%m-%d') AS period,
                    TIMESTAMP '1999-11-03 23:59:59' + to_days((7 * i)::INTEGER) AS period_end FROM range(0, 21) t(i)) w
            JOIN commits ON ts <= w.period_end GROUP BY ALL""",
)
def asof_commits_weekly(s: Standin) -> DataFrame:
    return trends.commits_at_periods(s.commits(), "1999-11-03", "2000-03-25", WEEKLY).drop("period_end")


def _snapshots(s: Standin) -> DataFrame:
    return trends.with_tree(trends.commits_at_periods(s.commits(), SINCE, UNTIL, MONTHLY), s.trees())


def _snapshot_languages(s: Standin) -> DataFrame:
    return trends.snapshot_languages(_snapshots(s), s.trees())


def _trend_repos(s: Standin) -> DataFrame:
    return trends.trend_repos(_snapshots(s), _snapshot_languages(s))


@query("trend_repo_totals", f"SELECT period_no, period, repo, {MEASURES} FROM trend_repo")
def trend_repo_totals(s: Standin) -> DataFrame:
    return _trend_repos(s)


@query("trend_language_totals", f"SELECT period_no, period, language, {MEASURES} FROM trend_lang")
def trend_language_totals(s: Standin) -> DataFrame:
    return trends.trend_languages(_snapshot_languages(s))


@query(
    "trend_pruned",
    f"SELECT 1::INTEGER AS period_no, period, language, {MEASURES} FROM trend_lang WHERE period = '2000-03'",
)
def trend_pruned(s: Standin) -> DataFrame:
    """One period, so about nine of ten trees are of no interest."""
    snapshots = trends.with_tree(trends.commits_at_periods(s.commits(), "2000-03", "2000-03", MONTHLY), s.trees())
    return trends.trend_languages(trends.snapshot_languages(snapshots, s.trees()))


def _trend_totals(s: Standin) -> DataFrame:
    return trends.trend_totals(trends.period_calendar(s.spark, SINCE, UNTIL, MONTHLY), _trend_repos(s))


@query(
    "trend_totals",
    f"""SELECT period_no, period, repos, {MEASURES}, code_delta,
               CASE WHEN code_delta IS NULL THEN '' WHEN code_delta >= 0 THEN '+' || code_delta ELSE code_delta::VARCHAR END AS delta_label
        FROM trend_delta""",
)
def trend_totals(s: Standin) -> DataFrame:
    return tables.period_table(_trend_totals(s))


@query(
    "trend_years",
    """SELECT period_no, code, CASE WHEN lag(code) OVER (ORDER BY period_no) > 0 THEN code - lag(code) OVER (ORDER BY period_no) END AS code_delta
       FROM (SELECT (year(ts) - 1990)::INTEGER AS period_no, count(*) AS code FROM commits GROUP BY 1)""",
)
def trend_years(s: Standin) -> DataFrame:
    years = s.commits().groupBy((F.year("ts") - 1990).alias("period_no")).agg(F.count(F.lit(1)).alias("code"))
    return trends.with_code_delta(years)


def _matrix_sql(row: str, view: str, where: str = "") -> str:
    cells = ", ".join(f"coalesce(sum(code) FILTER (period = '{p}'), 0)::BIGINT AS \"{p}\"" for p in PERIODS)
    return f"SELECT {row}, {cells} FROM {view} {where} GROUP BY {row}"


@query("trend_languages", _matrix_sql("language", "trend_lang"))
def trend_languages(s: Standin) -> DataFrame:
    return trends.code_matrix(trend_language_totals(s), "language", PERIODS)


@query("trend_repos", _matrix_sql("repo", "trend_repo"))
def trend_repos(s: Standin) -> DataFrame:
    return trends.code_matrix(_trend_repos(s), "repo", PERIODS)


@query(
    "trend_top_languages",
    _matrix_sql(
        "language", "trend_lang",
        "WHERE language IN (SELECT language FROM trend_lang GROUP BY language ORDER BY max(code) DESC, language LIMIT 10)",
    ),
)
def trend_top_languages(s: Standin) -> DataFrame:
    return tables.top_language_matrix(trend_language_totals(s), PERIODS)


@query(
    "trend_top_repos",
    _matrix_sql(
        "repo", "trend_repo", "WHERE repo IN (SELECT repo FROM trend_repo GROUP BY repo ORDER BY max(code) DESC, repo LIMIT 20)"
    ),
)
def trend_top_repos(s: Standin) -> DataFrame:
    return tables.top_repo_matrix(_trend_repos(s), PERIODS)


@query("trend_names", "SELECT DISTINCT language FROM trend_lang")
def trend_names(s: Standin) -> DataFrame:
    return tables.names_over_time(trend_language_totals(s), "language")


@query(
    "trend_snapshots",
    """SELECT t.period_no, t.period, t.repos, t.code, coalesce(l.names, '') AS languages
       FROM trend_total t LEFT JOIN (SELECT period_no, string_agg(language || '=' || code, ',' ORDER BY code DESC, language) AS names
                                     FROM trend_lang GROUP BY period_no) l ON t.period_no = l.period_no""",
)
def trend_snapshots(s: Standin) -> DataFrame:
    rows = reports.trend_snapshots(_trend_totals(s), trend_language_totals(s))
    pairs = F.transform("by_language", lambda e: F.concat(e["name"], F.lit("="), e["code"].cast("string")))
    return rows.select(
        "period_no", "period", "totals.repos", "totals.code", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("languages")
    )


# Report tables.


@query(
    "project_rollup",
    """SELECT CASE WHEN GROUPING(project) = 0 THEN project END AS project, GROUPING(project)::INTEGER AS is_total, count(*) AS repos,
              sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments, sum(complexity)::BIGINT AS complexity,
              round(sum(comments)::DOUBLE / sum(comments + code) * 100, 6) AS comment_percent
       FROM repos r JOIN totals t ON r.repo = t.repo GROUP BY ROLLUP (project)""",
)
def project_rollup(s: Standin) -> DataFrame:
    return tables.project_rollup(s.repos(), _totals(s)).withColumn("comment_percent", F.round("comment_percent", 6))


@query(
    "project_table",
    """SELECT coalesce(project, 'TOTAL') AS project, GROUPING(project)::INTEGER AS is_total, count(*) AS repos,
              format('{:,}', sum(code)::BIGINT) AS code_lines, format('{:,}', sum(comments)::BIGINT) AS comment_lines,
              round(sum(comments)::DOUBLE / sum(comments + code) * 100, 6) AS comment_percent,
              format('{:,}', sum(complexity)::BIGINT) AS complexity_label
       FROM repos r JOIN totals t ON r.repo = t.repo GROUP BY ROLLUP (project)""",
)
def project_table(s: Standin) -> DataFrame:
    rollup = tables.project_rollup(s.repos(), _totals(s)).withColumn("comment_percent", F.round("comment_percent", 6))
    return tables.project_table(rollup)


_REPO_LINES = """
    SELECT r.repo, slug AS repository, url, project, code, complexity,
           round(CASE WHEN comments + code = 0 THEN 0 ELSE comments::DOUBLE / (comments + code) * 100 END, 6) AS comment_percent
    FROM repos r JOIN totals t ON r.repo = t.repo"""


@query("all_repos", _REPO_LINES)
def all_repos(s: Standin) -> DataFrame:
    return tables.all_repos(s.repos(), _totals(s)).withColumn("comment_percent", F.round("comment_percent", 6))


@query("top_repos", _REPO_LINES + " ORDER BY code DESC, slug, r.repo LIMIT 10")
def top_repos(s: Standin) -> DataFrame:
    return tables.top_repos(s.repos(), _totals(s)).withColumn("comment_percent", F.round("comment_percent", 6))


@query(
    "repos_by_project",
    f"""SELECT x.*, sum(code) OVER (PARTITION BY project)::BIGINT AS project_code, count(*) OVER (PARTITION BY project) AS project_repos
        FROM ({_REPO_LINES}) x""",
)
def repos_by_project(s: Standin) -> DataFrame:
    return tables.repos_by_project(s.repos(), _totals(s)).withColumn("comment_percent", F.round("comment_percent", 6))


@query("top_languages", f"SELECT language, {MEASURES} FROM languages ORDER BY code DESC, language LIMIT 7")
def top_languages(s: Standin) -> DataFrame:
    return tables.top_languages(language_report(s))


@query(
    "top_language_names",
    """SELECT string_agg(language, ', ' ORDER BY code DESC, language) AS top_languages
       FROM (SELECT language, code FROM languages ORDER BY code DESC, language LIMIT 3)""",
)
def top_language_names(s: Standin) -> DataFrame:
    return tables.top_language_names(language_report(s), 3)


@query(
    "repo_report",
    """SELECT r.repo, slug AS repository, url, project, coalesce(license, '—') AS license, files, code, comments, t.complexity,
              CASE WHEN category = 'failed' THEN 'Failed (error)'
                   WHEN days_since_commit >= 0 THEN upper(category[1]) || category[2:] || ' (' || days_since_commit || 'd)'
                   ELSE upper(category[1]) || category[2:] || ' (no commits)' END AS health,
              printf('%.1f%%', floor(commit_percent * 10 + 0.5) / 10) AS ai_commits, ai_additions::VARCHAR AS ai_additions
       FROM repos r JOIN totals t ON r.repo = t.repo LEFT JOIN health h ON r.repo = h.repo LEFT JOIN ai ON r.repo = ai.repo
            LEFT JOIN licenses k ON r.repo = k.repo""",
)
def repo_report(s: Standin) -> DataFrame:
    ai = authorship.ai_by_repo(s.repos(), s.commits(), s.commit_stats())
    licenses = license.repo_license(license.license_files(s.license_files()), s.corpus())
    return tables.repository_table(s.repos(), _totals(s), licenses=licenses, health=_health(s), ai=ai)


@query(
    "summary_table",
    """SELECT position, metric, value FROM (
           SELECT 1 AS position, 'Repositories' AS metric, repos AS value FROM portfolio
           UNION ALL SELECT 2, 'Files', files FROM portfolio UNION ALL SELECT 3, 'Lines', lines FROM portfolio
           UNION ALL SELECT 4, 'Code', code FROM portfolio UNION ALL SELECT 5, 'Comments', comments FROM portfolio
           UNION ALL SELECT 6, 'Blanks', blanks FROM portfolio UNION ALL SELECT 7, 'Complexity', complexity FROM portfolio
           UNION ALL SELECT 8, 'Filtered Files', filtered_files FROM portfolio) WHERE position < 8 OR value > 0""",
)
def summary_table(s: Standin) -> DataFrame:
    return tables.summary_table(portfolio_totals(s))


@query("language_table", "SELECT language, files, code, comments, blanks, complexity FROM languages")
def language_table(s: Standin) -> DataFrame:
    return tables.language_table(language_report(s))


@query(
    "health_table",
    """SELECT position, CASE category WHEN 'active' THEN 'Active (<180d)' WHEN 'maintained' THEN 'Maintained (180-365d)'
                                      WHEN 'abandoned' THEN 'Abandoned (>365d)' ELSE 'Failed (error)' END AS category,
              repos, code, CASE category WHEN 'failed' THEN '—' ELSE printf('%.1f%%', floor(code_percent * 10 + 0.5) / 10) END AS code_share
       FROM summary WHERE category <> 'failed' OR repos > 0""",
)
def health_table(s: Standin) -> DataFrame:
    return tables.health_table(health.health_summary(_health(s), _totals(s)))


@query(
    "health_details_table",
    """SELECT w.repo, slug AS repository, "window", authors, commits, additions, deletions, net_churn,
              CASE "window" WHEN '0-6mo' THEN 1 WHEN '6-12mo' THEN 2 ELSE 3 END::INTEGER AS window_no
       FROM windows w JOIN repos r ON w.repo = r.repo""",
)
def health_details_table(s: Standin) -> DataFrame:
    return tables.health_details_table(s.repos(), health_windows(s))


@query(
    "churn_table",
    """SELECT slug AS repository, t.repo, total_commits, rank, path, changes, additions, deletions
       FROM top_files t JOIN repos r ON t.repo = r.repo
            JOIN (SELECT repo, count(*) AS total_commits FROM commits GROUP BY repo) n ON t.repo = n.repo""",
)
def churn_table(s: Standin) -> DataFrame:
    return tables.churn_table(s.repos(), churn_scanned(s), churn_top_files(s))


@query(
    "hotspot_table",
    """SELECT slug AS repository, x.repo, rank, path, changes, complexity, score::VARCHAR AS hotspot_score
       FROM (SELECT t.repo, t.path, changes, complexity, changes * complexity AS score,
                    row_number() OVER (PARTITION BY t.repo ORDER BY changes * complexity DESC, t.path)::INTEGER AS rank
             FROM churn t JOIN complexity c ON t.repo = c.repo AND t.path = c.path WHERE complexity > 0) x
            JOIN repos r ON x.repo = r.repo WHERE rank <= 10""",
)
def hotspot_table(s: Standin) -> DataFrame:
    return tables.hotspot_table(s.repos(), hotspots(s))


@query(
    "error_table",
    "SELECT slug AS repository, error FROM repos r JOIN failures f ON r.repo = f.repo WHERE stage = 'files'",
)
def error_table(s: Standin) -> DataFrame:
    failed = s.failures().filter(F.col("stage") == "files")
    return tables.error_table(reports.split_results(s.repos(), failed)[1])


@query("good_repos", "SELECT repo FROM repos WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'files')")
def good_repos(s: Standin) -> DataFrame:
    failed = s.failures().filter(F.col("stage") == "files")
    return reports.split_results(s.repos(), failed)[0].select("repo")


@query(
    "ai_table",
    """SELECT 1 AS position, 'Commits' AS metric, sum(total_commits)::BIGINT::VARCHAR AS total, sum(ai_commits)::BIGINT AS ai_attributed,
              printf('%.1f%%', floor(sum(ai_commits)::DOUBLE / sum(total_commits) * 1000 + 0.5) / 10) AS share FROM ai
       UNION ALL SELECT 2, 'Line additions', '—', sum(ai_additions)::BIGINT, '—' FROM ai HAVING sum(ai_additions) > 0""",
)
def ai_table(s: Standin) -> DataFrame:
    by_repo = authorship.ai_by_repo(s.repos(), s.commits(), s.commit_stats())
    return tables.ai_table(authorship.ai_over_all(by_repo))


@query(
    "report_sections",
    """SELECT (SELECT count(*) > 0 FROM ai) AS has_ai, (SELECT count(*) > 0 FROM health) AS has_health,
              (SELECT count(*) > 0 FROM windows) AS has_details, (SELECT count(*) > 0 FROM top_files) AS has_churn,
              (SELECT min(project) <> max(project) OR max(project) <> '' FROM repos) AS has_groups""",
)
def report_sections(s: Standin) -> DataFrame:
    ai = authorship.ai_by_repo(s.repos(), s.commits(), s.commit_stats())
    return tables.sections(s.repos(), ai=ai, health=_health(s), windows=health_windows(s), top_files=churn_top_files(s))


# Whole analyses, as a user runs them: what several results read is written to the shared folder.

ALL = dict(ai=True, health=True, health_details=True, churn=True, hotspots=True)


def _analysis(s: Standin, **options):
    chosen = Options(include_archived=True, include_forks=True, **{**ALL, **options})
    return analyze(s.portfolio(), chosen, NOW, provider="github", organization="org")


_SHOWN_DIAGNOSTICS = f"""
    SELECT category, slug AS repo, message FROM (
        SELECT d.* FROM ({_PARTIAL}) d LEFT JOIN failures f ON d.repo = f.repo
             AND ((category = 'ai-estimate-detail' AND stage = 'ai-estimate') OR (category = 'health-details' AND stage = 'health'))
        WHERE f.repo IS NULL
        UNION ALL SELECT stage, repo, error FROM failures WHERE stage IN ('ai-estimate', 'health')) x
    JOIN repos r ON x.repo = r.repo"""


@query("diagnostics", _SHOWN_DIAGNOSTICS)
def diagnostics(s: Standin) -> DataFrame:
    return _analysis(s, churn=False, hotspots=False).diagnostics


@query("diagnostic_lines", f"SELECT '[' || category || '] ' || repo || ' | ' || message AS value FROM ({_SHOWN_DIAGNOSTICS})")
def diagnostic_log(s: Standin) -> DataFrame:
    return diagnostic_lines(diagnostics(s))


@query("diagnostic_counts", f"SELECT category, count(*) AS entries FROM ({_SHOWN_DIAGNOSTICS}) GROUP BY category")
def diagnostic_counts(s: Standin) -> DataFrame:
    return diagnostics(s).groupBy("category").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "report_rows",
    """SELECT r.repo, slug AS repository, k.license, t.files, t.code, t.filtered_files, l.languages, n.total_commits AS scanned,
              f.paths AS top_files, a.total_commits, a.ai_commits, h.category, w.windows,
              CASE WHEN w.repo IS NOT NULL THEN round(b.bus_factor, 6) END AS bus_factor
       FROM repos r JOIN totals t ON r.repo = t.repo LEFT JOIN licenses k ON r.repo = k.repo
            LEFT JOIN (SELECT repo, string_agg(language, ',' ORDER BY code DESC, language) AS languages FROM repo_languages
                       WHERE language IS NOT NULL GROUP BY repo) l ON r.repo = l.repo
            LEFT JOIN (SELECT repo, string_agg(path, ',' ORDER BY rank) AS paths FROM top_files GROUP BY repo) f ON r.repo = f.repo
            LEFT JOIN (SELECT repo, count(*) AS total_commits FROM commits GROUP BY repo) n ON r.repo = n.repo
            LEFT JOIN (SELECT * FROM ai WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'ai-estimate')) a ON r.repo = a.repo
            LEFT JOIN health h ON r.repo = h.repo
            LEFT JOIN (SELECT repo, string_agg("window" || '=' || authors || '/' || commits, ',' ORDER BY "window") AS windows
                       FROM windows WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'health') GROUP BY repo) w ON r.repo = w.repo
            LEFT JOIN (SELECT repo, max(n)::DOUBLE / sum(n) * 100 AS bus_factor
                       FROM (SELECT repo, identity, count(*) AS n FROM commits GROUP BY ALL) GROUP BY repo) b ON r.repo = b.repo
       WHERE r.repo NOT IN (SELECT repo FROM failures WHERE stage = 'files')""",
)
def report_rows(s: Standin) -> DataFrame:
    rows = _analysis(s, hotspots=False).rows
    details = F.col("health_details")
    windows = F.transform(
        F.array_sort(F.map_keys(details["authors_by_window"])),
        lambda w: F.concat(
            w, F.lit("="), details["authors_by_window"][w].cast("string"), F.lit("/"),
            details["churn_by_window"][w]["commits"].cast("string"),
        ),
    )
    return rows.select(
        "repo", "repository", "license", "totals.files", "totals.code", F.coalesce("filtered_files", F.lit(0)).alias("filtered_files"),
        F.nullif(F.array_join("languages.name", ","), F.lit("")).alias("languages"),
        F.col("churn.total_commits").alias("scanned"), F.array_join("churn.top_files.path", ",").alias("top_files"),
        "ai_estimate.total_commits", "ai_estimate.ai_commits", "health.category",
        F.array_join(windows, ",").alias("windows"), F.round(details["bus_factor"], 6).alias("bus_factor"),
    )


@query(
    "report_head",
    """SELECT 'github' AS provider, 'org' AS organization, p.repos, p.code, l.names AS languages, a.total_commits, a.ai_commits,
              (SELECT count(*) FROM health h WHERE category = 'active' AND repo IN (SELECT repo FROM good)) AS active_repos,
              (SELECT count(*) FROM health h WHERE category = 'failed' AND repo IN (SELECT repo FROM good)) AS failed_repos
       FROM (SELECT count(*) AS repos, sum(code)::BIGINT AS code FROM totals WHERE repo IN (SELECT repo FROM good)) p,
            (SELECT string_agg(language || '=' || code, ',' ORDER BY code DESC, language) AS names
             FROM (SELECT language, sum(code)::BIGINT AS code FROM repo_languages
                   WHERE language IS NOT NULL AND repo IN (SELECT repo FROM good) GROUP BY language)) l,
            (SELECT sum(total_commits)::BIGINT AS total_commits, sum(ai_commits)::BIGINT AS ai_commits FROM ai
             WHERE repo IN (SELECT repo FROM good) AND repo NOT IN (SELECT repo FROM failures WHERE stage = 'ai-estimate')) a""",
)
def report_head(s: Standin) -> DataFrame:
    head = _analysis(s, churn=False, hotspots=False).head
    pairs = F.transform("by_language", lambda e: F.concat(e["name"], F.lit("="), e["code"].cast("string")))
    return head.select(
        "provider", "organization", "totals.repos", "totals.code", F.array_join(pairs, ",").alias("languages"),
        "ai_estimate.total_commits", "ai_estimate.ai_commits",
        F.col("health_summary.active.repos").alias("active_repos"), F.col("health_summary.failed.repos").alias("failed_repos"),
    )


@query(
    "report_heading",
    """SELECT 'a workspace' AS title, 'a group' AS organization, format('{:,}', repos) AS repositories, format('{:,}', lines) AS lines, format('{:,}', code) AS code,
              format('{:,}', comments) AS comments, format('{:,}', blanks) AS blanks,
              printf('%.1f%%', floor(CASE WHEN comments + code = 0 THEN 0 ELSE comments::DOUBLE / (comments + code) * 100 END * 10 + 0.5) / 10) AS comment_ratio,
              format('{:,}', complexity) AS complexity,
              (SELECT string_agg(language, ', ' ORDER BY code DESC, language) FROM (SELECT language, code FROM languages ORDER BY code DESC, language LIMIT 7)) AS top_languages,
              '2001-08-31' AS generated FROM portfolio""",
)
def report_heading(s: Standin) -> DataFrame:
    organization = T.report_organization(F.lit("an org"), F.lit("a user"), F.lit("a group"))
    head = reports.report_head(portfolio_totals(s), language_report(s), generated_at="2001-08-31T10:00:00Z", workspace="a workspace")
    return tables.heading_table(head.withColumn("organization", organization))


@query("trends_report", "SELECT period_no, period, repos, code, code_delta FROM trend_delta")
def trends_report(s: Standin) -> DataFrame:
    tables_ = s.portfolio()
    tables_.files, tables_.failures = s.trees(), None
    options = Options(include_archived=True, include_forks=True)
    totals = analyze_trends(tables_, options, SINCE, UNTIL, MONTHLY).totals
    return totals.select("period_no", "period", "repos", "code", "code_delta")


def _written(s: Standin, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "report_round_trip",
    """SELECT slug AS repository, project, k.license, t.files, t.code, t.comments, t.complexity, category, n.total_commits, f.path AS top_file, w.windows, ai_commits
       FROM repos r JOIN totals t ON r.repo = t.repo LEFT JOIN licenses k ON r.repo = k.repo LEFT JOIN health h ON r.repo = h.repo
            LEFT JOIN (SELECT repo, count(*) AS total_commits FROM commits GROUP BY repo) n ON r.repo = n.repo
            LEFT JOIN (SELECT repo, path FROM top_files WHERE rank = 1) f ON r.repo = f.repo
            LEFT JOIN (SELECT * FROM ai WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'ai-estimate')) a ON r.repo = a.repo
            LEFT JOIN (SELECT repo, count(*) AS windows FROM windows WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'health') GROUP BY repo) w ON r.repo = w.repo
       WHERE r.repo NOT IN (SELECT repo FROM failures WHERE stage = 'files')""",
)
def report_round_trip(s: Standin) -> DataFrame:
    """A report that was written, read again and taken apart."""
    result, folder = _analysis(s, hotspots=False), _written(s, "report")
    write_report(folder, result.head, result.rows, result.errors)
    frames = report_source.report_frames(report_source.read_report(s.spark, folder))
    windows = frames["windows"].groupBy("repo").agg(F.count(F.lit(1)).alias("windows"))
    ai = report_source.read_report(s.spark, folder).repositories.select(
        F.concat_ws(":", "provider", "url").alias("repo"), "ai_estimate.ai_commits"
    )
    parts = [
        frames["totals"], frames["licenses"], frames["health"], frames["scanned"], ai, windows,
        frames["top_files"].where("rank = 1").select("repo", F.col("path").alias("top_file")),
    ]
    out = frames["repos"]
    for part in parts:
        out = out.join(part, "repo", "left")
    return out.select(
        F.col("slug").alias("repository"), "project", "license", "files", "code", "comments", "complexity", "category", "total_commits", "top_file", "windows", "ai_commits"
    )


@query(
    "trends_round_trip",
    """SELECT t.period_no, t.period, t.repos, t.code, l.code AS go_code, r.code AS largest
       FROM trend_total t LEFT JOIN (SELECT period_no, code FROM trend_lang WHERE language = 'Go') l ON t.period_no = l.period_no
            LEFT JOIN (SELECT period_no, max(code) AS code FROM trend_repo GROUP BY period_no) r ON t.period_no = r.period_no""",
)
def trends_round_trip(s: Standin) -> DataFrame:
    tables_, folder = s.portfolio(), _written(s, "trends")
    tables_.files, tables_.failures = s.trees(), None
    result = analyze_trends(tables_, Options(include_archived=True, include_forks=True), SINCE, UNTIL, MONTHLY)
    write_trends_report(folder, result.head, result.rows, result.repository_rows, result.errors)
    frames = report_source.trend_frames(report_source.read_report(s.spark, folder))
    go = frames["by_language"].where("language = 'Go'").select("period_no", F.col("code").alias("go_code"))
    largest = frames["by_repo"].groupBy("period_no").agg(F.max("code").alias("largest"))
    joined = frames["totals"].join(go, "period_no", "left").join(largest, "period_no", "left")
    return joined.select("period_no", "period", "repos", "code", "go_code", "largest")


@query(
    "number_labels",
    """SELECT o_orderkey, format('{:,}', o_totalprice::BIGINT * (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END)) AS price_label,
              CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', -(o_totalprice::BIGINT)) ELSE '+' || format('{:,}', o_totalprice::BIGINT) END AS delta_label,
              strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'day ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day_or_text,
              upper(lower(o_orderpriority)[1]) || lower(o_orderpriority)[2:] AS capitalized
       FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders)""",
)
def number_labels(s: Standin) -> DataFrame:
    orders = s.table("orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, F.lit(-1)).otherwise(F.lit(1))
    number = F.floor("o_totalprice").cast("bigint") * sign
    instant = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    other = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("day "), "o_orderkey")).otherwise(instant)
    return orders.select(
        "o_orderkey", T.thousands(number).alias("price_label"), T.signed(number, separators=True).alias("delta_label"),
        T.date_part(instant).alias("day"), T.date_part(other).alias("day_or_text"),
        T.capitalize(F.lower("o_orderpriority")).alias("capitalized"),
    )


# Sources.


@query(
    "source_github_repos",
    """SELECT 'github:https://gh.example/' || n_name || '/' || c_name AS repo, 'github' AS provider, c_name AS slug, '' AS project,
              'https://gh.example/' || n_name || '/' || c_name || '.git' AS clone_url, '' AS default_branch,
              c_acctbal < 0 AS archived, c_custkey % 10 = 0 AS fork
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def source_github_repos(s: Standin) -> DataFrame:
    return github.repos(s.github_repo_pages()).drop("name", "url", "download_url")


@query(
    "source_gitlab_repos",
    """SELECT 'gitlab:https://gl.example/' || n_name || '/' || c_mktsegment || '/' || c_name AS repo, lower(c_name) AS slug, c_name AS name,
              n_name || '/' || c_mktsegment AS project, 'trunk' AS default_branch, c_acctbal < 0 AS archived, c_custkey % 10 = 0 AS fork
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def source_gitlab_repos(s: Standin) -> DataFrame:
    return gitlab.repos(s.gitlab_repo_pages()).drop("provider", "url", "clone_url", "download_url")


@query(
    "source_bitbucket_repos",
    """SELECT 'bitbucket:https://bb.example/' || n_name || '/' || c_name AS repo, c_name AS slug, c_mktsegment AS project,
              'https://bb.example/' || n_name || '/' || c_name || '.git' AS clone_url,
              'https://bitbucket.org/' || n_name || '/' || c_name || '/get/' || CASE WHEN c_custkey % 4 = 0 THEN 'dev%20line' ELSE 'main' END || '.tar.gz' AS download_url,
              CASE WHEN c_custkey % 4 = 0 THEN 'dev line' ELSE 'main' END AS default_branch, false AS archived, c_custkey % 10 = 0 AS fork
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 0""",
)
def source_bitbucket_repos(s: Standin) -> DataFrame:
    return bitbucket.repos(s.bitbucket_repo_pages()).drop("provider", "name", "url")


@query(
    "source_gitlab_subgroups",
    """SELECT n_nationkey::BIGINT AS id, lower(n_name) AS path, r_name || '/' || lower(n_name) AS full_path, n_name AS name
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def source_gitlab_subgroups(s: Standin) -> DataFrame:
    return gitlab.subgroups(s.subgroup_pages())


_SOURCE_COMMITS = """
    SELECT o_custkey::VARCHAR AS repo, o_orderkey::VARCHAR AS hash,
           'Dev ' || (o_orderkey % 3) || ' <dev' || (o_orderkey % 3) || '@e.com>' AS author,
           'Change' || chr(10) || o_orderpriority AS message,
           CASE WHEN o_orderkey % 17 <> 0 THEN strftime(date_trunc('second', o_orderdate), '%Y-%m-%d %H:%M:%S') END AS ts,
           floor(o_orderkey / 100)::BIGINT AS page
    FROM orders"""


def _commit_rows(commits: DataFrame) -> DataFrame:
    return commits.select(
        "repo", "hash", "author", "message", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.floor(F.col("seq") / 1_000_000).alias("page"),
    )


@query("source_github_commits", _SOURCE_COMMITS)
def source_github_commits(s: Standin) -> DataFrame:
    return _commit_rows(github.commits(s.commit_pages("github")))


@query("source_gitlab_commits", _SOURCE_COMMITS)
def source_gitlab_commits(s: Standin) -> DataFrame:
    return _commit_rows(gitlab.commits(s.commit_pages("gitlab")))


@query("source_bitbucket_commits", _SOURCE_COMMITS)
def source_bitbucket_commits(s: Standin) -> DataFrame:
    return _commit_rows(bitbucket.commits(s.commit_pages("bitbucket")))


def _asof_sql(provider: str, author: str, committer: str) -> str:
    return f"""SELECT '{provider}' AS provider, repo, period_no, period, arg_max(hash, strftime({committer}, '%Y-%m-%dT%H:%M:%S.%f') || '#' || hash) AS commit_hash
        FROM periods JOIN (SELECT o_custkey::VARCHAR AS repo, o_orderkey::VARCHAR AS hash, date_trunc('second', o_orderdate)::TIMESTAMP AS day,
                                  to_days((o_orderkey % 5 * 40)::INTEGER) AS apart FROM orders WHERE o_orderkey % 17 <> 0) c ON {author} <= period_end GROUP BY ALL"""


@query("asof_from_pages", _asof_sql("github", "day", "day + apart") + " UNION ALL " + _asof_sql("gitlab", "day - apart", "day"))
def asof_from_pages(s: Standin) -> DataFrame:
    """Landed commits whose two dates disagree."""
    found = [
        trends.commits_at_periods(source.commits(s.commit_pages(source.PROVIDER)), SINCE, UNTIL, MONTHLY).drop("period_end").withColumn("provider", F.lit(source.PROVIDER))
        for source in (github, gitlab)
    ]
    return found[0].unionByName(found[1])


@query("source_github_stats", "SELECT repo, hash, additions, deletions FROM commit_stats")
def source_github_stats(s: Standin) -> DataFrame:
    return github.commit_stats(s.detail_pages()).drop("error")


@query("source_gitlab_stats", "SELECT repo, hash, additions, deletions FROM commit_stats")
def source_gitlab_stats(s: Standin) -> DataFrame:
    return gitlab.commit_stats(s.detail_pages()).drop("error")


@query("source_bitbucket_stats", "SELECT repo, hash, additions, deletions FROM commit_stats")
def source_bitbucket_stats(s: Standin) -> DataFrame:
    return bitbucket.commit_stats(s.diff_pages()).drop("error")


@query("source_github_files", "SELECT repo, hash, path, additions, deletions FROM commit_files")
def source_github_files(s: Standin) -> DataFrame:
    return github.commit_files(s.detail_pages())


@query(
    "source_bitbucket_files",
    """SELECT repo, hash, CASE WHEN deletions % 2 = 1 THEN 'old-' ELSE '' END || path AS path, additions, deletions FROM commit_files""",
)
def source_bitbucket_files(s: Standin) -> DataFrame:
    return bitbucket.commit_files(s.diff_pages())


@query("archive_files", "SELECT 'doc' || doc_id AS repo, 'src/main.txt' AS path, md5(text) AS digest, strlen(text)::INTEGER AS bytes FROM documents")
def archive_files(s: Standin) -> DataFrame:
    files = archives.archive_files(archives.expand_archives(s.archives()))
    return files.select("repo", "path", F.md5("content").alias("digest"), F.octet_length("content").alias("bytes"))


@query(
    "report_reader",
    """SELECT 'org' || (c_custkey // 100) AS organization, CASE WHEN (c_custkey // 100) % 2 = 0 THEN 'standard' ELSE 'trends' END AS report_type,
              c_name AS label, floor(abs(c_acctbal))::BIGINT AS code FROM customer""",
)
def report_reader(s: Standin) -> DataFrame:
    parsed = report_source.parse_reports(s.report_texts())
    standard = report_source.report_repositories(parsed).select(
        "organization", F.lit("standard").alias("report_type"), F.col("repository").alias("label"), F.col("totals.code").alias("code")
    )
    trends_ = report_source.report_snapshots(parsed).select(
        "organization", F.lit("trends").alias("report_type"), F.col("period").alias("label"), F.col("totals.code").alias("code")
    )
    return standard.unionByName(trends_)
