"""Earlier reports in JSON, standard or trends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.health import CATEGORIES
from tallyforge.schema import MEASURES, repo_key

# Names of the fields in a report.
_MEASURES = "files bigint, lines bigint, code bigint, comments bigint, blanks bigint, complexity bigint"
LANGUAGES = f"array<struct<name string, {_MEASURES}>>"
TOTALS = f"struct<repos bigint, {_MEASURES}, filtered_files bigint>"
FILE_CHURN = (
    "array<struct<path string, changes bigint, additions bigint, deletions bigint, complexity bigint, hotspot double>>"
)
AI_ESTIMATE = (
    "struct<total_commits bigint, ai_commits bigint, commit_percent double, total_additions bigint,"
    " ai_additions bigint, addition_percent double, details array<struct<hash string, author string,"
    " message string, signals array<string>, additions bigint, deletions bigint>>>"
)
HEALTH = "struct<category string, last_commit_date string, days_since_commit int, error string>"
HEALTH_DETAILS = (
    "struct<authors_by_window map<string, int>, churn_by_window map<string, struct<additions bigint,"
    " deletions bigint, net_churn bigint, commits int>>, bus_factor double, velocity_trend double>"
)
REPOSITORY = (
    f"struct<repository string, project string, provider string, url string, license string, languages {LANGUAGES},"
    f" totals {TOTALS}, filtered_files bigint,"
    f" churn struct<total_commits bigint, top_files {FILE_CHURN}, hotspots {FILE_CHURN}>,"
    f" ai_estimate {AI_ESTIMATE}, health {HEALTH}, health_details {HEALTH_DETAILS}>"
)
_CATEGORY = "struct<repos bigint, code bigint, code_percent double>"
HEALTH_SUMMARY = f"struct<active {_CATEGORY}, maintained {_CATEGORY}, abandoned {_CATEGORY}, failed {_CATEGORY}>"
ERRORS = "array<struct<repository string, error string>>"
HEAD = (
    "generated_at string, provider string, workspace string, organization string,"
    " filters struct<projects array<string>, repos array<string>, exclude array<string>>,"
    f" totals {TOTALS}, by_language {LANGUAGES}, ai_estimate {AI_ESTIMATE}, health_summary {HEALTH_SUMMARY},"
    " since string, until string, `interval` string, periods array<string>"
)
SNAPSHOT = f"struct<period string, totals {TOTALS}, by_language {LANGUAGES}>"
ERROR = "struct<repository string, error string>"


def _fields(struct: str) -> str:
    return struct.removeprefix("struct<").removesuffix(">")


@dataclass
class Report:
    """One or more reports of a kind (``standard`` or ``trends``), as rows: none of the frames has a whole report in a row."""

    kind: str
    head: DataFrame
    repositories: DataFrame  # of trends with ``period``
    errors: DataFrame
    snapshots: DataFrame | None = None


# Documents: each a whole report.


def parse_reports(texts: DataFrame) -> DataFrame:
    """Reports from a frame with the report text in ``value``: ``document`` as a VARIANT, which has no fixed type, with its ``report_type``.

    A report with snapshots is about trends, any other is a standard one; a text that is no JSON is none. Other columns are passed on.
    """
    kept = [c for c in texts.columns if c != "value"]
    snapshots = F.try_variant_get("document", "$.snapshots", "array<variant>")
    kind = F.when(F.size(snapshots) > 0, F.lit("trends")).otherwise(F.lit("standard"))
    parsed = texts.select(*kept, F.try_parse_json("value").alias("document")).filter(F.col("document").isNotNull())
    return parsed.withColumn("report_type", kind)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of one report each."""
    return parse_reports(spark.read.text(path, wholetext=True))


def _elements(documents: DataFrame, column: str, path: str, kind: str, *kept: Column) -> DataFrame:
    """A row for each element of an array inside a document, as ``e`` of a type, with its ``place``; the document itself goes no further."""
    found = F.try_variant_get(F.col(column).outer(), path, "variant")
    exploded = documents.lateralJoin(documents.sparkSession.tvf.variant_explode(found))
    return exploded.select(*kept, F.col("pos").alias("place"), F.try_variant_get("value", "$", kind).alias("e"))


def _organization() -> Column:
    return F.try_variant_get("document", "$.organization", "string").alias("organization")


def report_repositories(reports: DataFrame) -> DataFrame:
    """Repository rows of standard reports."""
    standard = reports.filter(F.col("report_type") == "standard")
    return _elements(standard, "document", "$.repositories", REPOSITORY, _organization()).select("organization", "e.*")


def report_snapshots(reports: DataFrame) -> DataFrame:
    """Period rows of trends reports, numbered."""
    trends = reports.filter(F.col("report_type") == "trends")
    return _elements(trends, "document", "$.snapshots", SNAPSHOT, _organization()).select(
        "organization", (F.col("place") + 1).alias("period_no"), "e.*"
    )


def of_documents(reports: DataFrame, kind: str) -> Report:
    """All reports of a kind, taken apart."""
    own = reports.filter(F.col("report_type") == kind)
    head = own.select(F.try_variant_get("document", "$", f"struct<{HEAD}>").alias("h")).select("h.*")
    errors = _elements(own, "document", "$.errors", ERROR).select("e.*")
    if kind == "standard":
        return Report(kind, head, report_repositories(own).drop("organization"), errors)
    periods = _elements(own, "document", "$.snapshots", "variant").select((F.col("place") + 1).alias("period_no"), F.col("e").alias("snapshot"))
    period = F.try_variant_get("snapshot", "$.period", "string").alias("period")
    rows = _elements(periods, "snapshot", "$.repositories", REPOSITORY, F.col("period_no"), period).select("period_no", "period", "e.*")
    return Report(kind, head, rows, errors, report_snapshots(own).drop("organization"))


# Folders, as this package writes them.


def read_report(spark: SparkSession, folder: str) -> Report:
    """A report that was written as folders of JSON lines. One that has snapshots is about trends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshots")
    trends = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def lines(name: str, fields: str) -> DataFrame:
        return spark.read.schema(fields).json(f"{folder}/{name}")

    numbered = "period_no int, period string, "
    head, errors = lines("head", HEAD), lines("errors", _fields(ERROR))
    rows = lines("repositories", (numbered if trends else "") + _fields(REPOSITORY))
    if not trends:
        return Report("standard", head, rows, errors)
    return Report("trends", head, rows, errors, lines("snapshots", "period_no int, " + _fields(SNAPSHOT)))


def report_frames(report: Report) -> dict[str, DataFrame]:
    """A standard report taken apart into the frames that report tables are made of.

    The key of a repository is made of provider and URL as ever; several reports may be read at once.
    """
    standard = report.head
    rows = report.repositories.withColumn("repo", repo_key(F.col("provider"), F.col("url")))
    files = ["path", "changes", "additions", "deletions", "complexity", "hotspot"]

    def ranked(column: str) -> DataFrame:
        exploded = rows.select("repo", F.posexplode(column).alias("_place", "f"))
        return exploded.select("repo", (F.col("_place") + 1).alias("rank"), *[F.col("f")[c].alias(c) for c in files])

    windows = rows.select(
        "repo", F.explode("health_details.churn_by_window").alias("window", "w"), "health_details.authors_by_window"
    ).select(
        "repo",
        "window",
        F.coalesce(F.try_element_at("authors_by_window", F.col("window")), F.lit(0)).cast("long").alias("authors"),
        F.col("w.commits").cast("long").alias("commits"),
        "w.additions",
        "w.deletions",
        "w.net_churn",
    )
    summary = standard.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(c).alias("category"), F.col(f"health_summary.{c}").alias("s"))
                    for i, c in enumerate(CATEGORIES, start=1)
                ]
            )
        )
    ).filter(F.col("s").isNotNull())
    project = F.coalesce("project", F.lit(""))
    return {
        "repos": rows.select("repo", F.col("repository").alias("slug"), project.alias("project"), "provider", "url"),
        "totals": rows.select("repo", *[F.col(f"totals.{m}").alias(m) for m in MEASURES]),
        "portfolio": standard.select(
            F.col("totals.repos").alias("repos"),
            *[F.col(f"totals.{m}").alias(m) for m in MEASURES],
            F.coalesce("totals.filtered_files", F.lit(0)).alias("filtered_files"),
        ),
        "by_language": standard.select(F.inline("by_language")).withColumnRenamed("name", "language"),
        "licenses": rows.filter(F.col("license").isNotNull()).select("repo", "license"),
        "ai": rows.filter(F.col("ai_estimate").isNotNull()).select("repo", "ai_estimate.commit_percent", "ai_estimate.ai_additions"),
        "ai_total": standard.filter(F.col("ai_estimate").isNotNull()).select(
            *[F.col(f"ai_estimate.{c}").alias(c) for c in ["total_commits", "ai_commits", "commit_percent", "ai_additions"]]
        ),
        "health": rows.filter(F.col("health").isNotNull()).select("repo", "health.category", "health.days_since_commit"),
        "health_summary": summary.select("position", "category", "s.repos", "s.code", "s.code_percent"),
        "windows": windows,
        "scanned": rows.filter(F.col("churn").isNotNull()).select("repo", "churn.total_commits"),
        "top_files": ranked("churn.top_files"),
        "hotspots": ranked("churn.hotspots"),
        "errors": report.errors,
    }


def trend_frames(report: Report) -> dict[str, DataFrame]:
    """A trends report taken apart: totals, language sums and repository sums per period."""
    rows, periods = report.repositories, report.snapshots
    measures = [F.col(f"totals.{m}").alias(m) for m in MEASURES]
    return {
        "totals": periods.select("period_no", "period", F.coalesce("totals.repos", F.lit(0)).alias("repos"), *measures),
        "by_language": periods.select("period_no", "period", F.inline("by_language")).withColumnRenamed("name", "language"),
        "by_repo": rows.select("period_no", "period", repo_key(F.col("provider"), F.col("url")).alias("repo"), "repository", *measures),
    }
