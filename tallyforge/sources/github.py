"""GitHub responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.schema import repo_key
from tallyforge.sources.pages import instant, listed, or_blank, or_zero

PROVIDER = "github"

# Names of the fields in the responses.
REPO_PAGE = "array<struct<name string, full_name string, html_url string, clone_url string, archived boolean, fork boolean>>"
COMMIT_PAGE = (
    "array<struct<sha string, commit struct<author struct<name string, email string, date string>,"
    " committer struct<date string>, message string>>>"
)
COMMIT_DETAIL = (
    "struct<stats struct<additions bigint, deletions bigint>,"
    " files array<struct<filename string, additions bigint, deletions bigint>>>"
)


def repos(pages: DataFrame) -> DataFrame:
    """Repositories: the name is the slug, there is no project and no default branch."""
    items = listed(pages, F.from_json("value", REPO_PAGE), [])
    item = F.col("item")
    name, url = or_blank(item["name"]), or_blank(item["html_url"])
    return items.select(
        repo_key(F.lit(PROVIDER), url).alias("repo"),
        F.lit(PROVIDER).alias("provider"),
        name.alias("slug"),
        name.alias("name"),
        F.lit("").alias("project"),
        url.alias("url"),
        or_blank(item["clone_url"]).alias("clone_url"),
        F.lit("").alias("download_url"),
        F.lit("").alias("default_branch"),
        F.coalesce(item["archived"], F.lit(False)).alias("archived"),
        F.coalesce(item["fork"], F.lit(False)).alias("fork"),
    )


def commits(pages: DataFrame) -> DataFrame:
    """Commits: author as name and e-mail, author date, and the committer's date where it is given."""
    items = listed(pages, F.from_json("value", COMMIT_PAGE), ["repo"])
    commit = F.col("item")["commit"]
    author = commit["author"]
    ts = instant(author["date"])
    return items.select(
        "repo",
        or_blank(F.col("item")["sha"]).alias("hash"),
        F.format_string("%s <%s>", or_blank(author["name"]), or_blank(author["email"])).alias("author"),
        or_blank(commit["message"]).alias("message"),
        ts.alias("ts"),
        F.coalesce(instant(commit["committer"]["date"]), ts).alias("committer_ts"),
        "seq",
    )


def commit_stats(pages: DataFrame) -> DataFrame:
    """Added and deleted lines of each commit."""
    stats = F.from_json("value", COMMIT_DETAIL)["stats"]
    return pages.select(
        "repo",
        "hash",
        or_zero(stats["additions"]).alias("additions"),
        or_zero(stats["deletions"]).alias("deletions"),
        F.lit(None).cast("string").alias("error"),
    )


def commit_files(pages: DataFrame) -> DataFrame:
    """Changed files of each commit."""
    changed = pages.select("repo", "hash", F.inline(F.from_json("value", COMMIT_DETAIL)["files"]))
    return changed.select(
        "repo",
        "hash",
        or_blank(F.col("filename")).alias("path"),
        or_zero(F.col("additions")).alias("additions"),
        or_zero(F.col("deletions")).alias("deletions"),
    )
