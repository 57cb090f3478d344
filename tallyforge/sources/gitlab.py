"""GitLab responses. There are no file changes per commit here, so churn has no source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.schema import repo_key
from tallyforge.sources.pages import instant, listed, or_blank, or_zero

PROVIDER = "gitlab"

# Names of the fields in the responses.
REPO_PAGE = (
    "array<struct<id bigint, path string, path_with_namespace string, name string, web_url string,"
    " http_url_to_repo string, default_branch string, archived boolean,"
    " forked_from_project struct<id bigint>, namespace struct<full_path string>>>"
)
SUBGROUP_PAGE = "array<struct<id bigint, path string, full_path string, name string>>"
COMMIT_PAGE = (
    "array<struct<id string, author_name string, author_email string, message string,"
    " authored_date string, committed_date string>>"
)
COMMIT_DETAIL = "struct<stats struct<additions bigint, deletions bigint>>"


def repos(pages: DataFrame) -> DataFrame:
    """Repositories: the path is the slug, the namespace the project; a fork names its origin."""
    items = listed(pages, F.from_json("value", REPO_PAGE), [])
    item = F.col("item")
    url = or_blank(item["web_url"])
    return items.select(
        repo_key(F.lit(PROVIDER), url).alias("repo"),
        F.lit(PROVIDER).alias("provider"),
        or_blank(item["path"]).alias("slug"),
        or_blank(item["name"]).alias("name"),
        or_blank(item["namespace"]["full_path"]).alias("project"),
        url.alias("url"),
        or_blank(item["http_url_to_repo"]).alias("clone_url"),
        F.lit("").alias("download_url"),
        or_blank(item["default_branch"]).alias("default_branch"),
        F.coalesce(item["archived"], F.lit(False)).alias("archived"),
        item["forked_from_project"].isNotNull().alias("fork"),
    )


def subgroups(pages: DataFrame) -> DataFrame:
    """Subgroups of a group."""
    items = listed(pages, F.from_json("value", SUBGROUP_PAGE), [])
    return items.select("item.id", "item.path", "item.full_path", "item.name")


def commits(pages: DataFrame) -> DataFrame:
    """Commits: author as name and e-mail, committed date; ``author_ts`` is when it was written, which decides when history has it."""
    items = listed(pages, F.from_json("value", COMMIT_PAGE), ["repo"])
    item = F.col("item")
    ts = instant(item["committed_date"])
    return items.select(
        "repo",
        or_blank(item["id"]).alias("hash"),
        F.format_string("%s <%s>", or_blank(item["author_name"]), or_blank(item["author_email"])).alias("author"),
        or_blank(item["message"]).alias("message"),
        ts.alias("ts"),
        ts.alias("committer_ts"),
        F.coalesce(instant(item["authored_date"]), ts).alias("author_ts"),
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
