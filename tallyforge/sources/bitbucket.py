"""Bitbucket responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import blank_to_null
from tallyforge.schema import repo_key
from tallyforge.sources.pages import instant, listed, or_blank, or_zero

PROVIDER = "bitbucket"

# Names of the fields in the responses, the clone link taken, the branch assumed and
# the place of a tarball.
ELEMENTS_PAGE = "struct<values array<string>>"
REPO = (
    "struct<slug string, full_name string, project struct<key string>, mainbranch struct<name string>,"
    " links struct<html struct<href string>, clone array<struct<name string, href string>>>,"
    " parent struct<full_name string>, _broken string>"
)
PROJECT_PAGE = "struct<values array<struct<key string, name string>>>"
COMMIT_PAGE = "struct<values array<struct<hash string, date string, message string, author struct<raw string>>>>"
DIFFS = (
    "array<struct<new struct<path string>, old struct<path string>, lines_added bigint, lines_removed bigint>>"
)
DIFF_PAGE = f"struct<values {DIFFS}>"
CLONE_LINK = "https"
DEFAULT_BRANCH = "main"
TARBALL = "https://bitbucket.org/%s/get/%s.tar.gz"


def repos(pages: DataFrame) -> DataFrame:
    """Repositories: clone link by name, ``main`` without a branch, tarball link; none is archived.

    An element that is no repository is skipped, the rest of its page is kept.
    """
    items = listed(pages, F.from_json("value", ELEMENTS_PAGE)["values"], [])
    parsed = items.withColumn("item", F.from_json("item", REPO, {"columnNameOfCorruptRecord": "_broken"}))
    item = F.col("item")
    url = or_blank(item["links"]["html"]["href"])
    links = F.filter(item["links"]["clone"], lambda link: link["name"] == CLONE_LINK)
    branch = F.coalesce(blank_to_null(item["mainbranch"]["name"]), F.lit(DEFAULT_BRANCH))
    # A branch is one path segment: blanks are %20 there, not +.
    segment = F.replace(F.url_encode(branch), F.lit("+"), F.lit("%20"))
    slug = or_blank(item["slug"])
    return parsed.filter(item.isNotNull() & item["_broken"].isNull()).select(
        repo_key(F.lit(PROVIDER), url).alias("repo"),
        F.lit(PROVIDER).alias("provider"),
        slug.alias("slug"),
        slug.alias("name"),
        or_blank(item["project"]["key"]).alias("project"),
        url.alias("url"),
        or_blank(F.try_element_at(links, F.lit(1))["href"]).alias("clone_url"),
        F.format_string(TARBALL, or_blank(item["full_name"]), segment).alias("download_url"),
        branch.alias("default_branch"),
        F.lit(False).alias("archived"),
        item["parent"].isNotNull().alias("fork"),
    )


def projects(pages: DataFrame) -> DataFrame:
    """Projects of a workspace."""
    items = listed(pages, F.from_json("value", PROJECT_PAGE)["values"], [])
    return items.select(or_blank(F.col("item.key")).alias("key"), or_blank(F.col("item.name")).alias("name"))


def commits(pages: DataFrame) -> DataFrame:
    """Commits: author as written, date with fractions of a second."""
    items = listed(pages, F.from_json("value", COMMIT_PAGE)["values"], ["repo"])
    item = F.col("item")
    ts = instant(item["date"])
    return items.select(
        "repo",
        or_blank(item["hash"]).alias("hash"),
        or_blank(item["author"]["raw"]).alias("author"),
        or_blank(item["message"]).alias("message"),
        ts.alias("ts"),
        ts.alias("committer_ts"),
        "seq",
    )


def commit_files(pages: DataFrame) -> DataFrame:
    """Changed files of each commit, from all its pages: the new path, the old one of a deleted file."""
    diffs = pages.select("repo", "hash", F.inline(F.from_json("value", DIFF_PAGE)["values"]))
    path = F.when(F.col("new").isNotNull(), or_blank(F.col("new.path"))).otherwise(or_blank(F.col("old.path")))
    return diffs.select(
        "repo",
        "hash",
        path.alias("path"),
        or_zero(F.col("lines_added")).alias("additions"),
        or_zero(F.col("lines_removed")).alias("deletions"),
    )


def commit_stats(pages: DataFrame) -> DataFrame:
    """Added and deleted lines of each commit: the sum over all its pages, 0 for an empty change.

    Each page is added up where it lies, so that only one row per page is shuffled.
    """
    values = F.coalesce(F.from_json("value", DIFF_PAGE)["values"], F.array().cast(DIFFS))
    zero = F.lit(0).cast("long")
    per_page = pages.select(
        "repo",
        "hash",
        F.aggregate(values, zero, lambda total, v: total + or_zero(v["lines_added"])).alias("additions"),
        F.aggregate(values, zero, lambda total, v: total + or_zero(v["lines_removed"])).alias("deletions"),
    )
    return (
        per_page.groupBy("repo", "hash")
        .agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
        .withColumn("error", F.lit(None).cast("string"))
    )
