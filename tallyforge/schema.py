"""Input tables. ``repo`` is the provider and URL of a repository folded into one key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemas as DDL text, for ``spark.read.schema`` and ``createDataFrame``.
REPOS = (
    "repo string, provider string, slug string, name string, project string, url string, clone_url string,"
    " download_url string, default_branch string, archived boolean, fork boolean"
)
# ``seq`` is the position in the provider's listing, newest first; null when unknown.
COMMITS = (
    "repo string, hash string, author string, message string, ts timestamp, committer_ts timestamp, seq bigint"
)
COMMIT_STATS = ("repo string, hash string, additions bigint, deletions bigint, error string")
COMMIT_FILES = ("repo string, hash string, path string, additions bigint, deletions bigint")
FILES = ("repo string, commit_hash string, path string, content binary")
REPO_FAILURES = ("repo string, stage string, error string")
DIAGNOSTICS = ("category string, repo string, message string")

# Names of the six measures in report order.
MEASURES = ["files", "lines", "code", "comments", "blanks", "complexity"]


def repo_key(provider: Column, url: Column) -> Column:
    """Key of a repository; two subgroups may share a slug, but not a URL."""
    return F.concat_ws(":", provider, url)
