"""Which repositories take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import url_owner

def _slug_join(repos: DataFrame, slugs: Sequence[str], how: str) -> DataFrame:
    spark = repos.sparkSession
    listed = spark.createDataFrame([(s,) for s in dict.fromkeys(slugs)], "slug string")
    return repos.join(listed, "slug", how)


def in_owner_scope(repos: DataFrame, owner: str) -> DataFrame:
    """Repositories of one owner: a user, organisation or workspace, or a group with its subgroups."""
    grouped = (F.col("project") == owner) | F.startswith(F.col("project"), F.lit(owner + "/"))
    owned = url_owner(F.col("url")) == owner
    return repos.filter(F.when(F.col("provider") == "gitlab", grouped).otherwise(owned))


def select_repos(
    repos: DataFrame,
    *,
    projects: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_archived: bool = False,
    include_forks: bool = False,
    owner: str | None = None,
) -> DataFrame:
    """Repositories left by all filters.

    Slugs match exactly; a missing slug is in no list. An excluded slug is out even if included. Projects only restrict the one
    provider that can filter by project.
    """
    if owner:
        repos = in_owner_scope(repos, owner)
    if projects:
        repos = repos.filter((F.col("provider") != "bitbucket") | F.col("project").isin(list(projects)))
    if not include_forks:
        repos = repos.filter(~F.col("fork"))
    if not include_archived:
        repos = repos.filter(~F.col("archived"))
    if include:
        repos = _slug_join(repos, include, "left_semi")
    if exclude:
        repos = _slug_join(repos, exclude, "left_anti")
    return repos


def pick_projects(projects: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Projects by key; all of them, or the selected keys."""
    if selected is not None:
        projects = projects.filter(F.col("key").isin(list(selected)))
    return projects.orderBy("key")
