"""Source trees in a folder that all executors reach.

Spark's own file sources leave out names that begin with a dot or an underscore, such as
``__init__.py``, so trees are listed and read by tasks through Arrow's file systems. Listing and
reading are separate steps: the listing is filtered and spread over all tasks before any content is
read, so that one huge repository is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.codestats import visible_files

LISTING = "repo string, commit_hash string, root string, path string, size bigint"
_LISTED_AT_ONCE = 10_000
_READ_AT_ONCE_BYTES = 64 << 20


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level of directories: the entries of each, files with their size and directories with -1."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for repo, commit_hash, root, path in zip(batch.repo, batch.commit_hash, batch.root, batch.path):
            system, base = fs.FileSystem.from_uri(root)
            base = base.rstrip("/")
            try:
                entries = system.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/")))
            except OSError:
                continue  # unreadable directories are skipped
            for entry in entries:
                size = -1 if entry.type == fs.FileType.Directory else entry.size
                rows.append((repo, commit_hash, root, entry.path[len(base) + 1 :], size))
                if len(rows) >= _LISTED_AT_ONCE:
                    yield pd.DataFrame(rows, columns=["repo", "commit_hash", "root", "path", "size"])
                    rows = []
        yield pd.DataFrame(rows, columns=["repo", "commit_hash", "root", "path", "size"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files below each directory, breadth first, one level in memory at a time."""
    for batch in batches:
        level = batch
        while len(level):
            below = []
            for entries in _list_directories(iter([level])):
                files = entries[entries["size"] >= 0]
                if len(files):
                    yield files
                below.append(entries[(entries["size"] < 0) & ~entries["path"].str.contains(r"(?:^|/)\.(?:git|hg)$")])
            level = pd.concat(below) if below else batch.iloc[:0]


def list_trees(trees: DataFrame) -> DataFrame:
    """Files below each tree (``repo``, ``commit_hash``, ``root`` as a URI), without their content.

    The first level of every tree is listed by one task; its directories are then spread over all
    tasks, so that the parts of one large tree are walked side by side.
    """
    start = trees.select("repo", F.col("commit_hash").cast("string"), "root", F.lit("").alias("path"))
    level = start.repartition("repo", "commit_hash").mapInPandas(_list_directories, LISTING)
    vcs = F.col("path").rlike(r"(?:^|/)\.(?:git|hg)$")
    directories = level.filter((F.col("size") < 0) & ~vcs).repartition("repo", "commit_hash", "path")
    return level.filter("size >= 0").unionByName(directories.mapInPandas(_walk, LISTING))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    columns = ["repo", "commit_hash", "path", "content"]
    for batch in batches:
        rows, held = [], 0
        for repo, commit_hash, root, path in zip(batch.repo, batch.commit_hash, batch.root, batch.path):
            system, base = fs.FileSystem.from_uri(root)
            try:
                with system.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as stream:
                    content = stream.read()
            except OSError:
                continue  # unreadable files are skipped
            rows.append((repo, commit_hash, path, content))
            held += len(content)
            if held >= _READ_AT_ONCE_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)


def read_trees(trees: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Table ``files`` of all trees.

    Files in version-control or vendored directories are left out before anything is read: they count
    nowhere. The rest is spread by path.
    """
    keys = ["repo", "commit_hash", "path"]
    listing = visible_files(list_trees(trees))
    spread = listing.repartition(partitions, *keys) if partitions else listing.repartition(*keys)
    return spread.mapInPandas(_read, "repo string, commit_hash string, path string, content binary")
