"""Gzipped tar archives of repositories.

A gzip stream cannot be split, so one archive is read by one task, as a stream, member by member: the
task holds a few expanded files, never an archive.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPANDED = "repo string, commit_hash string, path string, content binary, error string"
_AT_ONCE_BYTES = 64 << 20
_COLUMNS = ["repo", "commit_hash", "path", "content", "error"]


def find_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives below ``repo=<key>/``, one row each with its ``uri``; nothing is read yet."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    commit_hash = F.col("commit_hash") if "commit_hash" in found.columns else F.lit(None)
    return found.select(
        F.col("repo").cast("string").alias("repo"),
        commit_hash.cast("string").alias("commit_hash"),
        F.col("path").alias("uri"),
    )


@contextmanager
def _opened(uri: str) -> Iterator[BinaryIO]:
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    scheme, _, rest = uri.partition("://")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")
    with system.open_input_stream(base, compression=None) as stream:
        yield stream


def _members(stream: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """Path and content of the regular files, without the directory that wraps them all."""
    wrapper = ""
    with tarfile.open(fileobj=stream, mode="r|gz") as archive:
        for member in archive:
            name = member.name + ("/" if member.isdir() else "")
            if not wrapper and "/" in name:
                wrapper = name.split("/", 1)[0] + "/"
            path = posixpath.normpath(name.removeprefix(wrapper) or ".").lstrip("/")
            escapes = path in ("", ".", "..") or path.startswith("../")
            if member.isreg() and not escapes:
                yield path, archive.extractfile(member).read()


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        from_uri = "uri" in batch.columns
        for repo, commit_hash, source in zip(batch.repo, batch.commit_hash, batch.uri if from_uri else batch.content):
            rows, held = [], 0
            try:
                with _opened(source) if from_uri else io.BytesIO(source) as stream:
                    for path, body in _members(stream):
                        rows.append((repo, commit_hash, path, body, None))
                        held += len(body)
                        if held >= _AT_ONCE_BYTES:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, held = [], 0
            except (tarfile.TarError, EOFError, OSError, zlib.error) as broken:
                rows.append((repo, commit_hash, None, None, f"archive: {broken}"))
            yield pd.DataFrame(rows, columns=_COLUMNS)


def expand_archives(archives: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Files of each archive (``repo``, ``commit_hash`` and ``uri``); a broken one ends in an error row.

    Tasks are dealt archives by name and stream them. Instead of ``uri`` a frame may have small
    archives themselves in ``content``.
    """
    if "uri" not in archives.columns:
        return archives.select("repo", F.col("commit_hash").cast("string"), "content").mapInPandas(_expand, EXPANDED)
    named = archives.select("repo", F.col("commit_hash").cast("string"), "uri")
    spread = named.repartition(partitions, "uri") if partitions else named.repartition("uri")
    return spread.mapInPandas(_expand, EXPANDED)


def archive_files(expanded: DataFrame) -> DataFrame:
    """Table ``files`` from expanded archives; what was read of a broken one is left out by its failure."""
    return expanded.filter(F.col("error").isNull()).drop("error")


def archive_failures(expanded: DataFrame) -> DataFrame:
    """Table ``repo_failures`` from expanded archives."""
    failed = expanded.filter(F.col("error").isNotNull())
    return failed.select("repo", F.lit("files").alias("stage"), "error")
