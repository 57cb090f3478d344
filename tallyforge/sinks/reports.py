"""Reports and diagnostics as files.

A report is written as folders of JSON lines, not as one document: one line per repository, so that
writing scales with the number of tasks, and one line for the head with everything over all of them.
The fields are those of a single-document report; absent and empty optional ones are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import stage


def write_report(folder: str, head: DataFrame, repositories: DataFrame, errors: DataFrame, mode: str = "errorifexists") -> None:
    """Standard report: ``head``, ``repositories`` and ``errors`` below one folder."""
    head.write.mode(mode).json(f"{folder}/head")
    repositories.write.mode(mode).json(f"{folder}/repositories")
    errors.write.mode(mode).json(f"{folder}/errors")


def write_trends_report(
    folder: str, head: DataFrame, snapshots: DataFrame, repositories: DataFrame, errors: DataFrame, mode: str = "errorifexists"
) -> None:
    """Trends report: one line per period, and one per period and repository."""
    head.write.mode(mode).json(f"{folder}/head")
    snapshots.write.mode(mode).json(f"{folder}/snapshots")
    repositories.write.mode(mode).json(f"{folder}/repositories")
    errors.write.mode(mode).json(f"{folder}/errors")


def diagnostic_lines(diagnostics: DataFrame) -> DataFrame:
    """Log lines of diagnostics."""
    return diagnostics.select(F.format_string("[%s] %s | %s", "category", "repo", "message").alias("value"))


def write_diagnostics(folder: str, diagnostics: DataFrame, mode: str = "errorifexists") -> bool:
    """Write the log lines if there are any; tells whether there were. They are computed once, in the shared folder."""
    diagnostics = stage(diagnostics, "diagnostics")
    if diagnostics.isEmpty():
        return False
    diagnostic_lines(diagnostics).write.mode(mode).text(folder)
    return True


def write_tables(folder: str, tables: dict[str, DataFrame], mode: str = "errorifexists") -> None:
    """Report tables as Parquet, one folder each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder}/{name}")
