"""Landed API pages: the raw text of one response per row.

Each source below maps such rows to an input table. ``read_pages`` gets them from files; any frame
with the same columns (``value``, ``page`` and the keys of the request) serves as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# More than any API puts on one page, so that page and place give one increasing number.
PAGE_STRIDE = 1_000_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``value``, ``page`` from the last digits of its name (twelve at most; none: 0), and its directory keys.

    Requests about one repository or commit are landed below ``repo=<key>/`` and ``hash=<hash>/``.
    """
    pages = spark.read.text(path, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)[^\d]*$", 1)
    keys = [c for c in pages.columns if c != "value"]
    return pages.select(
        *[F.col(c).cast("string").alias(c) for c in keys],
        F.coalesce(F.right(number, F.lit(12)).try_cast("long"), F.lit(0)).alias("page"),
        "value",
    )


def listed(pages: DataFrame, array: Column, keys: list[str]) -> DataFrame:
    """One row per element of a page array, with ``seq``: its place in the whole listing."""
    return pages.select(*keys, "page", F.posexplode(array).alias("_place", "item")).select(
        *keys, "item", (F.col("page") * PAGE_STRIDE + F.col("_place")).alias("seq")
    )


def or_blank(value: Column) -> Column:
    """An absent text is the empty text."""
    return F.coalesce(value, F.lit(""))


def or_zero(value: Column) -> Column:
    """An absent count is 0."""
    return F.coalesce(value, F.lit(0).cast("long"))


def instant(text: Column) -> Column:
    """Instant of an RFC 3339 text, null when it is not one."""
    return F.try_to_timestamp(text)
