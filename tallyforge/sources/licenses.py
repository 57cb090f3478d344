"""License texts from files, as a corpus to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``spdx``, ``text`` of every file below a folder that holds a license text each, named by its id (an ending ``.txt`` is dropped)."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(?i)\.txt$", "")
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("spdx"), F.col("value").alias("text"))
