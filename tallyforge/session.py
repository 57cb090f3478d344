"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# UTC is required for results; the rest are defaults a cluster may override.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Call sites of columns are only for error messages, and cost more than building the columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tallyforge", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings this package expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches, from ``spark.checkpoint.dir``; in local mode only a temporary one, which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="tallyforge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[context.applicationId] = folder
    return _local_folders[context.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several results read, and read it back.

    The written table survives lost executors, cuts the lineage and lets each reader prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that this application has staged so far, and tell how many; to be called when all results that read them are written."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    hadoop, context = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for text in paths:
        path = hadoop.Path(text)
        path.getFileSystem(context).delete(path, True)
    return len(paths)


def keep_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose keys (all columns of ``keys``) are wanted.

    A semi join without hints: Spark broadcasts the keys if they are small in bytes, else both sides are shuffled, and
    adaptive execution splits skewed partitions. The rows that are kept are the same either way.
    """
    return df.join(keys, keys.columns, "left_semi")


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Further columns, each made once a row.

    Spark moves a filter below the columns it speaks of and makes them there a second time, which is dear for what is made of whole texts. A generator
    is passed by no filter on its output, and one of a single element leaves the number of rows.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[made.alias(name) for name, made in columns.items()]))))
