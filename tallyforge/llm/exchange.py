"""Moving very many small keyed values between tasks: packed by key range into binary columns.

A row for each of billions of values costs far more than the values. Tasks therefore sort what they hold, cut it at
the edges of equal ranges of the (hashed, so evenly spread) key, and send one row a range. A receiving task gets all
values of its range. The number of ranges follows spark.sql.shuffle.partitions, as everything else of a Spark job does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

RANGES_A_PARTITION = 4
#: Rows in an Arrow batch, unless the session says otherwise. Batches of long texts are cut by bytes already (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = "1000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, a thousand texts rather than ten thousand, where the user has not set their number."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def range_count(spark: SparkSession, each: int = RANGES_A_PARTITION) -> int:
    """Ranges to cut the keys into, ``each`` for every shuffle partition."""
    return max(1, each * int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Range of each hashed 64-bit key."""
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array of fixed width, first bytes first, so that equal high bytes lie together."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    """The array that ``planes`` made these bytes of."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def cut(keys: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of every range that occurs in sorted keys."""
    if not len(keys):
        return
    where = range_of(keys, count)
    edges = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(where)]):
        yield int(where[a]), int(a), int(b)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values in a sorted array."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
    return at, np.diff(np.r_[at, len(values)])


def column(table: pa.Table, name: str) -> list:
    """Values of a column of a group."""
    return table.column(name).to_pylist()
