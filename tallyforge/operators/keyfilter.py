"""Which rows have a wanted key, told before their other columns are read or moved.

The wanted keys become a Bloom filter: an aggregate of small bitmaps, one for each block of keys. A block holds ``BLOCK_BITS`` bits (4 kB), the most
Spark's bitmap aggregate has; the number of blocks follows the number of keys, at most ``MOST_BLOCKS`` (128 MB), so what is broadcast has a
bound that is known beforehand. Beyond the keys this is meant for more rows pass, but never fewer than are wanted: the filter only saves work,
and an exact join of whatever small result was made of the rows follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32_768
BITS_A_KEY = 16
MOST_BLOCKS = 32_768
#: Bits set for a key, all in its block.
PROBES = 2


def _block(columns: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def _places(columns: Sequence[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(probe), *columns), F.lit(BLOCK_BITS)) for probe in range(1, PROBES + 1)]


def key_filter(keys: DataFrame, expected: int | None = None) -> tuple[DataFrame, int]:
    """Bitmaps of all columns of ``keys`` (``_block``, ``_bits``), and the number of blocks; counts the keys unless ``expected`` tells how many there are about."""
    columns = keys.columns
    if expected is None:
        expected = keys.count()
    blocks = min(max(1, -(-expected * BITS_A_KEY // BLOCK_BITS)), MOST_BLOCKS)
    places = keys.select(_block(columns, blocks).alias("_block"), F.explode(F.array(*_places(columns))).alias("_place"))
    return places.groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits")), blocks


def _holds(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def possible(df: DataFrame, keys: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys`` (all its columns; nulls are values): all that are, and few others.

    The rows stay where they are: the bitmaps are broadcast, and only the key columns are looked at.
    """
    columns = keys.columns
    bitmaps, blocks = key_filter(keys, expected)
    met = df.withColumn("_block", _block(columns, blocks)).join(F.broadcast(bitmaps), "_block")
    for place in _places(columns):
        met = met.where(_holds(F.col("_bits"), place))
    return met.select(*df.columns)
