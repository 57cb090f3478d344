"""The first rows of each key by distributed selection: no key's rows are sorted or meet in a task, however many are wanted.

An order is a list of codes, whole numbers that are compared one after the other (see :class:`By`). For every key that has more rows than
wanted, an interval of codes is kept in which the last wanted row lies. One pass counts the rows of the interval in ``BINS`` equal bins, an
aggregate that is combined before it moves; running sums over the bins tell the one with the last wanted row, and its
least and largest code are the next interval. Where they are equal, the next code of the order decides among these rows. This ends when no
interval has more rows than are wanted. Then the rows before the interval are in, those behind it are out, and those inside, at most as many as
are wanted, are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import stage

BINS = 4096
#: Code of null, behind all others, which lie within +-2^61.
_NULL = 1 << 62
#: Bytes of a text in one code.
_CHUNK = 7


@dataclass(frozen=True)
class By:
    """A column of an order; nulls are last. A number or an instant is one code, a text (compared by bytes) has one for every few bytes."""

    column: str
    kind: str = "number"  # or "instant", "text"
    descending: bool = False

    def codes(self, chunks: int) -> list[Column]:
        column = F.col(self.column)
        if self.kind == "text":
            data = column.cast("binary")
            parts = [F.rpad(F.substring(data, 1 + _CHUNK * i, _CHUNK), F.lit(_CHUNK), F.lit(bytes(1))) for i in range(chunks)]
            values = [F.conv(F.hex(part), 16, 10).cast("long") for part in parts]
        elif self.kind == "instant":
            values = [F.unix_micros(column.cast("timestamp"))]
        else:
            values = [column.cast("long")]
        return [F.coalesce(-value if self.descending else value, F.lit(_NULL)) for value in values]

    def sort(self) -> Column:
        column = F.col(self.column)
        return column.desc_nulls_last() if self.descending else column.asc_nulls_last()


def _codes(order: Sequence[By], most: int) -> list[Column]:
    """The first ``most`` codes of an order, or all of them, when chunks of texts are as many as are asked for."""
    out: list[Column] = []
    for by in order:
        out += by.codes(max(1, most - len(out)))
    return out[:most]


def _placed(df: DataFrame, state: DataFrame, keys: Sequence[str], order: Sequence[By], levels: int, how: str) -> DataFrame:
    """Rows with the interval of their key (``cut``), and whether they lie before or inside it."""
    same_key = None
    for key in keys:
        equal = F.col(key).eqNullSafe(F.col(f"cut.{key}"))
        same_key = equal if same_key is None else same_key & equal
    # One code more than the deepest interval asks for, to know the next one.
    rows = df.withColumn("_codes", F.array(*_codes(order, levels + 2))).join(state.select(F.struct("*").alias("cut")), same_key, how)
    prefix = F.slice("_codes", F.lit(1), F.col("cut.level"))
    code = F.coalesce(F.get("_codes", F.col("cut.level")), F.lit(0))  # none left: alike in all
    same = prefix == F.col("cut.fixed")
    return rows.withColumns({
        "_code": code,
        "_inside": same & code.between(F.col("cut.lo"), F.col("cut.hi")),
        "_before": (prefix < F.col("cut.fixed")) | (same & (code < F.col("cut.lo"))),
    })


def _narrowed(df: DataFrame, state: DataFrame, keys: Sequence[str], order: Sequence[By], levels: int) -> DataFrame:
    """The next interval of each key."""
    inside = _placed(df, state, keys, order, levels, "inner").where("_inside")
    following = F.coalesce(F.get("_codes", F.col("cut.level") + 1), F.lit(0))
    bins = inside.groupBy("cut", F.expr(f"(_code - cut.lo) div ((cut.hi - cut.lo) div {BINS} + 1)").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_code").alias("_lo"), F.max("_code").alias("_hi"),
        F.min(following).alias("_next_lo"), F.max(following).alias("_next_hi"),
    )
    # At most BINS rows of a key.
    over = Window.partitionBy("cut").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    crossing = bins.withColumn("_passed", F.coalesce(F.sum("_rows").over(over), F.lit(0))).where("_passed < cut.need AND cut.need <= _passed + _rows")
    alike = F.col("_lo") == F.col("_hi")
    return crossing.select(
        *[F.col(f"cut.{key}").alias(key) for key in keys],
        F.when(alike, F.col("cut.level") + 1).otherwise(F.col("cut.level")).alias("level"),
        F.when(alike, F.concat("cut.fixed", F.array("_lo"))).otherwise(F.col("cut.fixed")).alias("fixed"),
        F.when(alike, F.col("_next_lo")).otherwise(F.col("_lo")).alias("lo"),
        F.when(alike, F.col("_next_hi")).otherwise(F.col("_hi")).alias("hi"),
        (F.col("cut.need") - F.col("_passed")).alias("need"), F.col("_rows").alias("rows"),
    )


def cuts(df: DataFrame, keys: Sequence[str], order: Sequence[By], count: int) -> tuple[DataFrame, int]:
    """The interval of each key that has more than ``count`` rows, none of which holds more rows than that, and the deepest code it is told by."""
    narrow = df.select(*dict.fromkeys([*keys, *(by.column for by in order)]))
    first = _codes(order, 1)[0]
    text = order[-1].kind == "text"
    longest = F.max(F.octet_length(order[-1].column)) if text else F.max(F.lit(0))
    sums = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("lo"), F.max(first).alias("hi"), longest.alias("bytes"))
    state = stage(sums.where(F.col("rows") > count), "first-rows")
    chunks = -(-(state.agg(F.max("bytes")).first()[0] or 0) // _CHUNK)
    last = len(order) - 1 + (max(chunks, 1) - 1 if text else 0)
    state = state.select(*keys, F.lit(0).alias("level"), F.array().cast("array<long>").alias("fixed"), "lo", "hi", F.lit(count).cast("long").alias("need"), "rows")
    deepest = 0
    while True:
        # Rows alike in every code cannot be told apart.
        unsettled = (F.col("rows") > count) & (F.col("level") <= last)
        if not state.where(unsettled).limit(1).count():
            return state, deepest
        state = stage(_narrowed(narrow, state.where(unsettled), keys, order, deepest).unionByName(state.where(~unsettled)), "first-rows")
        deepest = min(state.agg(F.max("level")).first()[0], last)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[By], count: int) -> DataFrame:
    """Exactly the first ``count`` rows of each key by an order in which a text comes last if at all; of rows alike in all of it any are taken.

    Runs a few jobs over the key and order columns, however many rows a key has; the result is a plan over ``df`` again. Nulls in keys are
    one key. Rows inside an interval alone are moved by their key; all others are kept or left out where they are.
    """
    if any(by.kind == "text" for by in order[:-1]):
        raise ValueError("a text can only be the last column of the order")
    state, levels = cuts(df, keys, order, count)
    placed = _placed(df, state, keys, order, levels, "left")
    certain = placed.where(F.col("cut").isNull() | F.col("_before")).select(*df.columns)
    ranked = placed.where("_inside").withColumn("_rank", F.row_number().over(Window.partitionBy("cut").orderBy(*(by.sort() for by in order))))
    return certain.unionByName(ranked.where("_rank <= cut.need").select(*df.columns))
