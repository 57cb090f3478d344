"""Conversations for training: of logged snapshots the longest stays, then turns are rendered.

A log often holds a conversation again and again, each time a few turns longer. The first i turns of a conversation have a
rolling hash: the exclusive or of a hash of each turn with its number. Exclusive or is associative, so a very long
conversation is taken in blocks, first in each block and then over the blocks. A conversation whose hash over all turns is the
hash of the first turns of a longer one is left out by an anti-join; of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import stage

#: Turns in a block, which is what one task orders and renders at a time.
BLOCK = 1024
# Fixed marks of the rendered form (ChatML).
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*(p for part in parts for p in (part.isNull(), F.coalesce(part, F.lit("")))))


def numbered(turns: DataFrame) -> DataFrame:
    """``at``: number of each turn in its conversation from 1, in the order of turn, role and text, nulls first.

    Counted in blocks of turn numbers and then over the blocks.
    """
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = turns.withColumn("rank", F.row_number().over(inside))
    same = ranked["conv_id"].eqNullSafe(blocks["conv_id"]) & ranked["block"].eqNullSafe(blocks["block"])
    return ranked.join(blocks, same).select(ranked["conv_id"], "turn", "role", "text", (F.col("base") + F.col("rank")).alias("at"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rolling hashes ``h1``, ``h2`` of the first ``at`` turns, for each turn of numbered conversations."""
    turn = _hash(F.col("role"), F.col("text"))
    rows = turns.select("conv_id", "at", F.xxhash64("at", turn).alias("t1"), F.xxhash64(F.lit(1), turn, "at").alias("t2"))
    rows = rows.withColumn("block", F.floor((F.col("at") - 1) / BLOCK))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.withColumn("r1", F.bit_xor("t1").over(inside)).withColumn("r2", F.bit_xor("t2").over(inside))
    same = rolled["conv_id"].eqNullSafe(blocks["conv_id"]) & (rolled["block"] == blocks["block"])
    return rolled.join(blocks, same).select(
        rolled["conv_id"], "at", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2")
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` of the conversations that begin no longer one; of equal ones the smallest id."""
    whole = hashes.groupBy("conv_id").agg(F.max(F.struct("at", "h1", "h2")).alias("w"))
    whole = whole.select("conv_id", F.col("w.at").alias("n_turns"), "w.h1", "w.h2")
    classes = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    sizes = whole.select(F.col("conv_id").alias("id"), "n_turns")
    begun = hashes.join(sizes, hashes["conv_id"].eqNullSafe(sizes["id"])).where("at < n_turns").select(F.col("at").alias("n_turns"), "h1", "h2").distinct()
    return classes.join(begun, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def collapse(conversations: DataFrame) -> DataFrame:
    """Parts of the maximal conversations: ``conv_id``, ``part``, ``n_turns`` (of the whole), ``turns`` (in the part), ``rendered``.

    A part has up to 1,024 turns, so most conversations are one part; the parts of a conversation in order are its text.
    Columns ``conv_id, turn, role, text`` are read, others are not looked at. Turns go by number, then role and text, nulls
    first; equal rows are turns of their own. Null roles and texts render as empty but differ from empty ones when conversations
    are compared. Rows without an id are one conversation. An empty table gives an empty result.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = numbered(turns)
    hashes = stage(prefixes(turns), "turn-prefixes")
    kept = maximal(hashes)
    shown = turns.join(kept.withColumnRenamed("conv_id", "id"), turns["conv_id"].eqNullSafe(F.col("id"))).drop("id")
    line = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    part = F.floor((F.col("at") - 1) / BLOCK).alias("part")
    lines = F.array_sort(F.collect_list(F.struct("at", line.alias("line"))))
    grouped = shown.groupBy("conv_id", part, "n_turns").agg(lines.alias("lines"))
    return grouped.select(
        "conv_id", "part", "n_turns", F.size("lines").cast("long").alias("turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered")
    )
