"""Conversations of any length in slices: what the chat operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed

#: Long conversations whose counts may be broadcast, at most.
BROADCAST_ROWS = 100_000


def turn_order(turn: str = "turn") -> list[Column]:
    """Rows of one conversation: by turn, nulls first, then role and text, by the text's digest."""
    return [F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.md5("text").asc_nulls_first()]


def long_conversations(turns: DataFrame, slice_turns: int) -> DataFrame:
    """(conv, low, step, last_slice), written: conversations of more than ``slice_turns`` rows, and how their turns are cut."""
    counted = turns.groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    step = F.ceil((F.col("high") - F.col("low") + 1).cast("double") * slice_turns / F.col("n")).cast("long")
    cut = counted.where(F.col("n") > slice_turns).select("conv", "low", F.coalesce(step, F.lit(1)).alias("step"), "high")
    return checkpointed(cut.select("conv", "low", "step", F.coalesce(F.floor((F.col("high") - F.col("low")) / F.col("step")), F.lit(0)).cast("long").alias("last_slice")))


def sliced(turns: DataFrame, long: DataFrame) -> DataFrame:
    """``turns`` with ``slice``: 0 in most conversations, ascending with the turn in long ones (null turns: 0)."""
    if long.isEmpty():
        return turns.withColumn("slice", F.lit(0).cast("long"))
    small = F.broadcast(long) if long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else long
    cut = turns.join(small, turns["conv_id"].eqNullSafe(small["conv"]), "left")
    at = F.floor((F.col("turn") - F.col("low")) / F.col("step")).cast("long")
    return cut.withColumn("slice", F.coalesce(at, F.lit(0).cast("long"))).select(*turns.columns, "slice")
