"""Line pieces joined end to start, in tables.

A piece goes on in the one that starts where it ends, if no other piece ends
or starts there.  Chains are found by pointer jumping: each round a piece
looks twice as far back, so rounds grow with the logarithm of the longest
chain, and no chain meets in one task until its points are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

PLACE = ["x", "y"]


def _links(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by, piece, back): the piece before each, null where a chain begins."""
    ends = pieces.select(*by, "piece", F.element_at("points", -1).alias("p")).select(*by, F.col("piece").alias("back"), "p.x", "p.y")
    starts = pieces.select(*by, "piece", F.element_at("points", 1).alias("p")).select(*by, "piece", "p.x", "p.y")
    only = lambda df, name: df.groupBy(*by, *PLACE).agg(F.min(name).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    met = only(starts, "piece").join(only(ends, "back"), [*by, *PLACE]).where("piece <> back")
    return pieces.select(*by, "piece").join(met.select(*by, "piece", "back"), [*by, "piece"], "left")


def _heads(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, piece, head, at, low): where each piece's chain begins and its place in it; pieces of closed chains have no head, but the least piece of the chain as low."""
    state = cut(links.select(*by, "piece", F.col("back").alias("to"), F.when(F.col("back").isNull(), F.col("piece")).alias("head"), F.when(F.col("back").isNull(), F.lit(0).cast("long")).otherwise(F.lit(1).cast("long")).alias("at"), F.least("piece", F.coalesce("back", "piece")).alias("low")))
    rounds = max(1, int(state.count()).bit_length())
    for _ in range(rounds):
        if not state.where("head is null").limit(1).count():
            break
        far = state.select(*by, F.col("piece").alias("to"), F.col("to").alias("next"), F.col("head").alias("found"), F.col("at").alias("more"), F.col("low").alias("least"))
        met = state.join(far, [*by, "to"], "left")
        open_ = F.col("head").isNull()
        state = cut(
            met.select(
                *by,
                "piece",
                F.when(open_, F.col("next")).alias("to"),
                F.coalesce("head", "found").alias("head"),
                F.when(open_, F.col("at") + F.col("more")).otherwise(F.col("at")).alias("at"),
                F.least("low", F.coalesce("least", "low")).alias("low"),
            )
        )
    return state


def chains(pieces: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, piece, chain, at): ``pieces(by, piece, points)`` with the first piece of their chain and their place in it from 0.

    A closed chain begins at its least piece.
    """
    by = list(by)
    links = cut(_links(pieces, by))
    state = _heads(links, by)
    ring = state.where("head is null")
    if not ring.isEmpty():
        state = _heads(cut(links.join(ring.where("low = piece").select(*by, "piece", F.lit(True).alias("first")), [*by, "piece"], "left").select(*by, "piece", F.when(F.col("first").isNull(), F.col("back")).alias("back"))), by)
    return state.select(*by, "piece", F.col("head").alias("chain"), "at")


def merged(pieces: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, chain, pieces, points): each chain as one line; a common point stands once."""
    by = list(by)
    placed = pieces.join(chains(pieces, by), [*by, "piece"])
    own = F.when(F.col("at") == 0, F.col("points")).otherwise(F.slice("points", 2, F.size("points")))
    lines = placed.groupBy(*by, "chain").agg(F.count("*").alias("pieces"), F.sort_array(F.collect_list(F.struct("at", own.alias("points")))).alias("x"))
    return lines.select(*by, "chain", "pieces", F.flatten(F.transform("x", lambda p: p["points"])).alias("points"))
