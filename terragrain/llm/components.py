"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed


def connected_components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``links(a, b)`` of longs → (node, label), the least node that is reachable.

    Each round takes the least label among a node and its neighbours and then
    follows labels once (pointer jumping), so the rounds grow with the
    logarithm of a component's diameter.  A round is written to the shared
    folder, which cuts the lineage.  With ``labels`` the links are added to
    components found before; nodes of no new link keep their label.
    """
    if labels is not None:
        old = labels
        a = old.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = old.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        links = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    links = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = links.union(links.select("b", "a"))
    state = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        hooked = state.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "low").alias("label"))
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("next"))
        fresh = checkpointed(hooked.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = fresh.where("label <> before").limit(1).count()
        state = fresh.select("node", "label")
        if not moved:
            break
    if labels is None:
        return state
    new = state.select(F.col("node").alias("label"), F.col("label").alias("into"))
    merged = old.join(new, "label", "left").select("node", F.coalesce("into", "label").alias("label"))
    return checkpointed(merged.union(state.join(old.select("node"), "node", "left_anti")))
