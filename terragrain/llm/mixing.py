"""Mixing sources to target weights by Sainte-Laguë apportionment, in SQL functions only.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources,
in code point order with null last, weigh 5, 2, 1, repeating, and share the
sum of all sizes; a target stops at ``cap`` times its source's size, and the
excess is shared again by weight until none is above.  That fixed point is
found in closed form: in ascending order of size over weight the capped
sources are a prefix.

The shared words are cut into equal blocks of ``block_words``.  Blocks go to
sources, and each source's blocks to its shards, by highest quotients
votes / (2k + 1).  Rounding votes / divisor starts within half a block of
each answer, so only a few quotients for each party are ranked.  A shard is a
bounded slice of one source's documents by seeded hash, so a source with a
third of all documents is many shards, and one window never spans a source.
In a shard the documents stand in seeded order; whole rounds repeat all of
them, and the remaining blocks are the first of that line.

Defined results: a null text has size 0 and nothing is taken of it; null
sources form one source; rows that repeat count each for themselves; an
empty table gives an empty result; a very long text is one document that the mix
may take in part.  Extra columns are not read.  Reruns agree because order
depends on seed, doc_id (the text where that is null) and size only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

SPLIT = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPLIT), "")), F.lit(0)).cast("long")


def apportioned(df: DataFrame, by: list[str], votes: str, seats: str, key: str, out: str) -> DataFrame:
    """``df`` with ``out``: its share of each group's ``seats`` by highest quotients.

    One row for each party; ties go to the lower ``key``.  Groups are the
    ``by`` columns, one group if there are none.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total, parties = F.sum(votes).over(group), F.count("*").over(group)
    share = F.when(F.col("__v") > 0, F.col(votes) / F.col("__v")).otherwise(F.lit(0.0))
    df = df.withColumn("__v", total.cast("double")).withColumn("__n", parties).withColumn("__share", share)
    df = df.withColumn("__base", F.floor(F.col(seats) * F.col("__share") + 0.5).cast("long"))
    df = df.withColumn("__left", F.when(F.col("__v") > 0, F.col(seats) - F.sum("__base").over(group)).otherwise(F.lit(0)).cast("long"))
    reach = (F.ceil(F.col("__share") * F.col("__n") * 1.5) + 1).cast("long")
    more = F.sequence(F.col("__base"), F.col("__base") + reach)
    less = F.sequence(F.greatest(F.lit(1), F.col("__base") - reach), F.col("__base"))
    odd = df.where("__left <> 0").where(F.col(votes) > 0)
    grown = odd.where("__left > 0").select(*by, key, "__left", (F.col(votes) * 1.0).alias("v"), F.explode(more).alias("k"))
    shrunk = odd.where("__left < 0 and __base > 0").select(*by, key, "__left", (F.col(votes) * 1.0).alias("v"), F.explode(less).alias("k"))
    ranked = grown.select(*by, key, "__left", F.lit(1).alias("d"), (-(F.col("v") / (2 * F.col("k") + 1))).alias("q"))
    ranked = ranked.union(shrunk.select(*by, key, "__left", F.lit(-1).alias("d"), (F.col("v") / (2 * F.col("k") - 1)).alias("q")))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("q", F.col(key) * F.col("d"))
    ranked = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.abs("__left"))
    names = [*by, key]
    moved = ranked.groupBy(*[F.col(c).alias(f"__m_{c}") for c in names]).agg(F.sum("d").alias("__d"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in names])
    kept = [c for c in df.columns if not c.startswith("__")]
    return df.join(moved, same, "left").select(*kept, (F.col("__base") + F.coalesce("__d", F.lit(0))).cast("long").alias(out))


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, no, docs, source_size, target) from rows of source and size."""
    s = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    s = s.withColumn("no", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    before = one.orderBy(cap * F.col("source_size") / F.col("w"), "no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(one)).withColumn("all_w", F.sum("w").over(one))
    s = s.withColumn("gone", F.coalesce(F.sum("source_size").over(before) * cap, F.lit(0))).withColumn("gone_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("rate", (F.col("all") - F.col("gone")).cast("double") / (F.col("all_w") - F.col("gone_w")).cast("double"))
    free = cap * F.col("source_size") >= F.col("rate") * F.col("w")
    s = s.withColumn("rate", F.min(F.when(free, F.struct("gone_w", "rate"))).over(one)["rate"])
    return s.select("source", "no", "docs", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("rate") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 16, shard_docs: int = 10_000, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, quota, taken) of ``docs(doc_id, text, source)``.

    ``quota`` is the number of words apportioned to the row's shard in whole
    blocks, ``taken`` the words that the mix takes of the document, repeats
    counted: never over ``cap`` times its size.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), "text")
    sized = checkpointed(sized.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string"))), F.col("size").cast("string")))).drop("text"))
    targets = source_targets(sized, weights, cap).withColumn("blocks", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / F.lit(block_words)).cast("long"))
    targets = checkpointed(apportioned(targets, [], "target", "blocks", "no", "source_blocks"))

    slim = targets.select(F.col("source").alias("__source"), "no", "source_size", "target", "source_blocks", F.ceil(F.col("docs") / F.lit(shard_docs)).cast("long").alias("shards"))
    rows = sized.join(slim, sized["source"].eqNullSafe(slim["__source"])).drop("__source")
    rows = rows.withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("shards"))
    cells = rows.groupBy("no", "shard").agg(F.first("source_blocks").alias("source_blocks"), F.sum("size").alias("cell"))
    cells = apportioned(cells, ["no"], "cell", "source_blocks", "shard", "cell_blocks")
    words = F.col("cell_blocks") * block_words
    rounds = F.when(F.col("cell") > 0, F.least(F.lit(cap), F.floor(words / F.col("cell")))).otherwise(F.lit(0)).cast("long")
    cells = cells.select("no", "shard", words.alias("quota"), rounds.alias("rounds"), F.when(rounds < cap, words - rounds * F.col("cell")).otherwise(F.lit(0)).alias("rest"))

    line = Window.partitionBy("no", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(cells, ["no", "shard"]).withColumn("ahead", F.coalesce(F.sum("size").over(line), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return out.select("doc_id", "source", "size", "source_size", "target", "shard", "quota", (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))
