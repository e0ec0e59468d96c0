"""Containment search of short test items inside documents, in SQL functions only.

A document leaks an item when it holds at least ``num``/``den`` of the item's
distinct word shingles.  Words are runs of letters and digits in lower case,
so case, punctuation and spacing do not hide a copy.

Items are partitioned by size: those of 2^s to 2^(s+1) - 1 shingles are one
partition, and those of fewer words than ``n``, whose shingle is the whole item,
are one for each length.  A partition sets how many hits its candidates need:
one more for every two doublings.  An item of m shingles gets the bottom-k
MinHash sketch of k = m - ceil(t*m) + hits: a document that holds ceil(t*m) of
m shingles must hold ``hits`` of any k, so the search misses nothing, however
long the document is, and a long item is not tried for one common shingle.
Documents stream past the sketches once, as hashes; only matching hashes
leave that stage.  Candidates are then verified on the shingles' text.

The sketch table is broadcast if it is counted to be at most
``broadcast_rows`` rows and ``broadcast_bytes`` bytes of text and keys, and so
are the candidates and the shingles; beyond that they are shuffled joins.  No
document is compared with each item.

Defined results: a null or wordless item matches nothing, and a null or
wordless document leaks nothing; repeated rows give one hit for each
(doc_id, text, item_id, text); null ids are carried as they are; a very long
text is searched whole; items of equal text are found each; an empty table on
either side gives an empty result.  Extra columns are not read, and
``decontaminated`` carries them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, fresh, row_key

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _windows(size: Column, n: int, each) -> Column:
    """``each(i)`` for every window of n words; no window in a shorter text."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), each)).otherwise(F.array())


def _spelled_and_hashed(n: int):
    return lambda i: F.struct(F.concat_ws(" ", F.slice("words", i + 1, n)).alias("s"), F.xxhash64(*[F.get("hashed", i + j) for j in range(n)], F.lit(n)).alias("h"))


def _exploded(rows: DataFrame, keys: list[str], lengths: list[int], text: bool) -> DataFrame:
    """(keys, s): the shingles of ``words`` of these lengths, as text or as hashes."""
    if text:
        w, kept = "words", rows.select(*keys, "words")
        one = lambda n: lambda i: F.concat_ws(" ", F.slice(w, i + 1, n))
    else:
        w, kept = "hashed", rows.select(*keys, F.transform("words", lambda x: F.xxhash64(x)).alias("hashed"))
        one = lambda n: lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)], F.lit(n))
    each = [_windows(F.size(w), n, one(n)) for n in lengths]
    return kept.select(*keys, F.explode(each[0] if len(each) == 1 else F.concat(*each)).alias("s"))


def _sized(df: DataFrame, rows: int, size: int) -> DataFrame:
    """A written table, broadcast only if its counted rows and bytes stay within the bounds."""
    if df.limit(rows + 1).count() > rows:
        return df
    texts = [F.octet_length(f.name) if f.dataType.typeName() == "string" else F.lit(8) for f in df.schema.fields]
    total = df.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0
    return F.broadcast(df) if total <= size else df


def item_shingles(benchmark: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(iid, item_id, m, part, hits, s, h, sketch): every distinct shingle of every item."""
    items = benchmark.select(F.col("item_id"), "text").withColumn("iid", row_key("item_id", "text")).withColumn("words", words(F.col("text"))).where("size(words) > 0").dropDuplicates(["iid"])
    part = items.withColumn("part", F.least(F.size("words"), F.lit(n))).withColumn("hashed", F.transform("words", lambda x: F.xxhash64(x)))
    out = None
    for k in range(1, n + 1):
        one = part.where(F.col("part") == k).select("iid", "item_id", "part", F.array_sort(F.array_distinct(_windows(F.size("words"), k, _spelled_and_hashed(k)))).alias("all"))
        out = one if out is None else out.union(one)
    out = out.withColumn("m", F.size("all")).withColumn("must", F.ceil(F.lit(num) * F.col("m") / F.lit(den)).cast("int"))
    size = F.floor(F.log2(F.col("m"))).cast("int")
    out = out.withColumn("hits", F.least(F.col("must"), F.when(F.col("part") < n, F.lit(1)).otherwise(1 + F.floor(size / 2)).cast("int")))
    out = out.withColumn("k", F.col("m") - F.col("must") + F.col("hits"))
    bottom = F.slice(F.array_sort(F.transform("all", lambda x: x["h"])), F.lit(1), F.col("k"))
    out = out.withColumn("bottom", bottom).select("iid", "item_id", "part", "m", "hits", "bottom", F.explode("all").alias("x"))
    return out.select("iid", "item_id", "part", "m", "hits", F.col("x.s").alias("s"), F.col("x.h").alias("h"), F.array_contains("bottom", F.col("x.h")).alias("sketch"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, num: int = 75, den: int = 100, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """(doc_id, rid, item_id, iid, m, shared) for each document and item that it leaks.

    ``rid`` and ``iid`` are the row keys of document and item, m the item's
    distinct shingles, shared those that the document holds.
    """
    items = checkpointed(item_shingles(benchmark, n, num, den))
    lengths = sorted(r["part"] for r in items.select("part").distinct().collect()) or [n]  # at most n values
    rows = docs.select(F.col("doc_id"), "text").withColumn("rid", row_key("doc_id", "text"))
    spelled = rows.withColumn("words", words(F.col("text"))).select("rid", "doc_id", "words")

    sketch = _sized(checkpointed(items.where("sketch").select("iid", "hits", F.col("h").alias("s"))), broadcast_rows, broadcast_bytes)
    seen = _exploded(spelled, ["rid"], lengths, text=False).join(sketch, "s").select("rid", "iid", "hits", "s").distinct()
    candidates = checkpointed(seen.groupBy("rid", "iid", "hits").count().where("count >= hits").select("rid", "iid"))

    some = spelled.join(_sized(candidates.select("rid").distinct(), broadcast_rows, broadcast_bytes), "rid", "left_semi")
    held = _exploded(some, ["rid", "doc_id"], lengths, text=True).distinct()
    whole = _sized(items.select("s", "iid", "item_id", "m"), broadcast_rows, broadcast_bytes)
    shared = held.join(whole, "s").groupBy("rid", "doc_id", "iid", "item_id", "m").agg(F.count("*").alias("shared"))
    shared = shared.where(F.lit(den) * F.col("shared") >= F.lit(num) * F.col("m"))
    return shared.join(candidates, ["rid", "iid"], "left_semi").select("doc_id", "rid", "item_id", "iid", F.col("m").cast("long").alias("m"), "shared")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak any item; all columns stay."""
    rid = fresh(docs, "rid")
    leaks = find_leaks(docs, benchmark, **options).select(F.col("rid").alias(rid)).distinct()
    return docs.withColumn(rid, row_key("doc_id", "text")).join(leaks, rid, "left_anti").drop(rid)
