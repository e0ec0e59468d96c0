"""Hashed byte n-gram features of whole texts, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed
from .textnp import SPACE, blocks, string_buffer

#: Letters A-Z in lower case, all spacing as one blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SPACE] = 32


def gram_codes(buf: np.ndarray, offsets: np.ndarray, n: int, bits: int, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of every n consecutive bytes that lie in one document."""
    x = fold[buf].astype(np.uint32)
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    code = np.zeros(m, dtype=np.uint32)
    for i in range(n):
        code = code * np.uint32(0x01000193) ^ x[i : i + m] * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    code >>= np.uint32(32 - bits)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    ok = offsets[1:][doc] >= np.arange(m) + n
    return doc[ok], code[ok]


def small_blocks(offsets: np.ndarray, docs: int) -> Iterator[tuple[int, int]]:
    """Row ranges bounded by bytes and by rows."""
    for i, j in blocks(offsets):
        for a in range(i, j, docs):
            yield a, min(a + docs, j)


def presence(buf: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """0/1 of shape (documents, 2**bits): which hashed n-grams of these orders occur."""
    out = np.zeros((len(offsets) - 1) << bits, dtype=np.float32)
    for n in orders:
        doc, code = gram_codes(buf, offsets, n, bits)
        out[(doc << bits) + code] = 1
    return out.reshape(-1, 1 << bits)


def counts(buf: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int, fold: np.ndarray = FOLD) -> np.ndarray:
    """Occurrences of hashed n-grams, of shape (documents, 2**bits)."""
    n = len(offsets) - 1
    out = np.zeros(n << bits, dtype=np.float32)
    for k in orders:
        doc, code = gram_codes(buf, offsets, k, bits, fold)
        out += np.bincount((doc << bits) + code, minlength=n << bits)
    return out.reshape(n, -1)


def column_blocks(batch: pa.RecordBatch, column: int, docs: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) over the rows of a batch's string column."""
    buf, offsets = string_buffer(batch.column(column))
    for i, j in small_blocks(offsets, docs):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label.

    Chosen by the hash of the text, so reruns agree; equal texts of one label
    count once.  One pass counts labels and one draws, however many labels
    there are: each label's share of hash values is set for half as many rows
    again as are wanted, so only those are ranked.
    """
    share = F.least(F.lit(float(1 << 30)), F.lit(1.5 * per_label * (1 << 30)) / F.col("count") + 1).cast("long")
    sizes = checkpointed(rows.groupBy(label).count().select(F.col(label).alias("__label"), share.alias("__share")))
    drawn = rows.join(_small(sizes), rows[label] == F.col("__label"))
    drawn = drawn.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < F.col("__share")).drop("__label", "__share").dropDuplicates([label, "text"])
    nth = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("text", F.lit(11)), "text"))
    return drawn.withColumn("__nth", nth).where(F.col("__nth") <= per_label).drop("__nth")


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table, broadcast only if its counted rows stay within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_keys(labels: DataFrame, key: str, label: str, per_label: int, max_labels: int) -> DataFrame:
    """At most ``per_label`` rows (key, label) of each frequent label, by the hash of the key.

    Keys alone are read, so a join with texts can broadcast the result, whose
    size the two bounds give.
    """
    rows = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    sizes = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    out = rows.limit(0)
    for r in sizes:
        share = int((1 << 30) * min(1.0, 1.5 * per_label / r["count"] + 1e-9) + 1)
        part = rows.where(F.col(label) == F.lit(r[label])).where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < F.lit(share))
        out = out.union(part.orderBy(F.xxhash64(key, F.lit(11)), key).limit(per_label))
    return out
