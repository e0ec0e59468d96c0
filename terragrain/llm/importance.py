"""Importance resampling of documents towards a target distribution, by hashed word n-grams.

Words are runs of ASCII letters, digits and all code points beyond ASCII, with
A-Z in lower case.  Features are all runs of 1 to ``n`` consecutive words,
joined by one space; a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo ``buckets``.  The strings of n-grams are never made.  CRC-32 is linear
over GF(2): appending L bytes to a text shifts its CRC by a 32 x 32 matrix
that depends on L alone, so

    crc(a + b) = shift(crc(a), len(b)) ^ crc(b).

Each word's CRC is taken once, and an n-gram's follows from that of the
(n-1)-gram before it, the blank's and its last word's.  Shifts by a length go
through the powers of two in it, each a matrix held as four tables of 256.

One pass counts the buckets of both tables, in tasks first; the gains of all
buckets, ``buckets`` longs whatever the input is, travel to a second pass that
weighs the documents.  Ranks come from a sort by ranges and counted range
sizes, so neither the order nor the draw meets in one task.

Defined results: a null or wordless text has no feature and weight 0; a null
doc_id draws as the empty text and comes last among equal scores; rows that
repeat count and rank each for themselves, equal ones in any order; very long
texts are read in pieces that overlap by n - 1 words, so no feature is lost;
an empty table on either side counts no features; an empty ``docs`` gives an
empty result.  Extra columns are not read, and ``resampled`` carries them
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import carried, checkpointed, fresh, partitions, restored
from .textnp import BLOCK_BYTES, blocks, string_buffer

#: Bytes of words, and A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Words of more bytes than this get their CRC from zlib, one by one.
LONG_WORD = 48


def _byte_table() -> np.ndarray:
    """The CRC-32 register after one more byte, for the low eight bits that leave it."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


TABLE = _byte_table()


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as tables of shape (4, 256), times each x."""
    out = matrix[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= matrix[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_matrices(count: int) -> list[np.ndarray]:
    """Shifts of a CRC by 1, 2, 4, .. bytes; each is the square of the one before."""
    every = np.arange(256, dtype=np.uint32)
    images = [every << np.uint32(8 * k) for k in range(4)]
    out = [np.stack([TABLE[x & np.uint32(255)] ^ (x >> np.uint32(8)) for x in images])]
    while len(out) < count:
        out.append(np.stack([_times(out[-1], row) for row in out[-1]]))
    return out


SHIFTS = _shift_matrices(31)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC as it is once so many bytes follow; the bytes' own CRC is to be added."""
    out, left, k = crc.copy(), length, 0
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = _times(SHIFTS[k], out[at])
        left, k = left >> 1, k + 1
    return out


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text, with one more entry at the end."""
    solid = WORD[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    begin, finish = solid.copy(), solid.copy()
    if len(buf):
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        finish[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, offsets)


def word_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every word in lower case, a byte of all words at a time."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    first = np.searchsorted(-size[order], -LONG_WORD) if len(order) else 0  # long words come first
    out = np.zeros(len(start), dtype=np.uint32)
    for i in order[:first]:
        out[i] = zlib.crc32(LOWER[buf[start[i] : end[i]]].tobytes())
    order = order[first:]
    at, left = start[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for p in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -p))  # those of more than p bytes
        state[:n] = TABLE[(state[:n] ^ LOWER[buf[at[:n] + p]]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def gram_crcs(crc: np.ndarray, size: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, CRCs of every k consecutive words joined by blanks), for k from 1 to n."""
    blank = np.uint32(zlib.crc32(b" "))
    gram = crc
    for k in range(1, n + 1):
        if k > 1:
            if len(gram) < 2:
                return
            gram = shifted(_times(SHIFTS[0], gram[:-1]) ^ blank, size[k - 1 :]) ^ crc[k - 1 :]
        yield k, gram


def _pieces(buf: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, words that were counted before): blocks of texts, and long texts in overlapping pieces."""
    for i, j in blocks(offsets, BLOCK_BYTES):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK_BYTES:
            yield i, buf[lo:hi], offsets[i : j + 1] - lo, 0
            continue
        begin, seen, limit = lo, 0, BLOCK_BYTES
        while begin < hi:
            stop = min(begin + limit, hi)
            while stop < hi and WORD[buf[stop - 1]] and WORD[buf[stop]]:  # never inside a word
                gap = np.flatnonzero(~WORD[buf[stop : min(stop + BLOCK_BYTES, hi)]])
                stop = stop + int(gap[0]) if len(gap) else min(stop + BLOCK_BYTES, hi)
            piece = buf[begin:stop]
            start = word_spans(piece, np.array([0, len(piece)]))[0]
            back = min(n - 1, len(start))  # the next piece starts with them again
            ahead = begin + int(start[len(start) - back]) if back else stop
            if ahead <= begin and stop < hi:  # no more words than are to be repeated
                limit *= 2
                continue
            yield i, piece, np.array([0, len(piece)]), seen
            if stop == hi:
                break
            begin, seen, limit = ahead, back, BLOCK_BYTES


def bucketed(buf: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words of each row, buckets of features with their row) of each piece: (row, new words), (row, bucket)."""
    for i, piece, offs, seen in _pieces(buf, offsets, n):
        start, end, first = word_spans(piece, offs)
        size = end - start
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        rows, found = [], []
        for k, gram in gram_crcs(word_crcs(piece, start, end), size, n):
            ok = doc[: len(gram)] == doc[k - 1 :]
            if seen:
                ok = ok & (np.arange(len(gram)) + k - 1 >= seen)
            rows.append(doc[: len(gram)][ok])
            found.append((gram[ok] % np.uint32(buckets)).astype(np.int64))
        fresh_words = np.diff(first)
        fresh_words[0:1] -= seen
        none = np.zeros(0, dtype=np.int64)
        yield i + np.arange(len(offs) - 1), fresh_words, np.stack([np.concatenate([none, *rows]) + i, np.concatenate([none, *found])])


def bucket_counts(texts: DataFrame, n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): occurrences of all features of ``texts(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, (_, b) in bucketed(*string_buffer(batch.column(0)), n, buckets):
                total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket; the array has a fixed size."""
    spark = docs.sparkSession
    s, t = (bucket_counts(x, n, buckets).withColumnRenamed("n", name) for x, name in ((docs, "s"), (target, "t")))
    both = checkpointed(spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0))
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    num = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    den = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    found = both.select("bucket", F.floor(F.log(num / den) * 1000).cast("long").alias("gain")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    out[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    return out


def weighed(docs: DataFrame, keep: list[str], gains: np.ndarray, n: int = 2) -> DataFrame:
    """``keep`` columns, n_words, n_features and weight, the floored mean gain of a document's features."""
    rows, ddl = carried(docs, keep)
    held = len(keep)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for row, fresh_words, (doc, b) in bucketed(*string_buffer(batch.column(held)), n, len(gains)):
                lo, size = int(row[0]), len(row)
                words[row] += fresh_words
                features[row] += np.bincount(doc - lo, minlength=size)
                total[row] += np.bincount(doc - lo, weights=gains[b], minlength=size).astype(np.int64)  # whole numbers under 2**53
            mean = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:held], pa.array(words), pa.array(features), pa.array(mean)], names=[*batch.schema.names[:held], "n_words", "n_features", "weight"])

    out = rows.mapInArrow(weigh, ", ".join(x for x in (ddl, "n_words long, n_features long, weight long") if x))
    return restored(out, keep)


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * -1000).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written, with each row's place 1, 2, .. in this order.

    A sort by ranges; places inside a range are counted where the rows stand,
    and a range's size is one row for each partition.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    at = fresh(df, "at")
    rows = checkpointed(dealt.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)
    ends = rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    before = np.concatenate([[0], np.cumsum([r["count"] for r in ends])]).tolist()
    first = df.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(ends, before, strict=False)], f"{at}p long, {at}b long")
    placed = rows.join(F.broadcast(first), part == F.col(f"{at}p"), "left")
    return placed.withColumn(name, F.col(f"{at}b") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, f"{at}p", f"{at}b")


def importance(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: str = "7") -> DataFrame:
    """``keep`` columns (doc_id), n_words, n_features, weight, score and rank of every document.

    Of the documents with ``least_words`` words or more, ``percent`` in a
    hundred are drawn without replacement by Gumbel top-k: the highest scores,
    ties by doc_id.  ``rank`` is null for the others.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = weighed(docs, keep, bucket_gains(docs, target, n, buckets), n)
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    may = F.col("n_words") >= least_words
    order = [F.when(may, F.lit(0)).otherwise(1), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows, order, "rank")
    count = placed.where(may).count()
    return placed.withColumn("rank", F.when(may & (F.col("rank") <= percent * count // 100), F.col("rank")))


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept."""
    at = fresh(docs, "row")
    rows = docs.withColumn(at, F.xxhash64("doc_id", "text"))
    drawn = importance(rows, target, ["doc_id", at], **settings).where("rank is not null")
    return rows.join(drawn.select(at, F.lit(1).alias(f"{at}k")).distinct(), at, "left_semi").drop(at)
