"""Removal of repeated line runs, by a suffix array over line-ID sequences.

A document is the sequence of its ``\\n``-parted lines that hold a word; a
line's ID is a 64-bit hash of its bytes.  Documents with equal sequences (by
128 bits) are one class; the first of a class, by (doc_id, row key), stands for
it in the suffix array, and the others are later copies as a whole, so a group
of thousands of copies adds one sequence.  ``suffixes`` ranks all suffixes by
prefix doubling until none can be told apart further, and takes the longest
common prefixes (LCP) of neighbours.  An LCP interval of depth d is a set of
occurrences of one run of d lines: the one that comes first by (doc_id, line)
is the original, all others are later copies.  Intervals of ``min_lines`` or
more count; with ``long_words`` those of fewer lines too, where the run has
more than so many words.  Starts of later copies join to maximal runs, whose
lines are deleted.  A longer repeated run is a chain of intervals of
``min_lines``, so deeper ones delete nothing further; ``repeated_runs`` gives
them.

Sequences are written once; the rounds shuffle ranks, and each text is
shuffled once, to meet its deletions.

Defined results: a null text stays null with no lines; lines without a word
are never part of a run and stay; a null doc_id comes last; rows of one doc_id
and text are one document and are treated alike, but each row without a doc_id
is its own, so of equal ones all but one are later copies; a document all of
whose lines go becomes the empty text; a very long text is one sequence like
any other; an empty table gives an empty result.  Other columns are carried,
whatever their names, and ``n_chars`` is counted anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed, row_key
from .suffixes import later_copies, suffix_array
from .textnp import SPACE, blocks, grouped, spans, string_buffer

_LAST, _ALL = (1 << 63) - 1, (1 << 31) - 1


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line of a block of documents."""
    newline = np.flatnonzero(buf == 10)
    doc_of = np.searchsorted(offsets, newline, side="right") - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    start = np.concatenate([offsets[full], newline + 1])
    end = np.concatenate([offsets[full + 1], newline])
    doc = np.concatenate([full, doc_of])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end_order = np.lexsort((end, np.concatenate([full, doc_of])))
    return start, end[end_order], doc


def worded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    solid = grouped(~SPACE[buf])
    return solid[end] > solid[start]


def word_counts(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    solid = ~SPACE[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[start[start < len(buf)]] = solid[start[start < len(buf)]]
    counted = grouped(begins)
    return counted[end] - counted[start]


_SEQUENCES = "rid long, ord long, cls binary, ids array<long>, cut array<int>"


def _sequences(min_lines: int, long_words: int | None):
    """Each document's line IDs, their class, and for each line the least lines from there on that make a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_buffer(batch.column(2))
            for i, j in blocks(offsets):
                b = buf[offsets[i] : offsets[j]]
                start, end, doc = lines_of(b, offsets[i : j + 1] - offsets[i])
                keep = worded(b, start, end)
                start, end, doc = start[keep], end[keep], doc[keep]
                first = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                least = np.full(len(start), min_lines, dtype=np.int32)
                if long_words is not None:
                    total = grouped(word_counts(b, start, end))
                    for n in range(min_lines - 1, 0, -1):
                        at = np.arange(max(len(start) - n + 1, 0))
                        inside = first[doc[at] + 1] >= at + n
                        least[at[inside & (total[at + n] - total[at] > long_words)]] = n
                names = [hashlib.md5(b"\n".join(b[x:y].tobytes() for x, y in zip(start[p:q], end[p:q], strict=True))).digest() for p, q in zip(first[:-1], first[1:], strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (spans(b, start, end).view(np.int64), least)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.binary()), *lists], ["rid", "ord", "cls", "ids", "cut"])

    return run


def _firsts(docs: DataFrame, min_lines: int, long_words: int | None) -> tuple[DataFrame, DataFrame]:
    """Sequences with lines, and of those the first document of each class."""
    ddl = docs.select("rid", "ord", "text").mapInArrow(_sequences(min_lines, long_words), _SEQUENCES)
    every = checkpointed(ddl.where("size(ids) > 0"))
    first = every.groupBy("cls").agg(F.min(F.struct("ord", "rid")).alias("first")).select("first.rid").withColumn("first", F.lit(True))
    every = every.join(first, "rid", "left")
    return every, checkpointed(every.where("first").dropDuplicates(["rid"]).select("rid", "ord", "ids", "cut"))


def later_runs(docs: DataFrame, min_lines: int, long_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rid, i, n): n lines from line i on that stand earlier too; and (rid) of null ids, of equal rows of which all but one go.

    ``docs(rid, ord, text)``; i counts lines with a word from 0.
    """
    every, sequences = _firsts(docs, min_lines, long_words)
    found = later_copies(sequences.select("rid", "ord", "ids"), [min_lines] if long_words is None else list(range(1, min_lines + 1)))
    need = sequences.select("rid", F.posexplode("cut").alias("i", "need")) if long_words is not None else None
    runs = found if need is None else found.join(need, ["rid", "i"]).where("n >= need")
    # a later copy as a whole is a run if any run starts in it, or if all its words make one
    whole = F.exists(F.zip_with("cut", F.sequence(F.lit(0), F.size("cut") - 1), lambda c, k: c + k <= F.size("cut")), lambda x: x)
    copies = every.where("first is null and size(ids) > 0").where(whole).select("rid", F.lit(0).alias("i"), F.size("ids").alias("n"))
    again = every.where(F.col("ord") == _LAST).where(whole).groupBy("rid").count().where("count > 1").select("rid")
    return runs.select("rid", "i", "n").union(copies), again


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(place, rid, i, lcp) of every line that stands twice: the suffix array of the classes of ``docs(doc_id, text)``, with LCP."""
    rows = docs.select(row_key("doc_id", "text").alias("rid"), order_of(F.col("doc_id")).alias("ord"), "text")
    return suffix_array(_firsts(rows, 1, None)[1].select("rid", "ids"))


_ADDED = [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept", pa.string())]


def _delete(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carried)
            buf, offsets = string_buffer(texts)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, doc = lines_of(b, o)
                solid = np.flatnonzero(worded(b, start, end))
                first = np.searchsorted(doc[solid], np.arange(j - i + 1))
                n_lines, removed, runs, kept = np.diff(first), np.zeros(j - i, dtype=np.int64), np.zeros(j - i, dtype=np.int64), []
                for d, at in enumerate(batch.column(carried + 1).slice(i, j - i).to_pylist()):
                    text = b[o[d] : o[d + 1]].tobytes()
                    if at:
                        step = np.zeros(n_lines[d] + 1, dtype=np.int64)
                        begin, length = np.array([(x["i"], x["n"]) for x in at]).T
                        np.add.at(step, begin, 1)
                        np.add.at(step, np.minimum(begin + length, n_lines[d]), -1)
                        gone = np.cumsum(step[:-1]) > 0
                        out = set((solid[first[d] : first[d + 1]][gone] - np.searchsorted(doc, d)).tolist())
                        removed[d], runs[d] = gone.sum(), np.diff(np.concatenate([[0], gone.view(np.int8)])).clip(0).sum()
                        text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in out)
                    kept.append(None if null[i + d] else text)
                added = [pa.array(n_lines, pa.int64()), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(carried)), *added], [f"c{c}" for c in range(carried)] + [n for n, _ in _ADDED])

    return run


def order_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _cleaned(docs: DataFrame, keep: list[str], min_lines: int, long_words: int | None) -> DataFrame:
    """Columns c0.. for ``keep``, then n_lines, n_removed, n_runs and kept."""
    rid, order = row_key("doc_id", "text"), order_of(F.col("doc_id"))
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").alias("__text"), rid.alias("__rid"), F.col("doc_id").isNull().alias("__null"))
    starts, again = later_runs(docs.select(rid.alias("rid"), order.alias("ord"), "text"), min_lines, long_words)
    starts = starts.groupBy(F.col("rid").alias("__rid")).agg(F.collect_set(F.struct("i", "n")).alias("__at"))
    again = checkpointed(again.select(F.col("rid").alias("__rid")))
    carried = [f"c{k}" for k in range(len(keep))]
    if again.isEmpty():
        met = rows.join(starts, "__rid", "left").select(*carried, "__text", "__at")
    else:
        same = rows.where("__null").join(again, "__rid", "left_semi")
        nth = F.row_number().over(Window.partitionBy("__rid").orderBy("__rid"))
        all_lines = F.array(F.struct(F.lit(0).alias("i"), F.lit(_ALL).alias("n")))
        same = same.withColumn("__nth", nth).join(starts, "__rid", "left").select(*carried, "__text", F.when(F.col("__nth") > 1, all_lines).otherwise(F.col("__at")).alias("__at"))
        others = rows.where("not __null").union(rows.where("__null").join(again, "__rid", "left_anti").select(*rows.columns))
        met = others.join(starts, "__rid", "left").select(*carried, "__text", "__at").union(same)
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields[:-2]] + ["n_lines long", "n_removed long", "n_runs long", "kept string"])
    return met.mapInArrow(_delete(len(keep)), ddl)


def line_dedup(docs: DataFrame, keep: list[str], min_lines: int = 3, long_words: int | None = None) -> DataFrame:
    """``keep`` columns, n_lines, n_removed, n_runs and kept, for each row of ``docs``.

    ``n_lines`` counts lines with a word, ``n_runs`` the maximal runs that
    were deleted, and ``kept`` is the text without them.
    """
    out = _cleaned(docs, keep, min_lines, long_words)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "n_lines", "n_removed", "n_runs", "kept")


def deduplicated(docs: DataFrame, min_lines: int = 3, long_words: int | None = 50) -> DataFrame:
    """``docs`` with all its columns, its texts without later copies.

    Runs of fewer lines go too if they have over ``long_words`` words.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return _cleaned(docs, others, min_lines, long_words).select(*[made[c].alias(c) for c in docs.columns])
