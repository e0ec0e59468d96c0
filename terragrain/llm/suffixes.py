"""A suffix array over line-ID sequences, by distributed prefix doubling.

A suffix is (rid, i): line i of sequence rid and all lines after it.  Its rank
after round k is the place, among all suffixes in the order of their first
2^k lines, of the first suffix with these lines; line IDs order lines.  Round
k + 1 sorts the suffixes whose rank is shared by the pair of their own rank
and that of the suffix 2^k lines on, and ranks them anew inside their old
rank.  Rounds go on until every suffix has a rank of its own or has nothing
left to tell it apart: its sequence ends.

Each sort is by range over (rank, next rank, rid, i), in slices of about
``SLICE_ROWS`` rows, so a rank that a third of all suffixes share is dealt over
many tasks.  A task ranks its slice by itself; what the first and the last run
of a slice have in the slices beside it follows from a few numbers of
each slice, one row for each task.

Neighbours in the final order give longest common prefixes (LCP).  Where the
pair of a suffix and its neighbour is the pair of the suffix before, one line
on, its LCP is one less; only the other pairs are compared line by line, over
at most twice the lines that doubling found shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed, partitions

#: Next ranks of suffixes that are told apart already: the sequence ends; the next line stands nowhere else.
ENDED, ALONE = -1, -2


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for k, n in enumerate(names):
            parts[k].append(batch.column(n).to_numpy(zero_copy_only=False))
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts]


def _pieces(names: list[str], arrays: list[np.ndarray], step: int = 100_000) -> Iterator[pa.RecordBatch]:
    for x in range(0, len(arrays[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(a[x : x + step]) for a in arrays], names)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


#: Rows of a slice, about.
SLICE_ROWS = 500_000


def _sorted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` sorted by ``keys`` in slices, as many as ``rows`` need, with the slice's number."""
    return df.repartitionByRange(max(1, -(-rows // SLICE_ROWS)), *keys).sortWithinPartitions(*keys).withColumn("slice", F.spark_partition_id())


def _told(slices: DataFrame) -> list:
    """What each slice says of itself, in order: one row for each task."""
    return sorted(slices.collect(), key=lambda s: s["slice"])


def _open(b):
    """Whether suffixes of one pair may differ further on: next ranks are doubled, odd ones are final."""
    return (b >= 0) & (b % 2 == 0)


_CARRIED = ["rid", "i", "size", "line"]
_SAID = ["rows", "a0", "b0", "a1", "b1", "tail", "place", "open"]
_LOCAL = "slice int, rid long, i int, size int, line long, a long, b long, off long, shared boolean, begins int, " + ", ".join(f"{c} long" for c in _SAID)
#: Bits of ``begins``: the row is of its slice's first a, first pair, last pair.
FIRST_A, FIRST_PAIR, LAST_PAIR = 1, 2, 4


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks inside a sorted slice, and one row that describes the slice.

    ``off`` counts the slice's rows of the same a with a smaller b.
    """
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    no, a, b, *carried = _columns(batches, ["slice", "a", "b", *_CARRIED])
    if not len(a):
        return
    of_a, of_ab = _starts(a), _starts(a, b)
    count = np.diff(np.append(of_ab, len(a)))
    first = of_a[np.searchsorted(of_a, of_ab, side="right") - 1]
    begins = np.where(first == 0, FIRST_A, 0) + np.where(of_ab == 0, FIRST_PAIR, 0) + np.where(of_ab == of_ab[-1], LAST_PAIR, 0)
    off, shared, begins = (np.repeat(x, count) for x in (of_ab - first, count > 1, begins.astype(np.int32)))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), *[pa.int64()] * len(_SAID)]
    for x in range(0, len(a), 100_000):
        part = [c[x : x + 100_000] for c in (no, *carried, a, b, off, shared, begins)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(part, types, strict=False)), *[pa.nulls(len(part[0]), pa.int64())] * len(_SAID)], names)
    said = (len(a), a[0], b[0], a[-1], b[-1], len(a) - of_a[-1], of_ab[-1] - of_a[-1], int(((count > 1) & _open(b[of_ab])).any()))
    row = [no[0], *[None] * 9, *said]
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)


_CARRY = "slice int, before long, goes_on boolean, pair long, follows boolean"


def _carries(slices: list) -> tuple[list[tuple], bool]:
    """For each slice: rows before it with its first a; whether its first pair began earlier, and at which place; whether its last pair goes on; and whether any pair at all is open."""
    out: list[tuple] = []
    more = any(s["open"] for s in slices)
    last = (None, None)
    rows = place = 0
    for k, s in enumerate(slices):
        first, end = (s["a0"], s["b0"]), (s["a1"], s["b1"])
        before = rows if first[0] == last[0] else 0
        goes_on = first == last
        more |= goes_on and bool(_open(first[1]))
        follows = k + 1 < len(slices) and (slices[k + 1]["a0"], slices[k + 1]["b0"]) == end
        out.append((s["slice"], before, goes_on, place if goes_on else 0, follows))
        before = before if end[0] == first[0] else 0
        if not (goes_on and end == first):
            place = s["place"] + before
        rows = s["tail"] + before
        last = end
    return out, more


def _refined(pairs: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """(carried, rank, shared, open) of ``pairs(a, b, rid, i, size, line)``, and whether some suffixes may still be told apart."""
    spark = pairs.sparkSession
    local = checkpointed(_sorted(pairs, rows, "a", "b", "rid", "i").mapInArrow(_rank, _LOCAL))
    carries, more = _carries(_told(local.where("rows is not null").select("slice", *_SAID)))
    found = local.where("rid is not null").join(F.broadcast(spark.createDataFrame(carries, _CARRY)), "slice")  # one row a task
    of = lambda bit: F.col("begins").bitwiseAND(F.lit(bit)) > 0
    earlier = of(FIRST_PAIR) & F.col("goes_on")
    off = F.when(earlier, F.col("pair")).otherwise(F.col("off") + F.when(of(FIRST_A), F.col("before")).otherwise(F.lit(0)))
    shared = F.col("shared") | earlier | (of(LAST_PAIR) & F.col("follows"))
    return found.select(*_CARRIED, (F.col("a") + off).alias("rank"), shared.alias("shared"), (shared & _open(F.col("b"))).alias("open")), more


def suffix_ranks(sequences: DataFrame) -> DataFrame:
    """(rid, i, size, line, rank, depth) of every suffix whose first line stands elsewhere too.

    ``sequences(rid, ids)`` has one row for each rid; ``size`` counts its lines
    and ``line`` names the first line of the suffix.  A suffix shares its first
    ``depth`` lines with another, and fewer than twice as many.
    """
    lines = sequences.select("rid", F.size("ids").alias("size"), F.posexplode("ids").alias("i", "id"))
    # 62 bits of the ID, doubled, as next ranks are: every shared pair of round 0 is open
    pairs = lines.select(F.lit(0).cast("long").alias("a"), F.expr("(id & 4611686018427387903) * 2").alias("b"), "rid", "i", "size", F.lit(0).cast("long").alias("line"))
    rows = sequences.agg(F.sum(F.size("ids"))).first()[0] or 0
    found, more = _refined(pairs, rows)
    state = found.where("shared").select("rid", "i", "size", F.col("rank").alias("line"), "rank", F.lit(False).alias("final"), F.lit(1).alias("depth"))
    state, depth = checkpointed(state), 1
    done, open_ = state.where("final"), state
    while more:
        rows = open_.count()
        after = done.union(open_).select("rid", (F.col("i") - depth).alias("i"), (F.col("rank") * 2 + F.col("final").cast("long")).alias("next"))
        b = F.when(F.col("i") + depth >= F.col("size"), F.lit(ENDED)).otherwise(F.coalesce("next", F.lit(ALONE))).cast("long")
        pairs = open_.join(after, ["rid", "i"], "left").select(F.col("rank").alias("a"), b.alias("b"), *_CARRIED)
        found, more = _refined(pairs, rows)
        found = found.select(*_CARRIED, "rank", (~F.col("open")).alias("final"), F.when(F.col("open"), F.lit(2 * depth)).otherwise(F.lit(depth)).alias("depth"))
        done, open_ = done.union(found.where("final")).coalesce(partitions(sequences.sparkSession)), found.where("not final")
        depth *= 2
    return done.union(open_).drop("final")


_PAIRED = "slice int, at long, rid long, i int, line long, depth int, prid long, pi int, pline long, pdepth int, rows long"


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each suffix with the one before it in its slice; and the last one of the slice, with the slice's rows."""
    names = [c.split()[0] for c in _PAIRED.split(", ")]
    no, rid, i, line, depth = _columns(batches, ["slice", "rid", "i", "line", "depth"])
    n = len(no)
    if not n:
        return
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    none = np.arange(n) == 0
    for x in range(0, n, 100_000):
        y = min(n, x + 100_000)
        before = [pa.array(np.concatenate([c[:1], c[:-1]])[x:y], t, mask=none[x:y]) for c, t in zip((rid, i, line, depth), types[6:10], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((no[x:y], np.arange(x, y), rid[x:y], i[x:y], line[x:y], depth[x:y]), types, strict=False)), *before, pa.nulls(y - x, pa.int64())], names)
    last = [no[0], None, rid[-1], i[-1], line[-1], depth[-1], None, None, None, None, n]
    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types, strict=True)], names)


def suffix_array(sequences: DataFrame) -> DataFrame:
    """(place, rid, i, lcp): suffixes in order, and how many lines each shares with the one before it.

    Suffixes whose first line stands nowhere else are left out, as they share
    nothing.
    """
    spark = sequences.sparkSession
    ranks = suffix_ranks(sequences).drop("size")
    paired = checkpointed(_sorted(ranks, ranks.count(), "rank", "rid", "i").mapInArrow(_beside, _PAIRED))
    carries, base, last = [], 0, (None,) * 4
    for s in _told(paired.where("rows is not null")):
        carries.append((s["slice"], base, *last))
        base, last = base + s["rows"], (s["rid"], s["i"], s["line"], s["depth"])
    carried = spark.createDataFrame(carries, "slice int, base long, qrid long, qi int, qline long, qdepth int")  # one row a task
    pairs = paired.where("rows is null").join(F.broadcast(carried), "slice")
    prior = {c: F.coalesce(f"p{c}", f"q{c}") for c in ("rid", "i", "line", "depth")}
    most = F.when(prior["line"] == F.col("line"), 2 * F.least("depth", prior["depth"])).otherwise(F.lit(0))
    pairs = pairs.select((F.col("base") + F.col("at")).alias("place"), "rid", "i", prior["rid"].alias("prid"), prior["i"].alias("pi"), most.alias("most"))
    along = Window.partitionBy("rid").orderBy("i")
    before = F.lag(F.struct("i", "prid", "pi", "most")).over(along)
    follows = F.coalesce((before["most"] > 0) & (before["i"] == F.col("i") - 1) & (before["prid"] == F.col("prid")) & (before["pi"] == F.col("pi") - 1), F.lit(False))
    pairs = checkpointed(pairs.withColumn("head", (F.col("most") > 0) & ~follows))
    own = sequences.select("rid", "ids")
    heads = pairs.where("head").join(own, "rid").select("rid", "i", "prid", "pi", "most", F.slice("ids", F.col("i") + 1, F.col("most")).alias("x"))
    heads = heads.join(own.withColumnRenamed("rid", "prid"), "prid").select("rid", "i", "x", F.slice("ids", F.col("pi") + 1, F.col("most")).alias("y"))
    differ = F.array_position(F.zip_with("x", "y", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = heads.select("rid", "i", F.when(differ > 0, differ - 1).otherwise(F.size("x")).cast("int").alias("shared"))
    known = F.last(F.when(F.col("most") == 0, F.struct("i", F.lit(0).alias("shared"))).when(F.col("head"), F.struct("i", "shared")), ignorenulls=True).over(along)
    out = pairs.join(shared, ["rid", "i"], "left").withColumn("known", known)
    return out.select("place", "rid", "i", (F.col("known.shared") - (F.col("i") - F.col("known.i"))).alias("lcp"))


_RUNS = "slice int, joined array<boolean>, whole array<boolean>, head array<struct<ord:long,rid:long,i:int>>, tail array<struct<ord:long,rid:long,i:int>>"


def _leasts(depths: list[int], lcp, ord_, rid, i):
    """By depth: where intervals begin in a slice, and the least (ord, rid, i) of each."""
    order = np.lexsort((i, rid, ord_))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    for d in depths:
        new = lcp < d
        new[0] = True
        begin = np.flatnonzero(new)
        yield d, begin, order[np.minimum.reduceat(rank, begin)]


def _intervals(depths: list[int]):
    names = [c.split(" ")[0] for c in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, lcp, ord_, rid, i = _columns(batches, ["slice", "lcp", "ord", "rid", "i"])
        if len(no):
            key = lambda k: {"ord": int(ord_[k]), "rid": int(rid[k]), "i": int(i[k])}
            each = [(bool(lcp[0] >= d), len(begin) == 1, key(least[0]), key(least[-1])) for d, begin, least in _leasts(depths, lcp, ord_, rid, i)]
            lists = [pa.array([[e[c] for e in each]], t) for c, t in enumerate((pa.list_(pa.bool_()), pa.list_(pa.bool_()), *([pa.list_(pa.struct([("ord", pa.int64()), ("rid", pa.int64()), ("i", pa.int32())]))] * 2)))]
            yield pa.RecordBatch.from_arrays([pa.array([no[0]]), *lists], names)

    return run


def _ends_of_intervals(slices: list, depths: list[int]) -> dict[int, tuple[list, list]]:
    """For each slice and depth, the least key of the intervals that reach into it from before and after."""
    out = {s["slice"]: ([None] * len(depths), [None] * len(depths)) for s in slices}
    for c in range(len(depths)):
        low = None
        for k, s in enumerate(slices):  # forwards: the least key so far of the interval that goes on
            if s["joined"][c]:
                out[s["slice"]][0][c] = low
                low = min(low, tuple(s["tail"][c])) if s["whole"][c] else tuple(s["tail"][c])
            else:
                low = tuple(s["tail"][c])
        low = None
        for k in range(len(slices) - 1, -1, -1):
            s = slices[k]
            after = low if k + 1 < len(slices) and slices[k + 1]["joined"][c] else None
            out[s["slice"]][1][c] = after
            low = tuple(s["head"][c])
            if s["whole"][c] and after is not None:
                low = min(low, after)
    return out


def _later(depths: list[int], ends: dict[int, tuple[list, list]]):
    """The greatest depth of which a suffix's interval holds an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, lcp, ord_, rid, i = _columns(batches, ["slice", "lcp", "ord", "rid", "i"])
        if not len(no):
            return
        best = np.zeros(len(no), dtype=np.int32)
        before, after = ends[int(no[0])]
        mine = lambda k: (int(ord_[k]), int(rid[k]), int(i[k]))
        for c, (d, begin, least) in enumerate(_leasts(depths, lcp, ord_, rid, i)):
            later = np.ones(len(no), dtype=bool)
            later[least] = False
            for at, other in ((0, before[c]), (-1, after[c])):
                if other is not None and other < mine(least[at]):
                    later[least[at]] = True
            best[later] = d
        yield from _pieces(["rid", "i", "n"], [rid, i, best])

    return run


def later_copies(sequences: DataFrame, depths: list[int]) -> DataFrame:
    """(rid, i, n): suffixes whose first n lines stand earlier too, n the greatest of ``depths`` (ascending) that is so.

    ``sequences(rid, ord, ids)``; earlier is by (ord, rid, i).  An LCP interval
    of depth d is a run of neighbours that share d lines or more; its least
    suffix is the original, all others are later copies.
    """
    array = suffix_array(sequences).join(sequences.select("rid", "ord"), "rid")
    array = checkpointed(array.select("place", "rid", "i", "ord", "lcp"))
    ordered = checkpointed(_sorted(array, array.count(), "place"))
    slices = _told(ordered.mapInArrow(_intervals(depths), _RUNS))
    return ordered.mapInArrow(_later(depths, _ends_of_intervals(slices, depths)), "rid long, i int, n int").where("n > 0")
