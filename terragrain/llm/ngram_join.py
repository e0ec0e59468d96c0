"""Exact Jaccard self-join of documents on their word n-grams.

Documents are rows and distinct n-grams are columns of a sparse 0/1 matrix A;
overlaps are entries of A times its transpose.  The product is formed block
by block of columns and only where it can matter:

1. *Column blocks.*  Tasks deal the n-gram hashes of their documents to column
   blocks.  A block finds the columns with two or more documents and tells
   each document how many of its n-grams are such.  A document of n n-grams
   with fewer than ``num``/``den`` * n shared ones can link with none, and
   leaves.  Columns that recur within one block of documents are settled
   there and sent once, so a column of a third of all documents stays small.
2. *Classes.*  Equal rows are one class; the rest works on one row for each.
   Column counts are taken again over classes, from blocks of rows that send
   each of their columns once, and the same bound prunes again.
3. *Leaders.*  Of a row's columns, rarest first, the first n - ceil(t*n) + 1
   must hold one that it shares with any partner.  Each class is compared
   with the leader of most of those columns among the classes of about its
   size, the one whose columns are the most common, which is the middle of its
   group; verified links make first components.  Another round does so with
   other bounds of the size classes.
4. *Leading columns.*  Columns that still hold different components give the
   remaining pairs: the product of the leading columns alone counts what two
   rows share there.  Two rows of a and b columns need an overlap of
   o = ceil(t/(1+t) * (a+b)).  The smaller row's entries count only among its
   first a - ceil(2t/(1+t)*a) + 1 columns, the larger one's among its first
   b - ceil(t*b) + 1, and a pair is discarded when what it shares so far and
   what is left behind its last shared column cannot reach o.  A row of a
   columns, s of them in other rows, has no partner of more than
   (1+t)/t * s - a columns.
5. *Whole rows.*  The product of whole rows is formed for the pairs that are
   left: rows are cut by column into ``blocks`` parts, each part's product
   is one partial overlap, and the partial overlaps of a pair are added up and
   held against o.  Pairs inside one component are never formed, so
   a group of thousands of near copies costs a few comparisons for each, not
   all pairs; no link between components is lost.

The number of column blocks grows with the counted bytes of text.

Defined results: a null or wordless text has no n-grams and no links; fewer
than n words count as one n-gram; repeated rows share a class; a null id is
never a component's id unless all are null; a text longer than a block is a
block of its own; an empty table gives an empty result.  Extra columns are
not read, and ``one_of_each`` carries them whatever their names.
Hashes have 52 bits within a pair of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .replies import ANSWERS_DDL, PACKED_DDL, home_of, packed, unpacked
from .session import checkpointed, fresh, row_key, shards_of
from .textnp import U64, Words, binary_slices, blocks, cut, grouped, mix, shingles, string_buffer, wide

LOCAL_BYTES = 4 << 20
#: Bytes of a column's hash that are sent to its block, beside the block's number.
SENT = 5
#: Logarithm of a size class's ratio, in the search for leaders.
SIZE_STEP = 0.15
#: Rows of the later products up to which their names are broadcast.
FEW = 200_000


def _block_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h, 5) % U64(shards)).astype(np.int32)


def _class_of(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set: equal sets, and only they, have one name."""
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix(h, 11), out=total[1:])
    return mix(total[own[1:]] - total[own[:-1]] + mix(np.diff(own).astype(U64), 13), 17).view(np.int64)


def _columns(n: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("rid", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("cls", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy().astype(np.int64)
            buf, offsets = string_buffer(batch.column(1))
            for i, j in blocks(offsets, LOCAL_BYTES):
                h, own = shingles(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                s = np.sort(h)
                twice = np.unique(s[1:][s[1:] == s[:-1]])
                local = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h if len(twice) else np.zeros(len(h), dtype=bool)
                size = np.diff(own)
                shared = np.diff(grouped(local)[own])
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_block_of(rids[i:j].view(U64), shards)), pa.array(rids[i:j]), pa.array(size), pa.array(shared), pa.array(_class_of(h, own)), none, none, none], schema=schema)
                doc = np.repeat(np.arange(j - i), size)[~local]
                mine = h[~local]
                shard, shared_by = _block_of(mine, shards), _block_of(twice, shards)
                order = np.argsort(shard, kind="stable")
                doc, mine, shard = doc[order], mine[order], shard[order]
                edge = np.searchsorted(shard, np.arange(shards + 1))
                rows = []
                for k in np.unique(np.concatenate([shard, shared_by])):
                    d, c = np.unique(doc[edge[k] : edge[k + 1]], return_counts=True)
                    sent = np.concatenate([mine[edge[k] : edge[k + 1]], twice[shared_by == k]])
                    rows.append((int(k), None, None, None, None, rids[i:j][d].tobytes(), c.astype(np.uint32).tobytes(), cut(sent, SENT)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


_COUNTS = pa.schema([("home", pa.int32()), ("rids", pa.binary()), ("counts", pa.binary())])


def _to_homes(rids: np.ndarray, counts: np.ndarray, homes: int) -> pa.RecordBatch:
    """(n, shared, rows, cls) of each row key, packed for the slices of row keys."""
    home = home_of(rids, homes)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(homes + 1))
    rows = [(int(k), rids[order[cut[k] : cut[k + 1]]].tobytes(), counts[order[cut[k] : cut[k + 1]]].tobytes()) for k in np.flatnonzero(np.diff(cut))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _COUNTS.types, strict=True)], schema=_COUNTS)


def _count_shared(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            own = batch.column("rid").is_valid()
            here = batch.filter(own)
            if here.num_rows:
                counts = [here.column("n").to_numpy(), here.column("shared").to_numpy(), np.ones(here.num_rows, dtype=np.int64), here.column("cls").to_numpy()]
                yield _to_homes(here.column("rid").to_numpy(), np.stack(counts, axis=1), homes)
            for r in batch.filter(pa.compute.invert(own)).select(["shard", "ids", "counts", "hashes"]).to_pylist():
                sent.setdefault(r["shard"], []).append((r["ids"], r["counts"], r["hashes"]))
        for parts in sent.values():
            s = np.concatenate([wide(x[2], SENT) for x in parts])
            s.sort()
            twice = np.unique(s[1:][s[1:] == s[:-1]])
            del s
            if not len(twice):
                continue
            rids, counts = [], []
            for ids, sizes, hashes in parts:
                own = grouped(np.frombuffer(sizes, dtype=np.uint32))
                h = wide(hashes, SENT)[: own[-1]]
                hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
                shared = np.diff(grouped(hit)[own])
                found = np.flatnonzero(shared)
                rids.append(np.frombuffer(ids, dtype=np.int64)[found])
                counts.append(shared[found])
            rid, shared = np.concatenate(rids), np.concatenate(counts)
            if len(rid):
                zero = np.zeros(len(rid), dtype=np.int64)
                yield _to_homes(rid, np.stack([zero, shared, zero, zero], axis=1), homes)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n, shared, rows, cls) of each row key of a home."""
    rids, counts = [], []
    for batch in batches:
        for r in batch.to_pylist():
            rids.append(np.frombuffer(r["rids"], dtype=np.int64))
            counts.append(np.frombuffer(r["counts"], dtype=np.int64).reshape(-1, 4))
    if rids:
        rid, at = np.unique(np.concatenate(rids), return_inverse=True)
        each = np.concatenate(counts)
        total = [np.bincount(at, weights=each[:, c], minlength=len(rid)).astype(np.int64) for c in range(3)]
        cls = np.zeros(len(rid), dtype=np.int64)
        own = each[:, 2] > 0
        cls[at[own]] = each[own, 3]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, *total, cls)], ["rid", "n", "shared", "rows", "cls"])


_PACKS = "block long, cls binary, sizes binary, grams binary"


def _packs(n: int):
    """Rows of (cls, text) as blocks of sets; a block is named by its classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column(0).to_numpy().astype(np.int64)
            buf, offsets = string_buffer(batch.column(1))
            for i, j in blocks(offsets):
                h, own = shingles(Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n)
                name = mix(np.array([np.sum(mix(cls[i:j].view(U64), 19))], dtype=U64), 23).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array([x.tobytes()], pa.binary()) for x in (cls[i:j], np.diff(own).astype(np.int64), h))], ["block", "cls", "sizes", "grams"])

    return run


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["cls"], dtype=np.int64), np.frombuffer(r["sizes"], dtype=np.int64), np.frombuffer(r["grams"], dtype=U64)


def _send_columns(shards: int):
    names = ["shard", "block", "hashes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u, c = np.unique(_unpack(r)[2], return_counts=True)
                shard = _block_of(u, shards)
                rows = [(int(k), r["block"], cut(u[shard == k], SENT), c[shard == k].astype(np.uint32).tobytes()) for k in np.unique(shard)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    return run


def _count_columns(homes: int):
    """For each block, a class of frequency for each column that it sent: 0 if no other set has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sent.setdefault(r["shard"], []).append(r)
        for shard, rows in sent.items():
            u, at = np.unique(np.concatenate([wide(r["hashes"], SENT) for r in rows]), return_inverse=True)
            df = np.bincount(at, weights=np.concatenate([np.frombuffer(r["counts"], dtype=np.uint32) for r in rows]), minlength=len(u))
            rank = np.where(df > 1, np.minimum(1 + np.floor(4 * np.log2(np.maximum(df, 1))), 255), 0).astype(np.uint8)[at]
            own = grouped(np.array([len(r["counts"]) // 4 for r in rows]))
            yield from packed(shard, np.array([r["block"] for r in rows], dtype=np.int64), binary_slices(rank, own), homes)

    return run


_SETS = "cls long, n long, middle long, single long, prefix array<long>, grams array<long>"


def _rare_first(shards: int, num: int, den: int):
    """Sets that may still link, with the columns that must hold a shared one.

    A column's key is its class of frequency, then its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cls, sizes, h = _unpack(r)
                own = grouped(sizes)
                u, at = np.unique(h, return_inverse=True)
                shard, rank = _block_of(u, shards), np.zeros(len(u), dtype=np.uint8)
                for a in r["answers"] or ():
                    rank[np.flatnonzero(shard == a["shard"])] = np.frombuffer(a["bits"], dtype=np.uint8)
                key = (rank.astype(U64) << U64(52) | u)[at].view(np.int64)
                out = {k: [] for k in ("cls", "n", "middle", "single", "prefix", "grams")}
                for k in range(len(cls)):
                    mine = np.sort(key[own[k] : own[k + 1]])
                    n, single = len(mine), int(np.searchsorted(mine, 1 << 52))
                    first = n - -(-num * n // den) + 1
                    if n and single < first:
                        out["cls"].append(cls[k])
                        out["n"].append(n)
                        out["middle"].append(int(1000 * (mine >> 52).mean()))
                        out["single"].append(single)
                        out["prefix"].append(mine[single:first])
                        out["grams"].append(h[own[k] : own[k + 1]].view(np.int64))
                if out["cls"]:
                    lists = [pa.ListArray.from_arrays(pa.array(grouped(np.array([len(x) for x in out[c]])).astype(np.int32)), pa.array(np.concatenate(out[c]))) for c in ("prefix", "grams")]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.array(out[c], dtype=np.int64)) for c in ("cls", "n", "middle", "single")), *lists], list(out))

    return run


def _least_overlap(num: int, den: int):
    """ceil(t / (1 + t) * (na + nb)) in whole numbers."""
    return F.ceil((F.lit(num) * (F.col("na") + F.col("nb"))) / F.lit(num + den))


def _parts(sets: DataFrame, blocks_: int) -> DataFrame:
    """(cls, part, n, cols): each row's columns of each column block."""
    of_part = lambda k: F.filter("grams", lambda g: F.pmod(g, F.lit(blocks_)) == k)
    each = F.array(*[F.struct(F.lit(k).alias("part"), of_part(k).alias("cols")) for k in range(blocks_)])
    return sets.select("cls", "n", F.explode(each).alias("x")).select("cls", "n", "x.part", "x.cols").where("size(cols) > 0")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, blocks_: int, few: int = 0) -> DataFrame:
    """The pairs (a, b) whose overlap, added up over column blocks, is large enough.

    Only rows of some pair are dealt if these are counted to be ``few`` or less,
    so that their names can be broadcast.
    """
    if few:
        pairs = checkpointed(pairs)
        some = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        if some.limit(few + 1).count() <= few:
            sets = sets.join(F.broadcast(some), "cls", "left_semi")
    parts = _parts(sets, blocks_)
    left = pairs.join(parts.select(F.col("cls").alias("a"), F.col("n").alias("na"), "part", F.col("cols").alias("x")), "a")
    right = parts.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("part").alias("of"), F.col("cols").alias("y"))
    both = left.join(right, (left["b"] == right["b"]) & (left["part"] == right["of"])).select("a", left["b"], "na", "nb", F.size(F.array_intersect("x", "y")).alias("partial"))
    total = both.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    return total.where(F.col("overlap") >= _least_overlap(num, den)).select("a", "b")


def _divided(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``postings`` with the component of each row, of the columns that hold several components."""
    if labels is None:
        named = postings.withColumn("label", F.col("cls"))
    else:
        named = postings.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    return checkpointed(named.join(several, "h", "left_semi"))


def _leading(named: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that the product of their leading columns does not discard.

    ``named(h, cls, n, pos, label)``; a is the smaller row.
    """
    x, y = (named.select("h", *[F.col(c).alias(f"{c}{s}") for c in ("cls", "n", "pos", "label", "cap")]) for s in "ab")
    x = x.where(F.col("posa") <= F.col("na") - F.ceil(F.lit(2 * num) * F.col("na") / F.lit(num + den)))
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("clsa") < F.col("clsb"))
    least = _least_overlap(num, den)
    early = (F.col("posa") <= F.col("na") - least) & (F.col("posb") <= F.col("nb") - least)
    pairs = x.join(y, "h").where(smaller & (F.col("labela") != F.col("labelb")) & early & (F.lit(den) * F.col("na") >= F.lit(num) * F.col("nb")) & (F.col("na") <= F.col("capb")) & (F.col("nb") <= F.col("capa")))
    counted = pairs.groupBy(F.col("clsa").alias("a"), F.col("clsb").alias("b"), "na", "nb").agg(F.count("*").alias("shared"), F.max("posa").alias("lasta"), F.max("posb").alias("lastb"))
    # columns before the last shared one that both lead with are all counted, later ones may be shared too
    rest = F.least(F.col("na") - F.col("lasta"), F.col("nb") - F.col("lastb")) - 1
    return counted.where(F.col("shared") + rest >= least).select("a", "b")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, blocks_: int = 4, rounds: int = 2, shard_bytes: int = 256 << 20) -> DataFrame:
    """Links of ``docs(doc_id, text)`` with den*|A∩B| >= num*|A∪B|, as components.

    Returns one row for each input row: doc_id, rid (its row key), n_shingles,
    component_id, component_size, and first, which is true for the row key of
    least doc_id in its component.
    """
    shards = shards_of(docs, "text", shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", row_key("doc_id", "text"))
    sent = rows.select("rid", "text").mapInArrow(_columns(n, shards), "shard int, rid long, n long, shared long, cls long, ids binary, counts binary, hashes binary")
    told = sent.repartitionById(shards, "shard").mapInArrow(_count_shared(shards), "home int, rids binary, counts binary")
    sizes = told.repartitionById(shards, "home").mapInArrow(_totals, "rid long, n long, shared long, rows long, cls long")
    sizes = checkpointed(sizes.select("rid", (F.col("n") / F.col("rows")).cast("long").alias("n"), (F.lit(den) * F.col("shared") >= F.lit(num) * F.col("n")).alias("may"), "cls"))

    one = sizes.where("may and n > 0").groupBy("cls").agg(F.min("rid").alias("rid"))
    some = rows.select("rid", "text").join(one, "rid").select("cls", "text")
    packs = checkpointed(some.mapInArrow(_packs(n), _PACKS))
    counted = packs.select("block", "cls", "sizes", "grams").mapInArrow(_send_columns(shards), "shard int, block long, hashes binary, counts binary")
    ranks = counted.repartitionById(shards, "shard").mapInArrow(_count_columns(shards), PACKED_DDL).repartitionById(shards, "home").mapInArrow(unpacked, ANSWERS_DDL)
    sets = packs.join(ranks.withColumnRenamed("rid", "block"), "block", "left").mapInArrow(_rare_first(shards, num, den), _SETS)
    sets = checkpointed(sets.dropDuplicates(["cls"]))
    reps = sets.select("cls", "n", "grams")
    cap = F.floor(F.lit(num + den) * (F.col("n") - F.col("single")) / F.lit(num)) - F.col("n")
    postings = sets.select("cls", "n", "middle", "single", cap.alias("cap"), F.posexplode("prefix").alias("pos", "h")).withColumn("pos", F.col("single") + F.col("pos")).drop("single")
    shared = postings.groupBy("h").count().where("count > 1").select("h")
    postings = checkpointed(postings.join(shared, "h"))

    labels, found = None, None
    for k in range(rounds):
        named = _divided(postings, labels)
        # groups of other sizes may have the column too, and their middle is no partner; bounds of size classes move by round
        named = named.withColumn("sizes", F.floor(F.log("n") / F.lit(SIZE_STEP) + F.lit(k / rounds)))
        lead = named.groupBy("h", "sizes").agg(F.max_by(F.struct("cls", "label"), F.struct("middle", "cls")).alias("lead")).select("h", "sizes", F.col("lead.cls").alias("a"), F.col("lead.label").alias("of"))
        votes = named.join(lead, ["h", "sizes"]).where("label <> of").groupBy(F.col("cls").alias("b"), "a").count()
        best = votes.groupBy("b").agg(F.max(F.struct("count", "a")).alias("x")).select("b", F.col("x.a").alias("a"))
        found = checkpointed(_verified(best, reps, num, den, blocks_, FEW if k else 0))
        if k and found.isEmpty():
            break
        labels = connected_components(found, labels)
    named = _divided(postings, labels)
    labels = connected_components(_verified(_leading(named, num, den), reps, num, den, blocks_, FEW), labels)

    out = rows.select("rid", "doc_id").join(sizes, "rid")
    grouped_ = out.where("n > 0 and may").select("cls", "doc_id", "rid").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", "rid", F.coalesce("label", "cls").alias("label"))
    grouped_ = grouped_.withColumn("ord", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    by_class = grouped_.groupBy("cls", "label").agg(F.min("doc_id").alias("least"), F.min(F.struct("ord", "rid")).alias("top"), F.count("*").alias("rows"))
    least = by_class.groupBy("label").agg(F.min("least").alias("least"), F.min("top").alias("top"), F.sum("rows").alias("component_size"))
    least = by_class.select("cls", "label").join(least, "label").select("cls", "least", F.col("top.rid").alias("top"), "component_size")
    out = out.withColumn("cls", F.when(F.col("may") & (F.col("n") > 0), F.col("cls"))).join(least, "cls", "left")
    first = F.coalesce(F.col("top") == F.col("rid"), F.lit(True)).alias("first")
    return out.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"), first)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of least doc_id; all columns stay."""
    rid, nth = fresh(docs, "rid"), fresh(docs, "nth")
    rows = docs.withColumn(rid, row_key("doc_id", "text"))
    first = ngram_components(docs, **options).where("first").select(F.col("rid").alias(rid)).distinct()
    place = F.row_number().over(Window.partitionBy(rid).orderBy(rid))
    return rows.join(first, rid, "left_semi").withColumn(nth, place).where(F.col(nth) == 1).drop(rid, nth)
