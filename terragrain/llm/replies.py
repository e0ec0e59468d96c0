"""Packed replies from shards to row keys.

A shard that has something to say about many rows would emit a record for
each pair of row and shard.  Replies instead travel packed, one record for
each pair of shard and home, a home being a slice of the row keys; a home
unpacks what all shards said and emits one record for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textnp import U64, binary_slices, grouped, mix

PACKED = pa.schema([("home", pa.int32()), ("shard", pa.int32()), ("rids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
PACKED_DDL = "home int, shard int, rids binary, sizes binary, data binary"
ANSWERS_DDL = "rid long, answers array<struct<shard:int,bits:binary>>"


def home_of(rids: np.ndarray, homes: int) -> np.ndarray:
    return (mix(rids.astype(np.int64).view(U64), 29) % U64(homes)).astype(np.int32)


def packed(shard: int, rids: np.ndarray, data: pa.Array, homes: int) -> Iterator[pa.RecordBatch]:
    """``data``, a binary for each of ``rids``, dealt to the homes of their rows."""
    home = home_of(rids, homes)
    order = np.argsort(home, kind="stable")
    data = pa.concat_arrays([data.take(pa.array(order))])
    offs = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], dtype=np.uint8) if data.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    cut = np.searchsorted(home[order], np.arange(homes + 1))
    to = np.flatnonzero(np.diff(cut))
    rows = [
        (int(k), shard, rids[order[cut[k] : cut[k + 1]]].astype(np.int64).tobytes(), np.diff(offs[cut[k] : cut[k + 1] + 1]).astype(np.uint32).tobytes(), raw[offs[cut[k]] : offs[cut[k + 1]]].tobytes())
        for k in to
    ]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each row key of a home: all that was said about it."""
    rids, shards, sizes, data = [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            rids.append(np.frombuffer(r["rids"], dtype=np.int64))
            sizes.append(np.frombuffer(r["sizes"], dtype=np.uint32).astype(np.int64))
            shards.append(np.full(len(rids[-1]), r["shard"], dtype=np.int32))
            data.append(np.frombuffer(r["data"], dtype=np.uint8))
    if not rids:
        return
    rid, bits = np.concatenate(rids), binary_slices(np.concatenate(data), grouped(np.concatenate(sizes)))
    order = np.argsort(rid, kind="stable")
    rid = rid[order]
    edge = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
    shard = np.concatenate(shards)[order]
    step = 5_000
    for x in range(0, len(edge), step):
        at = np.append(edge[x : x + step], edge[x + step] if x + step < len(edge) else len(rid))
        said = pa.StructArray.from_arrays([pa.array(shard[at[0] : at[-1]]), bits.take(pa.array(order[at[0] : at[-1]]))], ["shard", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array(rid[at[:-1]]), pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), said)], ["rid", "answers"])
