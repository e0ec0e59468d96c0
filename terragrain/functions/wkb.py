"""Well-known binary of polygons, as columns of rings of (x, y)."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

RINGS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))


def encode_polygon(rings) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out += [struct.pack("<dd", p["x"], p["y"]) for p in ring]
    return b"".join(out)


def decode_polygon(wkb: bytes) -> list[list[dict]]:
    order = "<" if wkb[0] == 1 else ">"
    kind, n = struct.unpack_from(order + "II", wkb, 1)
    if kind != 3:
        raise ValueError(f"geometry type {kind} is no polygon")
    at, rings = 9, []
    for _ in range(n):
        (m,) = struct.unpack_from(order + "I", wkb, at)
        xy = struct.unpack_from(f"{order}{2 * m}d", wkb, at + 4)
        rings.append([{"x": x, "y": y} for x, y in zip(xy[::2], xy[1::2], strict=True)])
        at += 4 + 16 * m
    return rings


# Rings of one polygon differ in length, which pandas and NumPy arrays have no shape for, so they stay Arrow lists.
@F.arrow_udf(BinaryType())
def polygon_to_wkb(rings: pa.Array) -> pa.Array:
    return pa.array([None if r is None else encode_polygon(r) for r in rings.to_pylist()], pa.binary())


@F.arrow_udf(RINGS)
def polygon_from_wkb(wkb: pa.Array) -> pa.Array:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return pa.array([None if b is None else decode_polygon(b) for b in wkb.to_pylist()], kind)


@F.pandas_udf(BinaryType())
def point_to_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


@F.pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def point_from_wkb(wkb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([struct.unpack(("<" if b[0] == 1 else ">") + "dd", b[5:21]) for b in wkb], columns=["x", "y"])
