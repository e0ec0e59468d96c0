"""Geographic coordinates to UTM and back, in column arithmetic.

The transverse Mercator series of Krüger in the third flattening, to its
third power: within a millimetre inside a zone.  No projection library is
needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 and the UTM grid.
RADIUS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def _meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees in a zone; ``south`` takes the southern false northing."""
    phi = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(phi) - _E * F.atanh(_E * phi))
    off = F.radians(lon) - _meridian(zone)
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    base = F.when(south, F.lit(SOUTH)).otherwise(F.lit(0.0)) if south is not None else F.lit(0.0)
    return EAST + SCALE * _A * east, base + SCALE * _A * north


def from_utm(east: Column, north: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    base = F.when(south, F.lit(SOUTH)).otherwise(F.lit(0.0)) if south is not None else F.lit(0.0)
    xi, eta = (north - base) / (SCALE * _A), (east - EAST) / (SCALE * _A)
    x, y = xi, eta
    for k, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return F.degrees(_meridian(zone) + F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def suggested_grid(corners: DataFrame, rows: int, cols: int) -> DataFrame:
    """(x0, y0, size, out_rows, out_cols): a north-up grid over reprojected ``corners(x, y)`` that keeps the length of the image's diagonal in pixels."""
    box = corners.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y1"), F.max("y").alias("y0"))
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y0") - F.col("y1")) / math.hypot(rows, cols)
    box = box.withColumn("size", size)
    whole = lambda a, b: F.ceil(F.round((F.col(a) - F.col(b)) / F.col("size"), 6)).cast("long")
    return box.select("x0", "y0", "size", whole("y0", "y1").alias("out_rows"), whole("x1", "x0").alias("out_cols"))
