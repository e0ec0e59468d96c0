"""Rasters on other grids and in other projections, by inverse mapping.

For each pixel of the output grid the place in the source is wanted: through
the output's geotransform and projection to degrees, and through the source's
to its pixels.  That is evaluated on a coarse mesh and interpolated inside a
mesh cell.  A cell is also evaluated at its middle and on its sides, and
``SAFETY`` times the greatest difference there bounds the cell's error.  A
pixel whose nearest source pixel the bound leaves open is evaluated itself,
so nearest neighbours are those of the exact mapping.  The mesh is a table
joined by cell; sources are equi-joined by pixel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import from_utm, to_utm
from ..plans.lineage import cut
from .cells import CELL
from .stencils import affine, inverse_affine

SAFETY = 4.0
#: Mesh cells up to which the mesh is broadcast.
FEW_CELLS = 200_000


@dataclass(frozen=True)
class Grid:
    """A geotransform, and the zone of a UTM grid, negative in the south; degrees if None."""

    geotransform: tuple[float, ...]
    zone: int | None = None

    def to_degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (x, y) if self.zone is None else from_utm(x, y, F.lit(abs(self.zone)), F.lit(self.zone < 0))

    def of_degrees(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return (lon, lat) if self.zone is None else to_utm(lon, lat, F.lit(abs(self.zone)), F.lit(self.zone < 0))


Mapping = Callable[[Column, Column], tuple[Column, Column]]


def inverse_mapping(out: Grid, source: Grid) -> Mapping:
    """(row, col) of the output as (row, col) of the source, whole numbers at pixel centres."""

    def at(row: Column, col: Column) -> tuple[Column, Column]:
        x, y = affine(out.geotransform, col + 0.5, row + 0.5)
        if out.zone != source.zone:
            x, y = source.of_degrees(*out.to_degrees(x, y))
        c, r = affine(inverse_affine(source.geotransform), x, y)
        return r - 0.5, c - 0.5

    return at


def output_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row_i"), (F.col("id") % cols).alias("col_i"))


def mesh(cells: DataFrame, mapping: Mapping, side: int) -> DataFrame:
    """(mr, mc, r00..c11, bound): source places of each mesh cell's corners, and how far an interpolated place may be off."""
    top, left = F.col("mr") * float(side), F.col("mc") * float(side)
    names = [(a, b) for a in (0, 1) for b in (0, 1)]
    corners = [x for a, b in names for x, k in zip(mapping(top + a * side, left + b * side), "rc", strict=True) for x in [x.alias(f"{k}{a}{b}")]]
    checks = [(0.5, 0.5), (0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)]
    exact = [x for k, (v, u) in enumerate(checks) for x, n in zip(mapping(top + v * side, left + u * side), "rc", strict=True) for x in [x.alias(f"x{n}{k}")]]
    found = cells.select("mr", "mc", *corners, *exact)
    off = [F.abs(F.col(f"x{n}{k}") - _between(n, F.lit(v), F.lit(u))) for k, (v, u) in enumerate(checks) for n in "rc"]
    return cut(found.select("mr", "mc", *[f"{n}{a}{b}" for n in "rc" for a, b in names], (F.greatest(*off) * SAFETY + 1e-9).alias("bound")))


def _between(name: str, v: Column, u: Column) -> Column:
    c = lambda a, b: F.col(f"{name}{a}{b}")
    return (c(0, 0) * (1 - u) + c(0, 1) * u) * (1 - v) + (c(1, 0) * (1 - u) + c(1, 1) * u) * v


def placed(grid: DataFrame, mapping: Mapping, side: int = 16) -> DataFrame:
    """``grid(row_i, col_i)`` with the source's r and c, and bound, by how much these may be off."""
    cell = grid.select("*", F.floor(F.col("row_i") / side).cast("long").alias("mr"), F.floor(F.col("col_i") / side).cast("long").alias("mc"))
    points = mesh(cell.select("mr", "mc").distinct(), mapping, side)
    points = F.broadcast(points) if points.limit(FEW_CELLS + 1).count() <= FEW_CELLS else points
    v, u = F.col("row_i") / float(side) - F.col("mr"), F.col("col_i") / float(side) - F.col("mc")
    return cell.join(points, ["mr", "mc"]).select(*grid.columns, _between("r", v, u).alias("r"), _between("c", v, u).alias("c"), "bound")


def nearest_pixels(grid: DataFrame, mapping: Mapping, side: int = 16) -> DataFrame:
    """``grid`` with (src_row, src_col), the source pixel that holds each output pixel's centre, as the exact mapping has it."""
    some = cut(placed(grid, mapping, side))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long")
    part = lambda c: F.col(c) + 0.5 - F.floor(F.col(c) + 0.5)
    sure = F.lit(True)
    for c in "rc":
        sure = sure & (part(c) > F.col("bound")) & (part(c) < 1 - F.col("bound"))
    names = list(grid.columns)
    clear = some.where(sure).select(*names, whole("r").alias("src_row"), whole("c").alias("src_col"))
    r, c = mapping(F.col("row_i").cast("double"), F.col("col_i").cast("double"))
    near = some.where(~sure).select(*names, r.alias("r"), c.alias("c")).select(*names, whole("r").alias("src_row"), whole("c").alias("src_col"))
    return clear.union(near)


def warped(px: DataFrame, source: Grid, out: Grid, grid: DataFrame, bands: list[str], side: int = 16) -> DataFrame:
    """(row_i, col_i, bands) of ``px`` on the output grid by nearest neighbour; nodata and places outside have no row."""
    at = nearest_pixels(grid.select(*CELL), inverse_mapping(out, source), side)
    image = px.where(F.col(bands[0]) > 0).select(F.col("row_i").alias("src_row"), F.col("col_i").alias("src_col"), *bands)
    return at.join(image, ["src_row", "src_col"]).select(*CELL, *bands)


def warped_bilinear(px: DataFrame, source: Grid, out: Grid, grid: DataFrame, band: str, side: int = 16) -> DataFrame:
    """(row_i, col_i, v) of a band by bilinear interpolation over valid neighbours, at places within the mesh's bound."""
    from .stencils import bilinear

    at = placed(grid.select(*CELL), inverse_mapping(out, source), side)
    points = at.select(F.struct(*CELL).alias("id"), F.col("c").alias("x"), F.col("r").alias("y"))
    return bilinear(points, px, band).select("id.row_i", "id.col_i", "v")


def warped_overlay(sources: list[tuple[DataFrame, Grid]], out: Grid, grid: DataFrame, bands: list[str], side: int = 16) -> DataFrame:
    """(row_i, col_i, source, bands): rasters warped into one grid; where several are valid the later of the list is taken."""
    every = None
    for k, (px, place) in enumerate(sources):
        one = warped(px, place, out, grid, bands, side).withColumn("source", F.lit(k + 1))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*CELL).agg(F.max("source").alias("source"), *[F.max_by(b, "source").alias(b) for b in bands])
