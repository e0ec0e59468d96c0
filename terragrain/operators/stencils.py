"""Neighbourhoods, resampling and pyramids of pixel tables.

A stencil deals pixels to square tiles, those near an edge to the tiles
beside it too, and each tile is one vectorised kernel of bounded size; other
neighbours are equi-joins on shifted keys.  Nothing compares all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lightness(r: Column, g: Column, b: Column) -> Column:
    """CIE L* of 8-bit sRGB."""
    lin = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    y = 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)
    return F.when(y > 216 / 24389, 116 * F.cbrt(y) - 16).otherwise(y * 24389 / 27)


def block_of(px: DataFrame, size: int) -> DataFrame:
    """Tile keys: tile_row, tile_col of a grid of ``size`` by ``size`` pixels."""
    return px.withColumn("tile_row", F.floor(F.col("row_i") / size)).withColumn("tile_col", F.floor(F.col("col_i") / size))


def block_grid(rows: DataFrame, size: int) -> DataFrame:
    """(bi, bj, x0, y0, w, h): blocks of images (n_rows, n_cols), short at the edges."""
    last = lambda n: F.greatest(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int"))
    b = rows.select("n_rows", "n_cols", F.explode(F.sequence(F.lit(0), last("n_rows"))).alias("bi")).select("*", F.explode(F.sequence(F.lit(0), last("n_cols"))).alias("bj"))
    return b.select("bi", "bj", (F.col("bj") * size).alias("x0"), (F.col("bi") * size).alias("y0"), F.least(F.lit(size), F.col("n_cols") - F.col("bj") * size).alias("w"), F.least(F.lit(size), F.col("n_rows") - F.col("bi") * size).alias("h"))


def pyramid(px: DataFrame, levels: int) -> DataFrame:
    """Levels 1..n by nearest neighbour: every 2^k-th row and column, renumbered."""
    ks = px.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    step = F.expr("cast(shiftleft(1, level) as bigint)")
    kept = ks.withColumn("step", step).where((F.col("row_i") % F.col("step") == 0) & (F.col("col_i") % F.col("step") == 0))
    return kept.withColumn("row_i", F.floor(F.col("row_i") / F.col("step"))).withColumn("col_i", F.floor(F.col("col_i") / F.col("step"))).drop("step")


def overview_level(out_res: float, src_res: float, levels: int) -> int:
    """The overview that a coarser output reads, or -1 for the full image."""
    import math

    return -1 if out_res <= src_res or not levels else min(int(math.floor(math.log2(out_res / src_res))), levels) - 1


def neighbours4(px: DataFrame, value: str) -> DataFrame:
    """(src, dst): pixels with value > 0 and their valid right and lower neighbours."""
    ok = px.where(F.col(value) > 0).select("pid", "row_i", "col_i")
    right = ok.select(F.col("pid").alias("dst"), "row_i", (F.col("col_i") - 1).alias("col_i"))
    below = ok.select(F.col("pid").alias("dst"), (F.col("row_i") - 1).alias("row_i"), "col_i")
    return ok.join(right.union(below), ["row_i", "col_i"]).select(F.col("pid").alias("src"), "dst")


#: Kernels of 3 x 4 and 4 x 3 weights; the anchor is the second row and column.
GRADIENT_X = [(r - 1, c - 1, (-1 if c < 2 else 1)) for r in range(3) for c in range(4)]
GRADIENT_Y = [(r - 1, c - 1, (-1 if r < 2 else 1)) for r in range(4) for c in range(3)]


def stencil(px: DataFrame, value: str, kernel: list[tuple[int, int, int]], tile: int = 256) -> DataFrame:
    """(row_i, col_i, g, n): absolute weighted sum of neighbours, and how many are valid.

    Rows are shuffled once, by tile; a tile takes the pixels of its kernel's
    reach around it.
    """
    r0, r1 = min(r for r, *_ in kernel), max(r for r, *_ in kernel)
    c0, c1 = min(c for _, c, _ in kernel), max(c for _, c, _ in kernel)
    tiles = lambda x, low, high: F.sequence(F.floor((F.col(x) - high) / tile), F.floor((F.col(x) - low) / tile))
    dealt = px.select("row_i", "col_i", F.col(value).cast("double").alias("v"), F.explode(tiles("row_i", r0, r1)).alias("tr")).select("*", F.explode(tiles("col_i", c0, c1)).alias("tc"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]) * tile, int(pdf.tc.iloc[0]) * tile
        row, col, v = (pdf[c].to_numpy() for c in ("row_i", "col_i", "v"))
        grid = np.zeros((tile + r1 - r0, tile + c1 - c0))
        grid[row - tr - r0, col - tc - c0] = v
        total, valid = np.zeros((tile, tile)), np.zeros((tile, tile), dtype=np.int64)
        for dr, dc, w in kernel:
            near = grid[dr - r0 : dr - r0 + tile, dc - c0 : dc - c0 + tile]
            total += w * near
            valid += near > 0
        own = (row >= tr) & (row < tr + tile) & (col >= tc) & (col < tc + tile)
        at = row[own] - tr, col[own] - tc
        return pd.DataFrame({"row_i": row[own], "col_i": col[own], "g": np.abs(total[at]), "n": valid[at]})

    out = dealt.groupBy("tr", "tc").applyInPandas(one, "row_i long, col_i long, g double, n long")
    kind = px.schema[value].dataType
    return out if kind.typeName() == "double" else out.withColumn("g", F.col("g").cast(kind))


def bilinear(points: DataFrame, px: DataFrame, value: str) -> DataFrame:
    """``points(id, x, y)`` sampled at pixel coordinates; nodata neighbours have no weight.

    Returns (id, v): the weighted mean of valid neighbours, 0 where none is.
    """
    corner = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    p = points.withColumn("r0", F.floor("y")).withColumn("c0", F.floor("x")).withColumn("k", F.explode(corner))
    fy, fx = F.col("y") - F.col("r0"), F.col("x") - F.col("c0")
    w = F.when(F.col("k.r") == 1, fy).otherwise(1 - fy) * F.when(F.col("k.c") == 1, fx).otherwise(1 - fx)
    p = p.select("id", (F.col("r0") + F.col("k.r")).alias("row_i"), (F.col("c0") + F.col("k.c")).alias("col_i"), w.alias("w"))
    hit = p.join(px.where(F.col(value) > 0).select("row_i", "col_i", F.col(value).alias("v")), ["row_i", "col_i"], "left")
    ok = F.when(F.col("v").isNotNull(), F.col("w"))
    return hit.groupBy("id").agg(F.when(F.sum(ok) > 0, F.sum(ok * F.col("v")) / F.sum(ok)).otherwise(F.lit(0.0)).alias("v"))


def affine(gt: tuple[float, ...], col: Column, row: Column) -> tuple[Column, Column]:
    """Object coordinates of a pixel by a six-number geotransform."""
    return gt[0] + gt[1] * col + gt[2] * row, gt[3] + gt[4] * col + gt[5] * row


def pixel_centre(x: Column, x0: float, dx: float) -> Column:
    """Pixel coordinate of an object coordinate, whole numbers at pixel centres."""
    return (x - x0) / dx - 0.5


def inverse_affine(gt: tuple[float, ...]) -> tuple[float, ...]:
    det = gt[1] * gt[5] - gt[2] * gt[4]
    a, b, c, d = gt[5] / det, -gt[2] / det, -gt[4] / det, gt[1] / det
    return (-a * gt[0] - b * gt[3], a, b, -c * gt[0] - d * gt[3], c, d)


def compose_affine(f: tuple[float, ...], g: tuple[float, ...]) -> tuple[float, ...]:
    """f after g."""
    x = lambda k, gx, gy: f[k] * gx + f[k + 1] * gy
    return (f[0] + x(1, g[0], g[3]), x(1, g[1], g[4]), x(1, g[2], g[5]), f[3] + x(4, g[0], g[3]), x(4, g[1], g[4]), x(4, g[2], g[5]))


def resample(px: DataFrame, value: str, grid: DataFrame, to_source: tuple[float, ...]) -> DataFrame:
    """A raster on another grid: ``grid(id, row_i, col_i)`` mapped to source pixel centres."""
    x, y = affine(to_source, F.col("col_i") + 0.5, F.col("row_i") + 0.5)
    return bilinear(grid.select("id", (x - 0.5).alias("x"), (y - 0.5).alias("y")), px, value)
