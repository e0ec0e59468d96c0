"""Elevation-driven road deformation, and line pieces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stencils import bilinear


def segment_samples(segments: DataFrame, dem_res: float, k: float) -> DataFrame:
    """``segments(seg_id, x0, y0, x1, y1)`` → (seg_id, i, n, x, y, dist, angle): n + 1 points, n = ceil(dist*k/res)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = segments.withColumn("dist", F.hypot(dx, dy)).withColumn("angle", F.atan2(dy, dx)).withColumn("n", F.ceil(F.col("dist") * k / dem_res).cast("int")).where("n > 0")
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("i") / F.col("n")
    return s.select("seg_id", "i", "n", (F.col("x0") + t * dx).alias("x"), (F.col("y0") + t * dy).alias("y"), "dist", "angle")


def slope_ratio(samples: DataFrame, light: float, shift: float) -> DataFrame:
    """(seg_id, i, nbr): relief displacement across the road between samples, relative to their spacing."""
    order = Window.partitionBy("seg_id").orderBy("i")
    nbr = F.abs((F.lead("elev").over(order) - F.col("elev")) * shift * F.sin(F.col("angle") - light) / F.col("dist") * F.col("n"))
    return samples.withColumn("nbr", nbr).where("nbr is not null")


def long_runs(rows: DataFrame, flag, at_least: int, keys: str = "seg_id") -> DataFrame:
    """Flagged rows of runs of ``at_least`` consecutive i, with the run's first i and length."""
    order = Window.partitionBy(keys).orderBy("i")
    isle = rows.where(flag).withColumn("isle", F.col("i") - F.row_number().over(order))
    run = Window.partitionBy(keys, "isle")
    return isle.withColumn("run_start", F.min("i").over(run)).withColumn("run_length", F.count("*").over(run)).where(F.col("run_length") >= at_least).drop("isle")


def light_angle(dx: float, dy: float) -> tuple[float, float]:
    """Horizontal angle and length of the image shift for one metre of height."""
    return math.atan2(dy, dx), math.hypot(dx, dy)


def deformation(segments: DataFrame, dem: DataFrame, light: float, shift: float, threshold: float, at_least: int, dem_res: float = 1.0, k: float = 1.0) -> DataFrame:
    """Points of segments whose displacement ratio exceeds ``threshold`` in runs of ``at_least``.

    Only DEM cells around a sample are touched: the join is by cell.
    """
    s = segment_samples(segments, dem_res, k).withColumn("id", F.struct("seg_id", "i"))
    z = bilinear(s.select("id", "x", "y"), dem, "elev").select("id", F.col("v").alias("elev")).where("elev > 0")
    return long_runs(slope_ratio(s.join(z, "id"), light, shift), F.col("nbr") > threshold, at_least).select("seg_id", "i", "x", "y", "nbr")


def join_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces(line_id, k, start, stop)`` in ring order → (line_id, k, group): joined end to start.

    A new group begins where a start is not the end before it.  If the ring
    has a break, the pieces ahead of the first one belong to the last group.
    """
    order = Window.partitionBy("line_id").orderBy("k")
    broken = F.when(F.lag("stop").over(order).isNull(), 0).when(F.lag("stop").over(order) == F.col("start"), 0).otherwise(1)
    g = pieces.withColumn("b", broken).withColumn("group", F.sum("b").over(order)).drop("b")
    whole = Window.partitionBy("line_id")
    ring = F.max(F.when(F.col("k") == F.col("last"), F.col("stop"))).over(whole) == F.min(F.when(F.col("k") == 0, F.col("start"))).over(whole)
    g = g.withColumn("last", F.max("k").over(whole)).withColumn("closed", ring).withColumn("top", F.max("group").over(whole))
    return g.select("line_id", "k", F.when(F.col("closed") & (F.col("group") == 0), F.col("top")).otherwise(F.col("group")).alias("group"))
