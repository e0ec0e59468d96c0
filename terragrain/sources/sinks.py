"""Results as files of any store that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wkb import point_to_wkb, polygon_to_wkb
from ..operators.mosaic import blended
from ..operators.polygons import polygons
from ..operators.stencils import pyramid


def write_rasters(px: DataFrame, path: str, bands: list[str], levels: int = 0) -> None:
    """``px(raster_id, row_i, col_i, bands)`` with its overviews, one folder for each raster and level."""
    full = px.select("raster_id", "row_i", "col_i", *bands, F.lit(0).alias("level"))
    out = full.unionByName(pyramid(px.select("raster_id", "row_i", "col_i", *bands), levels)) if levels else full
    out.write.partitionBy("raster_id", "level").parquet(path)


def write_sharpened(px: DataFrame, path: str, bands: list[str], geotransform: tuple[float, ...] | None = None, rpc: dict[str, str] | None = None) -> None:
    """Sharpened pixels, and beside them where they lie: camera model or geotransform of the fine image."""
    spark = px.sparkSession
    px.select("row_i", "col_i", *bands).write.parquet(f"{path}/pixels")
    kind, value = ("rpc", json.dumps(rpc)) if rpc is not None else ("geotransform", json.dumps(geotransform))
    spark.createDataFrame([(kind, value)], "kind string, value string").write.parquet(f"{path}/place")


def read_sharpened(spark: SparkSession, path: str) -> tuple[DataFrame, dict | tuple | None]:
    row = spark.read.parquet(f"{path}/place").first()
    value = json.loads(row["value"])
    return spark.read.parquet(f"{path}/pixels"), tuple(value) if isinstance(value, list) else value


def write_mosaic(mosaic: DataFrame, rasters: DataFrame, path: str, bands: list[str], step: int = 1, blend: int = 0, compression: str = "zstd", levels: int = 0) -> None:
    """The mosaic raster of an ownership table, with overviews."""
    out = blended(mosaic, rasters, bands, blend, step).withColumn("raster_id", F.lit(0))
    full = out.select("raster_id", "row_i", "col_i", "owner", *bands, F.lit(0).alias("level"))
    if levels:
        full = full.unionByName(pyramid(out.select("raster_id", "row_i", "col_i", "owner", *bands), levels))
    full.drop("raster_id").write.option("compression", compression).partitionBy("level").parquet(path)


def write_borders(cells: DataFrame, names: DataFrame, path: str) -> None:
    """Borders of ``cells(geom_id, ..)`` as polygons with the names of ``names(geom_id, name)``."""
    shapes = polygons(cells).join(names, "geom_id")
    shapes.select("geom_id", "name", polygon_to_wkb("rings").alias("geom")).write.parquet(path)


def write_points(points: DataFrame, path: str, value: str = "nbr") -> None:
    """``points(x, y, value, ..)`` as WKB points with one real field."""
    rest = [c for c in points.columns if c not in ("x", "y", value)]
    points.select(*rest, point_to_wkb("x", "y").alias("geom"), F.col(value).cast("double").alias(value)).write.parquet(path)
