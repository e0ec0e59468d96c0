"""Vector layers laid out along a space-filling curve, so that a window reads the files it needs.

Features are range-partitioned by the Z-order of their boxes' middles, and
each range is a folder.  An index has the box of every folder.  A window is
first held against the index; the scan is joined with what is left of it on
the folder's number, so Spark prunes the other folders before it opens them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each coordinate in the curve's key.
BITS = 16
BOX = ["x0", "x1", "y0", "y1"]


def _spread(v: Column) -> Column:
    """Bits of a number of 16 bits, with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(x: Column, y: Column) -> Column:
    """The place on the curve of two whole numbers of ``BITS`` bits."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def write_layer(features: DataFrame, path: str, parts: int = 64) -> None:
    """``features(.., x0, x1, y0, y1)`` in about ``parts`` folders along the curve, and their index."""
    box = features.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).first()
    unit = lambda low, high, a, b: F.lit(0) if box[low] is None or box[high] <= box[low] else F.floor(((F.col(a) + F.col(b)) / 2 - box[low]) / (box[high] - box[low]) * ((1 << BITS) - 1))
    key = F.coalesce(z_order(unit("x0", "x1", "x0", "x1"), unit("y0", "y1", "y0", "y1")), F.lit(0).cast("long"))
    laid = features.withColumn("__z", key).repartitionByRange(parts, "__z").withColumn("part", F.spark_partition_id()).drop("__z")
    laid.write.partitionBy("part").parquet(f"{path}/features")
    whole = features.sparkSession.read.schema(laid.schema).parquet(f"{path}/features")
    whole.groupBy("part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count("*").alias("n")).write.parquet(f"{path}/index")


def window_parts(spark: SparkSession, path: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """(part): the folders whose box meets a window."""
    index = spark.read.parquet(f"{path}/index")
    return index.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)).select("part")


def read_window(spark: SparkSession, path: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Features whose box meets a window, from the folders that can have them; features without a box meet none."""
    near = spark.read.parquet(f"{path}/features").join(F.broadcast(window_parts(spark, path, x0, x1, y0, y1)), "part", "left_semi")  # a row a folder
    return near.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)).drop("part")
