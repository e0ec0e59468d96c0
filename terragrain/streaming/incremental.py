"""Incremental operators over arriving files, with state tables.

Each micro-batch reads the state of the batch before, writes a new version
beside it, and only then counts as done; a batch that runs again after a
failure overwrites its own version with the same rows.  A mosaic is kept by
tile: a batch reads and writes the tiles that it touches, and what was seen is
only added to, so a batch costs what it brings, not what there is.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wkb import polygon_from_wkb, polygon_to_wkb
from ..operators.polygons import polygons, rasterized
from ..operators.stretch import histogram
from ..plans.lineage import cut, shared_folder


class StateTable:
    """Versions of a table under a folder; version -1 is empty."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}")

    def write(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


class TileState:
    """Cells ``(row_i, col_i, ..)`` in versions by tile: a version holds the tiles that changed with it, whole.

    Below ``folder``, ``rows`` has them by version and tile, ``tiles`` what
    each version wrote.  A tile's state at a version is its newest one up to
    that; other files are pruned by their folder's names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, side: int = 64):
        self.spark, self.folder, self.schema, self.side = spark, folder, schema, side

    def tile(self):
        place = lambda c: F.floor(F.col(c) / self.side).cast("string")
        return F.concat_ws("_", place("row_i"), place("col_i"))

    def newest(self, version: int) -> DataFrame:
        """(tile, version) of every tile there is at a version."""
        return self.spark.read.schema("tile string, version long").parquet(f"{self.folder}/tiles/*").where(F.col("version") <= version).groupBy("tile").agg(F.max("version").alias("version"))

    def read(self, version: int, tiles: DataFrame | None = None) -> DataFrame:
        """The state at a version, or its part in ``tiles(tile)``."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        wanted = self.newest(version)
        if tiles is not None:
            wanted = wanted.join(tiles, "tile", "left_semi")
        rows = self.spark.read.schema(f"{self.schema}, version long, tile string").parquet(f"{self.folder}/rows")
        return rows.join(wanted, ["tile", "version"], "left_semi").drop("tile", "version")

    def write(self, version: int, rows: DataFrame) -> None:
        """``rows``, all cells of the tiles that they are in, as the version's."""
        named = rows.withColumn("tile", self.tile())
        named.repartition("tile").write.partitionBy("tile").mode("overwrite").parquet(f"{self.folder}/rows/version={version}")
        done = self.spark.read.schema(f"{self.schema}, version long, tile string").parquet(f"{self.folder}/rows").where(F.col("version") == version)
        done.select("tile", "version").distinct().write.mode("overwrite").parquet(f"{self.folder}/tiles/{version}")


class Seen:
    """Keys that were processed: each version adds its own."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def before(self, version: int) -> DataFrame:
        if version <= 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, version long").parquet(self.folder)
        return rows.where(F.col("version") < version).drop("version")

    def add(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={version}")


def _stream(spark: SparkSession, folder: str, schema, each) -> None:
    """Process what has arrived, one file a batch, from where the last run stopped."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    source.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def streamed_histogram(px: DataFrame, bands: list[str], files: int) -> DataFrame:
    """(band, dn, cnt) of pixels that arrive in ``files`` parts."""
    spark, folder = px.sparkSession, f"{shared_folder(px.sparkSession)}/{uuid.uuid4().hex}"
    for k in range(files):
        px.where(F.col("row_i") % files == k).coalesce(1).write.parquet(f"{folder}/in/{k}")
    state = StateTable(spark, f"{folder}/state", "band string, dn long, cnt long")
    done = []

    def each(batch: DataFrame, version: int) -> None:
        added = histogram(batch, bands).unionByName(state.read(version - 1))
        state.write(version, added.groupBy("band", "dn").agg(F.sum("cnt").alias("cnt")))
        done.append(version)

    _stream(spark, folder, px.schema, each)
    return state.read(max(done, default=-1))


def export_mosaic(mosaic: DataFrame, path: str) -> None:
    """``mosaic(row_i, col_i, owner)`` as one polygon for each owner, in WKB."""
    shapes = polygons(mosaic, "owner")
    shapes.select("owner", polygon_to_wkb("rings").alias("geom")).write.mode("overwrite").parquet(path)


def restored_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """The ownership table of exported polygons, to be carried on from."""
    shapes = spark.read.parquet(path).select("owner", polygon_from_wkb("geom").alias("rings"))
    return rasterized(shapes, "owner").select("row_i", "col_i", "owner")


def dividers(rows: DataFrame, column: str, shares: list[float], most: int = 1 << 16) -> list[int]:
    """For each share the least value of a long column that at least so many of the rows do not exceed.

    Exact: rows are counted in ever narrower ranges, at most ``most`` counts of which reach the driver at a time.
    """
    sized = cut(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")))
    whole = sized.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n")).first()
    if whole["n"] is None:
        return []
    out = []
    for share in shares:
        low, high, left = whole["low"], whole["high"], max(1, math.ceil(share * whole["n"]))
        while low < high:
            width = -(-(high - low + 1) // most)
            counts = sized.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / width).cast("long").alias("k")).agg(F.sum("n").alias("n")).collect()
            for r in sorted(counts):
                if left <= r["n"]:
                    low, high = low + r["k"] * width, min(high, low + (r["k"] + 1) * width - 1)
                    break
                left -= r["n"]
        out.append(low)
    return out


def streamed_mosaic(cells: DataFrame, batches: int, twice: bool = False, restart: bool = False, snapshot: int = 0, exports: list[str] | None = None, tile: int = 64) -> DataFrame:
    """(row_i, col_i, owner): polygons added in order of id, the later takes its region.

    ``twice`` delivers every part again, ``restart`` ends the stream after
    each part, ``snapshot`` exports every so many batches as polygons;
    the paths of exports are added to ``exports``.  What arrives is a note
    that names a part; the batch reads the part's files, however many there are.
    """
    spark, folder = cells.sparkSession, f"{shared_folder(cells.sparkSession)}/{uuid.uuid4().hex}"
    cells = cut(cells)
    cuts = dividers(cells, "geom_id", [k / batches for k in range(1, batches)])
    part = sum((F.col("geom_id") > c).cast("int") for c in cuts) if cuts else F.lit(0)
    mosaic = TileState(spark, f"{folder}/mosaic", "row_i long, col_i long, owner long", tile)
    seen = Seen(spark, f"{folder}/seen", "owner long")
    done = []

    cells.withColumn("part", part).write.partitionBy("part").parquet(f"{folder}/parts")
    delivered = spark.read.schema("row_i long, col_i long, geom_id long, part int").parquet(f"{folder}/parts")

    def each(batch: DataFrame, version: int) -> None:
        named = [r["part"] for r in batch.collect()]  # one row a note
        arrived = delivered.where(F.col("part").isin(named))
        fresh = arrived.select("row_i", "col_i", F.col("geom_id").alias("owner")).join(seen.before(version), "owner", "left_anti")
        own = cut(fresh.groupBy("row_i", "col_i").agg(F.max("owner").alias("owner")))
        touched = own.select(mosaic.tile().alias("tile")).distinct()
        old = mosaic.read(version - 1, touched).join(own, ["row_i", "col_i"], "left_anti")
        mosaic.write(version, old.select("row_i", "col_i", "owner").union(own))
        seen.add(version, fresh.select("owner").distinct())
        if snapshot and version % snapshot == 0:
            export_mosaic(mosaic.read(version), f"{folder}/export/{version}")
            if exports is not None:
                exports.append(f"{folder}/export/{version}")
        done.append(version)

    for k in range(batches):
        for again in range(2 if twice else 1):
            spark.createDataFrame([(k,)], "part int").coalesce(1).write.parquet(f"{folder}/in/{k}-{again}")
        if restart:
            _stream(spark, folder, "part int", each)
    _stream(spark, folder, "part int", each)
    return mosaic.read(max(done, default=-1))


def streamed_windows(spark: SparkSession, path: str, schema, width: str, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n): events of each window of ``width``, counted by a stream over the files of ``path``.

    State is kept by Spark, with a watermark of ``late`` behind the newest
    event; each batch writes the whole result as a new version.
    """
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    counted = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = counted.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    counted = counted.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n")
    state = StateTable(spark, f"{folder}/state", "hour long, event_type string, n long")
    done = []

    def each(batch: DataFrame, version: int) -> None:
        state.write(version, batch)
        done.append(version)

    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return state.read(max(done, default=-1))
