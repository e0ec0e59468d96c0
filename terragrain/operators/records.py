"""Names, dates, ordering and look-ups of image records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..plans.lineage import cut

#: Eight digits of a year 20xx.
DATE = r"20[0-9]{6}"

#: File extension to driver name.
RASTER_DRIVERS = {"tif": "GTiff", "tiff": "GTiff", "TIF": "GTiff", "TIFF": "GTiff", "img": "HFA"}
VECTOR_DRIVERS = {"shp": "ESRI Shapefile"}
COMPRESSIONS = ("", "LZW", "DEFLATE", "PACKBITS")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def date_of(path: Column) -> Column:
    """The first YYYYMMDD in a name that the calendar has, as a number, 0 if there is none."""
    known = F.filter(F.regexp_extract_all(path, F.lit(f"(?=({DATE}))"), F.lit(1)), lambda d: F.try_to_date(d, "yyyyMMdd").isNotNull())
    return F.coalesce(F.get(known, F.lit(0)).cast("int"), F.lit(0))


def raster_driver(path: Column) -> Column:
    """Driver by extension; an empty path is in memory; null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in RASTER_DRIVERS.items() for x in kv])
    return F.when(path == "", F.lit("MEM")).otherwise(F.element_at(known, extension(path)))


def vector_driver(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in VECTOR_DRIVERS.items() for x in kv])
    return F.when(path == "", F.lit("Memory")).otherwise(F.element_at(known, extension(path)))


def with_rasters(files: DataFrame, pattern: str = r"^(tif|tiff|TIF|TIFF|img)$") -> DataFrame:
    return files.where(extension(F.col("path")).rlike(pattern))


def sidecars(files: DataFrame, suffix: str = "_mask") -> DataFrame:
    """(path, sidecar): each file with the file of its stem plus suffix, null if there is none."""
    other = files.select(F.col("path").alias("sidecar"), stem(F.col("path")).alias("__stem"))
    return files.withColumn("__stem", F.concat(stem(F.col("path")), F.lit(suffix))).join(other, "__stem", "left").select("path", "sidecar")


#: Fixed value: resolutions whose gap is less than this share of the coarser one count as near.
NEAR = 0.1


def preferred(a, b) -> int:
    """Order of two images (path, reso, date): the newer of near resolutions, else the finer.

    The rule is no strict order over three images; lists are sorted by
    insertion from path order, so a cycle is resolved the same way each time.
    """
    near = abs(a.reso - b.reso) / max(a.reso, b.reso) < NEAR
    if a.date and b.date and a.date != b.date and near:
        return -1 if a.date > b.date else 1
    return (a.reso > b.reso) - (a.reso < b.reso)


def sorted_rasters(images: DataFrame, comparator=preferred, mosaic: str | None = None) -> DataFrame:
    """(mosaic, ord, path): ``images(path, reso, date)`` of each mosaic in the order of a comparator.

    The images of one mosaic are a bounded list, sorted as one group; a
    comparator that is no strict order has no other meaning than this list.
    Archives of any size have ``processing_order``.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        done: list = []
        for x in pdf.sort_values("path").itertuples(index=False):
            at = len(done)
            while at and comparator(x, done[at - 1]) < 0:
                at -= 1
            done.insert(at, x)
        return pd.DataFrame({"mosaic": [str(pdf.mosaic.iloc[0])] * len(done), "ord": range(len(done)), "path": [x.path for x in done]})

    of = F.lit("") if mosaic is None else F.col(mosaic).cast("string")
    out = images.select(of.alias("mosaic"), "path", "reso", "date").groupBy("mosaic").applyInPandas(order, "mosaic string, ord int, path string")
    return out.select("ord", "path") if mosaic is None else out


def reso_class(reso: Column) -> Column:
    """A class of resolutions of which any two are near: powers of 1 / (1 - NEAR), from 1."""
    return F.floor(F.round(F.log(reso) / F.log(F.lit(1 / (1 - NEAR))), 9)).cast("long")


def processing_order(reso: Column, date: Column, path: Column) -> list[Column]:
    """Sort keys of images: finer classes of resolution first, then dated before undated, newer, finer, and by path.

    Inside a class and between images that are not near this is the pairwise
    rule; near images of two classes go by class, which makes the order strict.
    """
    return [reso_class(reso), date == 0, -date, reso, path]


def running(rows: DataFrame, keys: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in the order of ``keys``: a range sort, and one sum for each slice."""
    named = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)], value.alias("__v"))
    by = [f"__k{i}" for i in range(len(keys))]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(named.repartitionByRange(slices, *by).sortWithinPartitions(*by)).withColumn("__slice", F.spark_partition_id())
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("__slice").agg(F.sum("__v").alias("__s"))
    sums = sums.select("__slice", F.coalesce(F.sum("__s").over(earlier.orderBy("__slice")), F.lit(0)).alias("__before"))  # one row a slice
    inside = F.coalesce(F.sum("__v").over(earlier.partitionBy("__slice").orderBy(*by)), F.lit(0))
    return ordered.join(F.broadcast(sums), "__slice").withColumn(name, F.col("__before") + inside).drop(*by, "__v", "__slice", "__before")


def numbered(rows: DataFrame, keys: list[Column], name: str = "ord") -> DataFrame:
    """``rows`` with their place in the order of ``keys`` from 0."""
    return running(rows, keys, F.lit(1), name)


def compacted(rows: DataFrame, deleted: DataFrame, fid: str = "fid") -> DataFrame:
    """``rows`` without the ``deleted(fid)``; ids stay dense from 0, as the last rows move into the holes.

    The highest id goes to the lowest hole, the next to the next.
    """
    gone = deleted.select(fid).distinct()
    left = rows.join(gone, fid, "left_anti")
    n = left.count()
    holes = numbered(gone.where(F.col(fid) < n), [F.col(fid)], "__n").select(F.col(fid).alias("__to"), "__n")
    movers = numbered(left.where(F.col(fid) >= n).select(fid), [-F.col(fid)], "__n").join(holes, "__n").select(fid, "__to")
    return left.join(movers, fid, "left").withColumn(fid, F.coalesce("__to", fid)).drop("__to").select(*rows.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours, first): each node's neighbours in order, and the place of its list when all lists stand one after another."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    lists = both.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))  # four at most on a grid
    return running(lists, [F.col("src")], F.size("neighbours").cast("long"), "first")


@F.pandas_udf(BinaryType())
def to_gbk(text: pd.Series) -> pd.Series:
    """Text as bytes of code page GBK."""
    return text.map(lambda t: None if t is None else t.encode("gbk", "replace"))


@F.pandas_udf(StringType())
def from_gbk(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else b.decode("gbk", "replace"))


def lookup_by_name(rows: DataFrame, query: DataFrame, field: str, default: str) -> DataFrame:
    """``rows(name)`` with ``query(name, field)``; the last duplicate by ``ord`` wins."""
    last = query.groupBy("name").agg(F.max_by(field, "ord").alias(field))
    return rows.join(last, "name", "left").withColumn(field, F.coalesce(field, F.lit(default)))


def unprocessed(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose file name is not among those done."""
    return inputs.withColumn("__n", file_name(F.col("path"))).join(done.select(file_name(F.col("path")).alias("__n")), "__n", "left_anti").drop("__n")


def index_by_name(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows(name)`` with the first idx of ``listed(name, idx)``, or -1."""
    first = listed.groupBy("name").agg(F.min("idx").alias("idx"))
    return rows.join(first, "name", "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))


def clamp_truncation(levels: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Pyramid levels cut from both ends so that one is left."""
    over = low + high >= levels
    top = F.when(over, F.least(high, levels - 1)).otherwise(high)
    return F.when(over, levels - 1 - top).otherwise(low), top


def later_wins(later: DataFrame, former: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, missing columns null; where both have a key the later one stays."""
    both = later.withColumn("__ord", F.lit(1)).unionByName(former.withColumn("__ord", F.lit(0)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__ord")))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__ord", "__rank")
