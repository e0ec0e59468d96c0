"""Histograms, look-up tables and contrast stretching of pixel tables.

A pixel table has one row for each pixel and one integer column for each
band; digital number 0 is nodata.  Histograms are aggregations with map-side
combine; everything after them works on at most 65536 rows for each band,
and what meets the pixels again is one row of thresholds or a bounded LUT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bands_long(px: DataFrame, bands: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, band, dn): one row for each pixel and band."""
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("long").alias("dn")) for b in bands])
    return px.select(*keys, F.explode(each).alias("x")).select(*keys, "x.band", "x.dn")


def any_valid(bands: list[str]) -> Column:
    """Whether any band of the pixel has data."""
    return F.greatest(*bands) > 0 if len(bands) > 1 else F.col(bands[0]) > 0


def histogram(px: DataFrame, bands: list[str]) -> DataFrame:
    """(band, dn, cnt), nodata included; histograms of parts add up."""
    return bands_long(px, bands).groupBy("band", "dn").agg(F.count("*").alias("cnt"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("band", "dn").agg(F.sum("cnt").alias("cnt"))


def cdf(hist: DataFrame) -> DataFrame:
    """Cumulative counts of valid numbers: (band, dn, cnt, below, total)."""
    up = Window.partitionBy("band").orderBy("dn")
    valid = hist.where("dn > 0")
    return valid.withColumn("below", F.sum("cnt").over(up)).withColumn("total", F.sum("cnt").over(Window.partitionBy("band")))


def clip_points(hist: DataFrame, low: float, high: float, last: int = 255) -> DataFrame:
    """(band, low, high): the bins where each tail first holds its share.

    A share of 0 keeps the whole range.  A band without data has no row.
    """
    down = Window.partitionBy("band").orderBy(F.desc("dn"))
    tails = cdf(hist).withColumn("above", F.sum("cnt").over(down))
    lo = F.min(F.when(F.col("below") >= low * F.col("total"), F.col("dn"))) if low > 0 else F.lit(0)
    hi = F.max(F.when(F.col("above") >= high * F.col("total"), F.col("dn"))) if high > 0 else F.lit(last)
    return tails.groupBy("band").agg(lo.cast("long").alias("low"), hi.cast("long").alias("high"))


def moments(px: DataFrame, bands: list[str]) -> DataFrame:
    """(band, n, s, ss) over valid numbers; parts add up."""
    return bands_long(px, bands).where("dn <> 0").groupBy("band").agg(F.count("*").alias("n"), F.sum("dn").alias("s"), F.sum(F.col("dn") * F.col("dn")).alias("ss"))


def sigma_points(stats: DataFrame, k: float) -> DataFrame:
    """(band, low, high): the mean less and plus k standard deviations, rounded."""
    mean = F.col("s") / F.col("n")
    dev = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return stats.select("band", F.round(mean - k * dev).cast("long").alias("low"), F.round(mean + k * dev).cast("long").alias("high"))


def saturate(x: Column, top: int = 255) -> Column:
    """Round half to even, then clamp to 0..top."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.bround(x, 0))).cast("long")


def lut_value(dn: Column, low: Column, high: Column) -> Column:
    """Linear stretch of low..high to 0..254; an empty range is a step."""
    step = F.when(dn > low, F.lit(255)).otherwise(F.lit(0)).cast("long")
    return F.when(high > low, saturate(F.lit(254.0) * (dn - low) / (high - low))).otherwise(step)


def lut(points: DataFrame, last: int = 255) -> DataFrame:
    """(band, dn, out) for every digital number."""
    dn = points.select("band", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("dn"))
    return dn.select("band", "dn", lut_value(F.col("dn"), F.col("low"), F.col("high")).alias("out"))


def apply_points(px: DataFrame, bands: list[str], points: DataFrame, keys: list[str]) -> DataFrame:
    """Stretched bands: 0 where no band has data, else LUT + 1, at most 255.

    The thresholds arrive as one row, whatever the image's size.
    """
    one = points.groupBy().agg(*[F.max(F.when(F.col("band") == b, F.struct("low", "high"))).alias(f"__{b}") for b in bands])
    out = px.crossJoin(F.broadcast(one))  # one row
    value = lambda b: F.least(F.lit(255), lut_value(F.col(b), F.col(f"__{b}.low"), F.col(f"__{b}.high")) + 1)
    return out.select(*keys, *[F.when(any_valid(bands) & F.col(f"__{b}").isNotNull(), value(b)).otherwise(F.lit(0)).cast("long").alias(b) for b in bands])


def percent_clip(px: DataFrame, bands: list[str], keys: list[str], low: float = 0.005, high: float = 0.005, last: int = 255) -> DataFrame:
    return apply_points(px, bands, clip_points(histogram(px, bands), low, high, last), keys)


def sigma_stretch(px: DataFrame, bands: list[str], keys: list[str], k: float = 2.5) -> DataFrame:
    return apply_points(px, bands, sigma_points(moments(px, bands), k), keys)


def apply_lut(px: DataFrame, band: str, table: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Join with a LUT of one band, at most 65536 rows."""
    t = table.select(F.col("dn").alias(band), F.col("out").alias(out))
    return px.join(F.broadcast(t), band).select(*keys, out)


def match_histograms(source: DataFrame, target: DataFrame) -> DataFrame:
    """(dn, out): for each source number the target number of nearest CDF.

    ``source`` and ``target`` are histograms (dn, cnt).  S and T are shares of
    valid pixels up to a number.  Where S <= 0 the answer is 0; else of the
    last number with T < S and its successor the nearer, the lower on ties.
    Fractions are compared in whole numbers, as S * total_t against
    T * total_s.
    """
    one = lambda h: cdf(h.select(F.lit("x").alias("band"), "dn", "cnt"))
    s, t = one(source), one(target)
    totals = s.agg(F.max("total").alias("ns")).crossJoin(t.agg(F.max("total").alias("nt")))
    s = s.crossJoin(F.broadcast(totals)).select("dn", (F.col("below") * F.col("nt")).alias("v"), F.lit(1).alias("src"))
    t = t.crossJoin(F.broadcast(totals)).select("dn", (F.col("below") * F.col("ns")).alias("v"), F.lit(0).alias("src"))
    zero = t.select(F.lit(0).cast("long").alias("dn"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("src")).limit(1)
    both = s.union(t).union(zero)
    order = Window.orderBy("v", F.desc("src"), "dn")  # equal values: source first, so that T < S holds strictly
    before = F.last(F.when(F.col("src") == 0, F.struct("v", "dn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the same order backwards, so that what follows is a running value too
    back = Window.orderBy(F.desc("v"), "src", F.desc("dn"))
    after = F.last(F.when(F.col("src") == 0, F.struct("v", "dn")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    near = both.withColumn("b", before).withColumn("a", after).where("src = 1")
    pick = F.when(F.col("a").isNotNull() & (F.col("a.v") - F.col("v") < F.col("v") - F.col("b.v")), F.col("a.dn")).otherwise(F.col("b.dn"))
    return near.select("dn", F.when(F.col("v") <= 0, F.lit(0)).otherwise(F.coalesce(pick, F.lit(0))).cast("long").alias("out"))
