"""Gram-Schmidt pansharpening of co-registered pixel tables.

The input has one row for each fine pixel: ``pan`` and the multispectral
bands resampled to it.  Statistics are one aggregation of 2 + 2B sums, the
weights of the adaptive form one of (B+1)^2 sums, and injection is a
projection; only sums and a histogram LUT reach the driver or a broadcast.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stretch import percent_clip


def mutual_mask(px: DataFrame, pan: str, bands: list[str]) -> DataFrame:
    """PAN and all bands set to 0 where PAN or the first band is nodata."""
    ok = (F.col(pan) > 0) & (F.col(bands[0]) > 0)
    return px.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(0)) for c in [pan, *bands]})


def synthetic(bands: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    """Weighted sum of the bands."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(b) for w, b in zip(weights, bands, strict=True)]) + F.lit(float(intercept))


def statistics(px: DataFrame, synth: Column, bands: list[str]) -> DataFrame:
    """One row: n, s, ss, and m_b, sm_b for each band, over valid pixels."""
    x = px.where(F.col(bands[0]) > 0).withColumn("__s", synth)
    sums = [F.count("*").alias("n"), F.sum("__s").alias("s"), F.sum(F.col("__s") * F.col("__s")).alias("ss")]
    sums += [a for b in bands for a in (F.sum(b).alias(f"m_{b}"), F.sum(F.col("__s") * F.col(b)).alias(f"sm_{b}"))]
    return x.agg(*sums)


def gains(stats: DataFrame, bands: list[str]) -> DataFrame:
    """Injection gains g_b = (n*sm - s*m) / (n*ss - s*s); 0 for a flat synthetic band."""
    var = F.col("n") * F.col("ss") - F.col("s") * F.col("s")
    return stats.select(*[F.when(var != 0, (F.col("n") * F.col(f"sm_{b}") - F.col("s") * F.col(f"m_{b}")) / var).otherwise(F.lit(0.0)).alias(f"g_{b}") for b in bands])


def normal_equations(px: DataFrame, bands: list[str], target: str) -> DataFrame:
    """(i, j, v): sums of products of the columns 1, bands and target, each pair once."""
    x = px.where(F.col(bands[0]) > 0)
    names = ["1", *bands, target]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = x.agg(*[F.sum(col(names[i]) * col(names[j])).alias(f"v{k}") for k, (i, j) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"v{k}").alias("v")) for k, (i, j) in enumerate(pairs)])).alias("x")).select("x.*")


def _solved(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction] | None:
    """The solution of a small system by elimination in whole fractions; None if it is singular."""
    n = len(b)
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for k in range(n):
        at = next((i for i in range(k, n) if rows[i][k]), None)
        if at is None:
            return None
        rows[k], rows[at] = rows[at], rows[k]
        for i in range(n):
            if i != k and rows[i][k]:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [rows[k][n] / rows[k][k] for k in range(n)]


def least_squares(px: DataFrame, bands: list[str], target: str) -> tuple[list[float], float]:
    """Weights and intercept of target ~ bands; B+1 unknowns are solved on the driver, without rounding where the sums allow one solution."""
    got = {(r["i"], r["j"]): Fraction(r["v"] or 0.0) for r in normal_equations(px, bands, target).collect()}
    names = [*bands, "1"]
    value = lambda a, b: got.get((a, b), got.get((b, a), Fraction(0)))
    a, b = [[value(i, j) for j in names] for i in names], [value(i, target) for i in names]
    w = _solved(a, b)
    if w is None:
        w = np.linalg.lstsq(np.array(a, dtype=float), np.array(b, dtype=float), rcond=None)[0]
    return [float(x) for x in w[:-1]], float(w[-1])


def pansharpen(px: DataFrame, pan: str, bands: list[str], keys: list[str], adaptive: bool = False, last: int = 65535, stretch: bool = False) -> DataFrame:
    """Fine bands: each band plus its gain times (matched PAN - synthetic PAN).

    The plain form weighs all bands alike; the adaptive one fits weights and
    an intercept by least squares.  PAN is matched to the synthetic band's
    histogram of rounded numbers.  Nodata stays 0.
    """
    from ..extensions import AdaptiveGramSchmidt, GramSchmidt

    method = AdaptiveGramSchmidt() if adaptive else GramSchmidt()
    method.last = last
    sharp = method.run(px, pan, bands, keys)
    return percent_clip(sharp, bands, keys, last=last) if stretch else sharp
