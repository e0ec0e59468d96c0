"""Global-to-local color balancing of overlapping rasters.

Fit: moments of each raster and of each overlap's two sides, a sparse weighted
least-squares system of 2 unknowns for each raster, whose normal equations
are summed as a table and solved by conjugate gradients over that table, and
means of grid cells.  Apply: gains, one row a raster, and the cells' means,
both interpolated at each pixel.  A cell's mean stands at the cell's first
corner; the four means around a pixel are gathered once for each cell, so a
pixel meets them all in one join.  Nothing of a raster is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows up to which the tables of means and of gains are broadcast; beyond, they are joined by cell and by raster.
BROADCAST_CELLS = 200_000
#: Where the four means around a pixel stand, from its own cell.
CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def raster_moments(px: DataFrame, bands: list[str]) -> DataFrame:
    """(raster_id, n, mean_b, dev_b) over pixels whose first band is valid."""
    each = [a for b in bands for a in (F.avg(b).alias(f"mean_{b}"), F.stddev_pop(b).alias(f"dev_{b}"))]
    return px.where(F.col(bands[0]) > 0).groupBy("raster_id").agg(F.count("*").alias("n"), *each)


def overlap_pairs(boxes: DataFrame) -> DataFrame:
    """(a, b) with a < b of boxes (raster_id, r0, r1, c0, c1) that intersect; one row a raster.

    Boxes meet in squares of about their own size; a pair counts in the
    square of its intersection's first corner, so only.
    """
    mean = boxes.agg(F.avg(F.col("r1") - F.col("r0") + 1).alias("h"), F.avg(F.col("c1") - F.col("c0") + 1).alias("w")).first()
    h, w = max(1, round(mean["h"] or 1)), max(1, round(mean["w"] or 1))
    span = lambda a, b, size: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    dealt = boxes.select("*", F.explode(span("r0", "r1", h)).alias("gr")).select("*", F.explode(span("c0", "c1", w)).alias("gc"))
    a, b = dealt.alias("a"), dealt.alias("b")
    hit = (F.col("a.r0") <= F.col("b.r1")) & (F.col("b.r0") <= F.col("a.r1")) & (F.col("a.c0") <= F.col("b.c1")) & (F.col("b.c0") <= F.col("a.c1"))
    here = (F.floor(F.greatest("a.r0", "b.r0") / h) == F.col("a.gr")) & (F.floor(F.greatest("a.c0", "b.c0") / w) == F.col("a.gc"))
    same = (F.col("a.gr") == F.col("b.gr")) & (F.col("a.gc") == F.col("b.gc"))
    return a.join(b, same & (F.col("a.raster_id") < F.col("b.raster_id")) & hit & here).select(F.col("a.raster_id").alias("a"), F.col("b.raster_id").alias("b"))


def extents(px: DataFrame) -> DataFrame:
    return px.groupBy("raster_id").agg(F.min("row_i").alias("r0"), F.max("row_i").alias("r1"), F.min("col_i").alias("c0"), F.max("col_i").alias("c1"))


def overlap_moments(px: DataFrame, bands: list[str]) -> DataFrame:
    """(a, b, n, mean_a_x, dev_a_x, mean_b_x, dev_b_x) over cells valid in both."""
    ok = px.where(F.col(bands[0]) > 0)
    left = ok.select("row_i", "col_i", F.col("raster_id").alias("a"), *[F.col(x).alias(f"a_{x}") for x in bands])
    right = ok.select("row_i", "col_i", F.col("raster_id").alias("b"), *[F.col(x).alias(f"b_{x}") for x in bands])
    both = left.join(right, ["row_i", "col_i"]).where("a < b")
    each = [m for x in bands for s in "ab" for m in (F.avg(f"{s}_{x}").alias(f"mean_{s}_{x}"), F.stddev_pop(f"{s}_{x}").alias(f"dev_{s}_{x}"))]
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), *each)


def normal_equations(moments: DataFrame, overlaps: DataFrame, bands: list[str]) -> DataFrame:
    """(band, i, j, m00, m01, m10, m11, v0, v1): nonzero 2 x 2 blocks of the weighted least-squares system.

    Unknowns 0 and 1 of raster i are its gain and offset; v is the right side,
    in blocks of i = j.  Overlap equations (equal means, equal deviations)
    weigh their area; a raster's own (keep both) half the mean overlap area, or
    1 without overlaps.
    """
    one = F.lit(1.0)

    def side(of: str, sign: int, b: str) -> Column:  # a raster's part in the equations of means and of deviations
        return F.struct(F.col(of).cast("long").alias("at"), (sign * F.col(f"mean_{of}_{b}")).alias("mean"), (sign * one).alias("one"), (sign * F.col(f"dev_{of}_{b}")).alias("dev"))

    sides = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.array(side("a", 1, b), side("b", -1, b)).alias("terms")) for b in bands]))
    meet = overlaps.select(F.col("n").cast("double").alias("w"), sides.alias("x")).select("w", "x.band", "x.terms", F.explode("x.terms").alias("x")).select("w", "band", "x", F.explode("terms").alias("y"))
    product = lambda f, g: F.sum(F.col("w") * (F.col(f"x.{f}") * F.col(f"y.{g}")))
    m00 = F.sum(F.col("w") * (F.col("x.mean") * F.col("y.mean") + F.col("x.dev") * F.col("y.dev")))
    shared = meet.groupBy("band", F.col("x.at").alias("i"), F.col("y.at").alias("j")).agg(m00.alias("m00"), product("mean", "one").alias("m01"), product("one", "mean").alias("m10"), product("one", "one").alias("m11"))
    mean = overlaps.agg(F.coalesce(F.avg("n") / 2, one).alias("w"))
    own = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"mean_{b}").alias("mean"), F.col(f"dev_{b}").alias("dev")) for b in bands]))
    own = moments.select(F.col("raster_id").cast("long").alias("i"), own.alias("x")).select("i", "x.*").crossJoin(F.broadcast(mean))  # one row
    square = F.col("w") * (F.col("mean") * F.col("mean") + F.col("dev") * F.col("dev"))
    own = own.select("band", "i", F.col("i").alias("j"), square.alias("m00"), (F.col("w") * F.col("mean")).alias("m01"), (F.col("w") * F.col("mean")).alias("m10"), F.col("w").alias("m11"), square.alias("v0"), (F.col("w") * F.col("mean")).alias("v1"))
    every = own.unionByName(shared.withColumn("v0", F.lit(0.0)).withColumn("v1", F.lit(0.0)))
    return every.groupBy("band", "i", "j").agg(*[F.sum(c).alias(c) for c in ("m00", "m01", "m10", "m11", "v0", "v1")])


def conjugate_gradients(blocks: DataFrame, tolerance: float = 1e-12, most: int = 2000) -> DataFrame:
    """(band, i, x0, x1): the solution of the block systems, all bands together.

    Preconditioned by the blocks of the diagonal.  An iteration is one join of
    the blocks with the direction and one sum by row, written to the shared
    folder; only a band's step lengths reach the driver.  A band rests once its
    residual has fallen to ``tolerance`` of what it was.
    """
    blocks = cut(blocks)
    det = F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10")
    at = blocks.where("i = j").select("band", "i", "v0", "v1", "m00", "m01", "m10", "m11", det.alias("det"))
    # a raster of one value has no block to invert: its gain and offset share what fits
    whole = F.col("det") > 1e-12 * F.col("m00") * F.col("m11")
    plain = lambda u, m: F.when(F.col(m) > 0, u / F.col(m)).otherwise(F.lit(0.0))
    solved = lambda u, v: (F.when(whole, (F.col("m11") * u - F.col("m01") * v) / F.col("det")).otherwise(plain(u, "m00")), F.when(whole, (F.col("m00") * v - F.col("m10") * u) / F.col("det")).otherwise(plain(v, "m11")))
    z0, z1 = solved(F.col("v0"), F.col("v1"))
    keep = ["band", "i", "m00", "m01", "m10", "m11", "det"]
    state = cut(at.select(*keep, F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.col("v0").alias("r0"), F.col("v1").alias("r1"), z0.alias("p0"), z1.alias("p1")))
    first = {r["band"]: r["rz"] for r in state.groupBy("band").agg(F.sum(F.col("r0") * F.col("p0") + F.col("r1") * F.col("p1")).alias("rz")).collect()}  # one row a band
    rz = dict(first)
    by_band = lambda values: F.coalesce(*[F.when(F.col("band") == b, F.lit(float(v))) for b, v in values.items()], F.lit(0.0))
    for _ in range(most):
        if not any(rz[b] > tolerance * tolerance * first[b] for b in rz):
            break
        direction = state.select("band", F.col("i").alias("j"), "p0", "p1")
        q = blocks.join(direction, ["band", "j"]).groupBy("band", "i").agg(F.sum(F.col("m00") * F.col("p0") + F.col("m01") * F.col("p1")).alias("q0"), F.sum(F.col("m10") * F.col("p0") + F.col("m11") * F.col("p1")).alias("q1"))
        state = cut(state.join(q, ["band", "i"]))
        pq = {r["band"]: r["pq"] for r in state.groupBy("band").agg(F.sum(F.col("p0") * F.col("q0") + F.col("p1") * F.col("q1")).alias("pq")).collect()}
        step = by_band({b: rz[b] / pq[b] if pq[b] > 0 and rz[b] > tolerance * tolerance * first[b] else 0.0 for b in rz})
        state = state.withColumn("step", step).select(*keep, "p0", "p1", *[(F.col(f"x{k}") + F.col("step") * F.col(f"p{k}")).alias(f"x{k}") for k in (0, 1)], *[(F.col(f"r{k}") - F.col("step") * F.col(f"q{k}")).alias(f"r{k}") for k in (0, 1)])
        z0, z1 = solved(F.col("r0"), F.col("r1"))
        new = {r["band"]: r["rz"] for r in state.groupBy("band").agg(F.sum(F.col("r0") * z0 + F.col("r1") * z1).alias("rz")).collect()}
        turn = by_band({b: new[b] / rz[b] if rz[b] > 0 else 0.0 for b in rz})
        state = state.withColumn("turn", turn).select(*keep, "x0", "x1", "r0", "r1", (z0 + F.col("turn") * F.col("p0")).alias("p0"), (z1 + F.col("turn") * F.col("p1")).alias("p1"))
        rz = {b: max(new[b], 0.0) for b in rz}
    return cut(state.select("band", "i", "x0", "x1"))


def solve_gains(moments: DataFrame, overlaps: DataFrame, bands: list[str]) -> DataFrame:
    """(raster_id, a_b, o_b of every band): gain and offset of each raster."""
    got = conjugate_gradients(normal_equations(moments, overlaps, bands))
    each = [F.max(F.when(F.col("band") == b, F.col(x))).alias(f"{k}_{b}") for b in bands for k, x in (("a", "x0"), ("o", "x1"))]
    return got.groupBy(F.col("i").cast("int").alias("raster_id")).agg(*each)


def cell_means(px: DataFrame, band: str, cell: int) -> DataFrame:
    """(raster_id, gr, gc, n, mean): means of valid pixels of each grid cell, clamped to 1..255."""
    x = px.where(F.col(band) > 0).groupBy("raster_id", F.floor(F.col("row_i") / cell).alias("gr"), F.floor(F.col("col_i") / cell).alias("gc"))
    return x.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.avg(band))).alias("mean"))


def global_means(cells: DataFrame) -> DataFrame:
    """(gr, gc, mean): means of the rasters' cells, weighed by pixels."""
    return cells.groupBy("gr", "gc").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def _cells(px: DataFrame, bands: list[str], cell: int) -> DataFrame:
    """(raster_id, gr, gc, and n and mean of each band) in one aggregation."""
    ok = lambda b: F.when(F.col(b) > 0, F.col(b))
    each = [a for b in bands for a in (F.count(ok(b)).alias(f"n_{b}"), F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.avg(ok(b)))).alias(f"r_{b}"))]
    return px.groupBy("raster_id", F.floor(F.col("row_i") / cell).alias("gr"), F.floor(F.col("col_i") / cell).alias("gc")).agg(*each)


def corner_means(local: DataFrame, bands: list[str]) -> DataFrame:
    """(raster_id, gr, gc, r_b, g_b): the raster's and the common means at the four corners of each cell, null where nothing is valid.

    The work is on cells, not on pixels: each is told to the four whose corner it is.
    """
    of = lambda b: F.sum(F.when(F.col(f"n_{b}") > 0, F.col(f"r_{b}") * F.col(f"n_{b}"))) / F.sum(F.when(F.col(f"n_{b}") > 0, F.col(f"n_{b}")))
    world = local.groupBy("gr", "gc").agg(*[of(b).alias(f"g_{b}") for b in bands])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(CORNERS)]))
    asked = local.select("raster_id", F.col("gr").alias("tr"), F.col("gc").alias("tc"), at.alias("x")).select("raster_id", "tr", "tc", "x.k", (F.col("tr") + F.col("x.r")).alias("gr"), (F.col("tc") + F.col("x.c")).alias("gc"))
    own = local.select("raster_id", "gr", "gc", *[F.when(F.col(f"n_{b}") > 0, F.col(f"r_{b}")).alias(f"r_{b}") for b in bands])
    met = asked.join(own, ["raster_id", "gr", "gc"], "left").join(world, ["gr", "gc"], "left")
    corner = lambda c: F.array(*[F.max(F.when(F.col("k") == k, F.col(c))) for k in range(len(CORNERS))])
    return met.groupBy("raster_id", F.col("tr").alias("gr"), F.col("tc").alias("gc")).agg(*[corner(f"{k}_{b}").alias(f"{k}_{b}") for b in bands for k in "rg"])


def fit(px: DataFrame, bands: list[str], cell: int) -> dict:
    """The model: greatest cell means, and the tables ``gains`` of rasters and ``cells`` of the means at each cell's corners."""
    moments, overlaps = cut(raster_moments(px, bands)), cut(overlap_moments(px, bands))
    local = cut(_cells(px, bands, cell))
    mean = lambda b: F.sum(F.when(F.col(f"n_{b}") > 0, F.col(f"r_{b}") * F.col(f"n_{b}"))) / F.sum(F.col(f"n_{b}"))
    top = local.groupBy("gr", "gc").agg(*[mean(b).alias(b) for b in bands]).agg(*[F.max(b).alias(b) for b in bands]).first()
    return {"method": "GlobalToLocal", "cell": cell, "max_mean": {b: 255.0 if top[b] is None else float(top[b]) for b in bands}, "gains": solve_gains(moments, overlaps, bands), "cells": cut(corner_means(local, bands))}


def _small(df: DataFrame) -> DataFrame:
    """A table, broadcast only if its counted rows stay within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else df


def apply(px: DataFrame, model: dict, keys: list[str]) -> DataFrame:
    """Balanced bands: gain and offset, then a power that maps interpolated raster means to global ones."""
    cell, bands = model["cell"], list(model["max_mean"])
    out = px.withColumn("gr", F.floor(F.col("row_i") / cell)).withColumn("gc", F.floor(F.col("col_i") / cell))
    out = out.join(_small(model["gains"]), "raster_id", "left").join(_small(model["cells"]), ["raster_id", "gr", "gc"], "left")
    y, x = F.col("row_i") / F.lit(float(cell)) - F.col("gr"), F.col("col_i") / F.lit(float(cell)) - F.col("gc")
    # Each step names what the next one uses more than once: written into one expression, every use would be computed again.
    out = out.select(*keys, *bands, *[c for b in bands for c in (f"a_{b}", f"o_{b}", f"r_{b}", f"g_{b}")], *[((y if r else 1 - y) * (x if k else 1 - x)).alias(f"__w{n}") for n, (r, k) in enumerate(CORNERS)])
    out = out.select(*keys, *bands, *[c for b in bands for c in _levels(b, float(model["max_mean"][b]))])
    out = out.select(*keys, *bands, *[c for b in bands for c in (F.col(f"__v_{b}"), _power(b).alias(f"__p_{b}"))])
    return out.select(*keys, *[_balanced(b, float(model["max_mean"][b])).alias(b) for b in bands])


def _between(c: str) -> Column:
    """The means at four corners interpolated at a pixel, weights renormalised over those that are there."""
    means = [F.get(c, F.lit(k)) for k in range(len(CORNERS))]
    parts = [F.col(f"__w{k}") * F.coalesce(m, F.lit(0.0)) for k, m in enumerate(means)]
    there = [F.when(m.isNotNull(), F.col(f"__w{k}")).otherwise(F.lit(0.0)) for k, m in enumerate(means)]
    total = sum(there[1:], there[0])
    return F.when(total > 0, sum(parts[1:], parts[0]) / total)


def _levels(b: str, top: float) -> list[Column]:
    """A band under gain and offset, and the shares of its raster's and the common mean."""
    v = F.col(b) * F.coalesce(F.col(f"a_{b}"), F.lit(1.0)) + F.coalesce(F.col(f"o_{b}"), F.lit(0.0))
    return [v.alias(f"__v_{b}"), (_between(f"r_{b}") / top).alias(f"__r_{b}"), (_between(f"g_{b}") / top).alias(f"__g_{b}")]


def _power(b: str) -> Column:
    r, g = F.col(f"__r_{b}"), F.col(f"__g_{b}")
    return F.when((r > 0) & (r != 1) & (g > 0), F.log(g) / F.log(r)).otherwise(F.lit(1.0))


def _balanced(b: str, top: float) -> Column:
    v = F.col(f"__v_{b}")
    mapped = F.pow(F.greatest(v, F.lit(0.0)) / top, F.coalesce(F.col(f"__p_{b}"), F.lit(1.0))) * top
    return F.when(F.col(b) == 0, F.lit(0)).when(v < 0, F.lit(1)).otherwise(F.round(F.greatest(F.lit(1.0), F.least(F.lit(255.0), mapped)))).cast("long")
