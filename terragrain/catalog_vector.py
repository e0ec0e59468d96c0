"""Queries of vector operators: predicates, overlays, parts, seams, mosaics, roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import register
from .fixtures import ctes, view
from .operators import cells as g
from .operators import mosaic, roads, seam
from .operators.records import numbered
from .operators.stencils import GRADIENT_X, GRADIENT_Y
from .plans.lineage import cut

_CELLS = ctes("cells")
_R = ctes("rasters")
_PX = ctes("px")
_LF = _CELLS + ", former AS (SELECT * FROM cells WHERE geom_id % 2 = 1), later AS (SELECT * FROM cells WHERE geom_id % 2 = 0)"
CELL = ["row_i", "col_i"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "cells")


def former(spark, d):
    return cells(spark, d).where("geom_id % 2 = 1")


def later(spark, d):
    return cells(spark, d).where("geom_id % 2 = 0")


_OVER = _LF + ", o AS (SELECT l.geom_id AS a_id, f.geom_id AS b_id, CAST(count(*) AS BIGINT) AS area FROM later l JOIN former f USING (row_i, col_i) GROUP BY 1, 2), s AS (SELECT geom_id, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY 1)"


@register("s06_layer_scan", ctes("rects") + " SELECT geom_id, r0, c0, h, w FROM rects")
def s06(spark, d):
    return view(spark, d, "rects")


@register("s07_filtered_layer_scan", ctes("rects") + " SELECT geom_id FROM rects WHERE r0 <= 6 AND r0 + h - 1 >= 4 AND c0 <= 40 AND c0 + w - 1 >= 20")
def s07(spark, d):
    """Features whose box meets a window: plain comparisons that reach the scan."""
    return view(spark, d, "rects").where("r0 <= 6 and r0 + h - 1 >= 4 and c0 <= 40 and c0 + w - 1 >= 20").select("geom_id")


@register("s16_dem_window", ctes("dem") + " SELECT row_i, col_i, elev FROM dem WHERE row_i BETWEEN 1 AND 3 AND col_i BETWEEN 5 AND 20")
def s16(spark, d):
    return view(spark, d, "dem").where("row_i between 1 and 3 and col_i between 5 and 20").select("row_i", "col_i", "elev")


@register("p05_intersects", _OVER + " SELECT a_id, b_id FROM o")
def p05(spark, d):
    return g.overlaps(later(spark, d), former(spark, d)).select("a_id", "b_id")


@register("p06_contains", _OVER + " SELECT a_id, b_id FROM o JOIN s ON s.geom_id = a_id WHERE area = n")
def p06(spark, d):
    return g.related(later(spark, d), former(spark, d), "area = a_area").select("a_id", "b_id")


@register("p14_case_classifier", _OVER + " SELECT a_id, b_id, CASE WHEN area = x.n THEN 'surrounded' WHEN area = y.n THEN 'anti_surrounded' ELSE 'overlap' END AS relation FROM o JOIN s x ON x.geom_id = a_id JOIN s y ON y.geom_id = b_id")
def p14(spark, d):
    return g.relation(later(spark, d), former(spark, d)).select("a_id", "b_id", "relation")


@register("p08_area_ratio", _OVER + " SELECT a_id, b_id FROM o JOIN s ON s.geom_id = a_id WHERE area <= CAST(0.6 AS DOUBLE) * n")
def p08(spark, d):
    return g.related(later(spark, d), former(spark, d), "area <= 0.6D * a_area").select("a_id", "b_id")


@register("p09_fragment_filter", _OVER + " SELECT a_id, b_id FROM o JOIN s ON s.geom_id = b_id WHERE area > CAST(0.1 AS DOUBLE) * n")
def p09(spark, d):
    return g.related(later(spark, d), former(spark, d), "area > 0.1D * b_area").select("a_id", "b_id")


@register("p10_mask_area", _OVER + " SELECT a_id, CAST(sum(area) AS BIGINT) AS area FROM o WHERE area > 5 GROUP BY a_id")
def p10(spark, d):
    return g.covered(later(spark, d), former(spark, d), "area > 5")


@register("a18_intersection_area", _OVER + " SELECT a_id, b_id, area FROM o")
def a18(spark, d):
    return g.overlaps(later(spark, d), former(spark, d))


@register("j04_overlay", _LF + " SELECT l.geom_id AS a_id, f.geom_id AS b_id, row_i, col_i FROM later l JOIN former f USING (row_i, col_i)")
def j04(spark, d):
    return g.intersection(later(spark, d), former(spark, d))


@register("j05_subtract_masks", _LF + " SELECT geom_id, row_i, col_i FROM former f WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.row_i = f.row_i AND l.col_i = f.col_i)")
def j05(spark, d):
    return g.difference(former(spark, d), later(spark, d))


@register("j06_fill_pieces", _LF + """, piece AS (SELECT l.geom_id * 1000 + f.geom_id AS geom_id, row_i, col_i FROM later l JOIN former f USING (row_i, col_i)), border AS (SELECT * FROM later), mask AS (SELECT geom_id, row_i, col_i FROM later WHERE col_i % 10 = 0),
i AS (SELECT p.geom_id AS a_id, b.geom_id AS b_id, count(*) AS n FROM piece p JOIN border b USING (row_i, col_i) GROUP BY 1, 2), z AS (SELECT geom_id, count(*) AS n FROM piece GROUP BY 1),
m AS (SELECT DISTINCT p.geom_id AS a_id, k.geom_id AS b_id FROM piece p JOIN mask k USING (row_i, col_i))
SELECT a_id AS geom_id, min(b_id) AS source FROM i JOIN z ON z.geom_id = a_id AND z.n = i.n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.a_id = i.a_id AND m.b_id = i.b_id) GROUP BY a_id""")
def j06(spark, d):
    """What later and former polygons share, filled from the first later one that contains it unmasked."""
    pieces = g.intersection(later(spark, d), former(spark, d)).select((F.col("a_id") * 1000 + F.col("b_id")).alias("geom_id"), *CELL)
    return g.fill_pieces(pieces, later(spark, d), later(spark, d).where("col_i % 10 = 0"))


@register("j13_overlay_raster", _R + ", poly AS (SELECT raster_id, row_i, col_i FROM rasters WHERE (raster_id = 1 AND col_i < 60) OR (raster_id = 2 AND col_i >= 40)), v AS (SELECT r.* FROM rasters r JOIN poly USING (raster_id, row_i, col_i) WHERE b1 > 0) SELECT row_i, col_i, arg_max(b1, raster_id) AS b1, arg_max(b2, raster_id) AS b2 FROM v GROUP BY row_i, col_i")
def j13(spark, d):
    r = view(spark, d, "rasters")
    poly = r.where("raster_id = 1 and col_i < 60 or raster_id = 2 and col_i >= 40").select(F.col("raster_id").cast("long").alias("geom_id"), *CELL)
    return mosaic.overlay_raster(r, poly, ["b1", "b2"])


@register("k05_raster_cuts", _R + " SELECT raster_id, row_i, col_i, b1 FROM rasters WHERE raster_id = 2 AND col_i >= 50")
def k05(spark, d):
    r = view(spark, d, "rasters")
    poly = r.where("raster_id = 2 and col_i >= 50").select(F.col("raster_id").cast("long").alias("geom_id"), *CELL)
    return mosaic.cut_rasters(r, poly).select("raster_id", "row_i", "col_i", "b1")


@register("j18_features_in_region", _CELLS + " SELECT DISTINCT geom_id FROM cells WHERE row_i BETWEEN 3 AND 6 AND col_i BETWEEN 10 AND 30")
def j18(spark, d):
    region = cells(spark, d).where("row_i between 3 and 6 and col_i between 10 and 30").select(*CELL).distinct()
    return cells(spark, d).join(region, CELL, "left_semi").select("geom_id").distinct()


@register("j19_touched_reverse", _OVER + " SELECT a_id, CAST(row_number() OVER (ORDER BY a_id DESC) AS INTEGER) AS ord FROM (SELECT DISTINCT a_id FROM o)")
def j19(spark, d):
    touched = g.shared(later(spark, d), former(spark, d)).select(F.col("geom_id").alias("a_id")).distinct()
    return numbered(touched, [-F.col("a_id")]).withColumn("ord", (F.col("ord") + 1).cast("int"))


@register("j20_nearest_vertex", ctes("rects") + " SELECT arg_min(geom_id, [(r0 - 5) * (r0 - 5) + (c0 - 33) * (c0 - 33), geom_id]) AS geom_id FROM rects")
def j20(spark, d):
    dist = (F.col("r0") - 5) * (F.col("r0") - 5) + (F.col("c0") - 33) * (F.col("c0") - 33)
    return view(spark, d, "rects").agg(F.min_by("geom_id", F.struct(dist, "geom_id")).alias("geom_id"))


@register("a12_union_envelope", _CELLS + " SELECT min(row_i) AS r0, max(row_i) AS r1, min(col_i) AS c0, max(col_i) AS c1 FROM cells")
def a12(spark, d):
    return g.envelope(cells(spark, d), [])


@register("a20_centroid", _CELLS + " SELECT geom_id, round(avg(row_i), 6) AS row_c, round(avg(col_i), 6) AS col_c FROM cells GROUP BY geom_id")
def a20(spark, d):
    return g.centroid(cells(spark, d)).select("geom_id", F.round("row_c", 6).alias("row_c"), F.round("col_c", 6).alias("col_c"))


@register("u01_union", _LF + " SELECT row_i, col_i FROM former UNION SELECT row_i, col_i FROM later")
def u01u(spark, d):
    return g.union(former(spark, d), later(spark, d))


@register("u01_intersection", _LF + " SELECT row_i, col_i FROM former INTERSECT SELECT row_i, col_i FROM later")
def u01i(spark, d):
    return g.shared(former(spark, d), later(spark, d)).select(*CELL).distinct()


@register("u01_difference", _LF + " SELECT row_i, col_i FROM former EXCEPT SELECT row_i, col_i FROM later")
def u01d(spark, d):
    return g.difference(former(spark, d), later(spark, d)).select(*CELL).distinct()


@register("u01_boundary", _CELLS + ", n AS (SELECT a.geom_id, a.row_i, a.col_i, count(*) AS n FROM cells a JOIN cells b ON a.geom_id = b.geom_id AND abs(a.row_i - b.row_i) + abs(a.col_i - b.col_i) = 1 GROUP BY 1, 2, 3) SELECT c.geom_id, c.row_i, c.col_i FROM cells c LEFT JOIN n USING (geom_id, row_i, col_i) WHERE coalesce(n, 0) < 4")
def u01b(spark, d):
    return g.boundary(cells(spark, d))


@register("f05_buffer", _CELLS + ", s AS (SELECT * FROM (VALUES (-1), (0), (1)) AS s(k)) SELECT DISTINCT geom_id, row_i + a.k AS row_i, col_i + b.k AS col_i FROM cells, s a, s b")
def f05(spark, d):
    return g.dilate(cells(spark, d), 1)


@register("f05_inner_buffer", _CELLS + " SELECT a.geom_id, a.row_i, a.col_i FROM cells a JOIN cells b ON a.geom_id = b.geom_id AND abs(a.row_i - b.row_i) <= 1 AND abs(a.col_i - b.col_i) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9")
def f05e(spark, d):
    return g.erode(cells(spark, d), 1)


@register("f04_envelope_polygon", ctes("rects") + " SELECT geom_id, CAST(h * w AS DOUBLE) AS area FROM rects")
def f04(spark, d):
    ring = g.box_ring(F.col("r0"), F.col("c0"), F.col("r0") + F.col("h"), F.col("c0") + F.col("w"))
    return view(spark, d, "rects").select("geom_id", g.ring_area(ring).alias("area"))


@register("u02_precedence_union", _CELLS + " SELECT row_i, col_i, max(geom_id) AS geom_id FROM cells GROUP BY row_i, col_i")
def u02(spark, d):
    return g.owner_by_order(cells(spark, d))


@register("u03_mosaic_update", _CELLS + ", m AS (SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY 1, 2) SELECT row_i, col_i, owner FROM m WHERE NOT (row_i BETWEEN 2 AND 5 AND col_i BETWEEN 20 AND 50) UNION ALL SELECT row_i, col_i, 999 FROM m WHERE row_i BETWEEN 2 AND 5 AND col_i BETWEEN 20 AND 50")
def u03(spark, d):
    m = g.owner_by_order(cells(spark, d)).withColumnRenamed("geom_id", "owner")
    return mosaic.update(m, m.where("row_i between 2 and 5 and col_i between 20 and 50"), 999)


@register("u04_surrounded_update", _CELLS + ", m AS (SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY 1, 2) SELECT row_i, col_i, owner FROM m UNION ALL SELECT row_i, col_i, 999 FROM (SELECT row_i, col_i FROM px WHERE row_i BETWEEN 0 AND 8 AND col_i BETWEEN 0 AND 60 EXCEPT SELECT row_i, col_i FROM m)")
def u04(spark, d):
    """The mosaic lies inside the new image, which takes what is left of its border."""
    m = g.owner_by_order(cells(spark, d)).withColumnRenamed("geom_id", "owner")
    border = view(spark, d, "px").where("row_i between 0 and 8 and col_i between 0 and 60").select(*CELL)
    return mosaic.surrounded(m, border, 999)


_PARTS = """, e AS (SELECT a.pid AS a, b.pid AS b FROM v a JOIN v b ON abs(a.row_i - b.row_i) + abs(a.col_i - b.col_i) = 1),
r AS (SELECT pid AS n, pid AS m FROM v UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT n AS pid, min(m) AS part FROM r GROUP BY n)"""


def _sparse(spark, d):
    """A sparse set of pixels, of many small parts."""
    return view(spark, d, "px").where("b1 % 3 = 1").select(F.lit(1).alias("geom_id"), *CELL, "pid")


def _parts(view: str, same: str = "") -> str:
    """CTEs that name the 4-connected parts of ``view(pid, row_i, col_i)``, of equal ``same`` columns, by their least cell: lab(pid, part)."""
    alike = "".join(f" AND a.{c} = b.{c}" for c in same.split())
    return f""", e1 AS (SELECT a.pid AS a, b.pid AS b FROM {view} a JOIN {view} b ON b.row_i = a.row_i AND b.col_i = a.col_i + 1{alike} UNION ALL SELECT a.pid, b.pid FROM {view} a JOIN {view} b ON b.row_i = a.row_i + 1 AND b.col_i = a.col_i{alike}),
e AS (SELECT a, b FROM e1 UNION ALL SELECT b, a FROM e1),
lab(pid, part) USING KEY (pid) AS (SELECT pid, pid FROM {view} UNION SELECT e.b, min(lab.part) FROM lab JOIN e ON e.a = lab.pid JOIN recurring.lab AS old ON old.pid = e.b WHERE lab.part < old.part GROUP BY e.b)"""


_RPX = _PX.replace("WITH ", "WITH RECURSIVE ", 1)
_RCELLS = _CELLS.replace("WITH ", "WITH RECURSIVE ", 1)
_SPARSE = _PX.replace("WITH ", "WITH RECURSIVE ", 1) + ", v AS (SELECT pid, row_i, col_i FROM px WHERE b1 % 3 = 1)" + _PARTS


@register("a14_connected_components", _SPARSE + " SELECT CAST(part AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY part")
def a14(spark, d):
    parts = g.components(_sparse(spark, d).select("geom_id", *CELL), ["geom_id"])
    named = parts.withColumn("pid", F.col("row_i") * 100 + F.col("col_i"))
    return named.groupBy("part").agg(F.min("pid").alias("p"), F.count("*").alias("n")).select(F.col("p").alias("part"), "n")


@register("p11_sliver_removal", _SPARSE + " SELECT c.pid FROM c JOIN (SELECT part FROM c GROUP BY part HAVING count(*) >= 3) USING (part)")
def p11(spark, d):
    """Parts of fewer than three cells go."""
    parts = g.components(_sparse(spark, d).select("geom_id", *CELL), ["geom_id"])
    small = parts.groupBy("part").count().where("count < 3").select("part")
    return parts.join(small, "part", "left_anti").select((F.col("row_i") * 100 + F.col("col_i")).alias("pid"))


@register("a15_regions_by_value", _RPX + ", v AS (SELECT pid, row_i, col_i, b2 % 2 AS value FROM px)" + _parts("v", "value") + " SELECT value, CAST(count(*) AS BIGINT) AS area, min(row_i) AS r0, max(row_i) AS r1, min(col_i) AS c0, max(col_i) AS c1 FROM v JOIN lab USING (pid) GROUP BY value, part")
def a15(spark, d):
    """Parts of equal value, as envelopes and areas."""
    p = view(spark, d, "px").select((F.col("b2") % 2).alias("value"), *CELL)
    return g.components(p, ["value"]).groupBy("value", "part").agg(F.count("*").alias("area"), F.min("row_i").alias("r0"), F.max("row_i").alias("r1"), F.min("col_i").alias("c0"), F.max("col_i").alias("c1")).drop("part")


@register("o03_biggest_part", _SPARSE + ", n AS (SELECT part, count(*) AS n FROM c GROUP BY part) SELECT row_i, col_i FROM v JOIN c USING (pid) WHERE part = (SELECT part FROM n ORDER BY n DESC, part LIMIT 1)")
def o03(spark, d):
    return g.biggest_part(_sparse(spark, d)).select(*CELL)


@register("o04_border_region", _RPX + ", v AS (SELECT pid, row_i, col_i FROM px WHERE b1 > 0)" + _parts("v") + ", n AS (SELECT part, count(*) AS n FROM lab GROUP BY part), k AS (SELECT row_i, col_i FROM v JOIN lab USING (pid) WHERE part = (SELECT part FROM n ORDER BY n DESC, part LIMIT 1)), d AS (SELECT * FROM range(-2, 3) t(dr), range(-2, 3) u(dc)) SELECT k.row_i + dr AS row_i, k.col_i + dc AS col_i FROM k, d GROUP BY 1, 2 HAVING count(*) = 25")
def o04(spark, d):
    """The biggest valid region, drawn in by two pixels."""
    valid = view(spark, d, "px").where("b1 > 0").select(F.lit(1).alias("geom_id"), *CELL)
    return g.erode(g.biggest_part(valid), 2).select(*CELL)


_HOLES = (
    _RCELLS
    + """, k AS (SELECT * FROM cells WHERE NOT (row_i % 4 = 2 AND col_i % 5 = 2)), box AS (SELECT geom_id, min(row_i) - 1 AS r0, max(row_i) + 1 AS r1, min(col_i) - 1 AS c0, max(col_i) + 1 AS c1 FROM k GROUP BY 1),
grid AS (SELECT geom_id, r0, r1, c0, c1, unnest(range(r0, r1 + 1)) AS row_i FROM box), f AS (SELECT geom_id, row_i, unnest(range(c0, c1 + 1)) AS col_i FROM grid),
v AS (SELECT geom_id, row_i, col_i, geom_id * 1000000 + (row_i + 1) * 1000 + col_i + 1 AS pid FROM f ANTI JOIN k USING (geom_id, row_i, col_i))"""
    + _parts("v", "geom_id")
    + " SELECT geom_id, CAST(count(DISTINCT part) - 1 AS BIGINT) AS holes FROM v JOIN lab USING (pid) GROUP BY geom_id"
)


@register("p07_holes", _HOLES)
def p07(spark, d):
    return g.holes(cells(spark, d).where("not (row_i % 4 = 2 and col_i % 5 = 2)"))


@register("a13_merge_touching", _RCELLS + ", v AS (SELECT DISTINCT row_i * 1000 + col_i AS pid, row_i, col_i FROM cells)" + _parts("v") + " SELECT CAST(count(*) AS BIGINT) AS area FROM lab GROUP BY part")
def a13(spark, d):
    return g.merge_touching(cells(spark, d)).select("area")


_SITES = _CELLS + ", s AS (SELECT geom_id, avg(row_i) AS r, avg(col_i) AS c FROM cells GROUP BY 1), o AS (SELECT row_i, col_i, arg_min(geom_id, [(row_i - r) * (row_i - r) + (col_i - c) * (col_i - c), CAST(geom_id AS DOUBLE)]) AS site FROM px, s GROUP BY 1, 2), p AS (SELECT x.site AS a, y.site AS b FROM o x JOIN o y ON x.row_i = y.row_i AND y.col_i = x.col_i + 1 UNION ALL SELECT x.site, y.site FROM o x JOIN o y ON x.col_i = y.col_i AND y.row_i = x.row_i + 1)"


@register("g04_voronoi_facets", _CELLS + ", s AS (SELECT geom_id, avg(row_i) AS r, avg(col_i) AS c FROM cells GROUP BY 1) SELECT row_i, col_i, arg_min(geom_id, [(row_i - r) * (row_i - r) + (col_i - c) * (col_i - c), CAST(geom_id AS DOUBLE)]) AS site FROM px, s GROUP BY 1, 2")
def g04(spark, d):
    return g.nearest_site(view(spark, d, "px"), g.centroid(cells(spark, d)))


@register("j02_voronoi_neighbours", _SITES + " SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b")
def j02(spark, d):
    """Symmetric pairs of sites whose facets touch."""
    site = cut(g.nearest_site(view(spark, d, "px"), g.centroid(cells(spark, d))))
    near = g.shifted(site, [(0, 1), (1, 0)], ["site"]).withColumnRenamed("site", "other").join(site, CELL).where("site <> other").select(F.col("site").alias("a"), F.col("other").alias("b"))
    return near.union(near.select("b", "a")).distinct()


@register("j03_refinement_pairs", _SITES + " SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a <> b")
def j03(spark, d):
    return j02(spark, d).where("a < b")


@register("o05_top_regions", _SPARSE + ", n AS (SELECT part, count(*) AS n FROM c GROUP BY part) SELECT CAST(row_number() OVER (ORDER BY n DESC, part) AS INTEGER) AS r, CAST(n AS BIGINT) AS n FROM n QUALIFY r <= 3")
def o05(spark, d):
    parts = g.components(_sparse(spark, d).select("geom_id", *CELL), ["geom_id"]).groupBy("part").agg(F.count("*").alias("n"))
    top = parts.orderBy(F.desc("n"), "part").limit(3)
    return top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "part"))).select("r", "n")  # three rows


@register("o06_top_region", _SPARSE + " SELECT CAST(max(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM c GROUP BY part)")
def o06(spark, d):
    return g.components(_sparse(spark, d).select("geom_id", *CELL), ["geom_id"]).groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))


_FRAGMENTS = (
    _RCELLS
    + ", v AS (SELECT row_i, col_i, row_i * 1000 + col_i AS pid, max(geom_id) AS owner FROM cells GROUP BY 1, 2)"
    + _parts("v", "owner")
    + ", z AS (SELECT owner, part, count(*) AS n FROM v JOIN lab USING (pid) GROUP BY 1, 2), main AS (SELECT owner, arg_max(part, [n, -part]) AS part FROM z GROUP BY 1), m AS (SELECT v.*, part, (owner, part) IN (SELECT (owner, part) FROM main) AS kept FROM v JOIN lab USING (pid))"
)


@register("o07_split_fragments", _FRAGMENTS + " SELECT owner, CAST(count(*) FILTER (kept) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT kept) AS BIGINT) AS split FROM m GROUP BY owner")
def o07(spark, d):
    m = g.owner_by_order(cells(spark, d)).withColumnRenamed("geom_id", "owner")
    main, rest = mosaic.split_fragments(m)
    return main.groupBy("owner").agg(F.count("*").alias("kept")).join(rest.groupBy("owner").agg(F.count("*").alias("split")), "owner", "left").select("owner", "kept", F.coalesce("split", F.lit(0)).alias("split"))


@register(
    "j17_reattach_fragments",
    _FRAGMENTS
    + """, f AS (SELECT * FROM m WHERE NOT kept), inside AS (SELECT f.owner, f.part, c.geom_id AS into_, count(*) AS n FROM f JOIN cells c USING (row_i, col_i) WHERE c.geom_id <> f.owner GROUP BY 1, 2, 3),
near AS (SELECT DISTINCT f.owner, f.part, k.owner AS into_ FROM f JOIN m k ON k.kept AND abs(k.row_i - f.row_i) + abs(k.col_i - f.col_i) = 1),
t AS (SELECT owner, part, min(into_) AS into_ FROM inside JOIN z USING (owner, part) JOIN near USING (owner, part, into_) WHERE inside.n = z.n GROUP BY 1, 2)
SELECT row_i, col_i, owner FROM m WHERE kept UNION ALL SELECT row_i, col_i, coalesce(into_, f.owner) FROM f LEFT JOIN t USING (owner, part)""",
)
def j17(spark, d):
    m = g.owner_by_order(cells(spark, d)).withColumnRenamed("geom_id", "owner")
    main, rest = mosaic.split_fragments(m)
    return mosaic.reattach(main, rest, cells(spark, d).withColumnRenamed("geom_id", "owner"))


def _pair(spark, d):
    r = view(spark, d, "rasters")
    return r.where("raster_id = 1"), r.where("raster_id = 2")


@register("p13_site_classes", _R + ", o AS (SELECT row_i, col_i FROM rasters WHERE raster_id = 1 AND b1 > 0), n AS (SELECT row_i, col_i FROM rasters WHERE raster_id = 2 AND b1 > 0) SELECT coalesce(o.row_i, n.row_i) AS row_i, coalesce(o.col_i, n.col_i) AS col_i, CASE WHEN n.row_i IS NULL THEN 0 WHEN o.row_i IS NULL THEN 1 ELSE 2 END AS cls FROM o FULL JOIN n ON o.row_i = n.row_i AND o.col_i = n.col_i")
def p13(spark, d):
    return seam.sites(*_pair(spark, d)).select("row_i", "col_i", "cls")


def _lightness(image: str) -> str:
    lin = lambda c: f"CASE WHEN {c} / CAST(255.0 AS DOUBLE) <= 0.04045 THEN {c} / CAST(255.0 AS DOUBLE) / 12.92 ELSE pow(({c} / CAST(255.0 AS DOUBLE) + 0.055) / 1.055, 2.4) END"
    return f"SELECT row_i, col_i, round(CASE WHEN y > CAST(216 AS DOUBLE) / 24389 THEN 116 * cbrt(y) - 16 ELSE y * 24389 / 27 END, 6) AS l FROM (SELECT row_i, col_i, CAST(0.2126 AS DOUBLE) * {lin('b1')} + CAST(0.7152 AS DOUBLE) * {lin('b2')} + CAST(0.0722 AS DOUBLE) * {lin('b3')} AS y FROM rasters WHERE raster_id = {image} AND b1 > 0)"


def _gradient(kernel: list, side: str) -> str:
    taps = ", ".join(f"({r}, {c}, {w})" for r, c, w in kernel)
    return f"SELECT s.row_i - r AS row_i, s.col_i - c AS col_i, abs(sum(coalesce({side}, 0) * w)) AS g, count(*) FILTER (coalesce({side}, 0) > 0) AS n FROM s, (VALUES {taps}) t(r, c, w) GROUP BY 1, 2"


def _seam_costs(dr: int, dc: int, kernel: str) -> str:
    cost = lambda a, b: f"CAST(round(100 * CASE WHEN ok THEN pow(greatest(20, least(40, greatest(go, gn))), 1.5) ELSE 200 END * pow(greatest(abs({a} - {b}), 2) + CASE WHEN ok THEN greatest(abs(go - gn) / 2.8, 2) ELSE 200 END, 1.4)) AS BIGINT)"
    return f"SELECT q.row_i - {dr} AS p_row, q.col_i - {dc} AS p_col, q.row_i AS q_row, q.col_i AS q_col, {cost('p.o', 'q.n')} AS c01, {cost('p.n', 'q.o')} AS c10 FROM (SELECT row_i, col_i, coalesce(lo, 0) AS o, coalesce(ln, 0) AS n, a.g AS go, b.g AS gn, a.n = 12 AND b.n = 12 AS ok FROM s JOIN {kernel}o a USING (row_i, col_i) JOIN {kernel}n b USING (row_i, col_i)) q JOIN (SELECT row_i, col_i, coalesce(lo, 0) AS o, coalesce(ln, 0) AS n FROM s) p ON p.row_i = q.row_i - {dr} AND p.col_i = q.col_i - {dc}"


@register(
    "w05_seam_costs",
    _R
    + f", lo AS ({_lightness('1')}), ln AS ({_lightness('2')}), s AS (SELECT coalesce(lo.row_i, ln.row_i) AS row_i, coalesce(lo.col_i, ln.col_i) AS col_i, lo.l AS lo, ln.l AS ln FROM lo FULL JOIN ln ON lo.row_i = ln.row_i AND lo.col_i = ln.col_i), "
    + ", ".join(f"{k}{side[1]} AS ({_gradient(kernel, side)})" for k, kernel in (("x", GRADIENT_X), ("y", GRADIENT_Y)) for side in ("lo", "ln"))
    + f" {_seam_costs(0, 1, 'y')} UNION ALL {_seam_costs(1, 0, 'x')}",
)
def w05(spark, d):
    return seam.pairs(seam.sites(*_pair(spark, d)))


@register("g01_min_cut_labels")
def g01(spark, d):
    s = seam.sites(*_pair(spark, d))
    return seam.cut_overlap(s, seam.pairs(s)).select("row_i", "col_i", "cls", "label")


@register("a19_seam_energy")
def a19(spark, d):
    """Energy of the cut, summed over edges whose ends have unequal labels, and as the kernel's pieces and known edges have it."""
    s = seam.sites(*_pair(spark, d))
    e = seam.pairs(s)
    lab = cut(seam.cut_overlap(s, e))
    end = lambda c: lab.select(F.col("row_i").alias(f"{c}_row"), F.col("col_i").alias(f"{c}_col"), F.col("label").alias(f"l{c}"), F.col("cls").alias(f"cls{c}"))
    ends = e.join(end("p"), ["p_row", "p_col"]).join(end("q"), ["q_row", "q_col"])
    cost = F.when((F.col("lp") == 0) & (F.col("lq") == 1), F.col("c01")).when((F.col("lp") == 1) & (F.col("lq") == 0), F.col("c10")).otherwise(0)
    pieces = lab.where("part is not null").groupBy("part").agg(F.max("energy").alias("energy")).agg(F.sum("energy").alias("pieces"))
    known = F.sum(F.when((F.col("clsp") < 2) & (F.col("clsq") < 2), cost).otherwise(0)).alias("known")
    return ends.agg(F.sum(cost).alias("summed"), known).crossJoin(pieces).select("summed", (F.col("pieces") + F.col("known")).alias("kernel"))


@register("c08_coarse_to_fine_seam")
def c08(spark, d):
    return seam.seam(*_pair(spark, d), levels=2)


@register("c06_serial_mosaic")
def c06(spark, d):
    r = view(spark, d, "rasters")
    return mosaic.serial(r, [1, 2], levels=2)


@register("c07_pair_seamline")
def c07(spark, d):
    """The two polygons on either side of the seam between two images, by area."""
    r = view(spark, d, "rasters")
    parts = mosaic.refined(mosaic.voronoi(r), r, 1, 2)
    from .operators.polygons import polygons

    shapes = polygons(parts.withColumnRenamed("owner", "geom_id"))
    signed = F.aggregate("rings", F.lit(0.0), lambda s, ring: s + F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda t, i: t + (F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"]) / 2))
    return shapes.select("geom_id", F.size("rings").alias("rings"), signed.alias("area"))


_VORONOI = _R + """, k AS (SELECT raster_id, row_i, col_i FROM rasters WHERE b1 > 0), s AS (SELECT raster_id, avg(row_i) AS r, avg(col_i) AS c FROM k GROUP BY 1), u AS (SELECT DISTINCT row_i, col_i FROM k),
o AS (SELECT row_i, col_i, arg_min(raster_id, [(row_i - r) * (row_i - r) + (col_i - c) * (col_i - c), CAST(raster_id AS DOUBLE)]) AS site FROM u, s GROUP BY 1, 2),
own AS (SELECT row_i, col_i, CAST(CASE WHEN bool_or(raster_id = site) THEN any_value(site) ELSE min(raster_id) END AS BIGINT) AS owner FROM o JOIN k USING (row_i, col_i) GROUP BY 1, 2)"""


@register("c09_voronoi_mosaic", _VORONOI + " SELECT row_i, col_i, owner FROM own")
def c09(spark, d):
    return mosaic.voronoi(view(spark, d, "rasters"))


@register("c10_mosaic_raster", _VORONOI + " SELECT row_i, col_i, owner, b1, b2, b3 FROM own JOIN rasters USING (row_i, col_i) WHERE raster_id = owner")
def c10(spark, d):
    r = view(spark, d, "rasters")
    return mosaic.mosaic_pixels(mosaic.voronoi(r), r)


@register("c11_raster_cuts", _VORONOI + " SELECT raster_id, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(b1) AS BIGINT) AS b1 FROM own JOIN rasters USING (row_i, col_i) WHERE raster_id = owner GROUP BY raster_id")
def c11(spark, d):
    r = view(spark, d, "rasters")
    own = mosaic.voronoi(r).withColumnRenamed("owner", "geom_id")
    return mosaic.cut_rasters(r, own).groupBy("raster_id").agg(F.count("*").alias("pixels"), F.sum("b1").alias("b1"))


@register("c13_overlay_with_masks", _LF + """, mask AS (SELECT row_i, col_i FROM px WHERE b1 % 7 = 0)
SELECT l.geom_id AS a_id, f.geom_id AS b_id, CAST(count(*) AS BIGINT) AS area FROM later l JOIN former f USING (row_i, col_i) WHERE NOT EXISTS (SELECT 1 FROM mask WHERE mask.row_i = l.row_i AND mask.col_i = l.col_i) GROUP BY 1, 2""")
def c13(spark, d):
    """Overlay of later and former polygons less the cells that a mask hides."""
    hidden = view(spark, d, "px").where("b1 % 7 = 0").select(*CELL)
    return g.overlaps(later(spark, d).join(hidden, CELL, "left_anti"), former(spark, d))


_SAMPLES = ctes("samples") + ", r AS (SELECT seg_id, i, abs(lead(elev) OVER w - elev) AS nbr FROM samples WINDOW w AS (PARTITION BY seg_id ORDER BY i))"


@register("w08_elevation_ratio", _SAMPLES + " SELECT seg_id, CAST(i AS BIGINT) AS i, round(nbr * 2 * sin(CAST(0.5 AS DOUBLE)) / 10 * 4, 6) AS nbr FROM r WHERE nbr IS NOT NULL")
def w08(spark, d):
    s = view(spark, d, "samples").select("seg_id", "i", "elev", F.lit(1.0).alias("angle"), F.lit(10.0).alias("dist"), F.lit(4).alias("n"))
    return roads.slope_ratio(s, 0.5, 2.0).select("seg_id", "i", F.round("nbr", 6).alias("nbr"))


@register("p15_ratio_threshold", _SAMPLES + " SELECT seg_id, i FROM r WHERE nbr > 40")
def p15(spark, d):
    order = Window.partitionBy("seg_id").orderBy("i")
    return view(spark, d, "samples").withColumn("nbr", F.abs(F.lead("elev").over(order) - F.col("elev"))).where("nbr > 40").select("seg_id", "i")


@register("w09_long_runs", _SAMPLES + ", f AS (SELECT seg_id, i, i - row_number() OVER (PARTITION BY seg_id ORDER BY i) AS isle FROM r WHERE nbr > 20), n AS (SELECT *, min(i) OVER q AS run_start, CAST(count(*) OVER q AS BIGINT) AS run_length FROM f WINDOW q AS (PARTITION BY seg_id, isle)) SELECT seg_id, i, run_start, run_length FROM n WHERE run_length >= 2")
def w09(spark, d):
    order = Window.partitionBy("seg_id").orderBy("i")
    s = view(spark, d, "samples").withColumn("nbr", F.abs(F.lead("elev").over(order) - F.col("elev")))
    return roads.long_runs(s, F.col("nbr") > 20, 2).select("seg_id", "i", "run_start", "run_length")


def _segments(spark, d):
    return view(spark, d, "supplier").select(F.col("s_suppkey").alias("seg_id"), (F.col("s_suppkey") % 20 + 0.25).alias("x0"), (F.col("s_suppkey") % 3 + 0.5).alias("y0"), (F.col("s_suppkey") % 20 + 12.25).alias("x1"), (F.col("s_suppkey") % 3 + 0.5).alias("y1"))


@register("w07_segment_samples", "WITH s AS (SELECT s_suppkey AS seg_id, s_suppkey % 20 + CAST(0.25 AS DOUBLE) AS x0, s_suppkey % 3 + CAST(0.5 AS DOUBLE) AS y FROM supplier), k AS (SELECT seg_id, x0, y, unnest(range(0, 13)) AS i FROM s) SELECT seg_id, CAST(i AS INTEGER) AS i, round(x0 + i, 6) AS x, round(y, 6) AS y FROM k")
def w07(spark, d):
    return roads.segment_samples(_segments(spark, d), 1.0, 1.0).select("seg_id", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_ROADS = ctes("dem") + """, s AS (SELECT s_suppkey AS seg_id, s_suppkey % 20 + CAST(0.25 AS DOUBLE) AS x0, s_suppkey % 3 + CAST(0.5 AS DOUBLE) AS y FROM supplier), p AS (SELECT seg_id, x0 + i AS x, y, i FROM (SELECT *, unnest(range(0, 13)) AS i FROM s)),
k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(r, c)),
w AS (SELECT seg_id, i, x, y, (CASE WHEN r = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, elev FROM p JOIN k ON true JOIN dem ON dem.row_i = CAST(floor(y) AS BIGINT) + r AND dem.col_i = CAST(floor(x) AS BIGINT) + c AND elev > 0),
z AS (SELECT seg_id, i, x, y, sum(w * elev) / sum(w) AS z FROM w GROUP BY 1, 2, 3, 4 HAVING sum(w) > 0),
n AS (SELECT seg_id, i, x, y, abs((lead(z) OVER q - z) * 1.0 * sin(CAST(0.0 AS DOUBLE) - atan2(CAST(0.8 AS DOUBLE), CAST(0.6 AS DOUBLE))) / 12 * 12) AS nbr FROM z WINDOW q AS (PARTITION BY seg_id ORDER BY i)),
f AS (SELECT *, i - row_number() OVER (PARTITION BY seg_id ORDER BY i) AS isle FROM n WHERE nbr > 0.05)
SELECT seg_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(y, 6) AS y, round(nbr, 4) AS nbr FROM (SELECT *, count(*) OVER (PARTITION BY seg_id, isle) AS run FROM f) WHERE run >= 2"""


@register("c12_road_deformation", _ROADS)
def c12(spark, d):
    angle, shift = roads.light_angle(0.6, 0.8)
    return roads.deformation(_segments(spark, d), view(spark, d, "dem"), angle, shift, 0.05, 2).select("seg_id", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("nbr", 4).alias("nbr"))


@register("f09_light_angle", "SELECT round(atan2(CAST(0.8 AS DOUBLE), CAST(0.6 AS DOUBLE)), 9) AS angle, CAST(1.0 AS DOUBLE) AS shift")
def f09(spark, d):
    return spark.range(1).select(F.round(F.atan2(F.lit(0.8), F.lit(0.6)), 9).alias("angle"), F.round(F.hypot(F.lit(0.6), F.lit(0.8)), 9).alias("shift"))


_PIECES = """WITH p AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id % 3 AS start, (event_id + user_id) % 3 AS stop FROM events),
b AS (SELECT *, CASE WHEN lag(stop) OVER w IS NULL OR lag(stop) OVER w = start THEN 0 ELSE 1 END AS b, max(k) OVER (PARTITION BY line_id) AS last FROM p WINDOW w AS (PARTITION BY line_id ORDER BY k)),
g AS (SELECT *, sum(b) OVER (PARTITION BY line_id ORDER BY k) AS g FROM b),
h AS (SELECT *, max(g) OVER w AS top, max(CASE WHEN k = last THEN stop END) OVER w = min(CASE WHEN k = 0 THEN start END) OVER w AS closed FROM g WINDOW w AS (PARTITION BY line_id))
SELECT line_id, CAST(k AS INTEGER) AS k, CAST(CASE WHEN closed AND g = 0 THEN top ELSE g END AS BIGINT) AS "group" FROM h"""


@register("w11_join_pieces", _PIECES)
def w11(spark, d):
    e = view(spark, d, "events")
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("k")
    p = e.select(F.col("user_id").alias("line_id"), k, (F.col("event_id") % 3).alias("start"), ((F.col("event_id") + F.col("user_id")) % 3).alias("stop"))
    return roads.join_pieces(p)
