"""Registered queries of the vertex-exact overlay.

The fixture's boxes are slanted by two shears, which keep areas, so SQL finds
the areas from the boxes' unit squares.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register
from .fixtures import ctes, view
from .operators import lines, overlay

_KEY = ["a_id", "b_id"]
#: Unit squares of boxes with a hole one unit inside, and what later and former ones share.
_UNITS = ctes("rects") + """, q AS (SELECT geom_id, r, c FROM (SELECT *, unnest(range(c0, c0 + w)) AS c FROM (SELECT *, unnest(range(r0, r0 + h)) AS r FROM rects)) WHERE r = r0 OR r = r0 + h - 1 OR c = c0 OR c = c0 + w - 1),
l AS (SELECT * FROM q WHERE geom_id % 2 = 0), f AS (SELECT * FROM q WHERE geom_id % 2 = 1),
s AS (SELECT geom_id, count(*) AS n FROM q GROUP BY geom_id),
i AS (SELECT l.geom_id AS a_id, f.geom_id AS b_id, count(*) AS n FROM l JOIN f USING (r, c) GROUP BY 1, 2),
z AS (SELECT i.*, a.n AS na, b.n AS nb FROM i JOIN s a ON a.geom_id = a_id JOIN s b ON b.geom_id = b_id)"""


def _slanted(r, c):
    x = c.cast("double") + 0.37 * r
    return F.struct(x.alias("x"), (r.cast("double") + 0.21 * x).alias("y"))


def _ring(r0, c0, r1, c1):
    return F.array(_slanted(r0, c0), _slanted(r0, c1), _slanted(r1, c1), _slanted(r1, c0), _slanted(r0, c0))


def frames(spark, d, hole: bool = True):
    """(geom_id, rings): slanted boxes, each with a hole."""
    r0, c0, r1, c1 = F.col("r0"), F.col("c0"), F.col("r0") + F.col("h"), F.col("c0") + F.col("w")
    rings = [_ring(r0, c0, r1, c1)] + [_ring(r0 + 1, c0 + 1, r1 - 1, c1 - 1)] * hole
    return overlay.oriented(view(spark, d, "rects").select("geom_id", F.array(*rings).alias("rings")))


def _sides(spark, d):
    every = frames(spark, d)
    return every.where("geom_id % 2 = 0"), every.where("geom_id % 2 = 1")


def _classes(spark, d):
    """Later and former boxes, of equal ones the first, and how results spread to all."""
    (later, of_later), (former, of_former) = (overlay.alike(s) for s in _sides(spark, d))
    return later, former, {"a_id": of_later, "b_id": of_former}


def _buffer_areas(shapes, d):
    """Areas of buffers; equal shapes are buffered once."""
    least, members = overlay.alike(shapes)
    return overlay.spread(_area(overlay.buffered(least, d), ["geom_id"]), {"geom_id": members})


def _area(found, key):
    return overlay.areas(found, key).where("area > 1e-6").withColumn("area", F.round("area", 5))


@register("u01_polygon_intersection", _UNITS + " SELECT a_id, b_id, CAST(n AS DOUBLE) AS area FROM z")
def u01i(spark, d):
    later, former, members = _classes(spark, d)
    return overlay.spread(_area(overlay.pair_overlay(later, former, overlay.INTERSECTION), _KEY), members)


def _of_shared(spark, d, operation):
    """Areas of ``operation`` on later and former boxes of which some part is shared."""
    later, former, members = _classes(spark, d)
    shared = overlay.areas(overlay.pair_overlay(later, former, overlay.INTERSECTION), _KEY).where("area > 1e-6").select(*_KEY)
    return overlay.spread(_area(overlay.pair_overlay(later, former, operation, shared), _KEY), members)


@register("u01_polygon_union", _UNITS + " SELECT a_id, b_id, CAST(na + nb - n AS DOUBLE) AS area FROM z")
def u01u(spark, d):
    return _of_shared(spark, d, overlay.UNION)


@register("u01_polygon_difference", _UNITS + " SELECT a_id, b_id, CAST(na - n AS DOUBLE) AS area FROM z WHERE na > n")
def u01d(spark, d):
    return _of_shared(spark, d, overlay.DIFFERENCE)


@register("u01_polygon_symmetric", _UNITS + " SELECT a_id, b_id, CAST(na + nb - 2 * n AS DOUBLE) AS area FROM z WHERE na + nb > 2 * n")
def u01s(spark, d):
    return _of_shared(spark, d, overlay.SYMMETRIC)


@register("j04_polygon_overlay", _UNITS + " SELECT a_id, b_id, CAST(n AS DOUBLE) AS area FROM z")
def j04(spark, d):
    """Later and former polygons laid over each other, multipolygons exploded, the parts' areas added up again."""
    later, former, members = _classes(spark, d)
    rings = overlay.ringed(overlay.pair_overlay(later, former, overlay.INTERSECTION), _KEY)
    return overlay.spread(_area(overlay.edges(overlay.parts(rings, _KEY), _KEY), _KEY), members)


@register("j05_polygon_masks", _UNITS + " SELECT geom_id, CAST(count(*) AS DOUBLE) AS area FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.r = f.r AND l.c = f.c) GROUP BY geom_id")
def j05(spark, d):
    """Former polygons without all later ones; covered ones are dropped."""
    later, former, members = _classes(spark, d)
    return overlay.spread(_area(overlay.minus_all(former, later), ["geom_id"]), {"geom_id": members["b_id"]})


@register("a13_polygon_dissolve", _UNITS + " SELECT geom_id % 7 AS part, CAST(count(DISTINCT r * 100000 + c) AS DOUBLE) AS area FROM q GROUP BY 1")
def a13(spark, d):
    """Unions of many polygons at once."""
    return _area(overlay.dissolved(frames(spark, d).withColumn("part", F.col("geom_id") % 7), "part"), ["part"])


@register("f05_round_buffer", ctes("rects") + " SELECT geom_id, round(h * w + 2 * 1.5 * (h + w) + 16 * 1.5 * 1.5 * sin(pi() / 16), 5) AS area FROM rects")
def f05b(spark, d):
    """Boxes grown by 1.5 with round corners of eight steps."""
    r0, c0, r1, c1 = F.col("r0"), F.col("c0"), F.col("r0") + F.col("h"), F.col("c0") + F.col("w")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    boxes = view(spark, d, "rects").select("geom_id", F.array(F.array(at(c0, r0), at(c1, r0), at(c1, r1), at(c0, r1), at(c0, r0))).alias("rings"))
    return _buffer_areas(boxes, 1.5)


@register("f05_round_inset", ctes("rects") + " SELECT geom_id, round(h * w - (h - 2) * (w - 2) - (2 * 0.25 * (h + w) - 4 * 0.25 * 0.25) - 2 * 0.25 * (h + w - 4) - 16 * 0.25 * 0.25 * sin(pi() / 16), 5) AS area FROM rects")
def f05n(spark, d):
    """Boxes with a hole drawn in by a quarter, from outside and from the hole."""
    r0, c0, r1, c1 = F.col("r0"), F.col("c0"), F.col("r0") + F.col("h"), F.col("c0") + F.col("w")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = lambda r0, c0, r1, c1: F.array(at(c0, r0), at(c1, r0), at(c1, r1), at(c0, r1), at(c0, r0))
    rings = F.array(box(r0, c0, r1, c1), box(r0 + 1, c0 + 1, r1 - 1, c1 - 1))
    return _buffer_areas(overlay.oriented(view(spark, d, "rects").select("geom_id", rings.alias("rings"))), -0.25)


@register("f08_line_merge", ctes("px") + """, q AS (SELECT a.row_i, a.col_i FROM px a JOIN px b ON b.row_i = a.row_i AND b.col_i = a.col_i + 1 WHERE a.b1 > 0 AND b.b1 > 0),
r AS (SELECT row_i, col_i, col_i - row_number() OVER (PARTITION BY row_i ORDER BY col_i) AS isle FROM q)
SELECT row_i * 1000 + min(col_i) AS chain, CAST(count(*) AS BIGINT) AS pieces, CAST(count(*) + 1 AS BIGINT) AS vertices, CAST(max(col_i) + 1 AS DOUBLE) AS x_end FROM r GROUP BY row_i, isle""")
def f08(spark, d):
    """Steps between neighbouring valid pixels of a row, joined to lines."""
    ok = view(spark, d, "px").where("b1 > 0").select("row_i", "col_i")
    pair = ok.join(ok.select("row_i", (F.col("col_i") - 1).alias("col_i")), ["row_i", "col_i"])
    point = lambda step: F.struct((F.col("col_i") + step).cast("double").alias("x"), F.col("row_i").cast("double").alias("y"))
    pieces = pair.select((F.col("row_i") * 1000 + F.col("col_i")).alias("piece"), F.array(point(0), point(1)).alias("points"))
    return lines.merged(pieces).select("chain", "pieces", F.size("points").cast("long").alias("vertices"), F.element_at("points", -1)["x"].alias("x_end"))
