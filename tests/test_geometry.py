"""Polygons of any slope, with holes of another vertex count, against plain point tests; buffers against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrain.functions.wkb import polygon_from_wkb, polygon_to_wkb
from terragrain.operators import lines, overlay, polygons

RINGS = "geom_id long, rings array<array<struct<x: double, y: double>>>"


def star(rng, x, y, r, n):
    """A ring around a point, anticlockwise, with n corners at uneven distances."""
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = rng.uniform(0.5, 1, n) * r
    ring = [(float(x + d * math.cos(t)), float(y + d * math.sin(t))) for t, d in zip(turn, far, strict=True)]
    return [*ring, ring[0]]


def shape(rng, x, y, r):
    outer = star(rng, x, y, r, int(rng.integers(7, 14)))
    hole = star(rng, x, y, r * 0.15, int(rng.integers(3, 6)))[::-1]
    return [outer, hole]


def inside(rings, x, y):
    odd = np.zeros(len(x), dtype=bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x)
    return odd


def plain(rings):
    return [[(p["x"], p["y"]) for p in ring] for ring in rings]


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in shapes.items()], RINGS)


@pytest.fixture(scope="module")
def stars():
    rng = np.random.default_rng(8)
    a = {k: shape(rng, *rng.uniform(0, 8, 2), 4) for k in range(5)}
    b = {k: shape(rng, *rng.uniform(0, 8, 2), 4) for k in range(5)}
    b[5] = [list(r) for r in a[0]]  # the same polygon: every edge shared
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    a[5], b[6] = [box(0.0, 0.0, 2.0, 2.0)], [box(2.0, 0.0, 4.0, 3.0)]  # a side in common, of another length
    a[6], b[7] = [box(0.0, 0.0, 6.0, 6.0), box(1.0, 1.0, 5.0, 5.0)[::-1]], [box(1.0, 1.0, 5.0, 5.0)]  # fills the hole
    return a, b


@pytest.mark.parametrize("name", ["UNION", "INTERSECTION", "DIFFERENCE", "SYMMETRIC"])
def test_overlay(spark, stars, name):
    a, b = stars
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-5, 13, 4000), rng.uniform(-5, 13, 4000)
    op = getattr(overlay, name)
    every = spark.createDataFrame([(i, j) for i in a for j in b], "a_id long, b_id long")
    found = overlay.ringed(overlay.pair_overlay(frame(spark, a), frame(spark, b), op, every), ["a_id", "b_id"])
    got = {(r.a_id, r.b_id): plain(r.rings) for r in found.collect()}
    truth = {"UNION": np.logical_or, "INTERSECTION": np.logical_and, "DIFFERENCE": lambda p, q: p & ~q, "SYMMETRIC": np.logical_xor}[name]
    for i in a:
        for j in b:
            want = truth(inside(a[i], x, y), inside(b[j], x, y))
            have = inside(got.get((i, j), []), x, y)
            assert (want == have).all(), (i, j, int((want != have).sum()))
    if name == "UNION":
        assert len(got[6, 7]) == 1 and len(got[6, 7][0]) == 5 and len(got[5, 6]) == 1
    if name == "DIFFERENCE":
        assert (0, 5) not in got


def test_box_pairs(spark, stars):
    a, b = stars
    box = lambda s: (min(p[0] for r in s for p in r), max(p[0] for r in s for p in r), min(p[1] for r in s for p in r), max(p[1] for r in s for p in r))
    want = {(i, j) for i in a for j in b for p, q in [(box(a[i]), box(b[j]))] if p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]}
    got = [tuple(r) for r in overlay.box_pairs(frame(spark, a), frame(spark, b)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dissolve_and_masks(spark, stars):
    a, b = stars
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-5, 13, 4000), rng.uniform(-5, 13, 4000)
    whole = overlay.ringed(overlay.dissolved(frame(spark, a).withColumn("g", F.lit(1)), "g"), ["g"]).collect()
    assert (inside(plain(whole[0].rings), x, y) == np.any([inside(s, x, y) for s in a.values()], axis=0)).all()
    split = overlay.parts(overlay.ringed(overlay.minus_all(frame(spark, a), frame(spark, b)), ["geom_id"]), ["geom_id"]).collect()
    for k in a:
        mine = [plain(r.rings) for r in split if r.geom_id == k]
        have = np.sum([inside(s, x, y) for s in mine], axis=0) if mine else np.zeros(len(x))
        assert (have == (inside(a[k], x, y) & ~np.any([inside(s, x, y) for s in b.values()], axis=0))).all()
    assert overlay.dissolved(frame(spark, {}).withColumn("g", F.lit(1)), "g").count() == 0


def test_buffers(spark):
    """A round, a bar and a concave ring: areas within what the steps of the corners leave."""
    turn = [2 * math.pi * k / 64 for k in range(64)]
    disc = [(3 * math.cos(t), 3 * math.sin(t)) for t in turn]
    bar = [(0.0, 0.0), (10.0, 5.0), (9.0, 7.0), (-1.0, 2.0)]
    ell = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0)]
    shapes = {k: [[*r, r[0]]] for k, r in enumerate((disc, bar, ell))}
    grown = {r.geom_id: r.area for r in overlay.areas(overlay.buffered(frame(spark, shapes), 1.0), ["geom_id"]).collect()}
    own = [polygons.area(s[0]) for s in shapes.values()]
    length = [sum(math.dist(p, q) for p, q in zip(s[0], s[0][1:], strict=False)) for s in shapes.values()]
    assert grown[0] == pytest.approx(own[0] + length[0] + math.pi, rel=0.01)
    assert grown[1] == pytest.approx(own[1] + length[1] + math.pi, rel=0.01)
    assert grown[2] == pytest.approx(own[2] + length[2] + math.pi * 5 / 4 - 1, rel=0.01)  # five outer corners, and one inner one where strips overlap
    drawn = {r.geom_id: r.area for r in overlay.areas(overlay.buffered(frame(spark, shapes), -0.5), ["geom_id"]).collect()}
    assert drawn[0] == pytest.approx(math.pi * 2.5**2, rel=0.01)
    assert drawn[2] == pytest.approx(5 * 1 + 1 * 4 + 0.25 * (1 - math.pi / 4), rel=0.01)
    assert 1 in drawn and overlay.buffered(frame(spark, shapes), -1.2).where("geom_id > 0").count() == 0


def test_holes_of_other_vertex_counts(spark):
    """Six by six cells with an L-shaped hole go through every function of rings."""
    hole = {(2, 2), (3, 2), (3, 3)}
    cells = spark.createDataFrame([(k, r, c) for k in (1, 2) for r in range(6) for c in range(6) if (r, c) not in hole], "geom_id long, row_i long, col_i long")
    shapes = polygons.polygons(cells)
    assert [[len(r) for r in x.rings] for x in shapes.collect()] == [[5, 7], [5, 7]]
    back = shapes.select("geom_id", polygon_to_wkb("rings").alias("g")).select("geom_id", polygon_from_wkb("g").alias("rings"))
    assert sorted(map(str, back.collect())) == sorted(map(str, shapes.collect()))
    assert polygons.rasterized(back).count() == cells.count() == polygons.rasterized(polygons.simplified(back, 0.2)).count()
    seam = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (6, 0))])
    assert [[len(r) for r in x.rings] for x in polygons.rotated_off_seam(shapes.withColumn("seam", seam)).collect()] == [[5, 7], [5, 7]]
    none = spark.createDataFrame([(3, None)], RINGS)
    assert none.select(polygon_to_wkb("rings").alias("g")).first().g is None and polygons.rasterized(none).count() == 0
    assert overlay.edges(none, ["geom_id"]).count() == 0


def test_line_chains(spark):
    """Open chains, a closed one and a fork, given in any order and by group."""
    rng = np.random.default_rng(5)
    order = rng.permutation(40).tolist()
    pt = lambda k: {"x": float(k), "y": 0.0}
    rows = [(1, order[k], [pt(k), pt(k + 0.5), pt(k + 1)]) for k in range(30) if k != 11]
    rows += [(2, 7, [pt(0), pt(1)]), (2, 3, [pt(1), pt(2)]), (2, 9, [pt(2), pt(0)])]  # closed
    rows += [(3, 1, [pt(0), pt(1)]), (3, 2, [pt(1), pt(2)]), (3, 3, [pt(1), pt(3)])]  # a fork: nothing goes on
    got = {(r.g, r.chain): [p.x for p in r.points] for r in lines.merged(spark.createDataFrame(rows, "g int, piece long, points array<struct<x: double, y: double>>").repartition(3), ["g"]).collect()}
    want = {(1, order[0]): np.arange(0, 11.01, 0.5).tolist(), (1, order[12]): np.arange(12, 30.01, 0.5).tolist(), (2, 3): [1, 2, 0, 1], (3, 1): [0, 1], (3, 2): [1, 2], (3, 3): [1, 3]}
    assert got == want


def test_tiles_of_a_streamed_mosaic(spark, tmp_path):
    """A version holds the tiles that its batch touched; every version can be read, and a batch that runs again changes nothing."""
    from terragrain.streaming.incremental import TileState

    state = TileState(spark, str(tmp_path / "m"), "row_i long, col_i long, owner long", 10)
    at = lambda rows: spark.createDataFrame(rows, "row_i long, col_i long, owner long")
    first = [(r, c, 1) for r in range(-5, 40) for c in range(40)]
    state.write(0, at(first))
    for _ in range(2):
        batch = at([(3, 3, 2)])
        touched = batch.select(state.tile().alias("tile")).distinct()
        old = state.read(0, touched).join(batch, ["row_i", "col_i"], "left_anti")
        state.write(1, old.union(batch))
    assert sorted(map(tuple, state.read(0).collect())) == first
    assert sorted(map(tuple, state.read(1).collect())) == sorted([x for x in first if x[:2] != (3, 3)] + [(3, 3, 2)])
    files = [p.parent.name for p in (tmp_path / "m" / "rows" / "version=1").rglob("*.parquet")]
    assert files == ["tile=0_0"] and state.read(1, touched).count() == 100
