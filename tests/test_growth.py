"""Steps that must not grow faster than their input."""

import math
import random

from pyspark.sql import functions as F

from terragrain.fixtures import view
from terragrain.functions import projection
from terragrain.operators import cells, color, overlay, seam
from terragrain.plans.lineage import cut
from terragrain.sources import geotiff, rpb
from terragrain.streaming import incremental

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meet_pixels_by_cell(spark):
    assert "NestedLoop" not in _plan(view(spark, SF, "cells"))
    rects = {r["geom_id"]: r for r in view(spark, SF, "rects").collect()}
    px = {(r["row_i"], r["col_i"]) for r in view(spark, SF, "px").collect()}
    want = sorted((g, i, j) for g, r in rects.items() for i in range(r["r0"], r["r0"] + r["h"]) for j in range(r["c0"], r["c0"] + r["w"]) if (i, j) in px)
    assert sorted(map(tuple, view(spark, SF, "cells").collect())) == want


def test_parts_are_joined_by_tiles_when_links_are_many(spark, monkeypatch):
    rng = random.Random(5)
    held = {(r, c): rng.random() < 0.6 for r in range(40) for c in range(60)}
    df = spark.createDataFrame([(int(v), r, c) for (r, c), v in held.items()], "value int, row_i long, col_i long")
    want = sorted(map(tuple, cells.components(df, ["value"]).collect()))
    monkeypatch.setattr(cells, "FEW_LINKS", 5)
    monkeypatch.setattr(cells, "TILE", 4)
    assert sorted(map(tuple, cells.components(df, ["value"]).collect())) == want


def test_crowded_and_coincident_sites_are_few_candidates(spark):
    crowd = [(k, float(k % 10), float(k % 8)) for k in range(4000)]
    sites = spark.createDataFrame(crowd, "geom_id long, row_c double, col_c double")
    tiles = spark.createDataFrame([(50, 0)], "tr long, tc long")
    assert cells.site_candidates(tiles, sites.where("geom_id < 40"), 10, 8).select(F.size("sites")).first()[0] < 20
    px = spark.createDataFrame([(r, c) for r in (0, 5, 300) for c in range(8)], "row_i long, col_i long")
    got = {(r["row_i"], r["col_i"]): r["site"] for r in cells.nearest_site(px, sites).collect()}
    assert got == {(r, c): min(((r - y) ** 2 + (c - x) ** 2, k) for k, y, x in crowd)[1] for r, c in got}
    assert len(got) == 24


def test_equal_shapes_are_overlaid_once(spark):
    box = lambda x, y: [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4), (x, y))]]
    kind = "geom_id long, rings array<array<struct<x: double, y: double>>>"
    a, of_a = overlay.alike(spark.createDataFrame([(k, box(0, 0) if k % 2 else box(2, 2)) for k in range(1, 7)], kind))
    b, of_b = overlay.alike(spark.createDataFrame([(k, box(1, 1)) for k in (10, 11, 12)], kind))
    assert (a.count(), b.count()) == (2, 1)
    found = overlay.areas(overlay.pair_overlay(a, b, overlay.INTERSECTION), ["a_id", "b_id"])
    got = overlay.spread(found, {"a_id": of_a, "b_id": of_b}).collect()
    assert sorted((r["a_id"], r["b_id"], round(r["area"], 6)) for r in got) == [(k, j, 9.0) for k in range(1, 7) for j in (10, 11, 12)]


def test_shared_cells_make_no_pairs(spark):
    many = spark.createDataFrame([(k, 0, c) for k in range(50) for c in range(3)], "geom_id long, row_i long, col_i long")
    assert cells.shared(many, many.where("col_i < 2")).count() == 100


def test_large_pieces_are_cut_by_tiles_as_whole(spark, monkeypatch):
    rng = random.Random(11)
    sites, edges = [], []
    for r in range(96):
        for c in range(8):
            sites.append((r, c, 0 if c == 0 else 1 if c == 7 else 2))
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < 96 and c + dc < 8:
                    edges.append((r, c, r + dr, c + dc, rng.choice((7, 7, rng.randint(5, 90))), rng.choice((7, rng.randint(5, 90)))))
    site = spark.createDataFrame(sites, "row_i long, col_i long, cls int")
    edge = spark.createDataFrame(edges, "p_row long, p_col long, q_row long, q_col long, c01 long, c10 long")
    warm = spark.createDataFrame([(r, c, int(c > 2 + r % 4)) for r, c, _ in sites], "row_i long, col_i long, label long")
    want = sorted((tuple(r) for r in seam.cut_overlap(site, edge, warm).collect()), key=repr)
    monkeypatch.setattr(seam, "PIECE", 400)
    monkeypatch.setattr(seam, "SIDE", 48)
    calls, tiled = [], seam._cut_large
    monkeypatch.setattr(seam, "_cut_large", lambda *a: calls.append(1) or tiled(*a))
    assert sorted((tuple(r) for r in seam.cut_overlap(site, edge, warm).collect()), key=repr) == want
    assert calls


def test_far_pixels_find_their_ground(spark):
    texts = spark.createDataFrame([("pan.rpb", rpb.example_rpb(3))], "path string, value string")
    fine = rpb.parse_rpb(texts).first()["rpc"]
    coarse = fine | {k: str(float(fine[k]) / 4) for k in ("LINE_OFF", "LINE_SCALE", "SAMP_OFF", "SAMP_SCALE")}
    grid = spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate((r, c) for r in range(50, 90000, 4999) for c in (0, 40, 99))], "id long, row_i long, col_i long")
    got = {r["id"]: (r["x"], r["y"]) for r in rpb.rpc_coregister(grid, fine, coarse, 50.0).collect()}
    assert all(abs(got[r["id"]][0] - r["col_i"] / 4) < 4e-5 and abs(got[r["id"]][1] - r["row_i"] / 4) < 4e-5 for r in grid.collect())


def test_latitudes_come_back_to_the_eighth_digit(spark):
    lat = F.col("id") / 2.0
    e, n = projection.to_utm(F.lit(113.3), lat, F.lit(49))
    there = spark.range(-178, 179).select("id", e.alias("e"), n.alias("n"))
    back = projection.from_utm(F.col("e"), F.col("n"), F.lit(49))[1]
    assert there.where(F.abs(back - lat) > 2e-9).count() == 0


def test_tall_rasters_are_files_of_some_rows(spark, tmp_path):
    px = spark.range(2500 * 3).select(F.lit(7).alias("raster_id"), F.expr("id div 3").alias("row_i"), (F.col("id") % 3).alias("col_i"), (F.col("id") % 251).alias("a"), (F.col("id") % 13).alias("b"))
    px = px.where("row_i < 900 or row_i >= 1100")
    geotiff.write_geotiff(px, f"{tmp_path}/t", ["a", "b"], origin=(5.0, 50.0), size=(0.5, -0.5))
    files = spark.read.parquet(f"{tmp_path}/t").collect()
    assert len(files) == 3 and max(geotiff.Image(bytes(f["content"])).rows for f in files) <= 1024
    assert {geotiff.decode(bytes(f["content"]))[1][3] for f in files} == {50.0, 50.0 - 512, 50.0 - 1024}
    want = {(r.row_i, r.col_i): (r.a, r.b) for r in px.collect()}
    got = {(r.row_i, r.col_i): (r.b1, r.b2) for r in geotiff.read_geotiff(spark, f"{tmp_path}/t").collect()}
    assert {k: v for k, v in got.items() if v != (0, 0)} == {k: v for k, v in want.items() if v != (0, 0)} and set(want) <= set(got)
    some = geotiff.read_geotiff(spark, f"{tmp_path}/t", window=(1020, 1, 2100, 3)).collect()
    assert {(r.row_i, r.col_i) for r in some} == {(r, c) for r in range(1020, 2100) for c in (1, 2)}


def test_dividers_are_exact_and_counted(spark):
    rng = random.Random(2)
    values = [rng.choice((-5, 3, 3, 900, rng.randint(-(10**6), 10**6))) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    least = lambda q: min(v for v in values if sum(x <= v for x in values) >= max(1, math.ceil(q * len(values))))
    assert incremental.dividers(df, "v", shares, most=16) == [least(q) for q in shares]
    assert incremental.dividers(df.where("v is null"), "v", shares) == []


def test_a_mosaic_gets_its_parts_from_many_files(spark):
    boxes = spark.range(12).select(F.col("id").alias("geom_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    boxes = boxes.select("geom_id", (F.col("geom_id") % 3).alias("row_i"), (F.col("geom_id") + F.col("k")).alias("col_i")).repartition(5)
    want = {(r.row_i, r.col_i): r.owner for r in boxes.groupBy("row_i", "col_i").agg(F.max("geom_id").alias("owner")).collect()}
    for more in ({}, {"twice": True}, {"restart": True}):
        assert {(r.row_i, r.col_i): r.owner for r in incremental.streamed_mosaic(boxes, batches=3, **more).collect()} == want
    assert incremental.streamed_mosaic(boxes.limit(0), batches=3).count() == 0


def test_balancing_names_what_it_uses_twice(spark):
    px = spark.range(40).select(F.lit(1).alias("raster_id"), F.expr("id div 8").alias("row_i"), (F.col("id") % 8).alias("col_i"), (F.col("id") % 50 + 1).alias("b1"))
    out = color.apply(px, color.fit(px, ["b1"], 4), ["raster_id", "row_i", "col_i"])
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("isnotnull(r_b1") <= 12 and out.count() == 40


def test_buffers_broadcast_no_edges(spark):
    ring = F.expr("array(array(struct(id * 1D as x, 0D as y), struct(id + 3D as x, 0D as y), struct(id + 3D as x, 2D as y), struct(id * 1D as x, 2D as y), struct(id * 1D as x, 0D as y)))")
    found = overlay.areas(overlay.buffered(spark.range(8).select(F.col("id").alias("geom_id"), ring.alias("rings")), 1.0), ["geom_id"])
    assert "Broadcast" not in _plan(found)
    assert {round(r["area"], 4) for r in found.collect()} == {round(6 + 10 + 16 * math.sin(math.pi / 16), 4)}


def test_equal_boxes_are_buffered_once(spark, monkeypatch):
    from terragrain import catalog_overlay

    boxes = spark.range(60).select(F.col("id").alias("geom_id"), F.expr("array(array(struct(0D as x, 0D as y), struct(3D as x, 0D as y), struct(3D as x, 2D + id % 3 as y), struct(0D as x, 2D + id % 3 as y), struct(0D as x, 0D as y)))").alias("rings"))
    counts, whole = [], overlay.buffered
    monkeypatch.setattr(overlay, "buffered", lambda shapes, *a: counts.append(shapes.count()) or whole(shapes, *a))
    got = catalog_overlay._buffer_areas(boxes, 0.5).collect()
    assert counts == [3] and len(got) == 60
    assert {r["geom_id"] % 3: r["area"] for r in got} == {k: round(3 * (2 + k) + 5 + k + 4 * math.sin(math.pi / 16), 5) for k in range(3)}


def test_many_steps_keep_plans_known_in_bounds(spark):
    df = spark.range(4).select("id", (F.col("id") + 1).alias("x"))
    for _ in range(7):
        df = cut(df.alias("a").join(df.alias("b"), "id").join(df.alias("c"), "id").join(df.alias("d"), "id").select("id", (F.col("a.x") + F.col("b.x") - F.col("c.x")).alias("x")))
    plan = df._jdf.queryExecution().optimizedPlan()
    assert int(plan.stats().sizeInBytes()) < 1 << 64 and plan.constraints().isEmpty()
    assert sorted(map(tuple, df.collect())) == [(k, k + 1) for k in range(4)]


def test_equal_cell_sets_are_laid_over_once(spark):
    box = lambda g, r, c: [(g, r + i, c + j) for i in range(2) for j in range(3)]
    kind = "geom_id long, row_i long, col_i long"
    a = spark.createDataFrame([x for g in range(0, 40, 2) for x in box(g, 0, g % 4)] + [(90, 0, 0), (90, 0, 0)], kind)
    b = spark.createDataFrame([x for g in range(1, 30, 2) for x in box(g, 1, 1)], kind)
    assert cells.alike(a)[0].select("class").distinct().count() == 3
    left, right = a.collect(), b.collect()
    want = sorted((x.geom_id, y.geom_id, x.row_i, x.col_i) for x in left for y in right if x[1:] == y[1:])
    assert sorted(map(tuple, cells.intersection(a, b).collect())) == want
    count = {}
    for p, q, *_ in want:
        count[p, q] = count.get((p, q), 0) + 1
    assert {(r.a_id, r.b_id): r.area for r in cells.overlaps(a, b).collect()} == count
    summed = {p: sum(n for (x, _), n in count.items() if x == p and n > 1) for p, _ in count}
    assert {r.a_id: r.area for r in cells.covered(a, b, "area > 1").collect()} == {p: n for p, n in summed.items() if n}


def test_listed_cells_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(view(spark, SF, "cells")).split("Aggregate")[0]
