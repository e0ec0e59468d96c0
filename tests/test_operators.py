"""Raster and vector operators on hand-made fixtures."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrain import logs
from terragrain.functions import projection
from terragrain.functions.vertices import graft, merge_lines, rotate_off_seam, simplify
from terragrain.functions.wkb import decode_polygon, encode_polygon
from terragrain.kernels.mincut import energy, expand, seam_labels
from terragrain.operators import cells, color, mosaic, pansharpen, polygons, records, roads, seam, stencils, stretch
from terragrain.sources.geotiff import decode, encode, read_geotiff


def pixels(spark, grid, *names):
    rows = [(int(r), int(c), *(int(x) for x in np.atleast_1d(v))) for (r, c), v in np.ndenumerate(np.array(grid, dtype=object))] if not names else grid
    return spark.createDataFrame(rows, "row_i long, col_i long, " + ", ".join(f"{n} long" for n in (names or ["b1"])))


def test_clip_points_on_exact_shares(spark):
    hist = spark.createDataFrame([("b", 0, 3), ("b", 1, 1), ("b", 2, 8), ("b", 9, 1)], "band string, dn long, cnt long")
    assert stretch.clip_points(hist, 0.1, 0.1).first()[1:] == (1, 9)
    assert stretch.clip_points(hist, 0.15, 0.15).first()[1:] == (2, 2)
    assert stretch.clip_points(hist, 0.05, 0.05).first()[1:] == (1, 9)
    assert stretch.clip_points(hist, 0.0, 0.0).first()[1:] == (0, 255)
    assert stretch.clip_points(hist.where("dn = 0"), 0.1, 0.1).count() == 0


def test_any_band_mask(spark):
    px = spark.createDataFrame([(0, 0, 7), (1, 7, 0), (2, 0, 0), (3, 9, 9)], "pid long, b1 long, b2 long")
    got = {r.pid: (r.b1, r.b2) for r in stretch.percent_clip(px, ["b1", "b2"], ["pid"]).collect()}
    assert got[2] == (0, 0) and got[0][0] >= 1 and got[1][1] >= 1 and got[3] == (255, 255)


def test_histogram_match_is_the_pointer_walk(spark):
    rng = random.Random(1)
    s, t = ({rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(25)} for _ in range(2))
    ns, nt = sum(s.values()), sum(t.values())
    target, below = [(0, 0)], 0
    for dn in sorted(t):
        below += t[dn]
        target.append((dn, below * ns))
    want, below = {}, 0
    for dn in sorted(s):
        below += s[dn]
        v, j = below * nt, 0
        while j + 1 < len(target) and target[j + 1][1] < v:
            j += 1
        if j + 1 < len(target) and target[j + 1][1] - v < v - target[j][1]:
            j += 1
        want[dn] = target[j][0]
    frame = lambda h: spark.createDataFrame(sorted(h.items()), "dn long, cnt long")
    assert dict(map(tuple, stretch.match_histograms(frame(s), frame(t)).collect())) == want


def test_bilinear_at_edges(spark):
    px = spark.createDataFrame([(r, c, 0 if (r, c) == (1, 1) else 10 * r + c + 1) for r in range(3) for c in range(3)], "row_i long, col_i long, v long")
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, -1.0, 0.0), (2, -0.5, 0.0), (3, 2.5, 2.0), (4, 3.0, 3.0), (5, 1.0, 1.0)], "id int, x double, y double")
    got = {r.id: r.v for r in stencils.bilinear(points, px, "v").collect()}
    assert got[0] == pytest.approx((1 + 2 + 11) / 3) and got[2] == pytest.approx(1) and got[3] == pytest.approx(23)
    assert got[1] == 0 or got[1] == pytest.approx(1)
    assert got[4] == 0 and got[5] == 0


def test_least_squares_weights(spark):
    rows = [(i + 1, (7 * i) % 23 + 1, 2 * (i + 1) + 3 * ((7 * i) % 23 + 1) + 5) for i in range(40)]
    w, c = pansharpen.least_squares(spark.createDataFrame(rows, "b1 long, b2 long, pan long"), ["b1", "b2"], "pan")
    assert w == pytest.approx([2, 3]) and c == pytest.approx(5)


def brute(unary, edges, c01, c10):
    n = len(unary)
    return min(energy(np.array(x), unary, edges, c01, c10) for x in itertools.product((0, 1), repeat=n))


def test_min_cut_is_optimal():
    rng = np.random.default_rng(0)
    edges = np.array([(4 * r + c, 4 * r + c + 1) for r in range(3) for c in range(3)] + [(4 * r + c, 4 * r + c + 4) for r in range(2) for c in range(4)])
    for _ in range(20):
        unary = rng.integers(0, 20, (12, 2))
        c01, c10 = rng.integers(0, 15, len(edges)), rng.integers(0, 15, len(edges))
        moved = expand(np.zeros(12, dtype=np.int64), 1, unary, edges, c01, c10)
        assert energy(moved, unary, edges, c01, c10) == brute(unary, edges, c01, c10)
        swept = seam_labels(np.zeros(12), unary, edges, c01, c10)
        assert energy(swept, unary, edges, c01, c10) == brute(unary, edges, c01, c10)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_and_holes(spark, monkeypatch, few):
    monkeypatch.setattr(cells, "FEW_LINKS", few)
    ring = [(1, r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)]
    both = spark.createDataFrame(ring + [(1, 9, 9), (2, 0, 0), (2, 1, 1)], "geom_id long, row_i long, col_i long")
    parts = cells.components(both, ["geom_id"]).groupBy("geom_id", "part").count().collect()
    assert sorted((r.geom_id, r["count"]) for r in parts) == [(1, 1), (1, 24), (2, 1), (2, 1)]
    assert {r.geom_id: r.holes for r in cells.holes(both).collect()} == {1: 1, 2: 0}
    assert cells.biggest_part(both.where("geom_id = 1")).count() == 24
    assert cells.components(both.limit(0), ["geom_id"]).count() == 0


def test_long_runs_keep_every_run(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 5, 5, 0, 5])], "seg_id int, i long, nbr double")
    want = {1: [1, 2, 4], 2: [1, 2], 3: []}
    for m, ids in want.items():
        assert sorted(r.i for r in roads.long_runs(rows, F.col("nbr") > 2, m).collect()) == ids


def test_dates(spark):
    names = ["GF2_20160831.tif", "x20200229", "x20190431", "none"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(records.date_of(F.col("p"))).collect()]
    assert got == [20160831, 20200229, 0, 0]


def test_cyclic_order_is_stable(spark):
    rows = [("a", 1.0, 20200101), ("b", 1.08, 20210101), ("c", 1.16, 20220101)]
    one, two = (spark.createDataFrame(x, "path string, reso double, date int") for x in (rows, rows[::-1]))
    order = lambda d: [r.path for r in records.sorted_rasters(d).orderBy("ord").collect()]
    assert order(one) == order(two) and len(order(one)) == 3


def test_codecs_and_vertices():
    data = np.arange(24, dtype=np.uint16).reshape(2, 4, 3)
    back, gt = decode(encode(data, (10.0, 20.0), (0.5, -0.5)))
    assert (back == data).all() and gt == (10.0, 0.5, 0.0, 20.0, 0.0, -0.5)
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    assert decode_polygon(encode_polygon([ring])) == [ring]
    assert simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]
    assert merge_lines([[(1, 1), (2, 2)], [(5, 5), (6, 6)], [(6, 6), (1, 1)]]) == [[(5, 5), (6, 6), (1, 1), (2, 2)]]
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert graft(square, [(4, 0), (3, 2), (4, 4)])[:3] == [(4, 0), (3, 2), (4, 4)]
    assert rotate_off_seam(square, [True, False, False, True])[0] == (0, 4)


def test_tiff_layouts(spark, tmp_path):
    """Strips and tiles under every packing, read whole, by window, and from files of different shapes."""
    rng = np.random.default_rng(1)
    images = {}
    for k, (name, packing, tile) in enumerate(itertools.product(("uint8", "uint16", "int16", "float32"), ("", "LZW", "DEFLATE", "PACKBITS"), (0, 16))):
        data = (rng.random((rng.integers(1, 60), rng.integers(1, 60), 2)) * 100).astype(name)
        back, gt = decode(encode(data, (10.0, 20.0), (0.5, -0.5), packing, tile))
        assert back.dtype == data.dtype and (back == data).all() and gt == (10.0, 0.5, 0.0, 20.0, 0.0, -0.5)
        if name == "uint16":
            images[f"{k}.tif"] = data
            (tmp_path / f"{k}.tif").write_bytes(encode(data, (0.0, 0.0), (1.0, -1.0), packing, tile))
    long_ = rng.integers(0, 256, 200_000).astype(np.uint8).reshape(400, 500, 1)
    assert (decode(encode(long_, (0.0, 0.0), (1.0, -1.0), "LZW"))[0] == long_).all()
    for window in (None, (5, 3, 20, 40)):
        r0, c0, r1, c1 = window or (0, 0, 10**6, 10**6)
        want = {(f, r, c): tuple(map(int, d[r, c])) for f, d in images.items() for r in range(d.shape[0]) for c in range(d.shape[1]) if r0 <= r < r1 and c0 <= c < c1}
        got = {(r.path.rsplit("/", 1)[1], r.row_i, r.col_i): (r.b1, r.b2) for r in read_geotiff(spark, str(tmp_path), files=True, window=window).collect()}
        assert got == want


def test_traced_rings_fill_their_cells():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 9)
        group = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, n * n + 1))}
        rings = polygons.trace(group)
        assert sorted(polygons.fill(rings)) == sorted(group) and sum(map(polygons.area, rings)) == len(group)
        assert all(r[0] == r[-1] and len(set(r[:-1])) == len(r) - 1 for r in rings)


def grid(spark, values):
    return spark.createDataFrame([(r, c, *v) for (r, c), v in values.items()], "row_i long, col_i long, b1 long, b2 long, b3 long")


def test_cut_by_pieces_is_optimal(spark):
    """Two open strips between known sites: each is one kernel call, and all together cost the least."""
    rng = random.Random(4)
    old = {(r, c): (rng.randrange(1, 255),) * 3 for r in range(3) for c in range(9) if c not in (4,)}
    new = {(r, c): (rng.randrange(1, 255),) * 3 for r in range(3) for c in range(9) if c not in (0, 8)}
    s = seam.sites(grid(spark, old), grid(spark, new)).withColumn("cls", F.when(F.col("col_i").isin(1, 7), 0).when(F.col("col_i") == 4, 1).otherwise(F.col("cls")))
    edges = [tuple(r) for r in seam.pairs(s).select("p_row", "p_col", "q_row", "q_col", "c01", "c10").collect()]
    got = seam.cut_overlap(s, seam.pairs(s)).collect()
    label = {(r.row_i, r.col_i): r.label for r in got}
    cls = {(r.row_i, r.col_i): r.cls for r in got}
    assert {k: v for k, v in label.items() if cls[k] < 2} == {k: v for k, v in cls.items() if v < 2}
    parts = {r.part for r in got if r.part is not None}
    open_ = sorted(k for k in label if cls[k] == 2)
    assert len(parts) == 2 and len(open_) == 12

    def cost(of):
        return sum(c01 if (of[a, b], of[c, d]) == (0, 1) else c10 if (of[a, b], of[c, d]) == (1, 0) else 0 for a, b, c, d, c01, c10 in edges)

    assert cost(label) == min(cost({**label, **dict(zip(open_, x))}) for x in itertools.product((0, 1), repeat=12))


def test_corridor_bounds_open_sites(spark):
    labels = spark.createDataFrame([(r, c, int(c > 40)) for r in range(20) for c in range(100)], "row_i long, col_i long, label int")
    assert {r.col_i for r in seam.corridor(labels, 3).collect()} == set(range(37, 44))


def test_serial_cases(spark):
    """An image apart is added, one around the mosaic takes the rim, one inside takes its core, one with a large hole is left out."""
    rng = random.Random(5)
    box = lambda k, r0, c0, h, w: [(k, r, c, *[rng.randrange(1, 255)] * 3) for r in range(r0, r0 + h) for c in range(c0, c0 + w)]
    ring = [x for x in box(5, 0, 0, 12, 12) if not (3 <= x[1] < 9 and 3 <= x[2] < 9)]
    rows = box(1, 6, 6, 12, 12) + box(2, 0, 0, 24, 24) + box(3, 9, 9, 6, 6) + box(4, 40, 40, 5, 5)
    r = spark.createDataFrame(rows + ring, "raster_id int, row_i long, col_i long, b1 long, b2 long, b3 long")
    got = {(x.row_i, x.col_i): x.owner for x in mosaic.serial(r, [1, 2, 3, 5, 4], core=2).collect()}
    assert set(got) == {(x[1], x[2]) for x in rows}
    assert got[0, 0] == 2 and got[23, 23] == 2 and got[40, 40] == 4 and got[12, 12] == 3 and 5 not in got.values()


def test_blended_line(spark):
    r = spark.createDataFrame([(k, 0, c, 100 * k, 1, 1) for k in (1, 2) for c in range(12)], "raster_id int, row_i long, col_i long, b1 long, b2 long, b3 long")
    own = spark.createDataFrame([(0, c, 1 if c < 6 else 2) for c in range(12)], "row_i long, col_i long, owner long")
    got = [x.b1 for x in mosaic.blended(own, r, ["b1"], blend=2).orderBy("col_i").collect()]
    assert got == [100, 100, 100, 100, 117, 133, 167, 183, 200, 200, 200, 200] or (got[:3], got[-3:]) == ([100] * 3, [200] * 3) and sorted(got) == got


def test_gain_solution(spark):
    """Gains of a ring of rasters and of one without overlaps, by conjugate gradients, are those of a dense least-squares solution."""
    rng, n = np.random.default_rng(2), 9
    mean, dev = rng.uniform(60, 180, (n, 2)), rng.uniform(10, 40, (n, 2))
    pairs = [(k, (k + 1) % 8) if k < 7 else (0, 7) for k in range(8)]
    weight = rng.integers(50, 500, len(pairs))
    sides = rng.uniform(40, 200, (len(pairs), 2, 2, 2))
    moments = spark.createDataFrame([(k, *[float(x) for b in range(2) for x in (mean[k, b], dev[k, b])]) for k in range(n)], "raster_id int, mean_x double, dev_x double, mean_y double, dev_y double")
    overlaps = spark.createDataFrame([(a, b, int(w), *[float(v) for band in range(2) for side in range(2) for v in sides[k, band, side]]) for k, ((a, b), w) in enumerate(zip(pairs, weight, strict=True))], "a int, b int, n long, mean_a_x double, dev_a_x double, mean_b_x double, dev_b_x double, mean_a_y double, dev_a_y double, mean_b_y double, dev_b_y double")
    got = {r.raster_id: r for r in color.solve_gains(moments, overlaps, ["x", "y"]).collect()}
    for band, name in enumerate("xy"):
        rows, right = [], []
        for k, ((a, b), w) in enumerate(zip(pairs, weight, strict=True)):
            (ma, da), (mb, db) = sides[k, band]
            for at in ({2 * a: ma, 2 * a + 1: 1, 2 * b: -mb, 2 * b + 1: -1}, {2 * a: da, 2 * b: -db}):
                rows.append([np.sqrt(w) * at.get(c, 0) for c in range(2 * n)])
                right.append(0)
        own = np.sqrt(weight.mean() / 2)
        for k in range(n):
            for at, v in (({2 * k: mean[k, band], 2 * k + 1: 1}, mean[k, band]), ({2 * k: dev[k, band]}, dev[k, band])):
                rows.append([own * at.get(c, 0) for c in range(2 * n)])
                right.append(own * v)
        want = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
        assert [v for k in range(n) for v in (got[k][f"a_{name}"], got[k][f"o_{name}"])] == pytest.approx(want.tolist(), rel=1e-7, abs=1e-7)


def test_interpolated_means(spark):
    """Between two cells' corners the power changes step by step, and nodata cells have no weight."""
    px = spark.createDataFrame([(1, r, c, 40 if c < 10 else 60) for r in range(20) for c in range(20)] + [(2, r, c, 80 + r) for r in range(20) for c in range(20)], "raster_id int, row_i long, col_i long, b long")
    model = color.fit(px, ["b"], 10)
    got = {(r.raster_id, r.row_i, r.col_i): r.b for r in color.apply(px, model, ["raster_id", "row_i", "col_i"]).collect()}
    line = [got[1, 5, c] for c in range(10)]
    assert max(abs(a - b) for a, b in itertools.pairwise(line)) <= 3  # no steps between cells' means
    assert len(set(line)) > 2 and all(1 <= v <= 255 for v in got.values())


def test_running_places(spark):
    rows = [(i, (i * 37) % 101, i % 7) for i in range(300)]
    got = {r.i: r.before for r in records.running(spark.createDataFrame(rows, "i long, k long, v long").repartition(5), [F.col("k"), -F.col("i")], F.col("v"), "before").collect()}
    total = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        assert got[i] == total
        total += v


def test_log_sinks(tmp_path):
    logger, path = logs.start_log("mosaicking", str(tmp_path), at=datetime(2020, 2, 29, 1, 2, 3))
    logger.info("three images")
    assert path.endswith("mosaicking_2020-02-29_01-02-03.log") and "three images" in open(path).read()


def test_projection_against_known_points(spark):
    """A zone's origin, and a point on the equator three degrees from the meridian."""
    df = spark.createDataFrame([(111.0, 0.0), (114.0, 0.0), (111.0, -33.0)], "lon double, lat double")
    e, n = projection.to_utm(F.col("lon"), F.col("lat"), F.lit(49), F.col("lat") < 0)
    got = [tuple(r) for r in df.select(e, n).collect()]
    assert got[0] == pytest.approx((500000.0, 0.0), abs=1e-3) and got[1][0] == pytest.approx(833978.557, abs=1e-2)
    assert got[2] == pytest.approx((500000.0, 10000000 - 3651294.5), abs=20)


def test_many_sites(spark):
    """Voronoi owners of a thousand sites, crowded in one corner, equal the plain search; few sites meet each cell."""
    rng = np.random.default_rng(4)
    at = np.vstack([rng.uniform(0, 60, (600, 2)), rng.uniform(0, 300, (400, 2)), [[500.0, -80.0], [10.0, 10.0], [10.0, 10.0]]])
    sites = spark.createDataFrame([(k, float(r), float(c)) for k, (r, c) in enumerate(at)], "geom_id long, row_c double, col_c double")
    px = spark.range(120 * 240).select(F.expr("id div 240").alias("row_i"), (F.col("id") % 240 - 20).alias("col_i"))
    got = {(r.row_i, r.col_i): r.site for r in cells.nearest_site(px, sites).collect()}
    assert len(got) == 120 * 240
    for (r, c), site in got.items():
        d = (r - at[:, 0]) * (r - at[:, 0]) + (c - at[:, 1]) * (c - at[:, 1])
        assert d[site] == d.min() and site == int(np.flatnonzero(d == d.min())[0])
    tiles = spark.range(20 * 40).select(F.expr("id div 40").alias("tr"), (F.col("id") % 40).alias("tc"))
    many = spark.range(20_000).select(F.col("id").alias("geom_id"), (F.rand(1) * 1000).alias("row_c"), (F.rand(2) * 2000).alias("col_c"))
    assert cells.site_candidates(tiles, many, 10, 10).select(F.max(F.size("sites"))).first()[0] < 60


def test_dilate_and_erode(spark):
    rng = np.random.default_rng(6)
    own = {(int(g), int(r), int(c)) for g, r, c in zip(rng.integers(0, 2, 260), rng.integers(0, 14, 260), rng.integers(0, 14, 260), strict=True)}
    df = spark.createDataFrame(sorted(own), "geom_id long, row_i long, col_i long")
    square = [(r, c) for r in range(-1, 2) for c in range(-1, 2)]
    assert {tuple(x) for x in cells.dilate(df, 1).collect()} == {(g, r + a, c + b) for g, r, c in own for a, b in square}
    assert {tuple(x) for x in cells.erode(df, 1).collect()} == {(g, r, c) for g, r, c in own if all((g, r + a, c + b) in own for a, b in square)}
