"""The raster data source, layers along a space-filling curve, and warps against the exact mapping."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrain.operators import warp
from terragrain.sources import layers
from terragrain.sources import raster_source as source


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rasters"))
    px = spark.range(200 * 300).select(F.lit(7).alias("raster_id"), F.expr("id div 300").alias("row_i"), (F.col("id") % 300).alias("col_i"), (F.col("id") * 7 % 251 + 1).alias("a"), (F.col("id") % 13).alias("b"))
    source.write_rasters(px, folder, ["a", "b"], origin=(100.0, 50.0), size=(0.5, -0.5), side=64, levels=2)
    return folder, {(r.row_i, r.col_i): (r.a, r.b) for r in px.collect()}


def test_whole_raster(spark, stored):
    folder, want = stored
    df = source.read_raster(spark, folder, tiles=3)
    assert {(r.row_i, r.col_i): (r.b1, r.b2) for r in df.collect()} == want
    assert df.rdd.getNumPartitions() == math.ceil(200 / 64) * math.ceil(300 / (64 * 3)) and df.columns == ["path", "row_i", "col_i", "b1", "b2"]


def test_windows_read_their_tiles(stored, spark):
    folder, want = stored
    got = source.read_raster(spark, folder, window="70,130,90,140", bands="2").collect()
    assert {(r.row_i, r.col_i): r.b2 for r in got} == {k: v[1] for k, v in want.items() if 70 <= k[0] < 90 and 130 <= k[1] < 140}
    (file,) = source.files_of(folder)
    raw = source.Ranged(file)
    parts = list(source.Image(raw).parts((70, 130, 90, 140)))
    assert sum(p.shape[0] * p.shape[1] for _, _, p in parts) == 200
    assert raw.read < source.opened(file)[0].get_file_info(file).size / 4
    assert source.read_raster(spark, folder, window="900,0,950,9").count() == 0


def test_pushed_filters(spark, stored):
    folder, want = stored
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = source.read_raster(spark, folder, tiles=1).where("row_i >= 100 and row_i < 110 and col_i = 5")
        assert {(r.row_i, r.col_i) for r in df.collect()} == {k for k in want if 100 <= k[0] < 110 and k[1] == 5}
        reader = source.PushedReader({"path": folder, "tiles": "1"}, df.schema)
        list(reader.pushFilters([source.GreaterThanOrEqual(("row_i",), 100), source.LessThan(("row_i",), 110), source.EqualTo(("col_i",), 5)]))
        assert [p.window for p in reader.partitions()] == [(100, 5, 110, 6)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_overviews(spark, stored):
    folder, want = stored
    got = {(r.row_i, r.col_i): r.b1 for r in source.read_raster(spark, folder, resolution=2.5, bands="1").collect()}
    assert got == {(r // 4, c // 4): v[0] for (r, c), v in want.items() if r % 4 == 0 and c % 4 == 0}
    assert source.level_of(source.files_of(folder)[0], {"resolution": "100"}) == 2 and source.level_of(source.files_of(folder)[0], {"resolution": "0.9"}) == 0


def test_layer_windows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(x + w), float(y), float(y + h)) for k, (x, y, w, h) in enumerate(zip(rng.uniform(0, 1000, 3000), rng.uniform(0, 500, 3000), rng.uniform(0, 9, 3000), rng.uniform(0, 9, 3000), strict=True))]
    df = spark.createDataFrame([*rows, (9999, None, None, None, None)], "geom_id long, x0 double, x1 double, y0 double, y1 double")
    path = str(tmp_path / "layer")
    layers.write_layer(df, path, parts=64)
    for x0, x1, y0, y1 in ((100, 130, 200, 230), (0, 1000, 0, 500), (-9, -5, 0, 500)):
        got = layers.read_window(spark, path, x0, x1, y0, y1)
        assert sorted(r.geom_id for r in got.collect()) == [k for k, a, b, c, e in rows if a <= x1 and b >= x0 and c <= y1 and e >= y0]
    total = spark.read.parquet(f"{path}/index").count()
    small, wide = (layers.window_parts(spark, path, *w).count() for w in ((100, 130, 200, 230), (100, 400, 100, 300)))
    assert total >= 40 and small <= 6 and small < wide < total
    read = spark.read.parquet(f"{path}/features").join(F.broadcast(layers.window_parts(spark, path, 100, 130, 200, 230)), "part", "left_semi")
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString().lower()


def test_warp_is_exact(spark):
    """Nearest pixels through the mesh are those of the mapping itself, from degrees to metres and between turned grids."""
    metres, degrees = warp.Grid((500000.0, 30.0, 0.0, 2545000.0, 0.0, -30.0), 49), warp.Grid((111.0, 0.0003, 0.0, 23.013, 0.0, -0.0003))
    turned = warp.Grid((10.0, 0.9, 0.3, 70.0, 0.2, -1.1), 49)
    grid = warp.output_grid(spark, 60, 90)
    for out, src in ((degrees, metres), (metres, degrees), (turned, warp.Grid((0.0, 1.0, 0.0, 0.0, 0.0, -1.0), 49))):
        mapping = warp.inverse_mapping(out, src)
        r, c = mapping(F.col("row_i").cast("double"), F.col("col_i").cast("double"))
        exact = {(x.row_i, x.col_i): (x.r, x.c) for x in grid.select("row_i", "col_i", r.alias("r"), c.alias("c")).collect()}
        got = {(x.row_i, x.col_i): (x.src_row, x.src_col) for x in warp.nearest_pixels(grid, mapping).collect()}
        assert got == {k: (math.floor(a + 0.5), math.floor(b + 0.5)) for k, (a, b) in exact.items()}
        for x in warp.placed(grid, mapping).collect():
            assert abs(x.r - exact[x.row_i, x.col_i][0]) <= x.bound and abs(x.c - exact[x.row_i, x.col_i][1]) <= x.bound and x.bound < 0.01


def test_bilinear_warp(spark):
    """A plane stays a plane."""
    px = spark.range(40 * 40).select(F.expr("id div 40").alias("row_i"), (F.col("id") % 40).alias("col_i")).withColumn("b", 10.0 + F.col("row_i") * 2 + F.col("col_i"))
    out = warp.Grid((5.0, 0.5, 0.0, -5.0, 0.0, -0.5), 1)
    got = warp.warped_bilinear(px, warp.Grid((0.0, 1.0, 0.0, 0.0, 0.0, -1.0), 1), out, warp.output_grid(spark, 20, 20), "b").collect()
    for r in got:
        assert r.v == pytest.approx(10 + (5 + 0.5 * (r.row_i + 0.5) - 0.5) * 2 + 5 + 0.5 * (r.col_i + 0.5) - 0.5, abs=1e-4)
