"""Queries of pixel operators: scans, masks, histograms, stretching, stencils, sharpening, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register
from .fixtures import ctes, view
from .operators import color, pansharpen, stencils, stretch

BANDS = ["b1", "b2", "b3"]
KEYS = ["pid", "row_i", "col_i"]
_PX = ctes("px")
_RASTERS = ctes("rasters")
_LONG = "long AS (SELECT pid, 'b1' AS band, b1 AS dn FROM px UNION ALL SELECT pid, 'b2', b2 FROM px UNION ALL SELECT pid, 'b3', b3 FROM px)"


def px(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "px")


def rasters(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "rasters")


@register("s02_window_read", _PX + " SELECT pid, b1, b3 FROM px WHERE row_i BETWEEN 2 AND 7 AND col_i BETWEEN 10 AND 59")
def s02(spark, d):
    """Chosen bands of a window."""
    return px(spark, d).where("row_i between 2 and 7 and col_i between 10 and 59").select("pid", "b1", "b3")


@register("s03_band_read", _PX + " SELECT pid, pan16 FROM px WHERE row_i < 5")
def s03(spark, d):
    return px(spark, d).where("row_i < 5").select("pid", "pan16")


@register("s04_block_grid", _PX + """, n AS (SELECT CAST(max(row_i) + 1 AS BIGINT) AS r, CAST(max(col_i) + 1 AS BIGINT) AS c FROM px),
g AS (SELECT r, c, unnest(range(0, CAST(ceil(r / 32.0) AS BIGINT))) AS bi FROM n), h AS (SELECT r, c, bi, unnest(range(0, CAST(ceil(c / 32.0) AS BIGINT))) AS bj FROM g)
SELECT CAST(bi AS BIGINT) AS bi, CAST(bj AS BIGINT) AS bj, CAST(bj * 32 AS BIGINT) AS x0, CAST(bi * 32 AS BIGINT) AS y0, CAST(least(32, c - bj * 32) AS BIGINT) AS w, CAST(least(32, r - bi * 32) AS BIGINT) AS h FROM h""")
def s04(spark, d):
    size = px(spark, d).agg((F.max("row_i") + 1).alias("n_rows"), (F.max("col_i") + 1).alias("n_cols"))
    return stencils.block_grid(size, 32).select(*[F.col(c).cast("long").alias(c) for c in ("bi", "bj", "x0", "y0", "w", "h")])


@register("s05_overview_read", _PX + " SELECT CAST(floor(row_i / 4) AS BIGINT) AS row_i, CAST(floor(col_i / 4) AS BIGINT) AS col_i, b1 FROM px WHERE row_i % 4 = 0 AND col_i % 4 = 0")
def s05(spark, d):
    """The overview that fits an output resolution of 6 from a source of 1."""
    level = stencils.overview_level(6.0, 1.0, 3) + 1
    return stencils.pyramid(px(spark, d), 3).where(F.col("level") == level).select("row_i", "col_i", "b1")


@register("p01_band_permutation", _PX + " SELECT pid, b3 AS r, b2 AS g, b1 AS b FROM px")
def p01(spark, d):
    return px(spark, d).select("pid", F.col("b3").alias("r"), F.col("b2").alias("g"), F.col("b1").alias("b"))


@register("p02_valid_mask", _PX + " SELECT pid, CASE WHEN b1 > 0 THEN 255 ELSE 0 END AS mask FROM px WHERE row_i % 2 = 0 AND col_i % 2 = 0")
def p02(spark, d):
    return px(spark, d).where("row_i % 2 = 0 and col_i % 2 = 0").select("pid", F.when(F.col("b1") > 0, 255).otherwise(0).alias("mask"))


@register("p03_mutual_mask", _PX + " SELECT pid, CASE WHEN pan16 > 0 AND b1 > 0 THEN pan16 ELSE 0 END AS pan16, CASE WHEN pan16 > 0 AND b1 > 0 THEN b1 ELSE 0 END AS b1, CASE WHEN pan16 > 0 AND b1 > 0 THEN b2 ELSE 0 END AS b2 FROM px")
def p03(spark, d):
    return pansharpen.mutual_mask(px(spark, d), "pan16", ["b1", "b2"]).select("pid", *[F.col(c).cast("long").alias(c) for c in ("pan16", "b1", "b2")])


@register("p04_any_band_mask", _PX + " SELECT pid, greatest(b1, b2, b3) > 0 AS valid FROM px")
def p04(spark, d):
    return px(spark, d).select("pid", stretch.any_valid(BANDS).alias("valid"))


@register("a01_histogram", _PX + ", " + _LONG + " SELECT band, dn, CAST(count(*) AS BIGINT) AS cnt FROM long GROUP BY band, dn")
def a01(spark, d):
    return stretch.histogram(px(spark, d), BANDS)


@register("a02_merged_histogram", _PX + ", " + _LONG + " SELECT band, dn, CAST(count(*) AS BIGINT) AS cnt FROM long GROUP BY band, dn")
def a02(spark, d):
    """Histograms of blocks, added up."""
    blocks = [px(spark, d).where(F.col("row_i") % 3 == k) for k in range(3)]
    return stretch.merge_histograms(*[stretch.histogram(b, BANDS) for b in blocks])


@register("a03_moments", _PX + ", " + _LONG + " SELECT band, CAST(count(*) AS BIGINT) AS n, CAST(sum(dn) AS BIGINT) AS s, CAST(sum(dn * dn) AS BIGINT) AS ss FROM long WHERE dn <> 0 GROUP BY band")
def a03(spark, d):
    return stretch.moments(px(spark, d), BANDS)


@register("w01_cdf", _PX + ", " + _LONG + ", h AS (SELECT band, dn, count(*) AS cnt FROM long WHERE dn > 0 GROUP BY band, dn) SELECT band, dn, CAST(sum(cnt) OVER (PARTITION BY band ORDER BY dn) AS BIGINT) AS below, CAST(sum(cnt) OVER (PARTITION BY band) AS BIGINT) AS total FROM h")
def w01(spark, d):
    return stretch.cdf(stretch.histogram(px(spark, d), BANDS)).select("band", "dn", "below", "total")


_CUTS = _PX + ", " + _LONG + """, h AS (SELECT band, dn, count(*) AS cnt FROM long WHERE dn > 0 GROUP BY band, dn),
t AS (SELECT band, dn, sum(cnt) OVER (PARTITION BY band ORDER BY dn) AS below, sum(cnt) OVER (PARTITION BY band ORDER BY dn DESC) AS above, sum(cnt) OVER (PARTITION BY band) AS total FROM h),
p AS (SELECT band, CAST(min(dn) FILTER (WHERE below >= CAST(0.005 AS DOUBLE) * total) AS BIGINT) AS low, CAST(max(dn) FILTER (WHERE above >= CAST(0.005 AS DOUBLE) * total) AS BIGINT) AS high FROM t GROUP BY band)"""
_STRETCHED = """, o AS (SELECT pid, band, CASE WHEN high > low THEN CAST(greatest(0, least(255, round_even(CAST(254.0 AS DOUBLE) * (dn - low) / (high - low), 0))) AS BIGINT) WHEN dn > low THEN 255 ELSE 0 END AS v FROM long JOIN p USING (band))
SELECT px.pid, row_i, col_i,
 CAST(CASE WHEN greatest(b1, b2, b3) > 0 THEN least(255, o1.v + 1) ELSE 0 END AS BIGINT) AS b1, CAST(CASE WHEN greatest(b1, b2, b3) > 0 THEN least(255, o2.v + 1) ELSE 0 END AS BIGINT) AS b2, CAST(CASE WHEN greatest(b1, b2, b3) > 0 THEN least(255, o3.v + 1) ELSE 0 END AS BIGINT) AS b3
FROM px JOIN o o1 ON o1.pid = px.pid AND o1.band = 'b1' JOIN o o2 ON o2.pid = px.pid AND o2.band = 'b2' JOIN o o3 ON o3.pid = px.pid AND o3.band = 'b3'"""


@register("w02_clip_points", _CUTS + " SELECT band, low, high FROM p")
def w02(spark, d):
    return stretch.clip_points(stretch.histogram(px(spark, d), BANDS), 0.005, 0.005)


@register("c01_percent_clip_stretch", _CUTS + _STRETCHED)
def c01(spark, d):
    return stretch.percent_clip(px(spark, d), BANDS, KEYS)


_SIGMA = _PX + ", " + _LONG + """, m AS (SELECT band, CAST(count(*) AS DOUBLE) AS n, CAST(sum(dn) AS DOUBLE) AS s, CAST(sum(dn * dn) AS DOUBLE) AS ss FROM long WHERE dn <> 0 GROUP BY band),
p AS (SELECT band, CAST(round(s / n - CAST(2.5 AS DOUBLE) * sqrt(greatest(ss / n - s / n * (s / n), 0))) AS BIGINT) AS low, CAST(round(s / n + CAST(2.5 AS DOUBLE) * sqrt(greatest(ss / n - s / n * (s / n), 0))) AS BIGINT) AS high FROM m)"""


@register("c02_sigma_stretch", _SIGMA + _STRETCHED)
def c02(spark, d):
    return stretch.sigma_stretch(px(spark, d), BANDS, KEYS)


@register("x04_stretch_by_parts", _CUTS + _STRETCHED)
def x04(spark, d):
    """Accumulate over blocks, finish, apply."""
    blocks = [px(spark, d).where(F.col("row_i") % 2 == k) for k in range(2)]
    hist = stretch.merge_histograms(*[stretch.histogram(b, BANDS) for b in blocks])
    return stretch.apply_points(px(spark, d), BANDS, stretch.clip_points(hist, 0.005, 0.005), KEYS)


@register("j16_lut_join", _CUTS + " SELECT pid, CASE WHEN high > low THEN CAST(greatest(0, least(255, round_even(CAST(254.0 AS DOUBLE) * (b2 - low) / (high - low), 0))) AS BIGINT) ELSE 0 END AS out FROM px, p WHERE band = 'b2'")
def j16(spark, d):
    points = stretch.clip_points(stretch.histogram(px(spark, d), ["b2"]), 0.005, 0.005)
    return stretch.apply_lut(px(spark, d), "b2", stretch.lut(points), ["pid"], "out")


_MATCH = _PX + """, s AS (SELECT dn, sum(c) OVER (ORDER BY dn) AS v, sum(c) OVER () AS n FROM (SELECT pan16 % 256 AS dn, count(*) AS c FROM px WHERE pan16 % 256 > 0 GROUP BY 1)),
t AS (SELECT dn, sum(c) OVER (ORDER BY dn) AS v, sum(c) OVER () AS n FROM (SELECT b1 AS dn, count(*) AS c FROM px WHERE b1 > 0 GROUP BY 1)),
u AS (SELECT dn, CAST(v AS BIGINT) AS v, CAST(n AS BIGINT) AS n FROM t UNION ALL SELECT 0, 0, (SELECT CAST(max(n) AS BIGINT) FROM t)),
b AS (SELECT s.dn, CAST(s.v * u.n AS BIGINT) AS x, max(CASE WHEN u.v * s.n < s.v * u.n THEN u.v * s.n END) AS lo, min(CASE WHEN u.v * s.n >= s.v * u.n THEN u.v * s.n END) AS hi, max(CASE WHEN u.v * s.n < s.v * u.n THEN u.dn END) AS ldn, min(CASE WHEN u.v * s.n >= s.v * u.n THEN u.dn END) AS hdn FROM s, u GROUP BY s.dn, s.v * u.n)
SELECT dn, CAST(CASE WHEN hi IS NOT NULL AND hi - x < x - lo THEN hdn ELSE ldn END AS BIGINT) AS out FROM b"""


@register("j12_histogram_match", _MATCH)
def j12(spark, d):
    hist = lambda c: px(spark, d).groupBy(c.alias("dn")).agg(F.count("*").alias("cnt"))
    return stretch.match_histograms(hist(F.col("pan16") % 256), hist(F.col("b1")))


@register("f16_saturating_cast", _PX + " SELECT pid, CAST(greatest(0, least(255, round_even(b1 * CAST(1.5 AS DOUBLE), 0))) AS BIGINT) AS u8 FROM px")
def f16(spark, d):
    return px(spark, d).select("pid", stretch.saturate(F.col("b1") * 1.5).alias("u8"))


@register("f17_c_math", _PX + " SELECT pid, round(b1 / CAST(2.0 AS DOUBLE)) AS half, CAST(floor(b2 / CAST(3.0 AS DOUBLE)) AS BIGINT) AS f, CAST(ceil(b2 / CAST(3.0 AS DOUBLE)) AS BIGINT) AS c, round(pow(b3, CAST(0.5 AS DOUBLE)), 6) AS r, round(ln(b1 + 1), 6) AS l, round(log2(b2 + 1), 6) AS l2, round(sin(CAST(b3 AS DOUBLE)), 6) AS s FROM px")
def f17(spark, d):
    c = F.col
    return px(spark, d).select("pid", F.round(c("b1") / 2.0).alias("half"), F.floor(c("b2") / 3.0).alias("f"), F.ceil(c("b2") / 3.0).alias("c"), F.round(F.pow(c("b3"), F.lit(0.5)), 6).alias("r"), F.round(F.log(c("b1") + 1), 6).alias("l"), F.round(F.log2(c("b2") + 1), 6).alias("l2"), F.round(F.sin(c("b3").cast("double")), 6).alias("s"))


@register("f18_matrix_reductions", _PX + " SELECT row_i, CAST(count(*) FILTER (WHERE b1 <> 0) AS BIGINT) AS non_zero, CAST(sum(b1) AS BIGINT) AS total, CAST(sum(b1 * b2) AS BIGINT) AS dot, min(b3) AS low, CAST(max(abs(b1 - b2)) AS BIGINT) AS gap FROM px GROUP BY row_i")
def f18(spark, d):
    return px(spark, d).groupBy("row_i").agg(F.count_if(F.col("b1") != 0).alias("non_zero"), F.sum("b1").alias("total"), F.sum(F.col("b1") * F.col("b2")).alias("dot"), F.min("b3").alias("low"), F.max(F.abs(F.col("b1") - F.col("b2"))).alias("gap"))


@register("f22_array_index", _PX + " SELECT pid, [b1, b2, b3][1 + pid % 3] AS picked, list_max([b1, b2, b3]) AS top FROM px")
def f22(spark, d):
    return px(spark, d).select("pid", F.get(F.array(*BANDS), (F.col("pid") % 3).cast("int")).alias("picked"), F.array_max(F.array(*BANDS)).alias("top"))


_LIGHT = "CASE WHEN {y} > 216.0 / 24389 THEN 116 * cbrt({y}) - 16 ELSE {y} * 24389 / 27 END"
_LIN = "(CASE WHEN {0} / CAST(255.0 AS DOUBLE) <= 0.04045 THEN {0} / CAST(255.0 AS DOUBLE) / 12.92 ELSE pow(({0} / CAST(255.0 AS DOUBLE) + 0.055) / 1.055, CAST(2.4 AS DOUBLE)) END)"
_Y = "(CAST(0.2126 AS DOUBLE) * " + _LIN.format("b1") + " + CAST(0.7152 AS DOUBLE) * " + _LIN.format("b2") + " + CAST(0.0722 AS DOUBLE) * " + _LIN.format("b3") + ")"


@register("f15_lightness", _PX + f" SELECT pid, round({_LIGHT.format(y=_Y)}, 6) AS l FROM px")
def f15(spark, d):
    return px(spark, d).select("pid", F.round(stencils.lightness(F.col("b1"), F.col("b2"), F.col("b3")), 6).alias("l"))


@register("k09_pyramid", _PX + " SELECT 1 AS level, CAST(floor(row_i / 2) AS BIGINT) AS row_i, CAST(floor(col_i / 2) AS BIGINT) AS col_i, b1 FROM px WHERE row_i % 2 = 0 AND col_i % 2 = 0 UNION ALL SELECT 2, CAST(floor(row_i / 4) AS BIGINT), CAST(floor(col_i / 4) AS BIGINT), b1 FROM px WHERE row_i % 4 = 0 AND col_i % 4 = 0")
def k09(spark, d):
    return stencils.pyramid(px(spark, d), 2).select("level", "row_i", "col_i", "b1")


@register("w10_nearest_downsample", _PX + " SELECT CAST(floor(row_i / 2) AS BIGINT) AS row_i, CAST(floor(col_i / 2) AS BIGINT) AS col_i, b2 FROM px WHERE row_i % 2 = 0 AND col_i % 2 = 0")
def w10(spark, d):
    return stencils.pyramid(px(spark, d), 1).select("row_i", "col_i", "b2")


@register("j15_neighbour_pairs", _PX + " SELECT a.pid AS src, b.pid AS dst FROM px a JOIN px b ON b.row_i = a.row_i AND b.col_i = a.col_i + 1 WHERE a.b1 > 0 AND b.b1 > 0 UNION ALL SELECT a.pid, b.pid FROM px a JOIN px b ON b.row_i = a.row_i + 1 AND b.col_i = a.col_i WHERE a.b1 > 0 AND b.b1 > 0")
def j15(spark, d):
    return stencils.neighbours4(px(spark, d), "b1")


def _stencil_sql(kernel) -> str:
    taps = ", ".join(f"({r}, {c}, {w})" for r, c, w in kernel)
    return _PX + f", k AS (SELECT * FROM (VALUES {taps}) AS k(dr, dc, w)) SELECT a.row_i, a.col_i, CAST(abs(sum(b.b1 * w)) AS BIGINT) AS g, CAST(count(*) FILTER (WHERE b.b1 > 0) AS BIGINT) AS n FROM px a JOIN k ON true JOIN px b ON b.row_i = a.row_i + dr AND b.col_i = a.col_i + dc GROUP BY a.row_i, a.col_i"


@register("w03_gradient_x", _stencil_sql(stencils.GRADIENT_X))
def w03(spark, d):
    return stencils.stencil(px(spark, d), "b1", stencils.GRADIENT_X)


@register("w03_gradient_y", _stencil_sql(stencils.GRADIENT_Y))
def w03y(spark, d):
    return stencils.stencil(px(spark, d), "b1", stencils.GRADIENT_Y)


@register("w04_full_neighbourhood", _stencil_sql(stencils.GRADIENT_X).replace("SELECT a.row_i, a.col_i, CAST(abs(sum(b.b1 * w)) AS BIGINT) AS g, CAST(count(*) FILTER (WHERE b.b1 > 0) AS BIGINT) AS n", "SELECT a.row_i, a.col_i, count(*) FILTER (WHERE b.b1 > 0) = 12 AS whole"))
def w04(spark, d):
    return stencils.stencil(px(spark, d), "b1", stencils.GRADIENT_X).select("row_i", "col_i", (F.col("n") == 12).alias("whole"))


_BILINEAR = """, p AS (SELECT pid AS id, col_i * CAST(0.7 AS DOUBLE) + 0.3 AS x, row_i * CAST(0.9 AS DOUBLE) - 0.6 AS y FROM px),
k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(r, c)),
s AS (SELECT id, (CASE WHEN r = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, b2 FROM p JOIN k ON true LEFT JOIN px ON px.row_i = CAST(floor(y) AS BIGINT) + r AND px.col_i = CAST(floor(x) AS BIGINT) + c AND b2 > 0)
SELECT id, round(CASE WHEN sum(CASE WHEN b2 IS NOT NULL THEN w END) > 0 THEN sum(w * b2) / sum(CASE WHEN b2 IS NOT NULL THEN w END) ELSE 0 END, 6) AS v FROM s GROUP BY id"""


@register("w06_bilinear", _PX + _BILINEAR)
def w06(spark, d):
    p = px(spark, d).select(F.col("pid").alias("id"), (F.col("col_i") * 0.7 + 0.3).alias("x"), (F.col("row_i") * 0.9 - 0.6).alias("y"))
    return stencils.bilinear(p, px(spark, d), "b2").select("id", F.round("v", 6).alias("v"))


@register("f01_affine", _PX + " SELECT pid, CAST(round(500000 + CAST(0.8 AS DOUBLE) * col_i + CAST(0.1 AS DOUBLE) * row_i, 6) AS DOUBLE) AS x, round(4000000 + CAST(0.1 AS DOUBLE) * col_i - CAST(0.8 AS DOUBLE) * row_i, 6) AS y, CAST(col_i AS DOUBLE) AS back_col, CAST(row_i AS DOUBLE) AS back_row FROM px")
def f01(spark, d):
    gt = (500000.0, 0.8, 0.1, 4000000.0, 0.1, -0.8)
    x, y = stencils.affine(gt, F.col("col_i"), F.col("row_i"))
    p = px(spark, d).select("pid", x.alias("x"), y.alias("y"))
    col, row = stencils.affine(stencils.inverse_affine(gt), F.col("x"), F.col("y"))
    return p.select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.abs(F.round(col, 3)).alias("back_col"), F.abs(F.round(row, 3)).alias("back_row"))


@register("f02_pixel_centre", _PX + " SELECT pid, round((col_i * CAST(2.0 AS DOUBLE) + 100 - 100) / 2.0 - 0.5, 6) AS cx FROM px")
def f02(spark, d):
    return px(spark, d).select("pid", F.round(stencils.pixel_centre(F.col("col_i") * 2.0 + 100, 100.0, 2.0), 6).alias("cx"))


_MASKED = _PX + ", v AS (SELECT pid, pan16, b1, b2, b3, (b1 + b2 + b3) / CAST(3.0 AS DOUBLE) AS s FROM px WHERE pan16 > 0 AND b1 > 0)"


@register("a04_sharpening_sums", _MASKED + " SELECT CAST(count(*) AS BIGINT) AS n, round(sum(s), 3) AS s, round(sum(s * s), 2) AS ss, CAST(sum(b1) AS BIGINT) AS m_b1, round(sum(s * b1), 2) AS sm_b1 FROM v")
def a04(spark, d):
    m = pansharpen.mutual_mask(px(spark, d), "pan16", BANDS)
    s = pansharpen.statistics(m, pansharpen.synthetic(BANDS, [1 / 3] * 3), BANDS)
    return s.select("n", F.round("s", 3).alias("s"), F.round("ss", 2).alias("ss"), F.col("m_b1").cast("long").alias("m_b1"), F.round("sm_b1", 2).alias("sm_b1"))


@register("a05_injection_gains", _MASKED + " SELECT round(regr_slope(b1, s), 6) AS g_b1, round(regr_slope(b2, s), 6) AS g_b2, round(regr_slope(b3, s), 6) AS g_b3 FROM v")
def a05(spark, d):
    m = pansharpen.mutual_mask(px(spark, d), "pan16", BANDS)
    g = pansharpen.gains(pansharpen.statistics(m, pansharpen.synthetic(BANDS, [1 / 3] * 3), BANDS), BANDS)
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


_COLUMNS = ["1", *BANDS, "pan16"]
_PRODUCTS = " UNION ALL ".join(f"SELECT '{x}' AS i, '{y}' AS j, CAST(sum({x} * {y}) AS DOUBLE) AS v FROM v" for k, x in enumerate(_COLUMNS) for y in _COLUMNS[k:])


@register("a16_normal_equations", _MASKED + f" {_PRODUCTS}")
def a16(spark, d):
    m = pansharpen.mutual_mask(px(spark, d), "pan16", BANDS)
    return pansharpen.normal_equations(m, BANDS, "pan16")


def _minor(i: int, j: int) -> str:
    """Cofactor of the 3 x 3 covariance matrix of the bands."""
    r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    m = lambda a, b: f"m{min(a, b)}{max(a, b)}"
    return f"{'-' if (i + j) % 2 else ''}({m(r[0], c[0])} * {m(r[1], c[1])} - {m(r[0], c[1])} * {m(r[1], c[0])})"


#: Least-squares weights by Cramer's rule on covariances.
_WEIGHTS = (
    ", q AS (SELECT "
    + ", ".join(f"covar_pop({x}, {y}) AS m{i}{j}" for i, x in enumerate(BANDS) for j, y in enumerate(BANDS) if i <= j)
    + ", "
    + ", ".join(f"covar_pop({x}, pan16) AS t{i}, avg({x}) AS a{i}" for i, x in enumerate(BANDS))
    + ", avg(pan16) AS ap FROM v), det AS (SELECT *, m00 * "
    + _minor(0, 0)
    + " + m01 * "
    + _minor(0, 1)
    + " + m02 * "
    + _minor(0, 2)
    + " AS det FROM q), w0 AS (SELECT *, "
    + ", ".join("(" + " + ".join(f"t{j} * {_minor(i, j)}" for j in range(3)) + f") / det AS w{i + 1}" for i in range(3))
    + " FROM det), w AS (SELECT w1, w2, w3, ap - w1 * a0 - w2 * a1 - w3 * a2 AS c FROM w0)"
)


@register("a16_least_squares_weights", _MASKED + _WEIGHTS + " SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(c, 4) AS c FROM w")
def a16w(spark, d):
    w, c = pansharpen.least_squares(pansharpen.mutual_mask(px(spark, d), "pan16", BANDS), BANDS, "pan16")
    return spark.createDataFrame([(*[round(x, 6) for x in w], round(c, 4))], "w1 double, w2 double, w3 double, c double")


#: PAN matched to the histogram of ``y(pid, pan16, bands, s)``, and injection by regression gains.
_SHARPENED = (
    """, sh AS (SELECT pan16 AS dn, count(*) AS cnt FROM y GROUP BY 1), th0 AS (SELECT CAST(greatest(0, least(65535, round_even(s, 0))) AS BIGINT) AS dn, count(*) AS cnt FROM y GROUP BY 1), th AS (SELECT * FROM th0 WHERE dn > 0),
n AS (SELECT (SELECT sum(cnt) FROM sh) AS ns, (SELECT sum(cnt) FROM th) AS nt),
sv AS (SELECT dn, CAST(sum(cnt) OVER (ORDER BY dn) * nt AS BIGINT) AS v FROM sh, n), tv AS (SELECT dn, CAST(sum(cnt) OVER (ORDER BY dn) * ns AS BIGINT) AS v FROM th, n UNION ALL SELECT 0, 0),
near AS (SELECT sv.dn, sv.v, b.dn AS bdn, b.v AS bv, a.dn AS adn, a.v AS av FROM sv ASOF LEFT JOIN tv b ON sv.v > b.v ASOF LEFT JOIN tv a ON sv.v <= a.v),
lut AS (SELECT dn, CASE WHEN av IS NOT NULL AND av - v < v - bv THEN adn ELSE bdn END AS out FROM near),
g AS (SELECT """
    + ", ".join(f"regr_slope({b}, s) AS g_{b}" for b in BANDS)
    + """ FROM y)
SELECT px.pid, px.row_i, px.col_i, """
    + ", ".join(f"CAST(CASE WHEN y.pid IS NULL THEN 0 ELSE greatest(0, least(65535, round_even(y.{b} + g_{b} * (out - s), 0))) END AS BIGINT) AS {b}" for b in BANDS)
    + " FROM px CROSS JOIN g LEFT JOIN y ON y.pid = px.pid LEFT JOIN lut ON lut.dn = y.pan16"
)


#: SQL that other queries' results equal too.
ORACLES_OF = {"c04": _MASKED + ", y AS (SELECT * FROM v)" + _SHARPENED}


@register("c04_gram_schmidt", ORACLES_OF["c04"])
def c04(spark, d):
    return pansharpen.pansharpen(px(spark, d), "pan16", BANDS, KEYS)


@register("c05_adaptive_gram_schmidt", _MASKED + _WEIGHTS + ", y AS (SELECT pid, pan16, b1, b2, b3, w1 * b1 + w2 * b2 + w3 * b3 + c AS s FROM v, w)" + _SHARPENED)
def c05(spark, d):
    return pansharpen.pansharpen(px(spark, d), "pan16", BANDS, KEYS, adaptive=True)


@register("a06_raster_moments", _RASTERS + " SELECT raster_id, CAST(count(*) AS BIGINT) AS n, round(avg(b1), 6) AS mean_b1, round(stddev_pop(b1), 6) AS dev_b1 FROM rasters WHERE b1 > 0 GROUP BY raster_id")
def a06(spark, d):
    m = color.raster_moments(rasters(spark, d), ["b1"])
    return m.select("raster_id", "n", F.round("mean_b1", 6).alias("mean_b1"), F.round("dev_b1", 6).alias("dev_b1"))


@register("j01_overlap_pairs", _RASTERS + ", e AS (SELECT raster_id, min(row_i) AS r0, max(row_i) AS r1, min(col_i) AS c0, max(col_i) AS c1 FROM rasters GROUP BY raster_id) SELECT a.raster_id AS a, b.raster_id AS b FROM e a JOIN e b ON a.raster_id < b.raster_id AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1")
def j01(spark, d):
    return color.overlap_pairs(color.extents(rasters(spark, d)))


@register("a07_overlap_moments", _RASTERS + " SELECT x.raster_id AS a, y.raster_id AS b, CAST(count(*) AS BIGINT) AS n, round(avg(x.b1), 6) AS mean_a_b1, round(stddev_pop(x.b1), 6) AS dev_a_b1, round(avg(y.b1), 6) AS mean_b_b1, round(stddev_pop(y.b1), 6) AS dev_b_b1 FROM rasters x JOIN rasters y ON x.row_i = y.row_i AND x.col_i = y.col_i AND x.raster_id < y.raster_id WHERE x.b1 > 0 AND y.b1 > 0 GROUP BY 1, 2")
def a07(spark, d):
    m = color.overlap_moments(rasters(spark, d), ["b1"])
    return m.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in m.columns if c.startswith(("mean", "dev"))])


_CELLS = _RASTERS + ", g AS (SELECT raster_id, CAST(floor(row_i / 10) AS BIGINT) AS gr, CAST(floor(col_i / 10) AS BIGINT) AS gc, CAST(count(*) AS BIGINT) AS n, greatest(1, least(255, avg(b1))) AS mean FROM rasters WHERE b1 > 0 GROUP BY 1, 2, 3)"


@register("a08_cell_means", _CELLS + " SELECT raster_id, gr, gc, n, round(mean, 6) AS mean FROM g")
def a08(spark, d):
    return color.cell_means(rasters(spark, d), "b1", 10).withColumn("mean", F.round("mean", 6))


@register("a09_global_means", _CELLS + " SELECT gr, gc, round(sum(mean * n) / sum(n), 6) AS mean FROM g GROUP BY gr, gc")
def a09(spark, d):
    return color.global_means(color.cell_means(rasters(spark, d), "b1", 10)).withColumn("mean", F.round("mean", 6))


@register("a10_greatest_mean", _CELLS + " SELECT round(max(m), 6) AS top FROM (SELECT sum(mean * n) / sum(n) AS m FROM g GROUP BY gr, gc)")
def a10(spark, d):
    return color.global_means(color.cell_means(rasters(spark, d), "b1", 10)).agg(F.round(F.max("mean"), 6).alias("top"))


@register("a11_extents", _RASTERS + " SELECT raster_id, min(row_i) AS r0, max(row_i) AS r1, min(col_i) AS c0, max(col_i) AS c1 FROM rasters GROUP BY raster_id")
def a11(spark, d):
    return color.extents(rasters(spark, d))


def _gains_sql(b: str) -> str:
    """Gains of the two fixture rasters in closed form: offsets are put in terms of gains, which leaves two equations."""
    return f"""
v_{b} AS (SELECT avg({b}) FILTER (raster_id = 1) AS m1, stddev_pop({b}) FILTER (raster_id = 1) AS d1, avg({b}) FILTER (raster_id = 2) AS m2, stddev_pop({b}) FILTER (raster_id = 2) AS d2 FROM rasters WHERE b1 > 0),
u_{b} AS (SELECT m1, d1, m2, d2, p1 - m1 AS p, p2 - m2 AS q, m1 - m2 AS c, e1, e2 FROM v_{b}, (SELECT avg(x.{b}) AS p1, stddev_pop(x.{b}) AS e1, avg(y.{b}) AS p2, stddev_pop(y.{b}) AS e2 FROM rasters x JOIN rasters y USING (row_i, col_i) WHERE x.raster_id = 1 AND y.raster_id = 2 AND x.b1 > 0 AND y.b1 > 0)),
t_{b} AS (SELECT *, p * p / 5 + e1 * e1 + d1 * d1 / 2 AS aa, -p * q / 5 - e1 * e2 AS ab, q * q / 5 + e2 * e2 + d2 * d2 / 2 AS bb, d1 * d1 / 2 - p * c / 5 AS ra, d2 * d2 / 2 + q * c / 5 AS rb FROM u_{b}),
s_{b} AS (SELECT *, (ra * bb - rb * ab) / (aa * bb - ab * ab) AS g1, (rb * aa - ra * ab) / (aa * bb - ab * ab) AS g2 FROM t_{b}),
a_{b} AS (SELECT 1 AS raster_id, g1 AS gain, m1 - m1 * g1 - (c + p * g1 - q * g2) * 2 / 5 AS off FROM s_{b} UNION ALL SELECT 2, g2, m2 - m2 * g2 + (c + p * g1 - q * g2) * 2 / 5 FROM s_{b})"""


def _balance_sql(bands: list[str], cell: int = 10) -> str:
    """CTEs ending in ``even``: every fixture raster balanced, its means and the common ones interpolated at each pixel."""
    out = _RASTERS
    for b in bands:
        out += f""",{_gains_sql(b)},
l_{b} AS (SELECT raster_id, row_i // {cell} AS gr, col_i // {cell} AS gc, count(*) AS n, greatest(1, least(255, avg({b}))) AS mean FROM rasters WHERE {b} > 0 GROUP BY 1, 2, 3),
w_{b} AS (SELECT gr, gc, sum(mean * n) / sum(n) AS mean FROM l_{b} GROUP BY gr, gc),
k_{b} AS (SELECT x.raster_id, row_i, col_i, {b} AS v, sum(h * l.mean) / sum(CASE WHEN l.mean IS NOT NULL THEN h END) AS r, sum(h * w.mean) / sum(CASE WHEN w.mean IS NOT NULL THEN h END) AS g FROM (
SELECT raster_id, row_i, col_i, {b}, row_i // {cell} + kr AS gr, col_i // {cell} + kc AS gc, (CASE WHEN kr = 1 THEN row_i / CAST({cell} AS DOUBLE) - row_i // {cell} ELSE 1 - (row_i / CAST({cell} AS DOUBLE) - row_i // {cell}) END) * (CASE WHEN kc = 1 THEN col_i / CAST({cell} AS DOUBLE) - col_i // {cell} ELSE 1 - (col_i / CAST({cell} AS DOUBLE) - col_i // {cell}) END) AS h
FROM rasters, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS z(kr, kc)) x LEFT JOIN l_{b} l ON l.raster_id = x.raster_id AND l.gr = x.gr AND l.gc = x.gc LEFT JOIN w_{b} w ON w.gr = x.gr AND w.gc = x.gc WHERE h > 0 GROUP BY 1, 2, 3, 4),
y_{b} AS (SELECT k.raster_id, row_i, col_i, v, v * gain + off AS lin, r / top AS r, g / top AS g, top FROM k_{b} k JOIN a_{b} USING (raster_id), (SELECT max(mean) AS top FROM w_{b})),
z_{b} AS (SELECT raster_id, row_i, col_i, CAST(CASE WHEN v = 0 THEN 0 WHEN lin < 0 THEN 1 ELSE round(greatest(1, least(255, pow(greatest(lin, 0) / top, CASE WHEN r > 0 AND r <> 1 AND g > 0 THEN ln(g) / ln(r) ELSE 1 END) * top))) END AS BIGINT) AS {b} FROM y_{b})"""
    joins = "".join(f" JOIN z_{b} USING (raster_id, row_i, col_i)" for b in bands[1:])
    return out + f", even AS (SELECT raster_id, row_i, col_i, {', '.join(bands)} FROM z_{bands[0]}{joins})"


ORACLES_OF["balance"], ORACLES_OF["balance_b1"] = _balance_sql(BANDS), _balance_sql(["b1"])


@register("a17_gain_solution", _RASTERS + "," + _gains_sql("b1") + " SELECT raster_id, round(gain, 6) AS gain, round(off, 4) AS off FROM a_b1")
def a17(spark, d):
    r = rasters(spark, d)
    got = color.solve_gains(color.raster_moments(r, ["b1"]), color.overlap_moments(r, ["b1"]), ["b1"])
    return got.select("raster_id", F.round("a_b1", 6).alias("gain"), F.round("o_b1", 4).alias("off"))


@register("c03_color_balance", ORACLES_OF["balance"] + " SELECT * FROM even")
def c03(spark, d):
    r = rasters(spark, d)
    return color.apply(r, color.fit(r, BANDS, 10), ["raster_id", "row_i", "col_i"])


_HALF = """, p AS (SELECT pid AS id, col_i / CAST(2.0 AS DOUBLE) + 0.25 - 0.5 AS x, row_i / CAST(2.0 AS DOUBLE) + 0.25 - 0.5 AS y FROM px),
k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(r, c)),
s AS (SELECT id, (CASE WHEN r = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, b1 FROM p JOIN k ON true LEFT JOIN px ON px.row_i = CAST(floor(y) AS BIGINT) + r AND px.col_i = CAST(floor(x) AS BIGINT) + c AND b1 > 0)
SELECT id, round(CASE WHEN sum(CASE WHEN b1 IS NOT NULL THEN w END) > 0 THEN sum(w * b1) / sum(CASE WHEN b1 IS NOT NULL THEN w END) ELSE 0 END, 6) AS v FROM s GROUP BY id"""


@register("j10_coregistration", _PX + _HALF)
def j10(spark, d):
    """A coarse band on a grid twice as fine, by the geotransform between them."""
    grid = px(spark, d).select(F.col("pid").alias("id"), "row_i", "col_i")
    return stencils.resample(px(spark, d), "b1", grid, (0.0, 0.5, 0.0, 0.0, 0.0, 0.5)).select("id", F.round("v", 6).alias("v"))


@register("j14_balanced_overlay", ORACLES_OF["balance_b1"] + " SELECT row_i, col_i, arg_max(b1, raster_id) AS b1 FROM even WHERE b1 > 0 GROUP BY row_i, col_i")
def j14(spark, d):
    """Rasters balanced, then laid over each other."""
    from .operators import mosaic

    r = rasters(spark, d)
    even = color.apply(r, color.fit(r, ["b1"], 10), ["raster_id", "row_i", "col_i"])
    whole = r.select(F.col("raster_id").cast("long").alias("geom_id"), "row_i", "col_i")
    return mosaic.overlay_raster(even, whole, ["b1"])
