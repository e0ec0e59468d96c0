"""Queries of names, dates, ordering, look-ups, text and JSON functions, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register
from .catalog_pixels import ORACLES_OF
from .fixtures import ctes, view
from .operators import records as r
from .plans.lineage import cut

_I = ctes("raster_info")


def info(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "raster_info")


@register("f11_date_in_name", _I + " SELECT rid, CAST(strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS INTEGER) * CAST(year(o_orderdate) >= 2000 AS INTEGER) AS date FROM raster_info JOIN orders ON o_orderkey = rid")
def f11(spark, d):
    return info(spark, d).select("rid", r.date_of(F.col("path")).alias("date"))


@register("f12_name_parts", _I + " SELECT rid, string_split(path, '/')[-1] AS name, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, regexp_extract(path, '\\.([^.]*)$', 1) AS ext FROM raster_info")
def f12(spark, d):
    p = F.col("path")
    return info(spark, d).select("rid", r.file_name(p).alias("name"), r.stem(p).alias("stem"), r.extension(p).alias("ext"))


@register("f14_suffix_match", _I + " SELECT rid, regexp_matches(path, '^.*[05]\\.tif$') AS hit FROM raster_info")
def f14(spark, d):
    return info(spark, d).select("rid", F.col("path").rlike(r"^.*[05]\.tif$").alias("hit"))


@register("f13_code_pages", _I + " SELECT rid, path AS back, CAST(octet_length(encode(path)) + 4 AS INTEGER) AS bytes FROM raster_info")
def f13(spark, d):
    """Names through code page GBK and back."""
    text = F.concat(F.lit("影像"), F.col("path"))
    coded = info(spark, d).select("rid", r.to_gbk(text).alias("raw"))
    return coded.select("rid", F.substring(r.from_gbk("raw"), 3, 1000).alias("back"), F.octet_length("raw").alias("bytes"))


@register("f19_json", _I + " SELECT rid, concat('{\"rid\":', rid, ',\"reso\":', reso_cm, '}') AS js, reso_cm AS reso FROM raster_info")
def f19(spark, d):
    js = info(spark, d).select("rid", F.to_json(F.struct("rid", F.col("reso_cm").alias("reso"))).alias("js"))
    return js.select("rid", "js", F.from_json("js", "rid long, reso long").getField("reso").alias("reso"))


@register("f21_timestamp_text", "SELECT o_orderkey AS rid, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d_%H-%M-%S') AS t FROM orders")
def f21(spark, d):
    return view(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss").alias("t"))


@register("k10_drivers", _I + " SELECT rid, 'GTiff' AS raster, CAST(NULL AS VARCHAR) AS vector, 'Memory' AS in_memory FROM raster_info")
def k10(spark, d):
    return info(spark, d).select("rid", r.raster_driver(F.col("path")).alias("raster"), r.vector_driver(F.col("path")).alias("vector"), r.vector_driver(F.lit("")).alias("in_memory"))


@register("k12_name_list", _I + " SELECT string_split(path, '/')[-1] AS name FROM raster_info")
def k12(spark, d):
    return info(spark, d).select(r.file_name(F.col("path")).alias("name"))


@register("s12_extension_filter", "SELECT page_id, url AS path FROM pages WHERE regexp_matches(regexp_extract(string_split(url, '/')[-1], '\\.([^.]*)$', 1), '^(html|htm|php|com)$')")
def s12(spark, d):
    return r.with_rasters(view(spark, d, "pages").select("page_id", F.col("url").alias("path")), "^(html|htm|php|com)$")


@register("s13_suffix_discovery", _I + " SELECT path FROM raster_info WHERE regexp_matches(path, '.*7\\.tif$')")
def s13(spark, d):
    return info(spark, d).where(F.col("path").rlike(r".*7\.tif$")).select("path")


@register("s14_sidecars", _I + ", f AS (SELECT path FROM raster_info UNION ALL SELECT replace(path, '.tif', '_mask.tif') FROM raster_info WHERE rid % 3 = 0) SELECT path, CASE WHEN NOT contains(path, '_mask') AND CAST(regexp_extract(path, '_([0-9]+)\\.tif', 1) AS INTEGER) % 3 = 0 THEN replace(path, '.tif', '_mask.tif') END AS sidecar FROM f")
def s14(spark, d):
    i = info(spark, d)
    files = i.select("path").union(i.where("rid % 3 = 0").select(F.regexp_replace("path", r"\.tif$", "_mask.tif")))
    return r.sidecars(files)


@register("s17_border_scan", ctes("rects") + " SELECT geom_id, concat('border_', CAST(geom_id AS VARCHAR)) AS name FROM rects")
def s17(spark, d):
    return view(spark, d, "rects").select("geom_id", F.concat(F.lit("border_"), F.col("geom_id").cast("string")).alias("name"))


@register("j22_row_to_mask", _I + " SELECT rid, replace(string_split(path, '/')[-1], '.tif', '_cloud.shp') AS mask FROM raster_info WHERE rid % 4 = 0")
def j22(spark, d):
    i = info(spark, d)
    masks = i.where("rid % 4 = 0").select(F.concat(r.stem(F.col("path")), F.lit("_cloud.shp")).alias("mask"))
    return i.withColumn("mask", F.concat(r.stem(F.col("path")), F.lit("_cloud.shp"))).join(masks, "mask", "left_semi").select("rid", "mask")


@register("j07_attribute_lookup", _I + ", q AS (SELECT string_split(path, '/')[-1] AS name, max(concat('v', CAST(reso_cm AS VARCHAR))) AS v FROM raster_info WHERE rid % 2 = 0 GROUP BY 1) SELECT rid, coalesce(q.v, 'none') AS v FROM raster_info LEFT JOIN q ON q.name = string_split(path, '/')[-1]")
def j07(spark, d):
    rows = info(spark, d).select("rid", r.file_name(F.col("path")).alias("name"))
    query = info(spark, d).where("rid % 2 = 0").select(r.file_name(F.col("path")).alias("name"), F.concat(F.lit("v"), F.col("reso_cm").cast("string")).alias("v"), F.col("rid").alias("ord"))
    return r.lookup_by_name(rows, query, "v", "none").select("rid", "v")


@register("j08_skip_done", _I + " SELECT rid, path FROM raster_info WHERE rid % 5 <> 0")
def j08(spark, d):
    done = info(spark, d).where("rid % 5 = 0").select(F.concat(F.lit("elsewhere/"), r.file_name(F.col("path"))).alias("path"))
    return r.unprocessed(info(spark, d).select("rid", "path"), done)


@register("j09_index_or_none", _I + " SELECT rid, CASE WHEN rid % 3 = 0 THEN CAST(rid // 3 AS BIGINT) ELSE -1 END AS idx FROM raster_info")
def j09(spark, d):
    rows = info(spark, d).select("rid", r.file_name(F.col("path")).alias("name"))
    listed = rows.where("rid % 3 = 0").select("name", F.floor(F.col("rid") / 3).alias("idx"))
    return r.index_by_name(rows, listed).select("rid", "idx")


@register("j21_align_fields", _I + " SELECT rid AS k, reso_cm AS reso, CAST(NULL AS VARCHAR) AS path FROM raster_info WHERE rid % 2 = 0 UNION ALL SELECT rid, NULL, path FROM raster_info WHERE rid % 2 = 1")
def j21(spark, d):
    i = info(spark, d)
    return r.later_wins(i.where("rid % 2 = 0").select(F.col("rid").alias("k"), F.col("reso_cm").alias("reso")), i.where("rid % 2 = 1").select(F.col("rid").alias("k"), "path"), ["k"])


_CLASS = "CAST(floor(round(ln(reso_cm / CAST(100.0 AS DOUBLE)) / ln(1 / CAST(0.9 AS DOUBLE)), 9)) AS BIGINT)"


@register("o01_raster_order", _I + f", k AS (SELECT path, reso_cm, {_CLASS} AS cls, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS date FROM raster_info JOIN orders ON o_orderkey = rid), z AS (SELECT path, reso_cm, cls, CASE WHEN date >= 20000000 THEN date ELSE 0 END AS date FROM k) SELECT CAST(row_number() OVER (ORDER BY cls, date = 0, -date, reso_cm, path) - 1 AS BIGINT) AS ord, path FROM z")
def o01(spark, d):
    i = info(spark, d).select("path", (F.col("reso_cm") / 100).alias("reso"), r.date_of(F.col("path")).alias("date"))
    return r.numbered(i, r.processing_order(F.col("reso"), F.col("date"), F.col("path"))).select("ord", "path")


@register("o02_custom_order", _I + " SELECT CAST(row_number() OVER (ORDER BY reso_cm, path) - 1 AS BIGINT) AS ord, path FROM raster_info")
def o02(spark, d):
    """An order of the caller's: by resolution, then path."""
    return r.numbered(info(spark, d).select("path", "reso_cm"), [F.col("reso_cm"), F.col("path")]).select("ord", "path")


@register("p17_truncation", _I + ", t AS (SELECT rid, 1 + rid % 5 AS n, rid % 4 AS lo, rid % 3 AS hi FROM raster_info) SELECT rid, CASE WHEN lo + hi >= n THEN n - 1 - least(hi, n - 1) ELSE lo END AS low, CASE WHEN lo + hi >= n THEN least(hi, n - 1) ELSE hi END AS high FROM t")
def p17(spark, d):
    rid = F.col("rid")
    low, high = r.clamp_truncation(1 + rid % 5, rid % 4, rid % 3)
    return info(spark, d).select("rid", low.alias("low"), high.alias("high"))


@register("p16_argument_check", _I + " SELECT rid, regexp_matches(path, '\\.tif$') AND reso_cm > 85 AS ok FROM raster_info")
def p16(spark, d):
    return info(spark, d).select("rid", (r.raster_driver(F.col("path")).isNotNull() & (F.col("reso_cm") > 85)).alias("ok"))


@register("p12_empty_holes", ctes("rects") + " SELECT geom_id, 2 AS rings FROM rects")
def p12(spark, d):
    """Rings of boxes with one real and one empty hole; the empty one goes."""
    from .operators.cells import box_ring, drop_empty_holes

    b = view(spark, d, "rects")
    c = F.col
    rings = F.array(box_ring(c("r0"), c("c0"), c("r0") + c("h"), c("c0") + c("w")), box_ring(c("r0") + 1, c("c0") + 1, c("r0") + 2, c("c0") + 2), box_ring(c("r0") + 1, c("c0") + 1, c("r0") + 1, c("c0") + 2))
    return b.select("geom_id", F.size(drop_empty_holes(rings)).alias("rings"))


def _shared(spark: SparkSession) -> str:
    """A fresh folder under the shared one that the session names."""
    from .plans.lineage import shared_folder

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@register("k06_export_vector", ctes("rects") + " SELECT geom_id, concat('GF2_', CAST(geom_id AS VARCHAR), '.tif') AS name FROM rects")
def k06(spark, d):
    """Polygons with their names as WKB, written and read back."""
    from .functions.wkb import polygon_from_wkb, polygon_to_wkb
    from .operators.cells import box_ring

    c = F.col
    rows = view(spark, d, "rects").select("geom_id", F.concat(F.lit("GF2_"), c("geom_id").cast("string"), F.lit(".tif")).alias("name"), F.array(box_ring(c("r0"), c("c0"), c("r0") + c("h"), c("c0") + c("w"))).alias("rings"))
    path = _shared(spark)
    rows.select("geom_id", "name", polygon_to_wkb("rings").alias("geom")).write.parquet(path)
    back = spark.read.parquet(path).withColumn("rings", polygon_from_wkb("geom"))
    return back.where("size(rings[0]) = 5").select("geom_id", "name")


@register("s01_raster_source", ctes("px") + " SELECT CAST(row_i AS BIGINT) AS row_i, CAST(col_i AS BIGINT) AS col_i, b1, b2 FROM px")
def s01(spark, d):
    """Pixels written as GeoTIFF and read back through the raster source."""
    from .sources.geotiff import read_geotiff, write_geotiff

    p = view(spark, d, "px").select(F.lit(7).alias("raster_id"), "row_i", "col_i", "b1", "b2")
    path = _shared(spark)
    write_geotiff(p, path, ["b1", "b2"], dtype="uint8", origin=(100.0, 200.0), size=(0.5, -0.5))
    return read_geotiff(spark, path).select("row_i", "col_i", "b1", "b2")


def rpb_texts(spark, d):
    """(path, value): a model text for every image of the fixture, its numbers from the image's."""
    from .sources.rpb import SCALARS, VECTORS

    k = F.col("geom_id")
    lines = [F.concat(F.lit(f"    {name} = "), F.format_string("%d", n), F.lit(";\n")) for name, n in zip(SCALARS, _rpb_scalars(k), strict=True)]
    for v, name in enumerate(VECTORS):
        numbers = _rpb_numbers(k, v)
        lines.append(F.concat(F.lit(f"    {name} = (\n"), F.array_join(numbers, ",\n"), F.lit(");\n")))
    return view(spark, d, "rects").select(F.concat(F.lit("GF2_"), k.cast("string"), F.lit(".rpb")).alias("path"), F.concat(F.lit("BEGIN_GROUP = IMAGE\n"), *lines, F.lit("END_GROUP = IMAGE\nEND;\n")).alias("value"))


def _rpb_numbers(k, v: int):
    """The twenty coefficients of vector v as text, by the rule of ``_rpb_coefficient``."""
    number = lambda i: F.when(i == _LEAD[v], 10_000).when(i < 3, 0).otherwise((k * 37 + (20 * v + i) * 11) % 19 - 9)
    return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("        "), number(i).cast("string"), F.lit("e-4")))


#: Which coefficient of each vector is one.
_LEAD = (2, 0, 1, 0)


def _rpb_scalars(k):
    """Twelve whole numbers of an image, in the order of the text."""
    return [k * 0 + 1, k * 0, 5000 + k, 6000 + k % 7, k * 0 + 23, k * 0 + 113, 40 + k % 5, k * 0 + 5000, k * 0 + 6000, k * 0 + 2, k * 0 + 3, k * 0 + 500]


def _rpb_coefficient(k, v: int, i: int):
    """Coefficient i of vector v in ten-thousandths: one leads, the others are small."""
    return k * 0 + 10_000 if i == _LEAD[v] else k * 0 if i < 3 else (k * 37 + (20 * v + i) * 11) % 19 - 9


class _Sql(str):
    """SQL text of a whole number, put together like a column."""

    def _with(self, sign, other, turned=False):
        a, b = (other, self) if turned else (self, other)
        return _Sql(f"({a} {sign} {b})")

    __add__ = lambda self, o: self._with("+", o)
    __radd__ = lambda self, o: self._with("+", o, True)
    __sub__ = lambda self, o: self._with("-", o)
    __mul__ = lambda self, o: self._with("*", o)
    __mod__ = lambda self, o: self._with("%", o)


def _rpb_sql() -> tuple[str, str]:
    """What the parser finds in every text, and the projection of the query's points, spelled out."""
    from .sources.rpb import SCALARS, VECTORS

    k = _Sql("k")
    scalars = dict(zip(SCALARS, _rpb_scalars(k), strict=True))
    rows = [f"('{SCALARS[n]}', CAST({v} AS VARCHAR))" for n, v in scalars.items()]
    rows += [f"('{n}', concat_ws(' ', {', '.join(f"concat({_rpb_coefficient(k, v, i)}, 'e-4')" for i in range(20))}))" for v, n in enumerate(VECTORS.values())]
    found = ctes("rects") + ", m AS (SELECT geom_id AS k FROM rects) SELECT concat('GF2_', k, '.rpb') AS path, x.name AS name, x.value AS value FROM (SELECT k, unnest([" + ", ".join(f"{{'name': {r[1 : r.index(',')]}, 'value': {r[r.index(',') + 2 : -1]}}}" for r in rows) + "]) AS x FROM m)"
    num = lambda n: f"CAST({scalars[n]} AS DOUBLE)"
    terms = ["1", "x", "y", "z", "x * y", "x * z", "y * z", "x * x", "y * y", "z * z", "x * y * z", "x * x * x", "x * y * y", "x * z * z", "x * x * y", "y * y * y", "y * z * z", "x * x * z", "y * y * z", "z * z * z"]
    cubic = lambda v: "(" + " + ".join(f"{_rpb_coefficient(k, v, i)} / CAST(10000 AS DOUBLE) * {t}" for i, t in enumerate(terms)) + ")"
    points = ctes("dem") + ", p AS (SELECT pid, pid % (SELECT count(*) FROM supplier) AS k, 112 + pid % 50 / CAST(25 AS DOUBLE) AS lon, 22 + pid // 50 % 40 / CAST(20 AS DOUBLE) AS lat, elev AS h FROM dem)"
    placed = f"SELECT pid, k, (lon - {num('longOffset')}) / {num('longScale')} AS x, (lat - {num('latOffset')}) / {num('latScale')} AS y, (h - {num('heightOffset')}) / {num('heightScale')} AS z FROM p"
    project = f"{points} SELECT pid, round({cubic(0)} / {cubic(1)} * {num('lineScale')} + {num('lineOffset')}, 4) AS line, round({cubic(2)} / {cubic(3)} * {num('sampScale')} + {num('sampOffset')}, 4) AS sample FROM ({placed})"
    return found, project


_RPB = _rpb_sql()


@register("s08_rpb_parser", _RPB[0])
def s08(spark, d):
    """The sixteen fields of every image's model text."""
    from .sources.rpb import parse_rpb

    return parse_rpb(rpb_texts(spark, d)).select("path", F.explode("rpc").alias("name", "value"))


@register("f10_rpc_transform", _RPB[1])
def f10(spark, d):
    """Ground points with heights from the elevation grid, each in the image of its own model."""
    from .sources.rpb import parse_rpb, rpc_project

    images = view(spark, d, "supplier").count()
    p = view(spark, d, "dem").select("pid", F.concat(F.lit("GF2_"), (F.col("pid") % images).cast("string"), F.lit(".rpb")).alias("path"), (112 + F.col("pid") % 50 / 25).alias("lon"), (22 + F.floor(F.col("pid") / 50) % 40 / 20).alias("lat"), F.col("elev").alias("h"))
    return rpc_project(p, cut(parse_rpb(cut(rpb_texts(spark, d)))), "path").select("pid", F.round("line", 4).alias("line"), F.round("sample", 4).alias("sample"))


@register("s10_model_import", ORACLES_OF["balance_b1"] + " SELECT raster_id, row_i, col_i, b1 FROM even")
def s10(spark, d):
    """A balancing model written as JSON and read again."""
    from .operators import color
    from .sources.model_json import read_model, write_model

    rasters, path = view(spark, d, "rasters"), _shared(spark)
    write_model(color.fit(rasters, ["b1"], 10), path)
    return color.apply(rasters, read_model(spark, path), ["raster_id", "row_i", "col_i"])


@register("s11_field_mapping", ctes("rects") + " SELECT geom_id AS fid, h AS height FROM rects")
def s11(spark, d):
    """Columns renamed by a JSON list of [source, target] pairs."""
    from .sources.model_json import renamed

    return renamed(view(spark, d, "rects"), '[["geom_id", "fid"], ["h", "height"]]')
