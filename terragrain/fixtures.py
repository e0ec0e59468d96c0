"""Raster and vector fixtures as views over the relational test tables.

The same SQL runs in Spark and in DuckDB: ``view`` gives a DataFrame,
``ctes`` the WITH clause that an equivalent DuckDB query starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("orders", "lineitem", "part", "supplier", "events", "pages", "embeddings", "customer")

VIEWS = {
    "li": "SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS q, CAST(COUNT(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_orderkey",
    "px": """SELECT o_orderkey AS pid, CAST(FLOOR(o_orderkey / 100) AS BIGINT) AS row_i, CAST(o_orderkey % 100 AS BIGINT) AS col_i,
 CASE WHEN q IS NULL THEN 0 ELSE CAST(q % 256 AS BIGINT) END AS b1,
 CASE WHEN q IS NULL THEN 0 ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 256 AS BIGINT) END AS b2,
 CASE WHEN q IS NULL THEN 0 ELSE CAST((n * 37 + o_custkey) % 256 AS BIGINT) END AS b3,
 CASE WHEN q IS NULL THEN 0 ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 65536 AS BIGINT) END AS pan16
FROM {orders} LEFT JOIN {li} ON o_orderkey = l_orderkey""",
    "rasters": """SELECT 1 AS raster_id, row_i, col_i, b1, b2, b3 FROM {px} WHERE col_i < 70
UNION ALL SELECT 2 AS raster_id, row_i, col_i,
 CASE WHEN b1=0 THEN 0 ELSE CAST(FLOOR(b1*4/5) AS BIGINT)+20 END AS b1, CASE WHEN b2=0 THEN 0 ELSE CAST(FLOOR(b2*4/5) AS BIGINT)+20 END AS b2, CASE WHEN b3=0 THEN 0 ELSE CAST(FLOOR(b3*4/5) AS BIGINT)+20 END AS b3
FROM {px} WHERE col_i >= 30""",
    "dem": "SELECT p_partkey AS pid, CAST(FLOOR(p_partkey / 50) AS BIGINT) AS row_i, CAST(p_partkey % 50 AS BIGINT) AS col_i, p_retailprice AS elev FROM {part}",
    "rects": "SELECT s_suppkey AS geom_id, CAST((s_suppkey*7) % 10 AS BIGINT) AS r0, CAST((s_suppkey*13) % 80 AS BIGINT) AS c0, CAST(3 + s_suppkey % 4 AS BIGINT) AS h, CAST(5 + s_suppkey % 11 AS BIGINT) AS w FROM {supplier}",
    "cells": "SELECT geom_id, row_i, col_i FROM {rects} JOIN {px} ON row_i >= r0 AND row_i < r0 + h AND col_i >= c0 AND col_i < c0 + w",
    "raster_info": """SELECT o_orderkey AS rid, concat('dir/GF2_', CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS STRING), '_', CAST(o_orderkey AS STRING), '.tif') AS path,
 CAST(80 + (o_orderkey % 5) * 5 AS BIGINT) AS reso_cm FROM {orders}""",
    "samples": "SELECT user_id AS seg_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, value AS elev FROM {events}",
}

USES = {"li": ["lineitem"], "px": ["orders", "li"], "rasters": ["px"], "dem": ["part"], "rects": ["supplier"], "cells": ["rects", "px"], "raster_info": ["orders"], "samples": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a fixture view of a table folder."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "cells":
        return _cells(view(spark, sf_dir, "rects"), view(spark, sf_dir, "px"))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in USES[name]})


def _cells(rects: DataFrame, px: DataFrame) -> DataFrame:
    """The ``cells`` view as an equi-join: each box lists its cells, where SQL's ranges would pair all boxes with all pixels.

    It is hinted as a merge: Spark estimates the listed cells by the few boxes, and would broadcast them.
    """
    side = lambda start, n: F.explode(F.when(F.col(n) > 0, F.sequence(F.col(start), F.col(start) + F.col(n) - 1)))
    listed = rects.select("geom_id", "c0", "w", side("r0", "h").alias("row_i")).select("geom_id", "row_i", side("c0", "w").alias("col_i"))
    return listed.hint("merge").join(px.select("row_i", "col_i"), ["row_i", "col_i"]).select("geom_id", "row_i", "col_i")


def ctes(*names: str) -> str:
    """``WITH`` clause of the named views and what they use, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for used in USES.get(name, ()):
            add(used)
        if name in VIEWS and name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{u: u for u in USES[n]})})" for n in done)
