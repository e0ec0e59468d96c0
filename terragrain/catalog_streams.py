"""Queries of incremental operators, run as streams over arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import register
from .catalog_pixels import BANDS, KEYS, _CUTS, _STRETCHED, px
from .fixtures import ctes, view
from .plans.lineage import shared_folder
from .streaming import incremental as inc


@register("t06_streamed_statistics", _CUTS + _STRETCHED)
def t06(spark, d):
    """A histogram gathered by a stream, then applied."""
    from .operators import stretch

    hist = inc.streamed_histogram(px(spark, d), BANDS, files=4)
    return stretch.apply_points(px(spark, d), BANDS, stretch.clip_points(hist, 0.005, 0.005), KEYS)


@register("t01_incremental_mosaic", ctes("cells") + " SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY row_i, col_i")
def t01(spark, d):
    """Polygons added one batch after another; the later takes its region."""
    return inc.streamed_mosaic(view(spark, d, "cells"), batches=4)


@register("t03_skip_processed", ctes("cells") + " SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY row_i, col_i")
def t03(spark, d):
    """Inputs that arrive twice change nothing."""
    return inc.streamed_mosaic(view(spark, d, "cells"), batches=3, twice=True)


@register("t02_restart", ctes("cells") + " SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY row_i, col_i")
def t02(spark, d):
    """The stream stops after each batch and goes on from its saved state."""
    return inc.streamed_mosaic(view(spark, d, "cells"), batches=3, restart=True)


@register("t04_snapshots", ctes("cells") + " SELECT row_i, col_i, max(geom_id) AS owner FROM cells GROUP BY row_i, col_i")
def t04(spark, d):
    """The state is exported after every batch; the last export is the mosaic."""
    exports: list[str] = []
    inc.streamed_mosaic(view(spark, d, "cells"), batches=3, snapshot=1, exports=exports)
    return inc.restored_mosaic(spark, exports[-1])


@register("k11_periodic_export", ctes("cells") + ", q AS (SELECT quantile_disc(geom_id, 0.25) AS a, quantile_disc(geom_id, 0.75) AS b FROM cells), m AS (SELECT 0 AS version, row_i, col_i FROM cells, q WHERE geom_id <= a UNION SELECT 2, row_i, col_i FROM cells, q WHERE geom_id <= b) SELECT version, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY version")
def k11(spark, d):
    """What each export holds when every second of four batches is exported."""
    exports: list[str] = []
    inc.streamed_mosaic(view(spark, d, "cells"), batches=4, snapshot=2, exports=exports)
    out = None
    for path in exports:
        one = inc.restored_mosaic(spark, path).agg(F.count("*").alias("n")).select(F.lit(int(path.rsplit("/", 1)[1])).alias("version"), "n")
        out = one if out is None else out.union(one)
    return out


@register("ext_tumbling_window", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))) AS BIGINT) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    """Extension: event-time windows over the events, read as a stream."""
    e, path = view(spark, d, "events").select("ts", "event_type"), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e.repartitionByRange(4, "ts").write.parquet(path)  # files that arrive one after another
    return inc.streamed_windows(spark, path, e.schema, "1 hour")
