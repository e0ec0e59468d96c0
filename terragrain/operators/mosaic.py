"""Mosaics as ownership tables: (row_i, col_i, owner) with one owner a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import CELL, centroid, components, nearest_site


def update(mosaic: DataFrame, region: DataFrame, owner: int) -> DataFrame:
    """The new image takes its region; old owners keep the difference."""
    taken = region.select(*CELL).distinct()
    return mosaic.join(taken, CELL, "left_anti").select(*CELL, "owner").union(taken.withColumn("owner", F.lit(owner).cast(mosaic.schema["owner"].dataType)))


def seam_region(labels: DataFrame, subtasks: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cells of the greatest part of label 1, and of the greatest parts of label 0, one at least."""
    parts = components(labels.select(*CELL, "label"), ["label"])
    size = parts.groupBy("label", "part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "part"))
    kept = size.withColumn("r", rank).where((F.col("r") == 1) | (F.col("label") == 0) & (F.col("r") <= max(subtasks, 1)))
    kept = parts.join(kept.select("label", "part"), ["label", "part"], "left_semi")
    return kept.where("label = 1").select(*CELL), kept.where("label = 0").select(*CELL)


def split_fragments(mosaic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The greatest part of each owner, and all other parts as fragments (part, cells)."""
    parts = components(mosaic.select(*CELL, "owner"), ["owner"])
    size = parts.groupBy("owner", "part").agg(F.count("*").alias("n"))
    best = size.groupBy("owner").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    main = parts.join(best, ["owner", "part"], "left_semi").select(*CELL, "owner")
    return main, parts.join(best, ["owner", "part"], "left_anti").select(*CELL, "owner", "part")


def reattach(main: DataFrame, fragments: DataFrame, borders: DataFrame) -> DataFrame:
    """Fragments go to the first other owner that touches them and whose border contains them.

    ``borders(owner, row_i, col_i)`` is what each image could show.  A
    fragment without such an owner stays with its own.
    """
    from .cells import NEAR4, shifted

    size = fragments.groupBy("owner", "part").agg(F.count("*").alias("n"))
    inside = fragments.join(borders.select(*CELL, F.col("owner").alias("into")), CELL).where("owner <> into").groupBy("owner", "part", "into").agg(F.count("*").alias("m"))
    near = shifted(fragments, NEAR4, ["owner", "part"]).join(main.select(*CELL, F.col("owner").alias("into")), CELL).select("owner", "part", "into").distinct()
    to = inside.join(size, ["owner", "part"]).where("m = n").join(near, ["owner", "part", "into"], "left_semi").groupBy("owner", "part").agg(F.min("into").alias("into"))
    moved = fragments.join(to, ["owner", "part"], "left").select(*CELL, F.coalesce("into", "owner").alias("owner"))
    return main.select(*CELL, "owner").union(moved)


def surrounded(mosaic: DataFrame, border: DataFrame, owner: int) -> DataFrame:
    """The mosaic lies inside a new image, which takes what is left of its border."""
    kind = mosaic.schema["owner"].dataType
    return mosaic.select(*CELL, "owner").union(border.select(*CELL).distinct().join(mosaic, CELL, "left_anti").select(*CELL, F.lit(owner).cast(kind)))


def anti_surrounded(mosaic: DataFrame, region: DataFrame, owner: int) -> DataFrame:
    """The new image lies inside the mosaic: owners keep the difference, and one that is left with nothing goes."""
    return update(mosaic, region, owner)


def _case(covered: DataFrame, valid: DataFrame) -> str:
    """How a new image's valid cells lie to the covered ones: apart, overlap, surrounded or anti_surrounded."""
    both = covered.select(*CELL, F.lit(1).alias("c")).join(valid.select(*CELL, F.lit(1).alias("v")), CELL, "full")
    n = both.agg(F.count(F.when(F.col("c").isNotNull() & F.col("v").isNotNull(), 1)).alias("both"), F.count("c").alias("c"), F.count("v").alias("v")).first()
    return "apart" if not n["both"] else "surrounded" if n["both"] == n["c"] else "anti_surrounded" if n["both"] == n["v"] else "overlap"


def serial(rasters: DataFrame, order: list[int], levels: int = 1, core: int = 4, max_hole: int = 16, sliver: int = 10, subtasks: int = 0) -> DataFrame:
    """Images added one after another, each against the mosaic so far by a minimum cut.

    An image works with its greatest valid part, and is left out if that has a
    hole of more than ``max_hole`` cells.  Apart from the mosaic it is added as
    it is.  If it surrounds the mosaic, cells of that deeper than ``core``
    stay old; if the mosaic surrounds it, its own such cells are new; so the
    seam runs around.  The new image takes the greatest part that the seam
    gives it; what it alone shows outside is added too where it holds
    ``sliver`` cells.  Owners cut in pieces keep their greatest, and
    other pieces go to neighbours that can show them.  Each step is written to the
    shared folder, as the next one reads it.
    """
    from ..plans.lineage import cut
    from .cells import biggest_part, erode
    from .seam import seam

    def image(k: int) -> DataFrame:
        cells = rasters.where(F.col("raster_id") == k).where("b1 > 0")
        part = biggest_part(cells.select(F.lit(k).alias("geom_id"), *CELL)).select(*CELL)
        return cut(cells.join(part, CELL, "left_semi").select(*CELL, "b1", "b2", "b3"))

    shown = rasters.where("b1 > 0").select(*CELL, F.col("raster_id").cast("long").alias("owner"))
    mosaic = None
    for k in order:
        new = image(k)
        if _greatest_hole(new) > max_hole:
            continue
        if mosaic is None:
            mosaic = cut(new.select(*CELL, F.lit(k).cast("long").alias("owner")))
            continue
        case = _case(mosaic, new)
        if case == "apart":
            mosaic = cut(mosaic.union(new.select(*CELL, F.lit(k).cast("long"))))
            continue
        forced = None
        if case in ("surrounded", "anti_surrounded"):
            inside, label = (mosaic, 0) if case == "surrounded" else (new, 1)
            forced = cut(erode(inside.select(F.lit(0).alias("geom_id"), *CELL), core).select(*CELL, F.lit(label).alias("label")))
        labels = cut(seam(mosaic_pixels(mosaic, rasters).select(*CELL, "b1", "b2", "b3"), new, levels, forced=forced))
        region, _ = seam_region(labels, subtasks)
        rest = labels.where("label = 1").join(region, CELL, "left_anti").join(mosaic, CELL, "left_anti").select(*CELL, F.lit(0).alias("one"))
        parts = cut(components(rest, ["one"]))
        large = parts.groupBy("part").count().where(F.col("count") >= sliver)
        mosaic = update(mosaic, region.union(parts.join(large, "part", "left_semi").select(*CELL)), k)
        main, fragments = split_fragments(cut(mosaic))
        mosaic = cut(reattach(main, fragments, shown))
    return mosaic


def _greatest_hole(cells: DataFrame) -> int:
    """Cells of the greatest part of the complement that the cells enclose."""
    from .cells import envelope

    box = envelope(cells, [])
    full = box.select(F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("row_i"), "r0", "c0", "c1").select("row_i", "r0", "c0", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("col_i"))
    out = full.join(cells.select(*CELL), CELL, "left_anti").select(*CELL, F.lit(0).alias("one"), ((F.col("row_i") == F.col("r0") - 1) & (F.col("col_i") == F.col("c0") - 1)).alias("corner"))
    parts = components(out.select(*CELL, "one"), ["one"])
    outer = parts.join(out.where("corner").select(*CELL), CELL, "left_semi").select("part")
    return parts.join(outer, "part", "left_anti").groupBy("part").count().agg(F.max("count")).first()[0] or 0


def refined(mosaic: DataFrame, rasters: DataFrame, a: int, b: int, levels: int = 1) -> DataFrame:
    """``mosaic`` with the line between owners ``a`` and ``b`` moved to the best seam in what both can show."""
    from .seam import seam

    theirs = mosaic.where(F.col("owner").isin(a, b)).select(*CELL)
    image = lambda k: rasters.where(F.col("raster_id") == k).join(theirs, CELL, "left_semi").select(*CELL, "b1", "b2", "b3")
    labels = seam(image(a), image(b), levels)
    return mosaic.join(labels, CELL, "left").select(*CELL, F.when(F.col("label") == 0, F.lit(a)).when(F.col("label") == 1, F.lit(b)).otherwise(F.col("owner")).cast("long").alias("owner"))


def touching(mosaic: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of owners with cells side by side."""
    from .cells import shifted

    near = shifted(mosaic, [(0, 1), (1, 0)], ["owner"]).withColumnRenamed("owner", "other").join(mosaic, CELL).where("owner <> other")
    return near.select(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")).distinct()


def voronoi(rasters: DataFrame, refine: bool = False, levels: int = 1) -> DataFrame:
    """Owners by nearest image centre among the images that are valid at a cell.

    With ``refine`` the line between each two neighbours is then moved to the
    best seam, and pieces cut off go to neighbours that can show them; the
    loop is over pairs of neighbouring images.
    """
    from ..plans.lineage import cut

    valid = rasters.where("b1 > 0").select(F.col("raster_id").cast("long").alias("geom_id"), *CELL)
    cells = valid.select(*CELL).distinct()
    site = nearest_site(cells, centroid(valid))
    hit = site.join(valid, CELL).groupBy(*CELL, "site").agg(F.max((F.col("geom_id") == F.col("site")).cast("int")).alias("ok"), F.min("geom_id").alias("first"))
    mosaic = hit.select(*CELL, F.when(F.col("ok") == 1, F.col("site")).otherwise(F.col("first")).alias("owner"))
    if refine:
        mosaic = cut(mosaic)
        for r in touching(mosaic).orderBy("a", "b").collect():  # pairs of neighbouring images
            mosaic = cut(refined(mosaic, rasters, r["a"], r["b"], levels))
        main, fragments = split_fragments(mosaic)
        mosaic = cut(reattach(main, fragments, valid.withColumnRenamed("geom_id", "owner")))
    return mosaic


def mosaic_pixels(mosaic: DataFrame, rasters: DataFrame) -> DataFrame:
    """Pixels of each cell's owner: (row_i, col_i, owner, bands)."""
    return mosaic.join(rasters.withColumn("owner", F.col("raster_id").cast("long")).drop("raster_id"), [*CELL, "owner"])


def overlay_raster(rasters: DataFrame, polygons: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels of rasters inside their polygons on one grid; later rasters overwrite, nodata is clear.

    ``polygons(geom_id, row_i, col_i)`` with the raster's id as geom_id.
    """
    inside = rasters.withColumn("geom_id", F.col("raster_id").cast("long")).join(polygons.select("geom_id", *CELL), ["geom_id", *CELL], "left_semi").where(F.col(bands[0]) > 0)
    return inside.groupBy(*CELL).agg(*[F.max_by(b, "raster_id").alias(b) for b in bands])


def cut_rasters(rasters: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each raster's pixels inside its own polygon."""
    return rasters.withColumn("geom_id", F.col("raster_id").cast("long")).join(polygons.select("geom_id", *CELL), ["geom_id", *CELL], "left_semi").drop("geom_id")


def blended(mosaic: DataFrame, rasters: DataFrame, bands: list[str], blend: int = 0, step: int = 1) -> DataFrame:
    """(row_i, col_i, owner, bands): the mosaic on a grid ``step`` times coarser, by nearest neighbour.

    Within ``blend`` cells of another owner's region, in steps with
    diagonals, a cell takes in that owner's pixel where there is one: half of
    it at the line, none at the distance.
    """
    from .cells import shifted

    out = mosaic_pixels(mosaic, rasters).select(*CELL, "owner", *bands)
    if blend:
        square = [(r, c) for r in range(-blend, blend + 1) for c in range(-blend, blend + 1) if r or c]
        line = shifted(mosaic, [(0, 1), (1, 0), (0, -1), (-1, 0)], ["owner"]).withColumnRenamed("owner", "other").join(mosaic, CELL).where("owner <> other").select(*CELL, F.col("owner").alias("near")).distinct()
        # cells beside the line, with the owner on its far side, reach ``blend`` steps
        reach = [shifted(line, [(r, c)], ["near"]).select(*CELL, "near", F.lit(max(abs(r), abs(c))).alias("d")) for r, c in square]
        far = reach[0]
        for x in reach[1:]:
            far = far.union(x)
        far = far.join(mosaic, CELL).where("owner <> near and d <= %d" % blend).groupBy(*CELL).agg(F.min(F.struct("d", "near")).alias("m")).select(*CELL, F.col("m.near").alias("near"), F.col("m.d").alias("d"))
        other = rasters.where(F.col(bands[0]) > 0).select(*CELL, F.col("raster_id").cast("long").alias("near"), *[F.col(b).alias(f"__{b}") for b in bands])
        far = far.join(other, [*CELL, "near"])
        share = (F.lit(blend + 1) - F.col("d")) / (2.0 * (blend + 1))
        mixed = [F.when(F.col("d").isNotNull(), F.round((1 - share) * F.col(b) + share * F.col(f"__{b}")).cast("long")).otherwise(F.col(b)).alias(b) for b in bands]
        out = out.join(far, CELL, "left").select(*CELL, "owner", *mixed)
    if step > 1:
        out = out.where((F.col("row_i") % step == 0) & (F.col("col_i") % step == 0)).withColumn("row_i", F.floor(F.col("row_i") / step)).withColumn("col_i", F.floor(F.col("col_i") / step))
    return out
