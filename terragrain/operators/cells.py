"""Vector geometry as cell sets.

A geometry is its grid cells, rows of (geom_id, row_i, col_i).  Predicates
and set algebra become equi-joins on cells and counts: two geometries meet
only where they share a cell, so an overlay never compares all pairs.
Exactness is that of the grid.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

CELL = ["row_i", "col_i"]
#: Links of runs up to which parts are found in one task.
FEW_LINKS = 200_000
#: Rows and columns of the tiles inside which links are joined first.
TILE = 256
NEAR4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
NEAR8 = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def area(cells: DataFrame, by: str = "geom_id") -> DataFrame:
    return cells.groupBy(by).agg(F.count("*").alias("area"))


def envelope(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(F.min("row_i").alias("r0"), F.max("row_i").alias("r1"), F.min("col_i").alias("c0"), F.max("col_i").alias("c1"))


def box_ring(r0, c0, r1, c1):
    """A closed envelope polygon as an array of (x, y)."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(pt(c0, r0), pt(c1, r0), pt(c1, r1), pt(c0, r1), pt(c0, r0))


def ring_area(ring):
    """Shoelace area of a closed ring of (x, y)."""
    n = F.size(ring)
    return F.abs(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + F.get(ring, i - 1)["x"] * F.get(ring, i)["y"] - F.get(ring, i)["x"] * F.get(ring, i - 1)["y"])) / 2


def drop_empty_holes(rings):
    """Rings without the interior ones of no area."""
    return F.concat(F.slice(rings, 1, 1), F.filter(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring_area(r) > 0))


def centroid(cells: DataFrame) -> DataFrame:
    return cells.groupBy("geom_id").agg(F.avg("row_i").alias("row_c"), F.avg("col_i").alias("col_c"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, area): every pair of geometries that share cells."""
    return related(a, b).select("a_id", "b_id", "area")


def relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that meet, as 'overlap', 'surrounded' (a within b) or 'anti_surrounded'."""
    return related(a, b)


def related(a: DataFrame, b: DataFrame, only: str = "true", whole: bool = False) -> DataFrame:
    """(a_id, b_id, area, a_area, b_area, relation) of pairs that meet and are ``only`` such.

    Geometries with the same cells meet the same others, so each is laid over
    once, ``only`` is asked once, and pairs are spread to all of them last:
    they are rows of the result, and no step before makes as many.  With
    ``whole`` also ``cells``, an array of the shared ones with how often each counts.
    """
    (x, of_a), (y, of_b) = alike(a), alike(b)
    left = x.select(F.col("class").alias("a_class"), *CELL, F.col("times").alias("at"))
    both = left.join(y.select(F.col("class").alias("b_class"), *CELL, F.col("times").alias("bt")).hint("merge"), CELL)
    times = F.col("at") * F.col("bt")
    shared = [F.collect_list(F.struct(*CELL, times.alias("times"))).alias("cells")] if whole else []
    pairs = both.groupBy("a_class", "b_class").agg(F.sum(times).alias("area"), *shared)
    size = lambda d, n: d.groupBy("class").agg(F.sum("times").alias(f"{n}_area")).withColumnRenamed("class", f"{n}_class")
    pairs = pairs.join(size(x, "a"), "a_class").join(size(y, "b"), "b_class")
    kind = F.when(F.col("area") == F.col("a_area"), "surrounded").when(F.col("area") == F.col("b_area"), "anti_surrounded").otherwise("overlap")
    pairs = cut(pairs.withColumn("relation", kind).where(only))
    member = lambda of, n: of.select(F.col("geom_id").alias(f"{n}_id"), F.col("class").alias(f"{n}_class"))
    out = pairs.join(member(of_a, "a"), "a_class").join(member(of_b, "b"), "b_class")
    return out.select("a_id", "b_id", "area", "a_area", "b_area", "relation", *(["cells"] if whole else []))


def covered(a: DataFrame, b: DataFrame, only: str = "true") -> DataFrame:
    """(a_id, area): areas of ``overlaps`` that are ``only`` such, added up over ``b``, without its pairs."""
    (x, of_a), (y, of_b) = alike(a), alike(b)
    left = x.select(F.col("class").alias("a_class"), *CELL, F.col("times").alias("at"))
    both = left.join(y.select(F.col("class").alias("b_class"), *CELL, F.col("times").alias("bt")).hint("merge"), CELL)
    pairs = both.groupBy("a_class", "b_class").agg(F.sum(F.col("at") * F.col("bt")).alias("area")).where(only)
    many = of_b.groupBy("class").agg(F.count("*").alias("many")).withColumnRenamed("class", "b_class")
    found = pairs.join(many, "b_class").groupBy("a_class").agg(F.sum(F.col("area") * F.col("many")).alias("area"))
    return found.join(of_a.withColumnRenamed("class", "a_class"), "a_class").select(F.col("geom_id").alias("a_id"), "area")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, row_i, col_i): the cells that each pair shares."""
    out = related(a, b, whole=True).select("a_id", "b_id", F.explode("cells").alias("c"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.times")))
    return out.select("a_id", "b_id", "c.row_i", "c.col_i", "c.times", again.alias("k")).select("a_id", "b_id", *CELL)


def alike(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, row_i, col_i, times) once for all geometries with the same cells (by 128 bits), and (geom_id, class) of each.

    ``times`` is how often a geometry has a cell.
    """
    named = cells.groupBy("geom_id", *CELL).agg(F.count("*").alias("times"))
    mark = named.groupBy("geom_id").agg(F.bit_xor(F.xxhash64(*CELL, "times")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), *CELL, "times")).alias("k"), F.count("*").alias("n"))
    of = cut(mark.withColumn("class", F.min("geom_id").over(Window.partitionBy("h", "k", "n"))).select("geom_id", "class"))
    once = of.where("geom_id = class").select("class")
    return cut(named.join(once, named["geom_id"] == once["class"]).select("class", *CELL, "times")), of


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [p.select(*CELL) for p in parts]).distinct()


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose cells ``b`` has too, once each, however many geometries of ``b`` have them."""
    return a.select("geom_id", *CELL).join(b.select(*CELL).distinct(), CELL, "left_semi").select("geom_id", *CELL)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*CELL).distinct(), CELL, "left_anti").select("geom_id", *CELL)


def shifted(cells: DataFrame, offsets: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    d = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets]))
    x = cells.select(*keep, *CELL, d.alias("d"))
    return x.select(*keep, (F.col("row_i") + F.col("d.r")).alias("row_i"), (F.col("col_i") + F.col("d.c")).alias("col_i"))


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """Cells within ``radius`` steps, diagonals included: along rows, then along columns."""
    reach = range(-radius, radius + 1)
    wide = shifted(cells, [(0, c) for c in reach], ["geom_id"]).distinct()
    return shifted(wide, [(r, 0) for r in reach], ["geom_id"]).distinct()


def erode(cells: DataFrame, radius: int) -> DataFrame:
    """Cells whose whole neighbourhood of ``radius`` steps is inside: along rows, then along columns."""
    reach = range(-radius, radius + 1)
    left = cells.select("geom_id", *CELL).distinct()
    for steps in ([(0, c) for c in reach], [(r, 0) for r in reach]):
        full = shifted(left, steps, ["geom_id"]).groupBy("geom_id", *CELL).agg(F.count("*").alias("n"))
        left = full.where(F.col("n") == len(steps)).select("geom_id", *CELL)
    return left


def boundary(cells: DataFrame) -> DataFrame:
    """Cells with a 4-neighbour outside."""
    inner = shifted(cells, NEAR4, ["geom_id"]).groupBy("geom_id", *CELL).agg(F.count("*").alias("n")).where("n = 4")
    return cells.join(inner, ["geom_id", *CELL], "left_anti").select("geom_id", *CELL)


def components(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_i, col_i, part): 4-connected parts, named by their least cell number.

    Runs along rows are joined first by a window, so runs are linked, not
    cells.  Links counted to be at most ``FEW_LINKS`` are one task's work;
    more are joined tile by tile first, which leaves the links between tiles.
    """
    key = F.col("row_i") * F.lit(1 << 31) + F.col("col_i")
    row = Window.partitionBy(*by, "row_i").orderBy("col_i")
    x = cells.select(*by, *CELL).distinct().withColumn("isle", F.col("col_i") - F.row_number().over(row))
    runs = cut(x.withColumn("run", F.min(key).over(Window.partitionBy(*by, "row_i", "isle"))).drop("isle"))
    below = runs.select(*by, (F.col("row_i") + 1).alias("row_i"), "col_i", F.col("run").alias("up"))
    links = cut(runs.join(below, [*by, *CELL]).select(*by, "run", "up").distinct())
    state = _linked(links, by)
    out = runs.join(state, [*by, "run"], "left")
    return out.select(*by, *CELL, F.coalesce("part", "run").alias("part"))


def _linked(links: DataFrame, by: list[str], side: int | None = None) -> DataFrame:
    """(by, run, part) of links: inside tiles of ``side`` rows and columns first, then between what these left, in tiles eight times as wide."""
    n, side = links.count(), side or TILE
    if n <= FEW_LINKS:
        return _joined(links, by)
    if side > 1 << 31:  # no tile parts them further
        return _jumped(links, by)
    tile = lambda c: F.struct(F.floor(F.shiftright(c, 31) / side), F.floor(F.col(c).bitwiseAND((1 << 31) - 1) / side))
    inside = tile("run") == tile("up")
    shards = max(n // max(FEW_LINKS, 1) + 1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.select(*by, "run").schema.fields)
    union = _union_find(by)

    def whole(parts):
        found = list(parts)
        if found:
            yield pd.concat(found, ignore_index=True)

    local = cut(links.where(inside).repartition(shards, *by, tile("run")).mapInPandas(lambda parts: union(whole(parts)), f"{ddl}, part long"))
    name = lambda c: local.select(*by, F.col("run").alias(c), F.col("part").alias(f"{c}_part"))
    across = links.where(~inside).join(name("run"), [*by, "run"], "left").join(name("up"), [*by, "up"], "left")
    across = cut(across.select(*by, F.coalesce("run_part", "run").alias("run"), F.coalesce("up_part", "up").alias("up")).where("run <> up").distinct())
    over = cut(_linked(across, by, side * 8))
    lone = over.join(local.select(*by, "run"), [*by, "run"], "left_anti")
    further = over.select(*by, F.col("run").alias("part"), F.col("part").alias("least"))
    return local.join(further, [*by, "part"], "left").select(*by, "run", F.coalesce("least", "part").alias("part")).union(lone.select(*by, "run", "part"))


def _union_find(by: list[str]):
    """A function of frames of links (by, run, up) that yields (by, run, part) of each."""

    def each(frames):
        for pdf in frames:
            parent: dict = {}

            def find(x):
                while parent.setdefault(x, x) != x:  # noqa: B023
                    parent[x] = x = parent[parent[x]]  # noqa: B023
                return x

            keys = list(zip(*[pdf[c] for c in by], strict=True)) if by else [()] * len(pdf)
            for k, a, b in zip(keys, pdf["run"], pdf["up"], strict=True):
                low, high = sorted((find((k, a)), find((k, b))), key=lambda x: x[1])
                parent[high] = low
            yield pd.DataFrame([(*k, run, find((k, run))[1]) for k, run in list(parent)], columns=[*by, "run", "part"])

    return each


def _joined(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, part) of counted, few links, by union and find in one task."""
    each = _union_find(by)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.select(*by, "run").schema.fields)
    return links.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda pdf: next(each([pdf])), f"{ddl}, part long")


def _jumped(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, part) by rounds of taking the least neighbour and following labels."""
    both = cut(links.union(links.select(*by, F.col("up").alias("run"), F.col("run").alias("up"))))
    state = both.select(*by, "run").distinct().withColumn("part", F.col("run"))
    while True:
        near = both.join(state.select(*by, F.col("run").alias("up"), "part"), [*by, "up"]).groupBy(*by, "run").agg(F.min("part").alias("low"))
        hooked = state.join(near, [*by, "run"], "left").select(*by, "run", F.col("part").alias("before"), F.least("part", F.coalesce("low", "part")).alias("part"))
        jump = state.select(*by, F.col("run").alias("part"), F.col("part").alias("next"))
        fresh = cut(hooked.join(jump, [*by, "part"], "left").select(*by, "run", "before", F.least("part", F.coalesce("next", "part")).alias("part")))
        state = fresh.select(*by, "run", "part")
        if not fresh.where("part <> before").limit(1).count():
            return state


def biggest_part(cells: DataFrame) -> DataFrame:
    """The largest part of each geometry, the first on ties."""
    parts = components(cells, ["geom_id"])
    size = parts.groupBy("geom_id", "part").agg(F.count("*").alias("n"))
    best = size.groupBy("geom_id").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    return parts.join(best, ["geom_id", "part"], "left_semi").select("geom_id", *CELL)


def holes(cells: DataFrame) -> DataFrame:
    """(geom_id, holes): parts of the complement inside the padded envelope, less the outer one."""
    box = envelope(cells, ["geom_id"])
    full = box.select("geom_id", F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("row_i"), "c0", "c1").select("geom_id", "row_i", F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("col_i"))
    out = full.join(cells, ["geom_id", *CELL], "left_anti")
    return components(out, ["geom_id"]).groupBy("geom_id").agg((F.countDistinct("part") - 1).alias("holes"))


def owner_by_order(cells: DataFrame, order: str = "geom_id") -> DataFrame:
    """(row_i, col_i, geom_id): the later geometry owns a shared cell."""
    return cells.groupBy(*CELL).agg(F.max_by("geom_id", order).alias("geom_id"))


def merge_touching(cells: DataFrame) -> DataFrame:
    """(part, area): geometries merged where they share or touch cells."""
    return components(cells.select(*CELL).withColumn("one", F.lit(1)), ["one"]).groupBy("part").agg(F.count("*").alias("area"))


def site_candidates(tiles: DataFrame, sites: DataFrame, size: int, levels: int) -> DataFrame:
    """(tr, tc, sites): for each tile the sites that may be nearest to one of its cells.

    Sites stand in a pyramid of squares, tiles at its foot and sides doubling.
    One site of a square for each level around a tile bounds the distance u
    of the nearest from the tile's middle.  With d the tile's diagonal, only
    sites within u + d of the middle can win a cell, and these are in the
    nine squares around at the first level whose side is u + d or more.
    """
    diagonal = (size - 1) * 2**0.5
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    up = lambda x, y: (F.floor(F.col(x) / F.pow(F.lit(2.0), "level")).cast("long").alias(y))
    put = sites.select(F.col("geom_id").alias("site"), "row_c", "col_c", F.floor(F.col("row_c") / size).cast("long").alias("sr"), F.floor(F.col("col_c") / size).cast("long").alias("sc"), level.alias("level"))
    put = cut(put.select("site", "row_c", "col_c", "level", up("sr", "qr"), up("sc", "qc")))
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    middle = tiles.select("tr", "tc", (F.col("tr") * size + (size - 1) / 2).alias("mr"), (F.col("tc") * size + (size - 1) / 2).alias("mc"))
    away = F.hypot(F.col("row_c") - F.col("mr"), F.col("col_c") - F.col("mc"))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("d", near).withColumn("qr", up("tr", "qr") + F.col("d.r")).withColumn("qc", up("tc", "qc") + F.col("d.c")).drop("d")

    one = put.groupBy("level", "qr", "qc").agg(F.min(F.struct("site", "row_c", "col_c")).alias("x")).select("level", "qr", "qc", "x.row_c", "x.col_c")
    bound = around(middle.withColumn("level", level)).join(one, ["level", "qr", "qc"]).groupBy("tr", "tc", "mr", "mc").agg((F.min(away) + F.lit(diagonal)).alias("reach"))
    wide = F.greatest(F.lit(0), F.least(F.lit(levels), F.ceil(F.log2(F.greatest(F.col("reach"), F.lit(1.0)) / size)).cast("int")))
    found = around(bound.withColumn("level", wide)).join(put, ["level", "qr", "qc"]).where(away <= F.col("reach") + F.lit(1e-6))
    return _contenders(found, size)


def _contenders(found: DataFrame, size: int) -> DataFrame:
    """(tr, tc, sites) without those that the nearest site of a corner beats at all four corners of the tile, and so at each of its cells."""
    corners = [(F.col("tr") * size + r, F.col("tc") * size + c) for r in (0, size - 1) for c in (0, size - 1)]
    square = lambda r, c, p: (p[0] - r) * (p[0] - r) + (p[1] - c) * (p[1] - c)
    nearest = [F.min(F.struct(square(F.col("row_c"), F.col("col_c"), p).alias("d"), "row_c", "col_c")).alias(f"best{k}") for k, p in enumerate(corners)]
    found = cut(found)
    tiles = found.groupBy("tr", "tc").agg(*nearest)
    away = [square(F.col("row_c"), F.col("col_c"), p) for p in corners]
    slack = F.greatest(*away) * 1e-12 + 1e-9
    beaten = [reduce(lambda a, b: a & b, [x > square(F.col(f"best{k}.row_c"), F.col(f"best{k}.col_c"), p) + slack for x, p in zip(away, corners, strict=True)]) for k in range(4)]
    kept = found.join(tiles, ["tr", "tc"]).where(~reduce(lambda a, b: a | b, beaten))
    return kept.groupBy("tr", "tc").agg(F.collect_list(F.struct("site", "row_c", "col_c")).alias("sites"))


def nearest_site(px: DataFrame, sites: DataFrame) -> DataFrame:
    """(row_i, col_i, site): Voronoi owner of each cell, the least id on ties.

    Cells meet the few sites that their tile may have, whatever the number of
    sites is.  Tiles are sized for a site each; of sites at one place the
    least id stands for all, and of sites that are crowded far from a tile
    those that others beat all over it are left out.
    """
    sites = cut(sites.groupBy("row_c", "col_c").agg(F.min("geom_id").alias("geom_id")))
    n = sites.count()
    box = px.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in CELL]).first()
    if not n or box[0] is None:
        return px.select(*CELL, F.lit(None).cast("long").alias("site")).limit(0)
    far = sites.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("row_c", "col_c")]).first()
    low, high = (min(box[0], far[0]), min(box[1], far[1])), (max(box[2], far[2]), max(box[3], far[3]))
    size = min(128, max(4, round(((box[2] - box[0] + 1) * (box[3] - box[1] + 1) / n) ** 0.5)))
    levels = max(0, int(max(b - a for a, b in zip(low, high, strict=True)) / size).bit_length() + 2)
    rows = px.select(*CELL, F.floor(F.col("row_i") / size).cast("long").alias("tr"), F.floor(F.col("col_i") / size).cast("long").alias("tc"))
    may = site_candidates(rows.select("tr", "tc").distinct(), sites, size, levels)
    may = cut(may.select(F.col("tr").alias("ut"), F.col("tc").alias("uc"), F.explode("sites").alias("s")).select("ut", "uc", "s.*"))

    def nearest(cells: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("site")
        r, c = near["row_c"].to_numpy(), near["col_c"].to_numpy()
        row, col = cells["row_i"].to_numpy(float), cells["col_i"].to_numpy(float)
        best = np.empty(len(cells), dtype=np.int64)
        step = max(1, 2_000_000 // max(len(near), 1))
        for k in range(0, len(cells), step):
            y, x = row[k : k + step, None] - r, col[k : k + step, None] - c
            best[k : k + step] = (y * y + x * x).argmin(axis=1)  # the least id on ties
        return pd.DataFrame({"row_i": cells["row_i"], "col_i": cells["col_i"], "site": near["site"].to_numpy()[best]})

    return rows.groupBy("tr", "tc").cogroup(may.groupBy("ut", "uc")).applyInPandas(lambda a, b: nearest(a, b), "row_i long, col_i long, site long")


def fill_pieces(pieces: DataFrame, borders: DataFrame, masks: DataFrame) -> DataFrame:
    """(geom_id, source): for each piece the first border that contains it and whose mask misses it.

    ``masks`` has the border's id as geom_id.
    """
    piece, piece_of = _classes(pieces)
    size = area(piece).withColumnRenamed("geom_id", "a_id").withColumnRenamed("area", "size")
    inside = overlaps(piece, borders.distinct()).join(size, "a_id").where("area = size").select("a_id", "b_id")
    hit = overlaps(piece, masks).select("a_id", "b_id")
    ok = inside.join(hit, ["a_id", "b_id"], "left_anti")
    found = ok.groupBy(F.col("a_id").alias("class")).agg(F.min("b_id").alias("source"))
    return piece_of.join(found, "class").select("geom_id", "source")


def _classes(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the least of all geometries with the same cells (by 128 bits), and (geom_id, class) of every one."""
    named = cut(cells.select("geom_id", *CELL).distinct())
    mark = named.groupBy("geom_id").agg(F.bit_xor(F.xxhash64(*CELL)).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), *CELL)).alias("k"), F.count("*").alias("n"))
    least = mark.withColumn("class", F.min("geom_id").over(Window.partitionBy("h", "k", "n"))).select("geom_id", "class")
    least = cut(least)
    return named.join(least.where("geom_id = class"), "geom_id", "left_semi"), least
