"""Cell sets as polygons and back: rings traced along cell edges, and rings filled by even-odd rule.

A polygon is one geometry's worth of work: its rings are vertex lists, so
tracing and filling are kernels by geometry; nothing crosses geometries.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vertices import graft, rotate_off_seam, simplify

Point = tuple[float, float]


def trace(cells: set[tuple[int, int]]) -> list[list[Point]]:
    """Closed rings (x, y) = (column, row) around cells, straight runs as one edge; holes run the other way round.

    No ring touches itself: where cells touch at a corner only, it is cut there.
    """
    out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for a, b, beside in (((c, r), (c + 1, r), (r - 1, c)), ((c + 1, r), (c + 1, r + 1), (r, c + 1)), ((c + 1, r + 1), (c, r + 1), (r + 1, c)), ((c, r + 1), (c, r), (r, c - 1))):
            if beside not in cells:
                out_of.setdefault(a, []).append(b)
    rings = []
    while out_of:
        start = at = min(out_of)
        ring, came = [], None
        while True:
            ways = out_of[at]
            # at a corner of two cells turn right, which stays with the cell the ring goes round
            k = 0 if len(ways) == 1 or came is None else max(range(len(ways)), key=lambda i: came[0] * (ways[i][1] - at[1]) - came[1] * (ways[i][0] - at[0]))
            to = ways.pop(k)
            if not ways:
                del out_of[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != came:
                ring.append((float(at[0]), float(at[1])))
            at, came = to, step
            if at == start and (at not in out_of or came != (0, 1)):
                break
        rings += _simple(ring)
    return rings


def _simple(vertices: list[Point]) -> list[list[Point]]:
    """A closed walk cut where it touches itself, each piece from a corner on."""
    out, walk, at = [], [], {}
    for p in [*vertices, vertices[0]]:
        if p in at:
            piece = walk[at[p] :]
            for q in piece:
                del at[q]
            walk = walk[: at.get(p, len(walk) - len(piece))]
            corners = [q for o, q, n in zip([piece[-1], *piece], piece, [*piece[1:], piece[0]], strict=False) if (o[0] == q[0]) != (q[0] == n[0])]
            out.append([*corners, corners[0]])
        at[p] = len(walk)
        walk.append(p)
    return out


def area(ring: list[Point]) -> float:
    """Signed: positive for an outer ring."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False)) / 2


def fill(rings: list[list[Point]]) -> list[tuple[int, int]]:
    """(row, col) of the cells whose centre an odd number of ring edges lies left of."""
    crossings: dict[int, list[float]] = {}
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if y0 == y1:
                continue
            low, high = min(y0, y1), max(y0, y1)
            for r in range(int(-(-(low - 0.5) // 1)), int(-(-(high - 0.5) // 1))):
                crossings.setdefault(r, []).append(x0 + (r + 0.5 - y0) * (x1 - x0) / (y1 - y0))
    out = []
    for r, xs in sorted(crossings.items()):
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2], strict=False):
            out += [(r, c) for c in range(int(-(-(a - 0.5) // 1)), int(-(-(b - 0.5) // 1)))]
    return out


RINGS = "array<array<struct<x: double, y: double>>>"
#: Rings differ in length, so they travel as Arrow lists: pandas would make ragged arrays of them.
RINGS_ARROW = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _named(rings: list[list[Point]]) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in ring] for ring in rings]


def _points(rings) -> list[list[Point]]:
    return [[(p["x"], p["y"]) for p in ring] for ring in rings or ()]


def polygons(cells: DataFrame, by: str = "geom_id") -> DataFrame:
    """(by, rings): each geometry's rings, outer ones first."""

    def one(table: pa.Table) -> pa.Table:
        at = set(zip(table["row_i"].to_pylist(), table["col_i"].to_pylist(), strict=True))
        rings = sorted(trace(at), key=lambda r: -area(r))
        return pa.table([table[by].slice(0, 1).combine_chunks(), pa.array([_named(rings)], RINGS_ARROW)], names=[by, "rings"])

    return cells.select(by, "row_i", "col_i").groupBy(by).applyInArrow(one, f"{by} {cells.schema[by].dataType.simpleString()}, rings {RINGS}")


def rasterized(shapes: DataFrame, by: str = "geom_id") -> DataFrame:
    """(by, row_i, col_i): the cells of ``shapes(by, rings)``."""

    def cells(batches):
        for batch in batches:
            for k, rings in enumerate(batch.column(1).to_pylist()):
                found = fill(_points(rings))
                if found:
                    key = batch.column(0).take(pa.array([k] * len(found)))
                    yield pa.RecordBatch.from_arrays([key, pa.array([r for r, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], names=[by, "row_i", "col_i"])

    return shapes.select(by, "rings").mapInArrow(cells, f"{by} {shapes.schema[by].dataType.simpleString()}, row_i long, col_i long")


def _each_ring(shapes: DataFrame, change, extra: list[str] = ()) -> DataFrame:
    """``shapes(.., rings)`` with every ring changed by ``change(ring, row)``; ``extra`` columns are read, then gone."""
    kept = [c for c in shapes.columns if c not in extra]

    def run(batches):
        for batch in batches:
            rows = batch.select(["rings", *extra]).to_pylist()
            rings = [None if row["rings"] is None else _named([change(ring, row) for ring in _points(row["rings"])]) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rings, RINGS_ARROW) if c == "rings" else batch.column(c) for c in kept], names=kept)

    return shapes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shapes.select(*kept).schema.fields))


def simplified(shapes: DataFrame, tolerance: float) -> DataFrame:
    return _each_ring(shapes, lambda ring, row: simplify(ring, tolerance))


def grafted(shapes: DataFrame) -> DataFrame:
    """``shapes(.., rings, seam)``: the shorter arc of each ring between the seam's ends becomes the seam."""
    return _each_ring(shapes, lambda ring, row: graft(ring, [(p["x"], p["y"]) for p in row["seam"]]), ["seam"])


def rotated_off_seam(shapes: DataFrame) -> DataFrame:
    """``shapes(.., rings, seam)``: rings begun where the seam begins, so that it is one piece."""
    return _each_ring(shapes, lambda ring, row: rotate_off_seam(ring, [(x, y) in {(p["x"], p["y"]) for p in row["seam"]} for x, y in ring[:-1]]), ["seam"])


def bordered(cells: DataFrame, tolerance: float = 0.0, inset: int = 2) -> DataFrame:
    """(geom_id, rings): the border of each image's greatest valid region: simplified, drawn in, simplified again."""
    from .cells import biggest_part, erode

    inner = erode(biggest_part(cells), inset)
    shapes = polygons(inner)
    return simplified(shapes, tolerance) if tolerance else shapes


def distance(a, b):
    """Distance of two points given as structs (x, y)."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])
