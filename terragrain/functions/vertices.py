"""Vertex-exact operations on lines and rings, for small driver-side lists."""

from __future__ import annotations

import math

Point = tuple[float, float]


def simplify(line: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker: vertices farther than ``tolerance`` from the kept chords stay."""
    if len(line) < 3:
        return list(line)
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = line[a], line[b]
        length = math.hypot(x1 - x0, y1 - y0)
        best, at = tolerance, -1
        for k in range(a + 1, b):
            x, y = line[k]
            far = abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / length if length else math.hypot(x - x0, y - y0)
            if far > best:
                best, at = far, k
        if at > 0:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [line[k] for k in sorted(keep)]


def nearest_vertex(ring: list[Point], point: Point) -> int:
    """Index of the nearest vertex, the first on ties."""
    return min(range(len(ring)), key=lambda i: (math.dist(ring[i], point), i))


def rotate_ring(ring: list[Point], first: int) -> list[Point]:
    """The closed ring begun at another of its vertices."""
    open_ = ring[:-1] if ring[0] == ring[-1] else ring
    turned = open_[first % len(open_) :] + open_[: first % len(open_)]
    return [*turned, turned[0]]


def rotate_off_seam(ring: list[Point], on_seam: list[bool]) -> list[Point]:
    """Begin the ring right after a vertex off the seam, so that the seam is one piece."""
    open_ = ring[:-1] if ring[0] == ring[-1] else ring
    for k in range(len(open_)):
        if on_seam[k] and not on_seam[k - 1]:
            return rotate_ring(ring, k)
    return list(ring)


def graft(ring: list[Point], seam: list[Point]) -> list[Point]:
    """The ring with its arc between the seam's ends replaced by the seam.

    Of the two arcs the shorter goes.
    """
    open_ = ring[:-1] if ring[0] == ring[-1] else list(ring)
    a, b = nearest_vertex(open_, seam[0]), nearest_vertex(open_, seam[-1])
    arc = lambda i, j: [open_[k % len(open_)] for k in range(i, j + 1 if j >= i else j + len(open_) + 1)]
    size = lambda p: sum(math.dist(u, v) for u, v in zip(p, p[1:], strict=False))
    one, two = arc(a, b), arc(b, a)
    out = list(seam) + two[1:-1] if size(one) <= size(two) else list(reversed(seam)) + one[1:-1]
    return [*out, out[0]]


def merge_lines(pieces: list[list[Point]]) -> list[list[Point]]:
    """Pieces in ring order, joined where one ends at the next one's start."""
    if not pieces:
        return []
    first = next((k for k in range(len(pieces)) if pieces[k - 1][-1] != pieces[k][0]), 0)
    out: list[list[Point]] = []
    for p in pieces[first:] + pieces[:first]:
        if out and out[-1][-1] == p[0]:
            out[-1] += p[1:]
        else:
            out.append(list(p))
    return out
