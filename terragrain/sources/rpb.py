"""Rational polynomial camera models: text parsing and projection in column arithmetic."""

from __future__ import annotations

from enum import Enum
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in the text and in the model, scalars first.
SCALARS = {
    "errBias": "ERR_BIAS", "errRand": "ERR_RAND", "lineOffset": "LINE_OFF", "sampOffset": "SAMP_OFF", "latOffset": "LAT_OFF", "longOffset": "LONG_OFF", "heightOffset": "HEIGHT_OFF",
    "lineScale": "LINE_SCALE", "sampScale": "SAMP_SCALE", "latScale": "LAT_SCALE", "longScale": "LONG_SCALE", "heightScale": "HEIGHT_SCALE",
}
VECTORS = {"lineNumCoef": "LINE_NUM_COEFF", "lineDenCoef": "LINE_DEN_COEFF", "sampNumCoef": "SAMP_NUM_COEFF", "sampDenCoef": "SAMP_DEN_COEFF"}


class RPCSource(Enum):
    """Where an image's camera model stands."""

    INTERNAL = 0
    RPB_FILE = 1


def camera_models(images: DataFrame, texts: DataFrame, source: RPCSource) -> DataFrame:
    """(path, rpc): the model of each of ``images(path, metadata)``.

    INTERNAL reads the image's own metadata, a map with all sixteen names;
    RPB_FILE the text beside it, ``texts(path, value)``, of the same name with
    extension ``rpb``.  An image without a model is left out.
    """
    if source is RPCSource.INTERNAL:
        names = [*SCALARS.values(), *VECTORS.values()]
        whole = reduce(lambda a, b: a & b, [F.coalesce(F.map_contains_key("metadata", F.lit(n)), F.lit(False)) for n in names])
        return images.where(whole).select("path", F.map_filter("metadata", lambda k, v: k.isin(names)).alias("rpc"))
    beside = parse_rpb(texts).withColumnRenamed("path", "rpb")
    return images.select("path", F.regexp_replace("path", r"\.[^./]*$", ".rpb").alias("rpb")).join(beside, "rpb").select("path", "rpc")


def parse_rpb(text: DataFrame) -> DataFrame:
    """``text(path, value)`` of whole files → (path, rpc): a map of 16 names to number text."""
    number = lambda k: F.regexp_extract("value", rf"{k}\s*=\s*([-+0-9.eE]+)", 1)
    numbers = lambda k: F.trim(F.regexp_replace(F.regexp_extract("value", rf"{k}\s*=\s*\(([^)]*)\)", 1), r"[\s,]+", " "))
    pairs = [x for k, n in SCALARS.items() for x in (F.lit(n), number(k))] + [x for k, n in VECTORS.items() for x in (F.lit(n), numbers(k))]
    return text.select("path", F.create_map(*pairs).alias("rpc"))


def _cubic(coefficients: Column, x: Column, y: Column, z: Column) -> Column:
    """Twenty terms of a cubic in longitude x, latitude y and height z."""
    terms = [F.lit(1.0), x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x * x * x, x * y * y, x * z * z, x * x * y, y * y * y, y * z * z, x * x * z, y * y * z, z * z * z]
    return reduce(lambda a, b: a + b, [F.get(coefficients, F.lit(k)) * t for k, t in enumerate(terms)])


def rpc_project(points: DataFrame, model: DataFrame, by: str | None = None) -> DataFrame:
    """``points(lon, lat, h)`` with line and sample; ``model(rpc)`` is one row, or one for each value of ``by``."""
    numbers = [*[F.element_at("rpc", n).cast("double").alias(f"__{n}") for n in SCALARS.values()], *[F.transform(F.split(F.element_at("rpc", n), " "), lambda s: s.cast("double")).alias(f"__{n}") for n in VECTORS.values()]]
    if by:
        p = points.join(model.select(by, *numbers), by)
    else:
        p = points.crossJoin(F.broadcast(model.select(*numbers)))  # one row
    norm = lambda c, n: (F.col(c) - F.col(f"__{n}_OFF")) / F.col(f"__{n}_SCALE")
    x, y, z = norm("lon", "LONG"), norm("lat", "LAT"), norm("h", "HEIGHT")
    ratio = lambda n: _cubic(F.col(f"__{n}_NUM_COEFF"), x, y, z) / _cubic(F.col(f"__{n}_DEN_COEFF"), x, y, z) * F.col(f"__{n}_SCALE") + F.col(f"__{n}_OFF")
    return p.select(*points.columns, ratio("LINE").alias("line"), ratio("SAMP").alias("sample"))


def example_rpb(seed: int) -> str:
    """A small well-formed model text, for tests."""
    value = lambda k: f"{((seed * 37 + k * 11) % 19 - 9) / 1e4:.6f}"
    base = {"errBias": 1, "errRand": 0, "lineOffset": 5000, "sampOffset": 6000, "latOffset": 23.1, "longOffset": 113.2, "heightOffset": 40, "lineScale": 5000, "sampScale": 6000, "latScale": 0.2, "longScale": 0.25, "heightScale": 500}
    lines = [f"    {k} = {v};" for k, v in base.items()]
    for n, k in enumerate(VECTORS):
        lead = ["0.0", "0.0", "1.0"] if k == "lineNumCoef" else ["0.0", "1.0", "0.0"] if k == "sampNumCoef" else ["1.0", "0.0", "0.0"]
        lines.append(f"    {k} = (\n" + ",\n".join(f"        {v}" for v in lead + [value(20 * n + i) for i in range(3, 20)]) + ");")
    return "BEGIN_GROUP = IMAGE\n" + "\n".join(lines) + "\nEND_GROUP = IMAGE\nEND;\n"


def _numbers(rpc: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: np.array([float(x) for x in v.split()]) for k, v in rpc.items()}


def _project(m: dict[str, np.ndarray], lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y, z = (lon - m["LONG_OFF"]) / m["LONG_SCALE"], (lat - m["LAT_OFF"]) / m["LAT_SCALE"], (h - m["HEIGHT_OFF"]) / m["HEIGHT_SCALE"]
    one = np.ones_like(x)
    terms = np.stack([one, x, y, z, x * y, x * z, y * z, x * x, y * y, z * z, x * y * z, x**3, x * y * y, x * z * z, x * x * y, y**3, y * z * z, x * x * z, y * y * z, z**3])
    ratio = lambda n: (m[f"{n}_NUM_COEFF"] @ terms) / (m[f"{n}_DEN_COEFF"] @ terms) * m[f"{n}_SCALE"] + m[f"{n}_OFF"]
    return ratio("LINE"), ratio("SAMP")


def _newton(m: dict[str, np.ndarray], line: np.ndarray, sample: np.ndarray, h: np.ndarray, lon: np.ndarray, lat: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Newton's method from a place, with differences for derivatives."""
    dx, dy = m["LONG_SCALE"][0] * 1e-5, m["LAT_SCALE"][0] * 1e-5
    with np.errstate(all="ignore"):  # a start may lead nowhere
        for _ in range(steps):
            l0, s0 = _project(m, lon, lat, h)
            lx, sx = _project(m, lon + dx, lat, h)
            ly, sy = _project(m, lon, lat + dy, h)
            a, b, c, d = (lx - l0) / dx, (ly - l0) / dy, (sx - s0) / dx, (sy - s0) / dy
            det = a * d - b * c
            u, v = line - l0, sample - s0
            lon, lat = lon + (d * u - b * v) / det, lat + (a * v - c * u) / det
    return lon, lat


def _astray(m: dict[str, np.ndarray], line: np.ndarray, sample: np.ndarray, h: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Pixels whose place on the ground does not lead back to them."""
    with np.errstate(all="ignore"):
        l0, s0 = _project(m, lon, lat, h)
        return ~((np.abs(l0 - line) <= m["LINE_SCALE"][0] * 1e-9) & (np.abs(s0 - sample) <= m["SAMP_SCALE"][0] * 1e-9))


def _ground(m: dict[str, np.ndarray], line: np.ndarray, sample: np.ndarray, h: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of pixels, by Newton's method from the model's centre.

    Pixels that do not settle, far outside of what the model was made for,
    are led there from the model's centre in ever smaller parts of the way,
    then tried from starts all around.  One that no start leads to has NaN.
    """
    lon, lat = _newton(m, line, sample, h, np.full_like(line, m["LONG_OFF"][0]), np.full_like(line, m["LAT_OFF"][0]), steps)
    places = [(x, y) for r in (2, 5, 10, 20, 40, 80) for x in (-r, -r / 2, 0, r / 2, r) for y in (-r, -r / 2, 0, r / 2, r) if x or y]
    tries = [(None, parts) for parts in (8, 32)] + [(start, 0) for start in places]
    astray = np.flatnonzero(_astray(m, line, sample, h, lon, lat))
    for start, parts in tries:
        if not len(astray):
            break
        to, across, high = line[astray], sample[astray], h[astray]
        x, y = start or (0.0, 0.0)
        near = np.full_like(to, m["LONG_OFF"][0] + x * m["LONG_SCALE"][0]), np.full_like(to, m["LAT_OFF"][0] + y * m["LAT_SCALE"][0])
        for k in range(1, parts):
            some = k / parts
            near = _newton(m, m["LINE_OFF"][0] + some * (to - m["LINE_OFF"][0]), m["SAMP_OFF"][0] + some * (across - m["SAMP_OFF"][0]), high, *near, 3)
        near = _newton(m, to, across, high, *near, 3 * steps)
        lost = _astray(m, to, across, high, *near)
        lon[astray], lat[astray] = np.where(lost, np.nan, near[0]), np.where(lost, np.nan, near[1])
        astray = astray[lost]
    return lon, lat


def rpc_coregister(grid: DataFrame, fine: dict[str, str], coarse: dict[str, str], height: float = 0.0, steps: int = 8) -> DataFrame:
    """``grid(id, row_i, col_i)`` of a fine image with the pixel coordinates (x, y) of the same ground in a coarse one.

    A pixel goes to the ground by the fine image's model at a height, and
    from there into the coarse image by its own; ``bilinear`` then samples.
    """
    a, b = _numbers(fine), _numbers(coarse)

    def run(batches):
        for pdf in batches:
            line, sample = pdf["row_i"].to_numpy(float), pdf["col_i"].to_numpy(float)
            h = np.full_like(line, height)
            y, x = _project(b, *_ground(a, line, sample, h, steps), h)
            yield pd.DataFrame({"id": pdf["id"], "x": x, "y": y})

    return grid.select("id", "row_i", "col_i").mapInPandas(run, f"id {grid.schema['id'].dataType.simpleString()}, x double, y double")
