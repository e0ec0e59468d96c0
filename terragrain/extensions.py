"""What a caller can plug in: seam methods, balancing methods by name, and sharpening by component substitution.

A method works on DataFrames and gives DataFrames, so a plugged one is planned
with the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import color, pansharpen
from .operators.seam import SeamCost, seam, sites, smooth_cost
from .operators.stretch import match_histograms, saturate


class MosaicMethod(Protocol):
    """How two images share their overlap."""

    def prepare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """What the method needs of both images, pixel by pixel."""

    def execute(self, prepared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        """(row_i, col_i, label): 0 old, 1 new."""


class GraphCut:
    """The seam of least cost, on any number of levels, under any cost."""

    def __init__(self, levels: int = 1, cost: SeamCost = smooth_cost):
        self.levels, self.cost = levels, cost

    def prepare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return sites(old, new)

    def execute(self, prepared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        return seam(old, new, self.levels, self.cost)


class NewerWins:
    """No seam: the new image takes all it shows."""

    def prepare(self, old: DataFrame, new: DataFrame) -> DataFrame:
        return sites(old, new)

    def execute(self, prepared: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
        return prepared.select("row_i", "col_i", (F.col("cls") != 0).cast("int").alias("label"))


def shared(method: MosaicMethod, old: DataFrame, new: DataFrame) -> DataFrame:
    return method.execute(method.prepare(old, new), old, new)


#: Balancing methods by name: fit(px, bands, cell) → model, apply(px, model, keys) → px.
BALANCING: dict[str, tuple[Callable, Callable]] = {"GlobalToLocal": (color.fit, color.apply)}


def balancing(name: str) -> tuple[Callable, Callable]:
    if name not in BALANCING:
        raise ValueError(f"unknown balancing method {name}; there are {sorted(BALANCING)}")
    return BALANCING[name]


class ComponentSubstitution:
    """Sharpening in hooks; subclasses replace any of them.

    ``weights`` sees the masked pixels, ``statistics`` the synthetic band,
    ``injection_gains`` the statistics, and ``inject`` puts a band together.
    """

    last = 65535

    def weights(self, px: DataFrame, pan: str, bands: list[str]) -> tuple[list[float], float]:
        raise NotImplementedError

    def statistics(self, px: DataFrame, synth: Column, bands: list[str]) -> DataFrame:
        return pansharpen.statistics(px, synth, bands)

    def injection_gains(self, stats: DataFrame, bands: list[str]) -> dict[str, float]:
        row = pansharpen.gains(stats, bands).first()
        return {b: float(row[f"g_{b}"] or 0.0) for b in bands}

    def match(self, valid: DataFrame, pan: str, synth: Column) -> DataFrame:
        """(dn, out): what PAN's numbers become."""
        hist = lambda x: valid.groupBy(x.alias("dn")).agg(F.count("*").alias("cnt"))
        return match_histograms(hist(F.col(pan).cast("long")), hist(saturate(synth, self.last)))

    def inject(self, band: Column, gain: float, delta: Column) -> Column:
        return band + F.lit(gain) * delta

    def run(self, px: DataFrame, pan: str, bands: list[str], keys: list[str]) -> DataFrame:
        masked = pansharpen.mutual_mask(px, pan, bands).select(*keys, pan, *bands)
        weights, c = self.weights(masked, pan, bands)
        synth = pansharpen.synthetic(bands, weights, c)
        gains = self.injection_gains(self.statistics(masked, synth, bands), bands)
        table = self.match(masked.where(F.col(bands[0]) > 0), pan, synth)  # at most ``last`` + 1 rows
        matched = masked.join(F.broadcast(table.select(F.col("dn").alias(pan), "out")), pan, "left")
        delta = F.coalesce("out", F.lit(0)) - synth
        out = [F.when(F.col(bands[0]) > 0, saturate(self.inject(F.col(b), gains[b], delta), self.last)).otherwise(F.lit(0)).cast("long").alias(b) for b in bands]
        return matched.select(*keys, *out)


class GramSchmidt(ComponentSubstitution):
    def weights(self, px, pan, bands):
        return [1 / len(bands)] * len(bands), 0.0


class AdaptiveGramSchmidt(ComponentSubstitution):
    def weights(self, px, pan, bands):
        return pansharpen.least_squares(px, bands, pan)
