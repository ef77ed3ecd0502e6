"""Exact shape changes: what one bin more or less makes of a cell, without building the cell again.

The state of a cell is its count, centre and centred second sums, and the length
of its outline; a bin is added or removed by an update of rank one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import compactness
from .spatial import FOUR, neighbours

STATE = ("n", "mx", "my", "sxx", "sxy", "syy", "perimeter")


@dataclass(frozen=True)
class Shape:
    """Columns of a cell's state."""

    n: Column
    mx: Column
    my: Column
    sxx: Column
    sxy: Column
    syy: Column
    perimeter: Column

    @classmethod
    def of(cls, prefix: str = "") -> Shape:
        return cls(*[F.col(f"{prefix}{c}") for c in STATE])

    def changed(self, x: Column, y: Column, beside: Column, sign: Column) -> Shape:
        """After a bin at (x, y) with so many 4-neighbours in the cell is added (sign 1) or removed (-1); nothing is left of a cell's only bin."""
        n = self.n + sign
        dx, dy = x - self.mx, y - self.my
        mx, my = self.mx + sign * F.try_divide(dx, n), self.my + sign * F.try_divide(dy, n)
        ex, ey = x - mx, y - my
        return Shape(n, mx, my, self.sxx + sign * dx * ex, self.sxy + sign * dx * ey, self.syy + sign * dy * ey, self.perimeter + sign * (4 - 2 * beside))

    def elongation(self) -> Column:
        """1 - sqrt(minor / major variance), 0 for a point."""
        half, gap = (self.sxx + self.syy) / 2, self.sxx - self.syy
        r = F.sqrt(F.greatest(gap * gap / 4 + self.sxy * self.sxy, F.lit(0.0)))
        return 1 - F.sqrt(F.coalesce(F.try_divide(F.greatest(half - r, F.lit(0.0)), half + r), F.lit(1.0)))

    def compactness(self) -> Column:
        return compactness(self.n, self.perimeter)


def states(bins: DataFrame) -> DataFrame:
    """(cell, state): of bins (cell, row, col, x, y), each bin once in its cell."""
    centre = bins.groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = bins.join(centre, "cell").withColumns({"_dx": F.expr("x - mx"), "_dy": F.expr("y - my")})
    second = d.groupBy("cell", "n", "mx", "my").agg(F.sum(F.expr("_dx * _dx")).alias("sxx"), F.sum(F.expr("_dx * _dy")).alias("sxy"), F.sum(F.expr("_dy * _dy")).alias("syy"))
    shared = neighbours(bins.select("row", "col", "cell"), FOUR, ["cell"], ["cell"]).groupBy("cell").agg(F.count_if(F.expr("cell = n_cell")).alias("_shared"))
    return second.join(shared, "cell", "left").select("cell", "n", "mx", "my", "sxx", "sxy", "syy", (4 * F.col("n") - F.coalesce("_shared", F.lit(0))).alias("perimeter"))


def changes(actions: DataFrame, bins: DataFrame) -> DataFrame:
    """actions (cell, row, col, x, y, sign, ..) with the cell's new n, mx, .., perimeter, elongation and compactness, and what elongation and compactness gain.

    A sign of 1 adds the bin to the cell, -1 removes it.  Counts of 4-neighbours in
    the cell come from one join of the actions' neighbours with the bins.
    """
    key = [c for c in actions.columns]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FOUR])
    around = actions.select("cell", "row", "col", "sign", F.explode(steps).alias("_o")).select("cell", "row", "col", "sign", (F.col("row") + F.col("_o.i")).alias("_r"), (F.col("col") + F.col("_o.j")).alias("_c"))
    beside = around.join(bins.select("cell", F.col("row").alias("_r"), F.col("col").alias("_c")), ["cell", "_r", "_c"]).groupBy("cell", "row", "col", "sign").agg(F.count("*").alias("_beside"))
    old = states(bins).withColumnsRenamed({c: f"_{c}" for c in STATE})
    j = actions.join(beside, ["cell", "row", "col", "sign"], "left").join(old, "cell")
    before = Shape.of("_")
    after = before.changed(F.col("x"), F.col("y"), F.coalesce("_beside", F.lit(0)), F.col("sign"))
    j = j.withColumns({"_el": before.elongation(), "_co": before.compactness()} | {c: getattr(after, c) for c in STATE})
    now = Shape.of()
    j = j.withColumns({"elongation": now.elongation(), "compactness": now.compactness()})
    return j.withColumns({"elongation_gain": F.expr("elongation - _el"), "compactness_gain": F.expr("compactness - _co")}).select(*key, *STATE, "elongation", "compactness", "elongation_gain", "compactness_gain")


def corrections(exact: DataFrame, gain: str, cached: str, weight: Column, denominator: Column) -> DataFrame:
    """``correction``: what a cached gain of an action lacks, weighted and in units of the score."""
    return exact.withColumn("correction", weight * (F.col(gain) - F.col(cached)) / denominator)
