"""Shape of cells made of unit bins: hulls, moments, radii."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hull_area(points: list[tuple[int, int]]) -> float:
    """Area of the convex hull of integer points by the monotone chain; exact."""
    pts = sorted(set(points))

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(reversed(pts))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2


def hull_area(bins: DataFrame, cell: str) -> DataFrame:
    """(cell, n, hull): hull of the corners of each cell's unit squares, at least the cell's own area.

    Only the outermost bins of each row can touch the hull, so a cell is reduced
    to two bins a row before a task sees it.
    """
    edge = bins.groupBy(cell, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.count("*").alias("k"))

    @F.pandas_udf("double")
    def area(rows: pd.Series) -> pd.Series:
        out = []
        for cell_rows in rows:
            pts = [(r["col"] + a, r["row"] + b) for x in cell_rows for r in ({"row": int(x["row"]), "col": int(x["lo"])}, {"row": int(x["row"]), "col": int(x["hi"])}) for a in (0, 1) for b in (0, 1)]
            out.append(_hull_area(pts))
        return pd.Series(out, dtype=float)

    g = edge.groupBy(cell).agg(F.sum("k").alias("n"), F.collect_list(F.struct("row", "lo", "hi")).alias("_rows"))
    n = F.col("n").cast("double")
    return g.select(cell, "n", F.when(F.col("n") <= 2, n).otherwise(F.greatest(area("_rows"), n)).alias("hull"))


def seed_features(bins: DataFrame, cell: str) -> DataFrame:
    """(cell, n, p90_radius, elongation): 90th percentile distance to the centre, 1 - sqrt(minor / major variance)."""
    c = bins.groupBy(cell).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = bins.join(c, cell).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    a = d.groupBy(cell).agg(F.count("*").alias("n"), F.percentile(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.9)).alias("p90_radius"), F.avg(F.col("dx") * F.col("dx")).alias("xx"), F.avg(F.col("dy") * F.col("dy")).alias("yy"), F.avg(F.col("dx") * F.col("dy")).alias("xy"))
    half = (F.col("xx") + F.col("yy")) / 2
    gap = F.col("xx") - F.col("yy")
    r = F.sqrt(F.greatest(gap * gap / 4 + F.col("xy") * F.col("xy"), F.lit(0.0)))
    ratio = F.coalesce(F.try_divide(F.greatest(half - r, F.lit(0.0)), half + r), F.lit(1.0))
    return a.select(cell, "n", "p90_radius", (1 - F.sqrt(ratio)).alias("elongation"))
