"""Polygons: regions as rows of directed edges, areas of what two regions share, reciprocal matches.

A region is a table of edges (key, x0, y0, x1, y1) in any order and either
direction: an outline, an outline with holes that run the other way, or several
outlines.  Below an edge lies a trapezoid that counts with the sign of the
edge's direction; a region is the signed sum of its trapezoids.  So the area
that two regions share is the signed sum over pairs of edges of the area that
two trapezoids share, which is the integral of the smaller of two lines: convex
or not, with no clipping, and an outline of many edges is never one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import small
from .spatial import rectangle_overlaps

#: Areas up to this are none: regions that touch.
LEAST_AREA = 1e-9


def regions(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, x0, y0, x1, y1): the edges of rings (key, ring) of points; a ring closes itself, null points and points that repeat fall out."""
    points = rings.select(key, F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("_p")).filter(F.size("_p") > 2)
    after = F.concat(F.slice("_p", 2, F.size("_p")), F.slice("_p", 1, 1))
    edges = points.select(key, F.explode(F.arrays_zip(F.col("_p").alias("p"), after.alias("q"))).alias("e"))
    return edges.select(key, F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")).filter("x0 <> x1 or y0 <> y1")


def extents(edges: DataFrame, key: str) -> DataFrame:
    """(key, area, x0, x1, y0, y1): signed area, positive if the inside is on the left, and bounds of each region."""
    return edges.groupBy(key).agg(
        F.sum(F.expr("(x0 * y1 - x1 * y0) / 2")).alias("area"),
        F.min(F.least("x0", "x1")).alias("x0"), F.max(F.greatest("x0", "x1")).alias("x1"), F.min(F.least("y0", "y1")).alias("y0"), F.max(F.greatest("y0", "y1")).alias("y1"),
    )


def _pieces(edges: DataFrame, key: str, tile: float) -> DataFrame:
    """(key, _area_<key>, <key>x0, .. bounds, _<key>): regions as pieces of a bounded number of edges; a region of few edges is one piece.

    Others are cut into columns of a tile's width, each with the edges that reach into it, and its bounds in x are the column's.
    """
    box = extents(edges, key).join(edges.groupBy(key).agg(F.count("*").alias("_n")), key)
    whole, many = box.filter(F.col("_n") <= PIECE), box.filter(F.col("_n") > PIECE)
    column = lambda v: F.floor(v / tile).cast("long")
    flat = F.filter(F.collect_list(F.array("x0", "y0", "x1", "y1")), lambda e: e[0] != e[2])
    rings = edges.groupBy(key).agg(flat.alias("_e"))
    one = whole.join(rings, key)
    cut_ = edges.join(many.select(key), key, "left_semi").withColumn("_c", F.explode(F.sequence(column(F.least("x0", "x1")), column(F.greatest("x0", "x1")))))
    rows = cut_.groupBy(key, "_c").agg(flat.alias("_e"))
    part = many.join(rows, key).withColumns({"x0": F.greatest("x0", F.col("_c") * tile), "x1": F.least("x1", (F.col("_c") + 1) * tile)}).drop("_c")
    both = one.unionByName(part).filter(F.size("_e") > 0)
    return both.select(key, F.col("area").alias(f"_area_{key}"), *[F.col(c).alias(f"{key}{c}") for c in ("x0", "x1", "y0", "y1")], F.flatten("_e").alias(f"_{key}"))


#: A region of up to this many edges is one piece.
PIECE = 64


def _ragged(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Edges [n, 4] of all rows and the number of each row's."""
    n = values.map(len).to_numpy(np.int64) // 4
    return (np.concatenate(values.to_numpy()) if len(values) else np.zeros(0)).reshape(-1, 4), n


def _parts(e: np.ndarray, f: np.ndarray, base: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Signed area that the trapezoids of edges e and f [n, 4] down to base share between left and right."""
    lo = np.maximum(np.maximum(np.minimum(e[:, 0], e[:, 2]), np.minimum(f[:, 0], f[:, 2])), left)
    hi = np.minimum(np.minimum(np.maximum(e[:, 0], e[:, 2]), np.maximum(f[:, 0], f[:, 2])), right)
    out = np.zeros(len(e))
    met = np.flatnonzero(lo < hi)
    e, f, base, lo, hi = e[met], f[met], base[met], lo[met], hi[met]
    height = lambda g, x: g[:, 1] - base + (x - g[:, 0]) * ((g[:, 3] - g[:, 1]) / (g[:, 2] - g[:, 0]))
    e0, e1, f0, f1 = height(e, lo), height(e, hi), height(f, lo), height(f, hi)
    d0, d1, m0, m1 = e0 - f0, e1 - f1, np.minimum(e0, f0), np.minimum(e1, f1)
    cross = d0 * d1 < 0
    t = np.where(cross, d0 / np.where(cross, d0 - d1, 1.0), 1.0)
    mid = e0 + t * (e1 - e0)
    twice = np.where(cross, (m0 + mid) * t + (mid + m1) * (1 - t), m0 + m1)
    out[met] = np.sign((e[:, 2] - e[:, 0]) * (f[:, 2] - f[:, 0])) * (hi - lo) / 2 * twice
    return out


def _common(pairs: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Signed area that two pieces share, row by row; pairs of edges in runs of bounded length."""
    for a, b, left, right, base in pairs:
        (e, m), (f, n) = _ragged(a), _ragged(b)
        at_e, at_f, size = np.cumsum(m) - m, np.cumsum(n) - n, m * n
        whole, out, k = np.cumsum(size), np.zeros(len(size)), 0
        left, right, base = (v.to_numpy(np.float64) for v in (left, right, base))
        while k < len(size):
            stop = max(k + 1, int(np.searchsorted(whole, (whole[k - 1] if k else 0) + 500_000, side="right")))
            row = np.repeat(np.arange(k, stop), size[k:stop])
            turn = np.arange(len(row)) - np.repeat(np.cumsum(size[k:stop]) - size[k:stop], size[k:stop])
            part = _parts(e[at_e[row] + turn // n[row]], f[at_f[row] + turn % n[row]], base[row], left[row], right[row])
            out[k:stop] = np.bincount(row - k, part, minlength=stop - k)
            k = stop
        yield pd.Series(out)


def overlaps(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(a, b, area_a, area_b, common, iou) of regions that share area: edges a (a, x0, y0, x1, y1) and b (b, x0, y0, x1, y1).

    Bounds of pieces of regions meet by tiles of the plane, each pair in one of
    them, and bring their edges along: no pair of edges is a row, and none is shuffled.
    """
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strip = rectangle_overlaps(_pieces(a, "a", tile), _pieces(b, "b", tile), tile, tasks)
    common = F.pandas_udf(_common, "double")
    bounds = F.greatest("ax0", "bx0"), F.least("ax1", "bx1"), F.least("ay0", "by0")
    found = strip.filter(bounds[0] < bounds[1]).select("a", "b", "_area_a", "_area_b", common("_a", "_b", *bounds).alias("_part"))
    found = found.groupBy("a", "b", "_area_a", "_area_b").agg(F.sum("_part").alias("_sum"))
    found = found.select("a", "b", F.abs("_area_a").alias("area_a"), F.abs("_area_b").alias("area_b"), F.expr("_sum * signum(_area_a) * signum(_area_b)").alias("common")).filter(F.col("common") > LEAST_AREA)
    return found.withColumn("iou", F.col("common") / (F.col("area_a") + F.col("area_b") - F.col("common")))


def expanded(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``found`` of regions that stand for equal ones, as pairs of all: members (of, member), on both sides."""
    members = small(members)
    for side in ("a", "b"):
        found = found.join(members.select(F.col("of").alias(side), F.col("member").alias("_m")), side).drop(side).withColumnRenamed("_m", side)
    return found


def reciprocal(found: DataFrame, votes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs of ``found`` that share most area with each other, the greater id of equals, where a's vote (a, b) is b and b is allowed (b)."""
    row = F.struct("common", "b"), F.struct("common", "a")
    best_a = found.groupBy("a").agg(F.max_by("b", row[0]).alias("b"))
    best_b = found.groupBy("b").agg(F.max_by("a", row[1]).alias("a"))
    both = best_a.join(best_b, ["a", "b"]).join(votes.select("a", "b"), ["a", "b"], "left_semi").join(allowed.select("b"), "b", "left_semi")
    return found.join(both, ["a", "b"])
