"""Spatial joins on grids and points.

A theta join on distance becomes an equi join on grid cells: one side is copied
to the cells its reach touches, the other is looked up in its own cell, and the
exact predicate follows.  No cross join is ever planned, and the cell size is
the reach, so a cell holds what its density gives and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import gaussian_kernel
from .lineage import cut, small


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def radius_join(points: DataFrame, centers: DataFrame, reach: float, extra: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs of points (.., x, y) and centers (.., cx, cy) with distance d <= reach, each center copied to nine grid cells.

    ``tasks``: grid cells are dealt to that many tasks and not packed by size, for few rows with many pairs.
    """
    p = points.withColumns({"_gx": _cell(F.col("x"), reach), "_gy": _cell(F.col("y"), reach)})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = centers.withColumn("_o", F.explode(near)).withColumns({"_gx": _cell(F.col("cx"), reach) + F.col("_o.i"), "_gy": _cell(F.col("cy"), reach) + F.col("_o.j")}).drop("_o")
    if tasks:
        p, c = (df.repartition(tasks, "_gx", "_gy") for df in (p, c))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d2 = dx * dx + dy * dy
    joined = p.join(c, ["_gx", "_gy"]).filter(d2 <= reach * reach).withColumn("d", F.sqrt(d2)).drop("_gx", "_gy")
    return joined.filter(extra) if extra is not None else joined


def places(centers: DataFrame, tie: Sequence[Column]) -> DataFrame:
    """Of the centers at one place, the first in the order of ``tie``: the others are never the nearest."""
    rest = [c for c in centers.columns if c not in ("cx", "cy")]
    kept = centers.filter("cx is not null and cy is not null").groupBy("cx", "cy")
    return kept.agg(F.min_by(F.struct(*rest), F.struct(*tie)).alias("_m")).select("cx", "cy", "_m.*") if rest else kept.agg(F.lit(1).alias("_m")).drop("_m")


def nearest(points: DataFrame, centers: DataFrame, keys: Sequence[str], reach: float, tie: Sequence[Column]) -> DataFrame:
    """For each point the nearest center, whatever its distance; of equals the first in the order of ``tie``, columns of the centers.

    Tiles of the points, a fourth of the side from level to level down to the
    reach, keep the centers that can be the nearest of a point in them: those that
    the one nearest the tile's middle does not beat at all four corners.  A far
    tile keeps few, so no point meets the centers of a whole region.
    """
    if bad := points.filter("x is null or y is null or isnan(x) or isnan(y)").limit(1).collect():
        raise RuntimeError(f"a point without a place: {bad[0]}")
    rest = list(centers.columns)
    left = places(centers, tie).select(*rest)
    tiled = points.withColumns({"_gx": _cell(F.col("x"), reach), "_gy": _cell(F.col("y"), reach)})
    leaves = cut(tiled.select("_gx", "_gy").distinct())
    span = leaves.agg((F.max("_gx") - F.min("_gx")).alias("w"), (F.max("_gy") - F.min("_gy")).alias("h")).first()
    level = 0
    while 4**level <= max(span["w"] or 0, span["h"] or 0):
        level += 1
    while level >= 0:
        size = 4**level
        tiles = leaves.select((F.floor(F.col("_gx") / size)).alias("_tx"), F.floor(F.col("_gy") / size).alias("_ty")).distinct()
        if "_tx" in left.columns:
            inner = tiles.select("*", F.floor(F.col("_tx") / 4).alias("_ux"), F.floor(F.col("_ty") / 4).alias("_uy"))
            met = left.withColumnsRenamed({"_tx": "_ux", "_ty": "_uy"}).join(small(inner), ["_ux", "_uy"]).drop("_ux", "_uy")
        else:
            met = left.crossJoin(small(tiles))
        left = cut(_not_beaten(cut(met), reach * size))
        level -= 1
    leaf = left.withColumnsRenamed({"_tx": "_gx", "_ty": "_gy"})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d = tiled.select(*keys, "x", "y", "_gx", "_gy").join(leaf, ["_gx", "_gy"]).withColumn("d", F.sqrt(dx * dx + dy * dy))
    return cut(d.groupBy(*keys).agg(F.min_by(F.struct("d", *rest), F.struct("d", *tie)).alias("_m")).select(*keys, "_m.*"))


def _not_beaten(met: DataFrame, side: float) -> DataFrame:
    """Rows (_tx, _ty, cx, cy, ..) but those that their tile's middlemost center beats at each corner of the tile, by more than rounding."""
    far = lambda i, j, x, y: ((F.col("_tx") + i) * side - F.col(x)) * ((F.col("_tx") + i) * side - F.col(x)) + ((F.col("_ty") + j) * side - F.col(y)) * ((F.col("_ty") + j) * side - F.col(y))
    best = met.groupBy("_tx", "_ty").agg(F.min(F.struct(far(0.5, 0.5, "cx", "cy").alias("d"), F.col("cx").alias("x"), F.col("cy").alias("y"))).alias("_b"))
    both = met.join(small(best), ["_tx", "_ty"])
    near = [far(i, j, "cx", "cy") <= far(i, j, "_b.x", "_b.y") * (1 + 1e-12) for i in (0, 1) for j in (0, 1)]
    return both.filter(near[0] | near[1] | near[2] | near[3]).drop("_b")


def k_nearest(points: DataFrame, centers: DataFrame, keys: Sequence[str], reach: float, k: int, tie: Sequence[Column]) -> DataFrame:
    """The k nearest centers within the reach, ranked by distance, then ``tie``, columns of the centers; a place gives its k first, so crowded centers do not multiply."""
    order = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(*tie))
    first = centers.withColumn("_p", order).filter(F.col("_p") <= k).drop("_p")
    w = Window.partitionBy(*keys).orderBy("d", *tie)
    return radius_join(points, first, reach).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_other(centers: DataFrame, key: str, reach: float) -> DataFrame:
    """(key, other, d): the nearest center (key, cx, cy) of another key, of equals the least; none for a lone center.

    Centers that share their place are each other's; only centers alone at their
    place look around, by doubled reach, and a place shows them its least key.
    """
    at = cut(centers.filter("cx is not null and cy is not null").groupBy("cx", "cy").agg(F.min(key).alias("_a"), F.max(key).alias("_z")))
    crowded = centers.join(at.filter("_a <> _z"), ["cx", "cy"])
    rest = crowded.filter(F.col(key) != F.col("_a")).select(key, F.col("_a").alias("other"), "cx", "cy")
    first = rest.groupBy("cx", "cy").agg(F.min(key).alias("other"), F.min("other").alias(key)).select(key, "other")
    out = rest.select(key, "other").unionByName(first).withColumn("d", F.lit(0.0))
    todo = at.filter("_a = _z").select(F.col("_a").alias(key), F.col("cx").alias("x"), F.col("cy").alias("y"))
    others = at.select(F.col("_a").alias("other"), "cx", "cy")
    span = at.agg((F.max("cx") - F.min("cx") + F.max("cy") - F.min("cy")).alias("s")).first()["s"] or 0.0
    while True:
        # Beyond the extent only a single centre is left without another one.
        if todo.isEmpty() or reach > 2 * span:
            return out
        hit = cut(radius_join(todo, others, reach, F.col("other") != F.col(key)).groupBy(key).agg(F.min_by(F.struct("other", "d"), F.struct("d", "other")).alias("m")).select(key, "m.*"))
        out = out.unionByName(hit)
        todo = todo.join(hit.select(key), key, "left_anti")
        reach *= 2


def with_other_distance(points: DataFrame, centers: DataFrame, keys: Sequence[str], key: str, reach: float) -> DataFrame:
    """(keys, key, d, other): centers (key, cx, cy) within the reach of each point and the least distance there of another key, null without one.

    The two least distances of a point come from its near places, so what is
    joined and ranked does not grow with the centers at a place; these join last.
    """
    keys = list(keys)
    at = centers.groupBy("cx", "cy").agg(F.min(key).alias("_a"), F.count("*").alias("_n"))
    near = cut(radius_join(points, at, reach).select(*keys, "cx", "cy", "d", "_a", "_n"))
    ends = near.groupBy(*keys).agg(F.min(F.struct("d", "_a", "_n")).alias("_m"))
    second = near.join(ends.select(*keys, F.col("_m._a").alias("_b")), keys).filter("_a <> _b").groupBy(*keys).agg(F.min("d").alias("_s"))
    ends = ends.join(second, keys, "left")
    two = ends.select(*keys, F.col("_m._a").alias("_first"), F.col("_m.d").alias("_d1"), F.when(F.col("_m._n") > 1, F.col("_m.d")).otherwise(F.col("_s")).alias("_d2"))
    each = near.select(*keys, "cx", "cy", "d").join(two, keys).join(centers.select(key, "cx", "cy"), ["cx", "cy"])
    return each.select(*keys, key, "d", F.when(F.col(key) == F.col("_first"), F.col("_d2")).otherwise(F.col("_d1")).alias("other"))


def nearest_few(points: DataFrame, centers: DataFrame, keys: Sequence[str], reach: float, k: int, tie: str) -> DataFrame:
    """(keys, near): the k first centers within the reach by distance (nine digits), then ``tie``, as an array of ``tie``.

    The reach doubles from a sixteenth for points that have found fewer than k, and
    a place gives its k first centers, so crowded centers do not multiply.
    """
    order = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(tie))
    first = cut(centers.select("cx", "cy", tie).withColumn("_r", order).filter(F.col("_r") <= k).drop("_r"))
    out, todo = None, cut(points)
    w = Window.partitionBy(*keys).orderBy(F.round("d", 9), tie)
    for step in range(5):
        r = reach / 2 ** (4 - step)
        ranked = radius_join(todo, first, r).select(*keys, "d", tie).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        found = ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", tie))), lambda c: c[tie]).alias("near"), F.max("d").alias("_d"))
        # What lies beyond the reach may still share nine digits with what lies on its rim.
        done = cut(found.filter((F.size("near") == k) & (F.col("_d") <= r - 1e-6)) if step < 4 else found).drop("_d")
        out = done if out is None else out.unionByName(done)
        todo = todo.join(done.select(*keys), list(keys), "left_anti")
    return out


def typed_weights(points: DataFrame, centers: DataFrame, keys: Sequence[str], scale: float, tie: Sequence[Column]) -> DataFrame:
    """(keys, type, weight): shares of the types of centers (.., type, cx, cy) within three scales of each point, by a Gaussian of the distance.

    A point without a center that near has the type of its nearest one alone;
    without any center there are no rows.
    """
    # Centers of one type at one place count as often as they are there.
    placed = centers.groupBy("type", "cx", "cy").agg(F.count("*").alias("_n"))
    near = radius_join(points, placed, 3 * scale)
    sums = cut(near.groupBy(*keys, "type").agg(F.sum(F.col("_n") * F.exp(-F.col("d") * F.col("d") / (2 * scale * scale))).alias("_w")))
    whole = sums.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    shares = sums.join(whole, list(keys)).select(*keys, "type", (F.col("_w") / F.col("_all")).alias("weight"))
    far = points.join(whole.select(*keys), list(keys), "left_anti")
    lone = nearest(far, centers, keys, 6 * scale, tie)
    return shares.unionByName(lone.select(*keys, "type", F.lit(1.0).alias("weight")))


def typed_sums(centers: DataFrame, key: str, scale: float) -> DataFrame:
    """(key, type, w): sums of a Gaussian of the distance over the centers (key, type, cx, cy) of a type within three scales of each center, itself too.

    Pairs are of places, so what is joined does not grow with the centers at a place; these join last.
    """
    placed = cut(centers.filter("cx is not null and cy is not null").groupBy("type", "cx", "cy").agg(F.count("*").alias("_n")))
    spots = placed.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    near = radius_join(spots, placed, 3 * scale, tasks=int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = near.groupBy(F.col("x").alias("cx"), F.col("y").alias("cy"), "type").agg(F.sum(F.col("_n") * gaussian_kernel(F.col("d") * F.col("d"), scale)).alias("w"))
    return centers.select(key, "cx", "cy").join(sums, ["cx", "cy"]).groupBy(key, "type").agg(F.sum("w").alias("w"))


def in_rectangles(points: DataFrame, rectangles: DataFrame, key: str, tile: float) -> DataFrame:
    """Points (x, y) inside closed rectangles (key, x0, x1, y0, y1), by tiles that the rectangles touch."""
    tiles = rectangles.withColumn("_tx", F.explode(F.sequence(_cell(F.col("x0"), tile), _cell(F.col("x1"), tile)))).withColumn("_ty", F.explode(F.sequence(_cell(F.col("y0"), tile), _cell(F.col("y1"), tile))))
    p = points.withColumns({"_tx": _cell(F.col("x"), tile), "_ty": _cell(F.col("y"), tile)})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return p.join(tiles, ["_tx", "_ty"]).filter(inside).select(key, *points.columns)


def rectangle_overlaps(a: DataFrame, b: DataFrame, tile: float, tasks: int | None = None) -> DataFrame:
    """Pairs (a, b) of closed rectangles that touch: a (a, ax0, ax1, ay0, ay1), b likewise.

    ``tasks``: tiles are dealt to that many tasks and not packed by size, for pairs that are much work each.
    """

    def tiles(df: DataFrame, n: str) -> DataFrame:
        t = df.withColumn("_tx", F.explode(F.sequence(_cell(F.col(f"{n}x0"), tile), _cell(F.col(f"{n}x1"), tile))))
        t = t.withColumn("_ty", F.explode(F.sequence(_cell(F.col(f"{n}y0"), tile), _cell(F.col(f"{n}y1"), tile))))
        return t.repartition(tasks, "_tx", "_ty") if tasks else t

    c = F.col
    meet = (c("ax0") <= c("bx1")) & (c("bx0") <= c("ax1")) & (c("ay0") <= c("by1")) & (c("by0") <= c("ay1"))
    # A pair is reported by the tile of its lower left common corner only.
    home = (c("_tx") == _cell(F.greatest("ax0", "bx0"), tile)) & (c("_ty") == _cell(F.greatest("ay0", "by0"), tile))
    return tiles(a, "a").join(tiles(b, "b"), ["_tx", "_ty"]).filter(meet & home).drop("_tx", "_ty")


EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def neighbours(bins: DataFrame, offsets: Sequence[tuple[int, int]], keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of bins (row, col, ..) with each existing neighbour's ``columns`` as n_<column>."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    left = bins.select("row", "col", *keep, F.explode(steps).alias("_o")).withColumns({"_r": F.col("row") + F.col("_o.i"), "_c": F.col("col") + F.col("_o.j")}).drop("_o")
    right = bins.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return left.join(right, ["_r", "_c"]).drop("_r", "_c")


def block_sums(bins: DataFrame, width: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over width x width blocks of the grid; partial blocks fall out."""
    b = bins.groupBy(*keys, F.expr(f"floor(row / {width})").alias("brow"), F.expr(f"floor(col / {width})").alias("bcol")).agg(F.count("*").alias("_n"), F.sum(value).alias(value))
    return b.filter(F.col("_n") == width * width).drop("_n")


def lag_pairs(bins: DataFrame, lag: tuple[int, int], value: str) -> DataFrame:
    """(a, b): values of bins and of the bins at the lag."""
    other = bins.select((F.col("row") - lag[0]).alias("row"), (F.col("col") - lag[1]).alias("col"), F.col(value).alias("b"))
    return bins.select("row", "col", F.col(value).alias("a")).join(other, ["row", "col"]).select("a", "b")
