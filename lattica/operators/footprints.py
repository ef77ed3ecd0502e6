"""Cell footprints: alpha shapes as boundary edges, grown by a margin with round corners.

Nothing here needs a whole cell in one task.  An alpha triangle has a circle of
at most 1 / alpha without points inside, so it shows in the triangulation of the
points of a tile and that much around it; the tile of the circle's centre
reports it.  Triangles of a cell that share an edge cancel there, which leaves
the boundary.  A grown shape's boundary is where the distance to the shape is
the margin: parts of shifted edges and of arcs around corners, and what lies
within two margins decides about each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_groups
from .lineage import cut

#: Chords in a quarter of a circle.
QUARTER = 16
#: Side of a tile in largest circle radii.
TILE = 12
_EDGE = ("x0", "y0", "x1", "y1")
_M64 = np.uint64(0x9E3779B97F4A7C15)


def _jitter(points: np.ndarray) -> np.ndarray:
    """A fixed shift of each point, -1 to 1, from its coordinates alone: the same in every tile."""
    a, b = (np.ascontiguousarray(points[:, k] + 0.0).view(np.uint64) for k in (0, 1))
    out = np.empty(points.shape)
    for k, h in enumerate((a * _M64 ^ (b + _M64) * np.uint64(0xC2B2AE3D27D4EB4F), b * _M64 ^ (a + _M64) * np.uint64(0x165667B19E3779F9))):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (h >> np.uint64(11)).astype(np.float64) / (1 << 52) - 1
    return out


def triangulations(points: np.ndarray, group: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners [triangle, 3, 2] with the inside on the left, circle centres, group) of groups of distinct points: Delaunay triangles whose circle is at most ``radius``.

    Points of a group enter by x; a triangle whose circle lies left of the next
    point is final, so each point meets only the triangles along the front.  All
    groups take their next point together, so that a step is one of long arrays.
    group: 0, 1, .. in order.
    """
    empty = np.zeros((0, 3, 2)), np.zeros((0, 2)), np.zeros(0, dtype=np.int64)
    if len(points) < 3:
        return empty
    n = np.bincount(group)
    first = np.cumsum(n) - n
    middle = np.round(np.add.reduceat(points, first) / n[:, None])
    p = (points - middle[group]) / radius + _jitter(points) * 1e-7
    order = np.lexsort((points[:, 1], points[:, 0], p[:, 0], group))
    points, p = points[order], p[order]
    far = 1e3 * (1 + np.maximum.reduceat(np.abs(p).max(1), first))
    rim = np.stack((np.stack((-far, -far), 1), np.stack((far, -far), 1), np.stack((0 * far, 1.5 * far), 1)), 1)
    size, p = len(p), np.vstack((p, rim.reshape(-1, 2)))

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.stack((c[:, 1] * (b * b).sum(1) - b[:, 1] * (c * c).sum(1), b[:, 0] * (c * c).sum(1) - c[:, 0] * (b * b).sum(1)), 1) / d[:, None]
        return a + u, (u * u).sum(1)

    live = size + np.arange(3 * len(n)).reshape(-1, 3)
    home = np.arange(len(n))
    centre, r2 = circles(live)
    final = []
    for i in range(int(n.max())):
        now = (first + i)[home]
        left = n[home] <= i
        now[left] = 0
        at = p[now]
        ahead = at - centre
        gone = left | ((ahead[:, 0] > 0) & (ahead[:, 0] ** 2 > r2))
        hit = ((ahead * ahead).sum(1) < r2) & ~gone
        final.append((live[gone], home[gone]))
        old, back = live[hit], home[hit]
        e = np.vstack([old[:, k] for k in ([0, 1], [1, 2], [2, 0])])
        both = np.sort(e, axis=1)
        _, place, times = np.unique(both[:, 0] * len(p) + both[:, 1], return_index=True, return_counts=True)
        place = place[times == 1]
        its = np.tile(back, 3)[place]
        new = np.column_stack((e[place], first[its] + i))
        stay = ~(gone | hit)
        fresh = circles(new)
        live, home = np.vstack((live[stay], new)), np.concatenate((home[stay], its))
        centre, r2 = np.vstack((centre[stay], fresh[0])), np.concatenate((r2[stay], fresh[1]))
    t, home = np.vstack([f[0] for f in final] + [live]), np.concatenate([f[1] for f in final] + [home])
    inner = (t < size).all(1)
    t, home = t[inner], home[inner]
    corners = points[t]
    u, v = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    double = u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    sides = [np.linalg.norm(corners[:, i] - corners[:, j], axis=1) for i, j in ((0, 1), (1, 2), (2, 0))]
    keep = (double > 1e-9) & (np.prod(sides, axis=0) <= 2 * double * radius)
    return corners[keep], circles(t[keep])[0] * radius + middle[home[keep]], home[keep]


def triangles(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(corners, circle centres) of one group of distinct points."""
    return triangulations(points, np.zeros(len(points), dtype=np.int64), radius)[:2]


def hull(points: np.ndarray) -> np.ndarray:
    """[edge, 4]: the convex hull's edges, inside on the left; there and back for points on a line, one edge without length for a point."""
    points = np.unique(points, axis=0)
    if len(points) == 1:
        return np.hstack((points, points))

    def chain(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    rows = [tuple(q) for q in points.tolist()]
    corners = np.array(chain(rows) + chain(rows[::-1]))
    return np.hstack((corners, np.roll(corners, -1, axis=0)))


def _distance(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Least distance of each point to the edges."""
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    length = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None] - a) * d).sum(2) / length, 0, 1)
    return np.sqrt((((points[:, None] - a) - t[:, :, None] * d) ** 2).sum(2)).min(1)


def _near(low: np.ndarray, high: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i ascending: low and high bounds i and boxes j [edge, 4] that touch."""
    some = max(1, 2_000_000 // max(1, len(boxes)))
    found = []
    for k in range(0, len(low), some):
        a, b = low[k : k + some], high[k : k + some]
        i, j = np.nonzero((boxes[:, 0] <= b[:, :1]) & (boxes[:, 1] <= b[:, 1:]) & (boxes[:, 2] >= a[:, :1]) & (boxes[:, 3] >= a[:, 1:]))
        found.append((i + k, j))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, dtype=np.int64),) * 2


def _spans(i: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, from, to): the stretches between the distinct values of each i."""
    order = np.lexsort((at, i))
    i, at = i[order], at[order]
    ok = (i[1:] == i[:-1]) & (at[1:] > at[:-1])
    return i[1:][ok], at[:-1][ok], at[1:][ok]


def _least(owner: np.ndarray, i: np.ndarray, measure, initial: float) -> np.ndarray:
    """The least of measure(k, m) for each position k of ``owner`` over the pairs m whose (ascending) i is owner[k]; done in runs of bounded length."""
    count = np.bincount(i, minlength=int(owner.max(initial=-1)) + 1)
    begin = np.cumsum(count) - count
    out = np.full(len(owner), initial)
    rest = np.flatnonzero(count[owner])
    size = count[owner[rest]]
    whole = np.cumsum(size)
    cut = 0
    while cut < len(rest):
        stop = max(cut + 1, int(np.searchsorted(whole, (whole[cut - 1] if cut else 0) + 1_000_000, side="right")))
        k, n = rest[cut:stop], size[cut:stop]
        first = np.cumsum(n) - n
        m = np.repeat(begin[owner[k]] - first, n) + np.arange(int(n.sum()))
        out[k] = np.minimum(out[k], np.minimum.reduceat(measure(np.repeat(k, n), m), first))
        cut = stop
    return out


def _clear(points: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray, edges: np.ndarray, r: float) -> np.ndarray:
    """Whether each point is r or more from all edges j that are paired with its owner i."""
    a, d = edges[:, :2], edges[:, 2:] - edges[:, :2]
    length = np.maximum((d * d).sum(1), 1e-300)

    def square(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        e = j[m]
        x, y, u, v = points[k, 0] - a[e, 0], points[k, 1] - a[e, 1], d[e, 0], d[e, 1]
        t = np.clip((x * u + y * v) / length[e], 0, 1)
        x, y = x - t * u, y - t * v
        return x * x + y * y

    return _least(owner, i, square, np.inf) >= (r * (1 - 1e-9)) ** 2


def _edge_pieces(edges: np.ndarray, own: np.ndarray, boxes: np.ndarray, r: float) -> np.ndarray:
    """[piece, 5]: the parts of the own edges, shifted by r to the outside, that no edge comes nearer to than r."""
    a, d = edges[own, :2], edges[own, 2:] - edges[own, :2]
    dd = (d * d).sum(1)
    a, d, dd = a[dd > 0], d[dd > 0], dd[dd > 0]
    p = a + np.stack((d[:, 1], -d[:, 0]), 1) * (r / np.sqrt(dd))[:, None]
    i, j = _near(np.minimum(a, a + d), np.maximum(a, a + d), boxes)
    rows, values = [np.arange(len(a)), np.arange(len(a))], [np.zeros(len(a)), np.ones(len(a))]
    for q in (edges[j, :2], edges[j, 2:]):  # circles around the ends
        w = p[i] - q
        b, c = (w * d[i]).sum(1), (w * w).sum(1) - r * r
        root = b * b - dd[i] * c
        ok = root > 0
        for sign in (-1, 1):
            rows.append(i[ok])
            values.append((-b[ok] + sign * np.sqrt(root[ok])) / dd[i[ok]])
    along = edges[:, 2:] - edges[:, :2]
    along = along / np.maximum(np.hypot(along[:, 0], along[:, 1]), 1e-300)[:, None]
    across = np.stack((-along[:, 1], along[:, 0]), 1)[j]
    slope, height = (across * d[i]).sum(1), ((p[i] - edges[j, :2]) * across).sum(1)
    ok = np.abs(slope) > 1e-12 * np.sqrt(dd[i])
    for sign in (-1, 1):
        rows.append(i[ok])
        values.append((sign * r - height[ok]) / slope[ok])
    rows, values = np.concatenate(rows), np.concatenate(values)
    inside = (values >= 0) & (values <= 1)
    k, t0, t1 = _spans(rows[inside], values[inside])
    ok = _clear(p[k] + ((t0 + t1) / 2)[:, None] * d[k], k, i, j, edges, r)
    k, t0, t1 = k[ok], t0[ok], t1[ok]
    return np.hstack((p[k] + t0[:, None] * d[k], p[k] + t1[:, None] * d[k], np.zeros((len(k), 1))))


def _arcs(edges: np.ndarray, corners: np.ndarray, boxes: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corner's place, from, to): angles of the circles around corners outside the shape that no edge comes nearer to than r."""
    i, j = _near(corners, corners, boxes)
    v = corners[i]
    rows, values = [np.arange(len(corners)), np.arange(len(corners))], [np.zeros(len(corners)), np.full(len(corners), 2 * math.pi)]

    def meet(ok: np.ndarray, axis: np.ndarray, open_: np.ndarray) -> None:
        turn = np.arctan2(axis[ok, 1], axis[ok, 0])
        for a in (turn - open_, turn + open_):
            rows.append(i[ok])
            values.append(np.mod(a, 2 * math.pi))

    for q in (edges[j, :2], edges[j, 2:]):
        w = q - v
        wide = np.hypot(w[:, 0], w[:, 1])
        ok = (wide > 0) & (wide < 2 * r)
        meet(ok, w, np.arccos(wide[ok] / (2 * r)))
    d = edges[:, 2:] - edges[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])[j]
    along = d[j] / np.maximum(length, 1e-300)[:, None]
    w = edges[j, :2] - v
    for axis, levels in ((along, (0.0, length)), (np.stack((-along[:, 1], along[:, 0]), 1), (-r, r))):
        for level in levels:  # lines along the edge's sides and ends
            c = ((w * axis).sum(1) + level) / r
            ok = (np.abs(c) <= 1) & (length > 0)
            meet(ok, axis, np.arccos(c[ok]))
    k, s0, s1 = _spans(np.concatenate(rows), np.concatenate(values))
    mid = (s0 + s1) / 2

    def turn(at: np.ndarray, sign: int) -> np.ndarray:
        here = (length > 0) & (edges[j][:, at] == v).all(1)
        angle = np.arctan2(sign * d[j[here], 1], sign * d[j[here], 0])
        return _least(k, i[here], lambda q, m: np.mod(mid[q] - angle[m], 2 * math.pi), 7.0)

    # The shape leaves a direction free: clockwise from it, an edge that ends at the corner comes before one that starts there.
    ok = turn(np.array([2, 3]), -1) <= turn(np.array([0, 1]), 1) + 1e-12
    k, s0, s1, mid = k[ok], s0[ok], s1[ok], mid[ok]
    ok = _clear(corners[k] + r * np.stack((np.cos(mid), np.sin(mid)), 1), k, i, j, edges, r)
    return k[ok], s0[ok], s1[ok]


def grown_edges(edges: np.ndarray, own: np.ndarray, corners: np.ndarray, r: float, quarter: int = QUARTER) -> np.ndarray:
    """[piece, 5]: edges of the shape grown by r that come from the ``own`` edges and the ``corners``, and the area between chord and arc.

    edges: all boundary edges within two margins of those.
    """
    boxes = np.hstack((np.minimum(edges[:, :2], edges[:, 2:]) - 2 * r, np.maximum(edges[:, :2], edges[:, 2:]) + 2 * r))
    straight = _edge_pieces(edges, own, boxes, r)
    k, s0, s1 = _arcs(edges, corners, boxes, r)
    n = np.maximum(1, np.ceil((s1 - s0) / (math.pi / 2 / quarter) - 1e-9)).astype(np.int64)
    step = (s1 - s0) / n
    which = np.repeat(np.arange(len(k)), n)
    chord = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    a, b = s0[which] + chord * step[which], np.where(chord + 1 == n[which], s1[which], s0[which] + (chord + 1) * step[which])
    at = lambda s: corners[k[which]] + r * np.stack((np.cos(s), np.sin(s)), 1)
    return np.vstack((straight, np.hstack((at(a), at(b), (r * r / 2 * (step - np.sin(step)))[which][:, None]))))


def _tile(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _tiles(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], halo: float, size: float) -> DataFrame:
    """Each row in every tile that its bounds, widened by the halo, touch."""
    across = df.withColumn("_tx", F.explode(F.sequence(_tile(x[0] - halo, size), _tile(x[1] + halo, size))))
    return across.withColumn("_ty", F.explode(F.sequence(_tile(y[0] - halo, size), _tile(y[1] + halo, size))))


def alpha_edges(points: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cell, x0, y0, x1, y1): boundary edges of the alpha shape of each cell's points (cell, x, y), inside on the left; cells without triangles have none."""
    radius = 1 / alpha
    size = TILE * radius
    kind = points.schema["cell"].dataType.simpleString()

    def run(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pdf))))
        corners, centres, home = triangulations(pdf[["x", "y"]].to_numpy(np.float64), group, radius)
        tile = pdf[["_tx", "_ty"]].to_numpy(np.float64)[first][home]
        mine = (np.floor(centres / size) == tile).all(1)
        c = corners[mine]
        out = pd.DataFrame(np.concatenate([np.hstack((c[:, i], c[:, j])) for i, j in ((0, 1), (1, 2), (2, 0))]), columns=list(_EDGE))
        out.insert(0, "cell", np.tile(pdf["cell"].to_numpy()[first][home[mine]], 3))
        return out

    given = points.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().distinct()
    x, y = F.col("x"), F.col("y")
    sides = map_groups(_tiles(given, (x, x), (y, y), radius, size), ["cell", "_tx", "_ty"], run, f"cell {kind}, x0 double, y0 double, x1 double, y1 double")
    turned = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(f"_{a}") for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    once = sides.select("cell", *ends, turned.alias("_turned")).groupBy("cell", *[f"_{e}" for e in _EDGE]).agg(F.count("*").alias("_n"), F.first("_turned").alias("_turned")).filter("_n = 1")
    return once.select("cell", *[F.when(F.col("_turned"), F.col(f"_{b}")).otherwise(F.col(f"_{a}")).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))])


def hull_edges(points: DataFrame, size: float) -> DataFrame:
    """(cell, x0, y0, x1, y1): convex hulls; those of tiles first, so that a cell's group has corners only."""
    kind = points.schema["cell"].dataType.simpleString()

    def part(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(hull(pdf[["x", "y"]].to_numpy(np.float64))[:, :2], columns=["x", "y"])
        out.insert(0, "cell", key[0])
        return out

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(hull(pdf[["x", "y"]].to_numpy(np.float64)), columns=list(_EDGE))
        out.insert(0, "cell", key[0])
        return out

    given = points.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    corners = given.groupBy("cell", _tile(F.col("x"), size).alias("_tx"), _tile(F.col("y"), size).alias("_ty")).applyInPandas(part, f"cell {kind}, x double, y double")
    return corners.groupBy("cell").applyInPandas(whole, f"cell {kind}, x0 double, y0 double, x1 double, y1 double")


def grow(edges: DataFrame, margin: float, size: float, quarter: int = QUARTER) -> DataFrame:
    """(cell, x0, y0, x1, y1, bulge): boundary edges of shapes (cell, edges) grown by a margin, round corners as chords.

    ``bulge`` is the area between chord and arc: with it, areas are exact.
    Edges are at most a few tiles of ``size`` long.
    """
    kind = edges.schema["cell"].dataType.simpleString()

    def run(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        every, tile, cells = pdf[list(_EDGE)].to_numpy(np.float64), pdf[["_tx", "_ty"]].to_numpy(np.float64), pdf["cell"].to_numpy()
        done = []
        for a, b in zip(first, [*first[1:], len(pdf)], strict=True):
            rows, home = every[a:b], tile[a]
            own = (np.floor((rows[:, :2] + rows[:, 2:]) / 2 / size) == home).all(1)
            corners = np.unique(rows[:, :2], axis=0)
            corners = corners[(np.floor(corners / size) == home).all(1)]
            done.append(grown_edges(rows, own, corners, margin, quarter))
        out = pd.DataFrame(np.concatenate(done), columns=[*_EDGE, "bulge"])
        out.insert(0, "cell", np.repeat(cells[first], [len(d) for d in done]))
        return out

    # A tile's own edges reach out of it by half their length, which the bounds of the longest edge cover.
    reach = edges.select("*", F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).alias("_len"))
    halo = reach.groupBy("cell").agg(F.max("_len").alias("_reach"))
    placed = edges.join(halo, "cell")
    wide = 2 * margin + F.col("_reach")
    low = lambda a: F.least(f"{a}0", f"{a}1") - wide
    high = lambda a: F.greatest(f"{a}0", f"{a}1") + wide
    tiled = _tiles(placed, (low("x"), high("x")), (low("y"), high("y")), 0.0, size)
    return map_groups(tiled, ["cell", "_tx", "_ty"], run, f"cell {kind}, x0 double, y0 double, x1 double, y1 double, bulge double")


def footprints(points: DataFrame, alpha: float = 0.05, margin: float = 1.0, quarter: int = QUARTER) -> DataFrame:
    """(cell, x0, y0, x1, y1, bulge): each cell's alpha shape, or its convex hull where no triangle is left, grown by the margin.

    Null coordinates fall out; points that repeat count once.
    """
    size = TILE / alpha
    shapes = cut(alpha_edges(points, alpha))  # read four times below
    rest = hull_edges(points.join(shapes.select("cell").distinct(), "cell", "left_anti"), size)
    return grow(shapes.unionByName(cut(rest)), margin, size, quarter)


def areas(edges: DataFrame, *more: Column) -> DataFrame:
    """(cell, area) of footprints, with more aggregates of their edges."""
    return edges.groupBy("cell").agg(F.sum(F.expr("(x0 * y1 - x1 * y0) / 2 + bulge")).alias("area"), *more)
