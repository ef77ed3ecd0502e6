"""Polygons and footprints against rasters, closed forms and plain rules."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lattica.operators import footprints as fp
from lattica.operators import polygons as pg

RING = "a long, ring array<struct<x double, y double>>"


def rings(spark, name, outlines):
    return pg.regions(spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in outlines], RING).withColumnRenamed("a", name), name)


def inside(edges, x, y):
    """Crossing parity of points and edges."""
    hit = np.zeros(len(x), dtype=int)
    for x0, y0, x1, y1 in edges:
        up = (y0 > y) != (y1 > y)
        if y0 != y1:
            hit += up & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return hit % 2 == 1


def outline(rnd, n, x, y, r):
    """A star-shaped outline, not convex."""
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + math.cos(t) * s, y + math.sin(t) * s) for t in turns for s in [r * rnd.uniform(0.3, 1)]]


def test_overlaps_equal_a_raster(spark):
    rnd = random.Random(3)
    a = [(i, outline(rnd, 9, rnd.uniform(0, 20), rnd.uniform(0, 20), 6)[:: rnd.choice((1, -1))]) for i in range(12)]
    b = [(i, outline(rnd, 7, rnd.uniform(0, 20), rnd.uniform(0, 20), 5)[:: rnd.choice((1, -1))]) for i in range(9)]
    got = {(r.a, r.b): r for r in pg.overlaps(rings(spark, "a", a), rings(spark, "b", b), 7.0).collect()}
    step = 0.03
    g = np.arange(-7, 27, step) + step / 2
    x, y = (m.ravel() for m in np.meshgrid(g, g))
    edge = lambda r: [(*p, *q) for p, q in zip(r, r[1:] + r[:1])]
    masks = [{i: inside(edge(r), x, y) for i, r in s} for s in (a, b)]
    seen = 0
    for i, m in masks[0].items():
        for j, k in masks[1].items():
            both = float((m & k).sum()) * step * step
            if both > 0.2:
                seen += 1
                assert got[i, j].common == pytest.approx(both, rel=0.02, abs=0.05)
                assert got[i, j].iou == pytest.approx((m & k).sum() / (m | k).sum(), abs=0.02)
            elif (i, j) in got:
                assert got[i, j].common < 0.25
    assert seen > 10


def test_overlaps_of_holes_touching_and_odd_rings(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ring = rings(spark, "a", [(1, square(0, 0, 10)), (1, square(3, 3, 4)[::-1])])
    other = rings(spark, "b", [(1, square(4, 4, 2)), (2, square(2, 2, 6)), (3, square(10, 0, 5)), (4, [(0, 0), (1, 1)]), (5, []), (6, square(1, 1, 1) + [(1, 1)])])
    got = {r.b: (round(r.area_a, 9), round(r.common, 9)) for r in pg.overlaps(ring, other, 3.0).collect()}
    # Inside the hole; around it; touching; a line; nothing; a ring that closes itself.
    assert got == {2: (84.0, 20.0), 6: (84.0, 1.0)}
    assert pg.overlaps(ring.limit(0), other, 3.0).count() == 0


def test_reciprocal_matches_follow_both_maxima_and_the_votes(spark):
    found = spark.createDataFrame([("A", "X", 10.0), ("A", "Y", 20.0), ("B", "X", 12.0), ("B", "Y", 5.0)], "a string, b string, common double")
    allowed = spark.createDataFrame([("X",), ("Y",)], "b string")
    votes = lambda *v: spark.createDataFrame(list(v), "a string, b string")
    assert {(r.a, r.b) for r in pg.reciprocal(found, votes(("A", "Y"), ("B", "X")), allowed).collect()} == {("A", "Y"), ("B", "X")}
    assert pg.reciprocal(found, votes(("A", "X"), ("B", "Y")), allowed).count() == 0


def test_triangles_are_those_without_points_in_their_circle():
    rng = np.random.default_rng(1)
    p = np.unique(np.vstack((rng.uniform(0, 30, (60, 2)), np.argwhere(np.ones((6, 6))) * 2.0)), axis=0)
    corners, centres = fp.triangles(p, 6.0)
    assert len(corners) > 50
    for t, c in zip(corners, centres):
        r = np.hypot(*(t[0] - c))
        assert (np.hypot(*(p - c).T) >= r - 1e-5).all() and r <= 6.0 + 1e-5
    brute = 0
    for i in range(len(p)):
        for j in range(i):
            for k in range(j):
                (ax, ay), (bx, by), (cx, cy) = p[i], p[j], p[k]
                d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                if abs(d) < 1e-9:
                    continue
                s = [x * x + y * y for x, y in (p[i], p[j], p[k])]
                u = np.array([(s[0] * (by - cy) + s[1] * (cy - ay) + s[2] * (ay - by)) / d, (s[0] * (cx - bx) + s[1] * (ax - cx) + s[2] * (bx - ax)) / d])
                r = np.hypot(*(p[i] - u))
                if r <= 6 and (np.hypot(*(p - u).T) > r - 1e-7).all() and (np.hypot(*(p - u).T) < r + 1e-7).sum() == 3:
                    brute += 1
    on_squares = 2 * 25  # four corners of a square lie on one circle: two triangles each
    assert brute <= len(corners) <= brute + on_squares


def raster_area(edges, margin, step):
    """Area within the margin of a shape, by cells of a raster."""
    low, high = edges.min() - margin - 1, edges.max() + margin + 1
    g = np.arange(low, high, step) + step / 2
    x, y = (m.ravel() for m in np.meshgrid(g, g))
    near = np.concatenate([fp._distance(np.stack((x[i : i + 20000], y[i : i + 20000]), 1), edges) for i in range(0, len(x), 20000)]) <= margin
    return float((near | inside(edges, x, y)).sum()) * step * step


def test_grown_edges_equal_a_raster_and_closed_forms():
    point = fp.hull(np.array([[3.0, 4.0]]))
    line = fp.hull(np.array([[0.0, 0.0], [1.0, 1.0], [4.0, 4.0]]))
    square = fp.hull(np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [1.0, 1.0]]))
    area = lambda e: float(((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]) / 2 + e[:, 4]).sum())
    grown = lambda e, r: fp.grown_edges(e, np.ones(len(e), dtype=bool), np.unique(e[:, :2], axis=0), r)
    assert area(grown(point, 1.5)) == pytest.approx(math.pi * 2.25, abs=1e-9)
    assert area(grown(line, 1.0)) == pytest.approx(math.pi + 2 * 4 * math.sqrt(2), abs=1e-9)
    assert area(grown(square, 1.0)) == pytest.approx(4 + 8 + math.pi, abs=1e-9)
    # A comb, whose gaps close, and a frame, whose hole shrinks.
    comb = [(0, 0), (9, 0), (9, 5), (7, 5), (7, 2), (5.5, 2), (5.5, 5), (3, 5), (3, 2), (1, 2), (1, 5), (0, 5)]
    frame = [(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (2, 6), (6, 6), (6, 2)]
    for shape in ([comb], frame):
        e = np.array([(*p, *q) for r in shape for p, q in zip(r, [*r[1:], r[0]])], dtype=float)
        for r in (0.5, 0.9, 1.3, 2.5):
            assert area(grown(e, r)) == pytest.approx(raster_area(e, r, 0.04), rel=4e-3)


def test_footprints_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(5)
    grid = np.argwhere(np.ones((70, 40))) * 2.0
    blob = grid[(np.hypot(grid[:, 0] - 60, grid[:, 1] - 40) < 35) & (np.hypot(grid[:, 0] - 50, grid[:, 1] - 40) > 12)] + 100
    rows = [(1, *map(float, p)) for p in blob] + [(2, *map(float, p)) for p in rng.uniform(-20, 60, (80, 2))] + [(3, 0.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 1.0), (4, 5.0, 1.0), (5, 0.0, 0.0), (5, 100.0, 0.0), (5, 0.0, 100.0), (5, 100.0, 100.0), (6, None, 1.0)]
    points = spark.createDataFrame(rows, "cell long, x double, y double")
    got = {r.cell: r.area for r in fp.areas(fp.footprints(points, 0.125, 1.0)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[3] == pytest.approx(math.pi, abs=1e-9) and got[4] == pytest.approx(math.pi + 8, abs=1e-9)
    assert got[5] == pytest.approx(10000 + 400 + math.pi, abs=1e-6)  # no triangle is small enough: the hull
    edges = {c: np.array([tuple(r)[1:] for r in fp.alpha_edges(points, 0.125).filter(f"cell = {c}").collect()]) for c in (1, 2)}
    for c in (1, 2):
        whole, _ = fp.triangles(np.unique(np.array([r[1:] for r in rows if r[0] == c]), axis=0), 8.0)
        u, v = whole[:, 1] - whole[:, 0], whole[:, 2] - whole[:, 0]
        shape = edges[c]
        assert ((shape[:, 0] * shape[:, 3] - shape[:, 2] * shape[:, 1]) / 2).sum() == pytest.approx((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2)
        assert got[c] == pytest.approx(raster_area(shape, 1.0, 0.15), rel=4e-3)
