"""Alpha shapes: the Delaunay triangles of a cell's points with a small circumcircle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .batches import map_groups
from .footprints import triangulations


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (index triples) of distinct points, by insertion: each point re-triangulates the hole of circles that hold it.

    Collinear points have none.  One call for one group, point by point: ``triangulations`` does the work of queries.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), dtype=np.int64)
    low, size = points.min(axis=0), max(float(np.ptp(points, axis=0).max()), 1.0)
    # A fixed tiny shift parts points of a grid that lie on one circle; the triangles are those of some Delaunay triangulation.
    rng = np.random.default_rng(0)
    p = (points - low) / size + rng.uniform(-1, 1, (n, 2)) * 1e-7
    p = np.vstack((p, [[-50.0, -50.0], [51.0, -50.0], [0.5, 60.0]]))
    tri = np.array([[n, n + 1, n + 2]])
    for i in range(n):
        a, b, c = (p[tri[:, k]] - p[i] for k in range(3))
        area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        sa, sb, sc = ((v * v).sum(axis=1) for v in (a, b, c))
        det = sa * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) - sb * (a[:, 0] * c[:, 1] - a[:, 1] * c[:, 0]) + sc * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
        inside = det * np.sign(area) > 0
        edges = np.vstack([tri[inside][:, [0, 1]], tri[inside][:, [1, 2]], tri[inside][:, [2, 0]]])
        _, at, count = np.unique(np.sort(edges, axis=1), axis=0, return_index=True, return_counts=True)
        rim = edges[at[count == 1]]
        tri = np.vstack((tri[~inside], np.column_stack((rim, np.full(len(rim), i)))))
    return tri[(tri < n).all(axis=1)]


def _outer(corners: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, group) of the sides that one triangle of a group has alone."""
    sides = np.concatenate([np.hstack((corners[:, i], corners[:, j])) for i, j in ((0, 1), (1, 2), (2, 0))])
    swap = (sides[:, 0] > sides[:, 2]) | ((sides[:, 0] == sides[:, 2]) & (sides[:, 1] > sides[:, 3]))
    sides[swap] = sides[swap][:, [2, 3, 0, 1]]
    home = np.tile(home, 3)
    order = np.lexsort((*sides.T, home))
    sides, home = sides[order], home[order]
    same = np.zeros(len(sides) + 1, dtype=bool)
    same[1:-1] = (sides[1:] == sides[:-1]).all(1) & (home[1:] == home[:-1])
    once = ~(same[1:] | same[:-1])
    return np.hypot(sides[once, 0] - sides[once, 2], sides[once, 1] - sides[once, 3]), home[once]


def alpha_areas(bins: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cell, points, triangles, area, rim): the alpha shape of each cell's points (cell, x, y); a cell is one group of bounded size.

    Cells of fewer than four points have no triangles.  area is that of the
    triangles, rim the length of their outer edges; a shape grown by a margin has
    about area + rim * margin more.
    """

    def run(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        n = len(first)
        group = np.repeat(np.arange(n), np.diff(np.append(first, len(pdf))))
        given = pd.DataFrame({"g": group, "x": pdf["x"].to_numpy(np.float64), "y": pdf["y"].to_numpy(np.float64)}).drop_duplicates()
        given = given[np.bincount(given["g"], minlength=n)[given["g"]] > 3]
        which, dense = np.unique(given["g"].to_numpy(), return_inverse=True)
        t, _, home = triangulations(given[["x", "y"]].to_numpy(), dense, 1 / alpha)
        home = which[home] if len(which) else home
        u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
        area = np.bincount(home, np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) / 2, minlength=n)
        length, side = _outer(t, home)
        return pd.DataFrame({"cell": pdf["cell"].to_numpy()[first], "points": np.bincount(group, minlength=n), "triangles": np.bincount(home, minlength=n), "area": area, "rim": np.bincount(side, length, minlength=n)})

    kind = bins.schema["cell"].dataType.simpleString()
    return map_groups(bins.select("cell", "x", "y"), ["cell"], run, f"cell {kind}, points long, triangles long, area double, rim double")
