"""Many groups in one call give what each gives alone."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lattica.operators import batches, outline
from lattica.operators import footprints as fp


def test_groups_triangulate_together_as_alone():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 12, (n, 2)) * 2.0, axis=0) + 500 * k for k, n in enumerate((60, 3, 1, 90, 2, 40))]
    group = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    corners, centres, home = fp.triangulations(np.concatenate(sets), group, 4.0)
    for k, s in enumerate(sets):
        alone, middle = fp.triangles(s, 4.0)
        assert (home == k).sum() == len(alone)
        assert sorted(map(tuple, corners[home == k].reshape(-1, 6))) == sorted(map(tuple, alone.reshape(-1, 6)))
        assert np.allclose(np.sort(centres[home == k], axis=0), np.sort(middle, axis=0))


def test_no_group_is_cut_by_batches():
    keys = np.repeat(["a", "b", "c", "d"], [5, 23, 1, 11])
    pdf = pd.DataFrame({"k": keys, "v": np.arange(len(keys))})
    for rows in (1, 4, 100):
        parts = list(batches.whole_groups(iter([pdf[i : i + 3] for i in range(0, len(pdf), 3)]), ["k"], rows))
        assert pd.concat(parts)["v"].tolist() == pdf["v"].tolist()
        seen = [set(p["k"]) for p in parts]
        assert sum(map(len, seen)) == len(set.union(*seen)) == 4


def test_alpha_shapes_equal_those_of_single_triangulations(spark):
    rng = np.random.default_rng(4)
    rows = [(c, *map(float, p)) for c in range(7) for p in rng.integers(0, 9, (c * 9, 2)) * 2]
    got = {r["cell"]: r for r in outline.alpha_areas(spark.createDataFrame(rows, "cell long, x double, y double"), 0.25).collect()}
    for c in range(1, 7):
        points = np.unique(np.array([r[1:] for r in rows if r[0] == c]), axis=0)
        t = points[outline.triangulate(points)]
        a, b, d = (np.linalg.norm(t[:, i] - t[:, j], axis=1) for i, j in ((0, 1), (1, 2), (2, 0)))
        u, v = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
        double = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        keep = (double > 1e-9) & (a * b * d <= 2 * double * 4)
        assert got[c]["points"] == c * 9 and got[c]["triangles"] == keep.sum()
        assert abs(got[c]["area"] - double[keep].sum() / 2) < 1e-9
