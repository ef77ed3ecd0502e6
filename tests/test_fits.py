"""Projective and Gaussian fits, and shape updates, against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions.maths import projective
from lattica.operators import fits, moments

MATRIX = np.array([[7.3, -0.1, 500], [0.05, 7.3, 700], [1e-4, -2e-4, 1]])


def project(h, xy):
    m = np.column_stack((xy, np.ones(len(xy)))) @ h.T
    return m[:, :2] / m[:, 2:]


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_homography_recovers_the_matrix(spark, share):
    rng = np.random.default_rng(3)
    xy = np.stack(np.meshgrid(np.arange(0, 100, 5.0), np.arange(0, 100, 5.0)), -1).reshape(-1, 2)
    uv = project(MATRIX, xy)
    wrong = rng.random(len(xy)) < share
    uv[wrong] += rng.normal(0, 200, (wrong.sum(), 2)) + 100
    points = spark.createDataFrame([(*map(float, (*a, *b)),) for a, b in zip(xy, uv)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, p double, q double")
    h = fits.homography(points, "a", "b", "p", "q", robust=share > 0, tolerance=1e-3)
    np.testing.assert_allclose(project(h, xy), project(MATRIX, xy), atol=1e-3)
    if share:
        with pytest.raises(ValueError, match="not one projective"):
            fits.homography(points, "a", "b", "p", "q", tolerance=1e-3)
    with pytest.raises(ValueError, match="four points"):
        fits.homography(points.limit(3), "a", "b", "p", "q")


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_homography_whose_horizon_crosses_the_points(spark, share):
    rng = np.random.default_rng(5)
    x, y = np.meshgrid(np.arange(0, 256, 16.0), np.arange(0, 100_000, 250.0))
    xy, a = np.stack((x, y), -1).reshape(-1, 2), (3.65, -0.05, 500.0, 0.025, 3.65, 700.0, 0.0, -2.0**-15, 1.0)
    w = xy @ a[6:8] + 1
    w[np.abs(xy[:, 1] - 32_750) < 1] = 0  # a row of points on the horizon itself
    xy[w == 0, 1] = 2.0**15
    with np.errstate(divide="ignore"):
        uv = np.stack((xy @ a[:2] + a[2], xy @ a[3:5] + a[5]), -1) / w[:, None]
    seen = spark.createDataFrame([tuple(map(float, r)) for r in xy], "x double, y double")
    got = np.array(seen.select(*projective(F.col("x"), F.col("y"), a)).collect())
    assert (w == 0).sum() == 16 and np.isinf(got[w == 0]).all()
    np.testing.assert_allclose(got, uv, rtol=1e-9)
    off = uv.copy()
    wrong = rng.random(len(xy)) < share
    off[wrong] += rng.normal(0, 20, (wrong.sum(), 2)) + 60
    points = spark.createDataFrame([tuple(map(float, r)) for r in np.hstack((xy, off))], "x double, y double, u double, v double")
    h = fits.homography(points, "x", "y", "u", "v", robust=share > 0, tolerance=1e-3)
    np.testing.assert_allclose(h.ravel(), a, rtol=1e-9, atol=1e-13)


def test_full_gaussians_equal_numpy(spark):
    rng = np.random.default_rng(8)
    data = {"big": rng.normal(1e4, 1, (60, 4)) @ rng.normal(0, 1, (4, 4)), "small": rng.normal(5, 2, (3, 4)), "one": rng.normal(0, 1, (1, 4)), "flat": np.ones((9, 4))}
    points = spark.createDataFrame([(k, *map(float, r)) for k, v in data.items() for r in v], "k string, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    fitted = fits.full_gaussians(points, "k", names)
    rows = {r["k"]: r for r in fitted.collect()}
    everything = np.vstack(list(data.values()))
    spread = np.var(everything, axis=0, ddof=1)
    for k, v in data.items():
        if len(v) > 4:
            cov = np.cov(v, rowvar=False)
        else:
            cov = np.diag(np.maximum(np.var(v, axis=0) if len(v) > 1 else spread, spread * 0.25))
        cov = cov + 1e-6 * np.eye(4)
        np.testing.assert_allclose(rows[k]["mean"], v.mean(axis=0), rtol=1e-9)
        np.testing.assert_allclose(rows[k]["logdet"], np.linalg.slogdet(cov)[1], atol=1e-4)
    scored = points.filter("k = 'big'").join(fitted, "k").select("a", fits.full_gaussian(F.array(*names), F.col("mean"), F.col("inverse"), F.col("logdet"), 4).alias("s")).collect()
    v = data["big"]
    cov = np.cov(v, rowvar=False) + 1e-6 * np.eye(4)
    z = v - v.mean(axis=0)
    expected = -0.5 * (4 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    np.testing.assert_allclose(sorted(r["s"] for r in scored), sorted(expected), rtol=1e-4)


def test_shape_changes_equal_a_new_cell(spark):
    rng = np.random.default_rng(5)
    spots = np.argwhere(rng.random((14, 14)) < 0.5)
    owner = {(int(r), int(c)): int(rng.integers(0, 3)) for r, c in spots} | {(40, 40): 9}
    bins = spark.createDataFrame([(o, r, c, c * 2.0 + 1e4, r * 2.0) for (r, c), o in owner.items()], "cell long, row long, col long, x double, y double")
    actions = bins.withColumn("sign", F.lit(-1)).unionByName(bins.filter("cell <> 9").withColumn("cell", (F.col("cell") + 1) % 3).withColumn("sign", F.lit(1)))

    def build(places):
        p = np.array(sorted(places), dtype=float)
        x, y = p[:, 1] * 2 + 1e4, p[:, 0] * 2
        edge = sum((r + i, c + j) not in places for r, c in places for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        return [len(p), x.mean(), y.mean(), ((x - x.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum(), ((y - y.mean()) ** 2).sum(), edge]

    got = moments.changes(actions, bins).collect()
    assert len(got) == actions.count()
    for r in got:
        places = {p for p, o in owner.items() if o == r["cell"]}
        places = places | {(r["row"], r["col"])} if r["sign"] == 1 else places - {(r["row"], r["col"])}
        if places:
            np.testing.assert_allclose([r[c] for c in moments.STATE], build(places), atol=1e-7)
        else:
            assert r["n"] == 0
    fixed = moments.corrections(moments.changes(actions, bins).withColumn("cached", F.col("compactness_gain") - 0.5), "compactness_gain", "cached", F.lit(2.0), F.lit(4.0))
    assert {round(r["correction"], 9) for r in fixed.filter("n > 0").collect()} == {0.25}


def test_poisson_draws_of_large_means(spark):
    import math

    from lattica.operators.background import _poisson

    def quantile(mean, u):
        total, k = 0.0, -1
        while total < u:
            k += 1
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        return k

    rows = [(m, u) for m in (0.0, 0.5, 30.0, 499.9, 500.0, 745.0, 746.0, 800.0, 1000.0, 20_000.0) for u in (0.001, 0.1, 0.5, 0.9, 0.999)]
    got = spark.createDataFrame(rows, "m double, u double").select("m", "u", _poisson(F.col("m"), F.col("u")).alias("k")).collect()
    for r in got:
        assert abs(r["k"] - (quantile(r["m"], r["u"]) if r["m"] else 0)) <= (1 if r["m"] > 1e4 else 0), r
