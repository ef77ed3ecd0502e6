"""Work that must not grow faster than the tables: brute force on small inputs, counts of candidates on lopsided ones."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from lattica.operators import spatial


def _points(spark, n):
    """Most points lie far above the few places of the centers."""
    return spark.range(n).select("id", (F.col("id") % 16 * 2.0).alias("x"), (F.expr("id div 16") * 20.0).alias("y"))


def _centers(spark, n):
    return spark.range(n).select(F.col("id").alias("cell"), (F.col("id") * 37 % 16 * 2.0 + 0.5).alias("cx"), (F.col("id") * 61 % 9 * 2.0 + 0.25).alias("cy"))


def test_nearest_center_of_far_points(spark):
    points, centers = _points(spark, 400), _centers(spark, 600)
    found = {r["id"]: (r["cell"], r["d"]) for r in spatial.nearest(points, centers, ["id"], 4.0, [F.col("cell")]).collect()}
    rows = centers.collect()
    for p in points.collect():
        d, cell = min((math.sqrt((p["x"] - c["cx"]) ** 2 + (p["y"] - c["cy"]) ** 2), c["cell"]) for c in rows)
        assert found[p["id"]] == (cell, d)
    assert len(found) == 400


def test_far_tiles_keep_few_centers(spark):
    centers = spatial.places(_centers(spark, 600), [F.col("cell")])
    assert centers.count() == 144
    tiles = spark.createDataFrame([(0, 5000), (1, 7000)], "_tx long, _ty long")
    kept = spatial._not_beaten(centers.crossJoin(tiles), 4.0)
    assert kept.filter("cy < 16").count() == 0 and 0 < kept.count() <= 32


def test_nearest_without_centers_has_no_rows(spark):
    assert spatial.nearest(_points(spark, 5), _centers(spark, 0), ["id"], 4.0, [F.col("cell")]).count() == 0


def test_local_patch_of_crowded_places(spark):
    """60 centers at each of a few places: six rows for each target, by distance and id, and no join of all with all."""
    centers = spark.range(540).select(F.col("id").alias("cell"), (F.col("id") % 9 * 3.0).alias("cx"), F.lit(0.25).alias("cy"))
    points = spark.range(12).select("id", (F.col("id") * 2.5).alias("x"), F.lit(0.0).alias("y"))
    rows = [(c["cell"], c["cx"]) for c in centers.collect()]
    for r in spatial.nearest_few(points, centers, ["id", "x", "y"], 50.0, 6, "cell").collect():
        inside = sorted((round(math.hypot(r["x"] - x, 0.25), 9), cell) for cell, x in rows if math.hypot(r["x"] - x, 0.25) <= 50)
        assert r["near"] == [cell for _, cell in inside[:6]]


def test_rarefy_shuffles_no_unit_and_ranks_large_rows(spark, monkeypatch):
    import hashlib

    from lattica.operators import simulate

    data = [(b, g, (b * 7 + g * 5) % 9 + (300 if b == 3 else 0)) for b in range(6) for g in range(4)]
    counts = spark.createDataFrame(data, "bin long, gene long, n long")
    want = {}
    for b in range(6):
        units = sorted((hashlib.sha256(f"9:{b}:{g}:{i}".encode()).hexdigest(), g) for x, g, n in data if x == b for i in range(n))
        if len(units) >= 12:
            for _, g in units[:12]:
                want[b, g] = want.get((b, g), 0) + 1
    monkeypatch.setattr(simulate, "ARRAY_UNITS", 100)
    assert {(r["bin"], r["gene"]): r["n"] for r in simulate.rarefy(counts, "bin", "gene", "n", 12, 9).collect()} == want


def test_drop_one_sums_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    from itertools import permutations

    from lattica.plans import catalog

    third = lambda values: math.floor((((values[0] + values[1]) + values[2]) + values[3]) / 1000 * 1000 + 0.5)
    draw = random.Random(0)
    trials = (tuple(draw.randint(90_000, 10_000_000) / 100 for _ in range(4)) for _ in range(100_000))
    prices = next(p for p in trials if round(sum(p) * 100) % 100 == 50 and len({third(q) for q in permutations(p)}) > 1)
    seen = set()
    for i, order in enumerate(sorted(permutations(prices))):
        rows = spark.createDataFrame([(1, p, 1.0, 0.0) for p in order], "l_orderkey long, l_extendedprice double, l_quantity double, l_discount double")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        done = catalog.queries()["drop_one_counterfactual"](spark, f"{tmp_path}/{i}").filter("component = 'price'").first()
        seen.add(done["mean_part"])
    assert len(seen) == 1


def test_projective_fit_of_a_deep_plane(spark):
    """Wrong points all lie to one side and the map is far from affine: rounds from an affine start bend the plane."""
    from lattica.functions.maths import projective
    from lattica.operators import fits
    from lattica.plans.suites.fitted import MAP

    g = spark.range(4000).select("id", (F.col("id") % 16 * 16.0).alias("x"), (F.expr("id div 16") * 56.0).alias("y"))
    u, v = projective(F.col("x"), F.col("y"), MAP)
    off = F.col("id") % 10 < 3
    seen = g.withColumns({"u": u + F.when(off, 40 + F.col("id") % 50).otherwise(0), "v": v - F.when(off, 25 + F.col("id") % 31).otherwise(0)})
    h = fits.homography(seen, "x", "y", "u", "v", robust=True, tolerance=1e-3)
    assert abs(h.ravel() - MAP).max() < 1e-4


def test_rounds_read_counts_of_candidate_bins_only(spark):
    from lattica.plans.bindings import Tables
    from lattica.plans.suites import em

    t = Tables(spark, "/root/testdata/sf0.001")
    pairs = em.problem(t).filter("bin < 300")
    kept = em.of_candidates(t, pairs)
    assert kept.join(pairs, "bin", "left_anti").count() == 0
    assert kept.count() == t.counts.join(pairs, "bin", "left_semi").count() > 0
