"""Centers that crowd at few places: the same rows as all pairs give."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import background, policy, spatial


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(8)
    places = rng.integers(0, 12, (14, 2)) * 3.0
    rows = [(int(k), *map(float, places[rng.integers(0, len(places))])) for k in range(40)] + [(99, 500.0, 500.0)]
    points = [(int(k), *map(float, rng.integers(0, 20, 2) * 2)) for k in range(30)]
    return rows, points, spark.createDataFrame(rows, "cell long, cx double, cy double"), spark.createDataFrame(points, "bin long, x double, y double")


def test_nearest_other_of_crowded_centers(crowd):
    rows, _, centers, _ = crowd
    want = {c: min((math.hypot(x - u, y - v), o) for o, u, v in rows if o != c) for c, x, y in rows}
    got = {r["cell"]: (r["d"], r["other"]) for r in spatial.nearest_other(centers, "cell", 4.0).collect()}
    assert got.keys() == want.keys() and all(got[c][1] == want[c][1] and abs(got[c][0] - want[c][0]) < 1e-9 for c in want)
    assert not spatial.nearest_other(centers.filter("cell = 99"), "cell", 4.0).collect()


def test_k_nearest_and_other_distance_of_crowded_centers(crowd):
    rows, points, centers, bins = crowd
    near = {b: sorted((math.hypot(x - u, y - v), c) for c, u, v in rows if math.hypot(x - u, y - v) <= 10) for b, x, y in points}
    got = {}
    for r in spatial.k_nearest(bins, centers, ["bin"], 10.0, 3, [F.col("cell")]).collect():
        got.setdefault(r["bin"], {})[r["rank"]] = r["cell"]
    assert got == {b: {k + 1: c for k, (_, c) in enumerate(n[:3])} for b, n in near.items() if n}
    want = {(b, c): min((e for e, o in n if o != c), default=None) for b, n in near.items() for _, c in n}
    other = {(r["bin"], r["cell"]): r["other"] for r in spatial.with_other_distance(bins, centers, ["bin"], "cell", 10.0).collect()}
    assert other.keys() == want.keys()
    assert all((other[k] is None) == (v is None) and (v is None or abs(other[k] - v) < 1e-9) for k, v in want.items())


def test_states_are_chosen_together_as_alone(spark):
    rows = [(s % 7, s // 7, a, float((s * a) % 5) if (s + a) % 11 else float("nan"), a != 2) for s in range(40) for a in range(1, 5)]
    actions = spark.createDataFrame(rows, "traj long, state long, action long, reward double, valid boolean")
    calls = spark.sparkContext.accumulator(0)

    class Counted(policy.Greedy):
        def select_all(self, actions, first):
            calls.add(1)
            return super().select_all(actions, first)

    got = {(r["traj"], r["state"]): r["action"] for r in policy.choose(actions, ["traj", "state"], Counted()).collect()}
    frame = pd.DataFrame(rows, columns=["traj", "state", "action", "reward", "valid"])
    for key, group in frame[frame["valid"]].groupby(["traj", "state"]):
        group = group.sort_values("action").reset_index(drop=True)
        assert got[key] == group["action"].iloc[policy.Greedy().select_action(group)]
    assert 0 < calls.value <= 8


def test_sources_are_found_once_for_all_their_counts(spark):
    bins = spark.createDataFrame([(k, float(k % 8), float(k // 8)) for k in range(64)], "bin long, x double, y double")
    seen = spark.sparkContext.accumulator(0)

    def watch(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    schema = "tx long, ty long, source long, x double, y double, type long, budget long"
    found = spark.createDataFrame([(0, 0, 9, 1.0, 1.0, 1, 20), (0, 0, 30, 6.0, 3.0, 1, 5), (0, 0, 31, 6.0, 3.0, 1, 0)], schema).mapInPandas(watch, schema)
    counts = background.spread(bins, found, spark.createDataFrame([(1, 4, 2), (1, 5, 1)], "type long, gene long, c long"), 3).collect()
    assert sum(r["n"] for r in counts) == 25 and {r["gene"] for r in counts} <= {4, 5}
    assert seen.value == 3


def test_pieces_of_regions_share_what_the_whole_regions_share(spark, monkeypatch):
    from lattica.operators import polygons as pg

    def ring(n, x, y, r):
        return [{"x": x + r * (1 + k % 2 / 3) * math.cos(2 * math.pi * k / n), "y": y + r * (1 + k % 2 / 3) * math.sin(2 * math.pi * k / n)} for k in range(n)]

    schema = "{0} long, ring array<struct<x:double,y:double>>"
    a = pg.regions(spark.createDataFrame([(1, ring(120, 3, 4, 30)), (2, ring(7, -20, 0, 9))], schema.format("a")), "a")
    b = pg.regions(spark.createDataFrame([(1, ring(90, 13, 9, 25)), (2, ring(6, 9, -8, 11)), (3, ring(5, 900, 0, 3))], schema.format("b")), "b")
    found = []
    for most in (64, 1000, 3):
        monkeypatch.setattr(pg, "PIECE", most)
        found.append({(r["a"], r["b"]): r["common"] for r in pg.overlaps(a, b, 16.0).collect()})
    for one in found[1:]:
        assert one.keys() == found[0].keys() and all(one[k] == pytest.approx(found[0][k], abs=1e-9) for k in one)
    copies = spark.createDataFrame([(1, 1), (1, 7), (2, 2), (3, 3)], "of long, member long")
    pairs = {(r["a"], r["b"]) for r in pg.expanded(pg.overlaps(a, b, 16.0), copies).collect()}
    assert pairs == {(x, y) for p, q in found[0] for x in {1: (1, 7)}.get(p, (p,)) for y in {1: (1, 7)}.get(q, (q,))}


def test_audit_finds_uses_that_are_far_apart(spark, tmp_path):
    from lattica.plans import catalog

    spark.createDataFrame([(0,), (128 * 20_000,), (5,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(0, 1, 50.0, 1.0), (128 * 20_000, 1, 50.0, 1.0), (5, 2, 50.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["cell"]: (r["uses"], r["least_distance"]) for r in catalog.queries()["assignment_audit"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 40_000.0), 2: (1, None)}


def test_cells_without_rewards_are_named_by_nulls(spark):
    from lattica.operators import online

    rewards = spark.createDataFrame([(1, 1.0), (1, 5.0), (1, None), (1, 0.0), (1, 3.0), (2, None)], "cell long, reward double")
    assert {tuple(r) for r in online.stop_delta(rewards, None, "topk_mean", 3).collect()} == {(1, 3.0), (2, 0.0)}
    s = spark.createDataFrame([([1.0, 2.0, 0.5],)], "a array<double>").select(online.softmax(F.col("a"))).first()[0]
    e = np.exp(np.array([1.0, 2.0, 0.5]) - 2)
    assert np.allclose(s, e / e.sum())


def test_typed_neighbour_weights_pair_places(spark, tmp_path, monkeypatch):
    import duckdb

    from lattica.plans import catalog

    # Keys 128 * 97 apart share their place.
    spark.range(2000).selectExpr("id % 5 + (id div 5) * 12416 as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    pairs, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **b: (pairs.append(join(*a, **b)), pairs[-1])[1])
    got = catalog.queries()["typed_neighbour_weights"](spark, str(tmp_path)).select("cell", "type", "weight").collect()
    duck = duckdb.connect()
    duck.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = duck.execute(f"select cell, type, weight from ({catalog.oracle_sql()['typed_neighbour_weights']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 2000
    assert sum(p.count() for p in pairs) <= 25
