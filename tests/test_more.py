"""Profiles, online scores, background, outlines, archives and tables on disk, against brute force and round trips."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import ids, maths
from lattica.operators import background, contracts, em, graph, growth, learn, online, outline, policy, profiles, simulate
from lattica.sources import artifacts, sinks, tables


def test_profiles_of_two_cells(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.5), (2, 2, 0.5)], "bin long, cell long, r double")
    counts = spark.createDataFrame([(1, 0, 4), (2, 0, 2), (2, 1, 2), (3, 1, 9)], "bin long, gene long, n long")
    q = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "a", 0.5), (2, "b", 0.5)], "cell long, k string, q double")
    theta = spark.createDataFrame([("a", 0, 0.75), ("a", 1, 0.25), ("b", 0, 0.25), ("b", 1, 0.75)], "k string, gene long, theta double")
    s = profiles.Profiles(prior=4.0, epsilon=1e-9, rate=0.5)
    mix = profiles.mixture(q, theta)
    old = {(r["cell"], r["gene"]): r["p"] for r in profiles.reference_only(mix, s).collect()}
    assert old[1, 0] == pytest.approx(0.75) and old[2, 0] == pytest.approx(0.5)
    new = {(r["cell"], r["gene"]): r["p"] for r in profiles.updated(pairs, counts, mix, s).collect()}
    # Cell 1: counts 4 + 1 and 1, prior 3 and 1.
    assert new[1, 0] == pytest.approx(8 / 10) and new[2, 0] == pytest.approx((1 + 2) / 6)
    a, b = (f(mix) for f in (lambda m: profiles.reference_only(m, s), lambda m: profiles.updated(pairs, counts, m, s)))
    for rate, want in ((0.0, old), (1.0, new)):
        assert {(r["cell"], r["gene"]): r["p"] for r in profiles.damped(a, b, rate).collect()} == want
    own = {(r["bin"], r["cell"]): r["L_cell"] for r in profiles.compatibility(pairs, counts, a, 1e-9).collect()}
    assert own[1, 1] == pytest.approx(math.log(0.75)) and own[2, 1] == pytest.approx((math.log(0.75) + math.log(0.25)) / 2)


def test_fixed_score_contract(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0, 0.5, None), (1, 2, 1.0, 0.5, None)], "bin long, cell long, d double, conf double, owner long")
    counts = spark.createDataFrame([(1, 0, 1)], "bin long, gene long, n long")
    ll = spark.createDataFrame([(1, "a", -1.0)], "bin long, k string, ll double")
    theta = spark.createDataFrame([("a", 0, 1.0)], "k string, gene long, theta double")
    kinds = spark.createDataFrame([("a", 0.0)], "k string, log_prior double")
    trust = spark.createDataFrame([(1, 1.0), (2, 1.0)], "cell long, reliability double")
    fixed = spark.createDataFrame([(1, 1, -3.0), (1, 2, 0.0)], "bin long, cell long, L_cell double")
    run = lambda p, f: profiles.run(pairs, counts, ll, theta, kinds, trust, em.Settings(d_max=2.0), p, 1, f)
    r = {x["cell"]: x["r"] for x in run(profiles.Profiles(rate=0.0), fixed)[0].collect()}
    assert r[1] + r[2] == pytest.approx(1) and r[2] > 0.5
    with pytest.raises(ValueError):
        run(profiles.Profiles(rate=0.5), fixed)
    with pytest.raises(contracts.ContractError):
        run(profiles.Profiles(rate=0.0), fixed.filter("cell = 1"))
    with pytest.raises(contracts.ContractError):
        run(profiles.Profiles(rate=0.0), fixed.withColumn("L_cell", F.lit(float("nan"))))
    with pytest.raises(ValueError):
        profiles.Profiles(rate=1.5)


def test_global_delta_is_the_change_of_the_objective(spark):
    rng = np.random.default_rng(3)
    ll, conf = {b: rng.normal(size=3) for b in range(6)}, rng.uniform(0.1, 1, 6)
    w = online.Weights(gain=1.3, support=0.2, old=0.7)

    def objective(members):
        s = sum((ll[b] for b in members), np.zeros(3))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        return w.gain * p.max() * sum(conf[b] for b in members) + w.old * sum(conf[b] * (p @ ll[b]) for b in members)

    table = spark.createDataFrame([(b, k, float(x)) for b in range(6) for k, x in enumerate(ll[b])], "bin long, k int, ll double")
    members = spark.createDataFrame([(b, 9, float(conf[b])) for b in range(4)], "bin long, cell long, conf double")
    bins = spark.createDataFrame([(b, 9, float(conf[b]), 0.25, 0.5, 0.0) for b in range(6)], "bin long, cell long, conf double, penalty double, support double, shape double")
    rows = bins.join(online.type_arrays(table), "bin").join(online.cell_states(members, table), "cell")
    for r in rows.select("bin", online.global_delta(w).alias("add"), online.global_delta(w, remove=True).alias("remove")).collect():
        if r["bin"] >= 4:
            assert r["add"] == pytest.approx(objective([0, 1, 2, 3, r["bin"]]) - objective(range(4)) - 0.25 + 0.2, abs=1e-9)
        else:
            assert r["remove"] == pytest.approx(objective([b for b in range(4) if b != r["bin"]]) - objective(range(4)) + 0.25 - 0.2, abs=1e-9)


def test_stop_and_planner(spark):
    rewards = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 0.0), (1, -9.0)], "cell long, reward double")
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    assert {tuple(r) for r in online.stop_delta(rewards, cells, "topk_mean", 3).collect()} == {(1, 2.0), (2, 0.0)}
    assert {tuple(r) for r in online.stop_delta(rewards, cells, "max").collect()} == {(1, 5.0), (2, 0.0)}
    with pytest.raises(ValueError):
        online.stop_delta(rewards, cells, "median")
    r = spark.range(1).select(online.frontier_quality(F.lit(0.5), F.lit(False), 0.1, 0.1), online.frontier_quality(F.lit(1e9), F.lit(True), 0.0, 0.0), online.stop_score(F.lit(True), F.lit(2.0), F.lit(-1.0)), online.stop_score(F.lit(False), F.lit(0.75), F.lit(0.5))).first()
    assert tuple(r) == (0.0, pytest.approx(1.0), -1.0, 0.25)


def test_background_conserves_budgets_and_stays_near(spark):
    bins = spark.createDataFrame([(r * 200 + c, c * 2.0, r * 2.0) for r in range(20) for c in range(100)], "bin long, x double, y double")
    cells = spark.createDataFrame([(1, "a", 3.0, 3.0), (2, "b", 10.0, 30.0)], "cell long, type string, x double, y double")
    found = background.sources(bins, cells, 2.0, 5, reach=30.0)
    again = background.sources(bins.repartition(7), cells, 2.0, 5, reach=30.0)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    assert len(rows) == sum(math.ceil(n * 4 / 64) for n in (20 * 64, 20 * 36)) and {r[5] for r in rows} <= {"a", "b"}
    supported = {r[2]: r[7] for r in rows}
    at = {r["bin"]: (r["x"], r["y"]) for r in bins.collect()}
    for source, yes in supported.items():
        x, y = at[source]
        assert yes == (min(math.hypot(x - a, y - b) for a, b in ((3, 3), (10, 30))) <= 30)
    budgets = [r[6] for r in rows]
    mean = 2.0 * 2000 / len(rows)
    assert abs(np.mean(budgets) - mean) < 6 * math.sqrt(mean / len(rows))
    types = spark.createDataFrame([("a", 0, 3), ("a", 1, 1), ("b", 2, 5)], "type string, gene long, c long")
    out = background.spread(bins, found, types, 5).collect()
    assert sum(r["n"] for r in out) == sum(budgets)
    home = {(int(x // 128), int(y // 128)): [] for x, y in at.values()}
    for r in rows:
        home[r[0], r[1]].append((r[3], r[4], r[5]))
    genes = {"a": {0, 1}, "b": {2}}
    for r in out:
        x, y = at[r["bin"]]
        assert any(math.hypot(x - a, y - b) <= 24 + 1e-9 and r["gene"] in genes[t] for a, b, t in home[int(x // 128), int(y // 128)])
    with pytest.raises(contracts.ContractError):
        background.spread(bins, found, types.filter("type = 'a'"), 5).collect()


def test_poisson_by_inversion(spark):
    us = [(i + 0.5) / 4000 for i in range(4000)]
    k = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(background._poisson(F.lit(3.0), F.col("u"))).collect()]
    for n in range(8):
        assert k.count(n) / 4000 == pytest.approx(math.exp(-3) * 3**n / math.factorial(n), abs=1e-3)


def test_calibrations(spark):
    assert background.retention(100, 50, 0.5) == 0.25
    with pytest.raises(ValueError):
        background.retention(10, 100, 0.0)
    assert background.shape_weight(2.0, 0.5, 3.0, 6.0) == 0.5
    with pytest.raises(ValueError):
        background.shape_weight(2.0, 0.5, 3.0, 0.0)
    c = spark.createDataFrame([("1", "a", 10.0, 20.0, 4.0, 16.0), ("2", "b", 1.0, 2.0, 1.0, 4.0)], "cell_id string, cell_type string, x_px double, y_px double, area_um2 double, area_px double")
    assert {tuple(r) for r in background.micron_coordinates(c).collect()} == {("1", "a", 5.0, 10.0), ("2", "b", 0.5, 1.0)}
    with pytest.raises(contracts.ContractError):
        background.micron_coordinates(c.withColumn("area_um2", F.col("x_px")))
    m = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2"), (3, "b", "d3")], "cell long, type string, donor string")
    assert [r["cell"] for r in background.eligible_sources(m, {"d1"}, {"d2"}).collect()] == [1]
    for g, r in (({"d1"}, {"d1"}), (set(), {"d1"}), ({"d1"}, {"dx"})):
        with pytest.raises(ValueError):
            background.eligible_sources(m, g, r)


def test_delaunay_circles_are_empty():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (60, 2))
    t = outline.triangulate(p)
    for tri in t:
        (ax, ay), (bx, by), (cx, cy) = p[tri]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        assert (np.hypot(p[:, 0] - ux, p[:, 1] - uy) >= math.hypot(ax - ux, ay - uy) - 1e-4).all()
    u, v = p[t][:, 1] - p[t][:, 0], p[t][:, 2] - p[t][:, 0]
    assert abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2 <= 100


def test_alpha_shape_leaves_out_the_gap(spark):
    block = [(1, x * 2.0, y * 2.0) for x in range(5) for y in range(5)]
    far = [(1, 100 + x * 2.0, y * 2.0) for x in range(5) for y in range(5)]
    few = [(2, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 0.0), (3, 2.0, 0.0), (3, 4.0, 0.0), (3, 6.0, 0.0)]
    got = {r["cell"]: r for r in outline.alpha_areas(spark.createDataFrame(block + far + few, "cell long, x double, y double"), 0.05).collect()}
    assert got[1]["area"] == pytest.approx(128) and got[1]["rim"] == pytest.approx(64)
    assert got[2]["area"] == got[3]["area"] == 0 and got[2]["triangles"] == 0


def test_policies(spark):
    a = spark.createDataFrame([(1, 0, 1.0, True), (1, 1, 5.0, False), (1, 2, 3.0, True), (2, 7, 0.0, True)], "s long, action long, reward double, valid boolean")
    assert {(r["s"], r["action"]) for r in policy.choose(a, ["s"], policy.Greedy()).collect()} == {(1, 2), (2, 7)}
    one, two = ({(r["s"], r["action"]) for r in policy.choose(a.repartition(n), ["s"], policy.Random(4)).collect()} for n in (1, 3))
    assert one == two and (1, 1) not in one
    with pytest.raises(PySparkException):
        policy.choose(a.withColumn("valid", F.lit(False)), ["s"], policy.Greedy()).collect()


def test_archives(spark, tmp_path):
    def soft(name, barcodes, top):
        np.savez(tmp_path / name, barcode_ids=np.array(barcodes), cell_ids=np.array(["c1", "c2"]), top1_cell_index=np.array(top), normalized_entropy=np.full(len(top), 0.5), is_ambiguous=np.zeros(len(top), bool), is_nuclear_locked=np.ones(len(top), bool))

    (tmp_path / "soft").mkdir()
    soft("soft/p1.npz", ["b1", "b2"], [1, -1])
    soft("soft/p2.npz", ["b3"], [0])
    got = artifacts.read_soft(spark, str(tmp_path / "soft"))
    assert {(r["barcode"], r["owner"]) for r in got.collect()} == {("b1", "c2"), ("b2", "__background__"), ("b3", "c1")}
    artifacts.write_soft(got, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    soft("soft/p3.npz", ["b3"], [0])
    with pytest.raises(contracts.ContractError):
        artifacts.read_soft(spark, str(tmp_path / "soft"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        artifacts.read_soft(spark, str(tmp_path / "none"))
    (tmp_path / "cells").mkdir()
    np.savez(tmp_path / "cells/a.npz", candidate_bin_ids=np.array(["x", "y"]), candidate_bin_xy_um=np.array([[1.0, 2.0], [3.0, 4.0]]), nucleus_center_xy_um=np.array([0.5, 0.25]), candidate_matrix_col_index=np.array([7, 9]))
    np.savez(tmp_path / "cells/b.npz", candidate_bin_ids=np.array(["z"]), candidate_bin_xy_um=np.array([[5.0, 6.0]]), nucleus_center_xy_um=np.array([0.0, 0.0]), candidate_expression=np.array([[1.0]]))
    rows = {(r["bin"], r["position"], r["x"], r["center_y"], r["column"]) for r in artifacts.read_episodes(spark, str(tmp_path / "cells")).collect()}
    assert rows == {("x", 0, 1.0, 0.25, 7), ("y", 1, 3.0, 0.25, 9), ("z", 0, 5.0, 0.0, None)}


def test_shape_model_and_resume(spark, tmp_path):
    model = spark.createDataFrame([(0, 5, [1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]])], "cluster int, n long, mean array<double>, covariance array<array<double>>")
    artifacts.save_shape_model(model, str(tmp_path / "m"), ["area", "rim"], [(1.0, 2.0), (0.0, 1.0)])
    back = artifacts.load_shape_model(spark, str(tmp_path / "m"), ["area", "rim"]).first()
    assert back["mean"] == [1.0, 2.0] and back["center"] == [1.0, 0.0] and back["covariance"][1] == [0.0, 1.0]
    with pytest.raises(contracts.ContractError):
        artifacts.load_shape_model(spark, str(tmp_path / "m"), ["area"])
    at, formula = str(tmp_path / "step"), {"name": "f", "w": 1.5}
    assert artifacts.resume_step(spark, at, "core", formula, ["p1"]) is None
    artifacts.save_step({"patch": spark.range(3), "cell": spark.range(2)}, at, "core", formula, ["p1"])
    found = artifacts.resume_step(spark, at, "core", formula, ["p1"])
    assert found["patch"].count() == 3 and found["cell"].count() == 2
    for split, f, p in (("outer", formula, ["p1"]), ("core", {"name": "f", "w": 2.0}, ["p1"]), ("core", formula, ["p2"])):
        with pytest.raises(contracts.ContractError):
            artifacts.resume_step(spark, at, split, f, p)
    spark.range(5).write.mode("overwrite").parquet(f"{at}/cell")
    with pytest.raises(contracts.ContractError):
        artifacts.resume_step(spark, at, "core", formula, ["p1"])


def test_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, 'c"d', None)], "k long, t string, v double")
    for fmt in ("parquet", "csv", "tsv"):
        at = str(tmp_path / f"x.{fmt}")
        sinks.write_table(df, at, fmt)
        back = tables.read_table(spark, at, schema="k long, t string, v double", columns=["k", "t"])
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, 'c"d')]
    with pytest.raises(contracts.ContractError):
        tables.read_table(spark, str(tmp_path / "x.parquet"), columns=["missing"])
    with pytest.raises(contracts.ContractError):
        tables.read_table(spark, str(tmp_path / "x.unknown"))
    pos = spark.createDataFrame([("b", 10.0, 20.0)], "barcode string, pxl_row_in_fullres double, pxl_col_in_fullres double")
    pos.write.parquet(str(tmp_path / "pos"))
    r = tables.read_positions(spark, str(tmp_path / "pos"), 0.5).first()
    assert (r["x_um"], r["y_um"]) == (10.0, 5.0)
    ep = spark.createDataFrame([(c, b) for c in (0, 255, 256, 700) for b in range(2)], "cell long, bin long")
    sinks.write_shards(ep, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["chunk"], r["cell"]) for r in back.select("chunk", "cell").distinct().collect()) == [(0, 0), (0, 255), (1, 256), (2, 700)]
    sinks.write_bundles(spark.createDataFrame([("p1", 2, "y"), ("p1", 1, "x"), ("p2", 3, "z")], "patch string, a int, b string"), "patch", str(tmp_path / "bundles"))
    docs = {r["patch"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "bundles")).collect()}
    assert docs["p1"] == {"rows": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]} and docs["p2"]["rows"][0]["a"] == 3


def test_logs_fingerprints_and_runs(spark, tmp_path):
    ev = spark.createDataFrame([("2024-07-01 12:00:00", "update_complete", '{"a": 1}')], "ts string, event string, payload string").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):
        sinks.append_log(ev, str(tmp_path / "log"))
    got = tables.read_log(spark, str(tmp_path / "log")).collect()
    assert len(got) == 2 and got[0]["event"] == "update_complete" and got[0]["timestamp_local"].startswith("2024-07-01T07:00") and json.loads(got[0]["payload"]) == {"a": 1}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one").write_bytes(b"0123456789")
    (tmp_path / "f/two").write_bytes(b"01234x6789")
    import hashlib

    whole = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in tables.fingerprints(spark, str(tmp_path / "f")).collect()}
    assert whole["one"] == hashlib.sha256(b"0123456789").hexdigest()
    ends = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in tables.fingerprints(spark, str(tmp_path / "f"), 4).collect()}
    assert ends["one"] == ends["two"] == hashlib.sha256(b"01236789").hexdigest()
    before = spark.createDataFrame(tables.fingerprints(spark, str(tmp_path / "f")).collect())
    assert tables.is_fresh(before, tables.fingerprints(spark, str(tmp_path / "f")))
    (tmp_path / "f/two").write_bytes(b"new")
    assert not tables.is_fresh(before, tables.fingerprints(spark, str(tmp_path / "f")))
    for m in ("alpha", "beta"):
        (tmp_path / f"runs/{m}_1").mkdir(parents=True)
        (tmp_path / f"runs/{m}_1/result.json").write_text("{}")
    runs = tables.discover_runs(spark, str(tmp_path / "runs/*/*"), r"/([a-z]+)_[0-9]+/")
    assert sorted(r["method"] for r in runs.collect()) == ["alpha", "beta"]
    (tmp_path / "runs/beta_2").mkdir()
    (tmp_path / "runs/beta_2/result.json").write_text("{}")
    with pytest.raises(contracts.ContractError):
        tables.discover_runs(spark, str(tmp_path / "runs/*/*"), r"/([a-z]+)_[0-9]+/")


def test_polygons_and_small_contracts(spark):
    v = spark.createDataFrame([("c", 1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)])], "cell_id string, label_id int, ord int, vertex_x double, vertex_y double").repartition(3)
    r = tables.read_polygons(v).select(tables.ring_area(F.col("ring")).alias("a"), tables.in_ring(F.lit(1.0), F.lit(1.0), F.col("ring")).alias("i"), tables.in_ring(F.lit(5.0), F.lit(1.0), F.col("ring")).alias("o")).first()
    assert (r["a"], r["i"], r["o"]) == (6.0, True, False)
    df = spark.createDataFrame([("yes", 1.0, 2.0), ("no", 3.0, 4.0), (None, 5.0, 6.0)], "b string, x_um double, y_um double")
    assert [r[0] for r in df.select(contracts.lenient_bool("b")).collect()] == [True, False, False]
    assert contracts.resolve_pair(df, [("x", "y"), ("x_um", "y_um")]) == ("x_um", "y_um")
    with pytest.raises(contracts.ContractError):
        contracts.resolve_pair(df, [("x", "y")])
    a = spark.createDataFrame([(1,), (2,)], "k int")
    contracts.assert_same_keys([a, a.union(a)], "k")
    with pytest.raises(contracts.ContractError):
        contracts.assert_same_keys([a, a.filter("k = 1")], "k")
    assert spark.createDataFrame([(bytearray(b"caf\xc3\xa9 "),)], "b binary").select(ids.decode_bytes(F.col("b"))).first()[0].strip() == "café"
    r = spark.range(1).select(maths.damp(F.lit(2.0), F.lit(4.0), 0.25).alias("d"), *[c.alias(n) for n, c in zip("ap", maths.shape_delta(F.lit(4), F.lit(8), F.lit(3)), strict=True)]).first()
    assert r["d"] == 3.5 and (r["a"], r["p"]) == (5, 6)
    soft = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (2, 7, 0.9)], "bin long, cell long, share double")
    assert contracts.from_composition(soft.filter("bin = 1"), "bin", "cell", "share").first()["cell"] == 4
    with pytest.raises(PySparkException):
        contracts.from_composition(soft, "bin", "cell", "share").collect()


def test_joint_step_rolls_back(spark):
    owners = spark.createDataFrame([(1, 10), (2, 20)], "barcode long, cell long")
    plan = spark.createDataFrame([(2, 10), (3, 30)], "barcode long, cell long")
    after, kept = growth.joint_step(owners, plan, lambda df: float(df.count()))
    assert kept and {tuple(r) for r in after.collect()} == {(1, 10), (2, 10), (3, 30)}
    same, kept = growth.joint_step(owners, plan, lambda df: 0.0)
    assert not kept and {tuple(r) for r in same.collect()} == {(1, 10), (2, 20)}
    with pytest.raises(ValueError):
        growth.joint_step(owners, plan.union(plan), lambda df: 1.0)


def test_reach_sample_and_gaussians(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    seeds = spark.createDataFrame([(1,)], "node long")
    allowed = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "node long")
    assert {r[0] for r in graph.reachable(seeds, allowed, edges).collect()} == {1, 2, 3}
    assert {r[0] for r in graph.reachable(seeds, allowed.filter("node <> 2"), edges).collect()} == {1}
    picked = simulate.exact_sample(spark.range(1000), "id", 37, 3)
    assert picked.count() == 37 and picked.count() == simulate.exact_sample(spark.range(1000).repartition(5), "id", 37, 3).intersect(picked).count()
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) * (1, 3) + (5, -1)
    (g,) = learn.gaussian_fit(spark.createDataFrame([(0, [float(a), float(b)]) for a, b in x], "cluster int, features array<double>"), "cluster", "features", 2, shrink=0.0)
    assert np.allclose(g["mean"], x.mean(axis=0)) and np.allclose(g["covariance"], np.cov(x.T, bias=True), atol=1e-6) and g["prior"] == 1
    two = spark.createDataFrame([([float(a), float(b)],) for a, b in np.vstack((x, x + 50))], "features array<double>")
    assert learn.best_kmeans(two, "features", [2, 3])[1] == 2
