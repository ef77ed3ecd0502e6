"""Small tables with results worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import ids, maths
from lattica.operators import contracts, em, evaluate, graph, learn, likelihood, ranked, sequences, shapes, simulate, spatial, stats
from lattica.sources import sinks, tables


def one(df):
    return df.first().asDict()


def test_fractional_overlap(spark):
    pred = spark.createDataFrame([("b1", 1), ("b2", 1)], "barcode string, cell int")
    gt = spark.createDataFrame([("b1", 1, 1.0), ("b2", 1, 0.25), ("b3", 1, 0.75)], "barcode string, cell int, w double")
    r = one(evaluate.fractional_overlap(pred, gt))
    assert (r["n_pred"], r["weight"], r["inter"]) == (2, 2.0, 1.25)
    m = one(spark.range(1).select(*[c.alias(n) for n, c in evaluate.set_metrics(F.lit(1.25), F.lit(2), F.lit(2.0)).items()]))
    assert m["iou"] == 1.25 / 2.75 and m["precision"] == 0.625 and m["recall"] == 0.625 and m["dice"] == 0.625


def test_empty_sets_have_null_iou_and_zero_f1(spark):
    m = one(spark.range(1).select(*[c.alias(n) for n, c in evaluate.set_metrics(F.lit(0), F.lit(0), F.lit(0)).items()]))
    assert m["iou"] is None and m["dice"] is None and m["precision"] == m["recall"] == m["f1"] == 0.0


def test_weight_column_choice(spark):
    df = spark.createDataFrame([(1, "b", 0.25, 0.9)], "cell_id int, barcode string, cell_coverage_fraction double, weight double")
    assert one(tables.read_claims(spark, df))["w"] == 0.25
    twice = df.unionAll(df)
    with pytest.raises(contracts.ContractError):
        tables.read_claims(spark, twice)


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert contracts.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(a, b, ["k"], validate="one_to_one")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, ["missing"])


def test_strict_and_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5", "7"), ("2", "x")], "a string, b string")
    r = df.select(contracts.strict_double("a").alias("a"), contracts.lenient_long("b").alias("b")).collect()
    assert [tuple(x) for x in r] == [(1.5, 7), (2.0, 0)]
    with pytest.raises(PySparkException):
        df.select(contracts.strict_double("b")).collect()


def test_block_sums_drop_partial_blocks(spark):
    bins = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1), (0, 2, 1)], "row int, col int, n int")
    assert [tuple(r) for r in spatial.block_sums(bins, 2, "n").collect()] == [(0, 0, 4)]


def test_soften_membrane(spark):
    n, c, m = maths.soften(F.lit(0.0), F.lit(0.0), F.lit(1.0), (0.0, 0.5, 0.5), 0.75)
    assert tuple(spark.range(1).select(n, c, m).first()) == (0.0, 0.375, 0.625)


def test_radius_join_is_exact(spark):
    rng = np.random.default_rng(3)
    p, c = rng.uniform(-50, 50, (300, 2)), rng.uniform(-50, 50, (40, 2))
    got = spatial.radius_join(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "i int, x double, y double"), spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(c)], "j int, cx double, cy double"), 9.0)
    want = {(i, j) for i in range(300) for j in range(40) if math.dist(p[i], c[j]) <= 9}
    assert {(r["i"], r["j"]) for r in got.collect()} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(41)] + [(100,), (101,), (200,)], "node long")
    got = {r["node"]: r["root"] for r in graph.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


def test_em_conserves_mass_and_locks(spark):
    rows = [(b, c, float(abs(b - 3 * c)), 0.6, 0 if b == 0 else None) for b in range(8) for c in range(3) if abs(b - 3 * c) < 6]
    pairs = spark.createDataFrame(rows, "bin long, cell long, d double, conf double, owner long")
    ll = spark.createDataFrame([(b, k, -1.0 - 0.1 * ((b + k) % 3)) for b in range(8) for k in range(2)], "bin long, k int, ll double")
    kinds = spark.createDataFrame([(0, -math.log(2)), (1, -math.log(2))], "k int, log_prior double")
    done, rounds = em.run(pairs, ll, kinds, em.Settings(d_max=6.0), rounds=5, tolerance=1e-9)
    total = {r["bin"]: r["s"] for r in done.groupBy("bin").agg(F.sum("r").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in total.values()) and 1 <= rounds <= 5
    assert {r["cell"]: r["r"] for r in done.filter("bin = 0").collect()}[0] == 1.0
    again, _ = em.run(pairs.orderBy(F.desc("bin"), F.desc("cell")), ll, kinds, em.Settings(d_max=6.0), rounds=5, tolerance=1e-9)
    key = lambda df: sorted((r["bin"], r["cell"], round(r["r"], 9)) for r in df.collect())
    assert key(done) == key(again)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "k string, v double")
    assert sorted(r["rank"] for r in ranked.average_ranks(df, "v", ["k"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_largest_remainder_keeps_the_budget(spark):
    df = spark.createDataFrame([(1, c, float(w)) for c, w in enumerate([3, 3, 3, 1])], "k int, c int, w double")
    got = stats.largest_remainder(df, ["k"], "w", F.lit(7), ["c"])
    assert sum(r["share"] for r in got.collect()) == 7


def test_thinning_and_rarefaction_conserve(spark):
    counts = spark.createDataFrame([(0, 0, 10), (0, 1, 0), (1, 0, 1), (1, 1, 8)], "bin long, gene long, n long")
    kept = {(r["bin"], r["gene"]): r["kept"] for r in simulate.thin(counts, ["bin", "gene"], "n", F.when(F.col("bin") == 0, 0.0).otherwise(1.0), 1).collect()}
    assert kept == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 8}
    r = simulate.rarefy(counts, "bin", "gene", "n", 9, 1).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    assert {x["bin"]: x["n"] for x in r} == {0: 9, 1: 9}


def test_transport_keeps_gene_totals(spark):
    counts = spark.createDataFrame([(r, c, g, (r + c + g) % 3) for r in range(6) for c in range(6) for g in range(2)], "row long, col long, gene long, n long")
    moved = simulate.transport(counts, 3, 0.7, 1.5)
    total = lambda df: {r["gene"]: r["n"] for r in df.groupBy("gene").agg(F.sum("n").alias("n")).collect()}
    assert total(moved) == total(counts)


def test_hull_area(spark):
    bins = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 0), ("a", 2, 0), ("b", 5, 5), ("c", 0, 0), ("c", 0, 1)], "cell string, row int, col int")
    got = {r["cell"]: r["hull"] for r in shapes.hull_area(bins, "cell").collect()}
    assert got == {"a": 7.0, "b": 1.0, "c": 2.0}


def test_gae_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    r, v, d = rng.normal(size=30), rng.normal(size=30), rng.random(30) < 0.2
    df = spark.createDataFrame([(1, i, float(r[i]), float(v[i]), bool(d[i])) for i in range(30)], "k int, s int, r double, v double, d boolean")
    want, carry = [0.0] * 30, 0.0
    for i in range(29, -1, -1):
        live = 0.0 if d[i] else 1.0
        nxt = v[i + 1] if i < 29 else 0.0
        carry = r[i] + 0.9 * nxt * live - v[i] + 0.9 * 0.8 * live * carry
        want[i] = carry
    got = {x["s"]: x["adv"] for x in sequences.gae(df, "k", "s", "r", "v", "d", 0.9, 0.8).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(30))


def test_ids(spark):
    df = spark.createDataFrame([("12.0",), (" 7 ",), ("",), ("nan",), ("12.5",)], "c string")
    assert [r[0] for r in df.select(ids.normalize_cell_id(F.col("c"))).collect()] == ["12", "7", None, None, "12.5"]
    assert spark.range(1).select(ids.format_barcode(F.lit(3), F.lit(41))).first()[0] == "s_002um_00003_00041-1"
    assert spark.range(1).select(ids.parse_remap(F.lit("a=b, c=d"))).first()[0] == {"a": "b", "c": "d"}
    with pytest.raises(PySparkException):
        spark.range(1).select(ids.parse_remap(F.lit("a=b,a=c"))).collect()


def test_matrix_market_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([(0, 0, 3), (4, 2, 1), (1, 2, 5)], "bin_idx long, gene_idx long, n long")
    sinks.write_matrix_market(counts, str(tmp_path / "m"), genes=3, bins=5)
    text = spark.read.text(str(tmp_path / "m/head")).unionAll(spark.read.text(str(tmp_path / "m/body")))
    text.coalesce(1).write.text(str(tmp_path / "all"))
    back = tables.read_matrix_market(spark, str(tmp_path / "all"))
    assert sorted((r["bin_idx"], r["gene_idx"], r["n"]) for r in back.collect()) == [(0, 0, 3), (1, 2, 5), (4, 2, 1)]


def test_names_and_features(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("b0\nb1\nb2\n")
    got = sorted(tuple(r) for r in tables.read_names(spark, str(tmp_path / "b.tsv"), "barcode").collect())
    assert got == [(0, "b0"), (1, "b1"), (2, "b2")]
    (tmp_path / "f.tsv").write_text("g0\tA\tGene Expression\ng1\tB\n")
    assert tables.read_features(spark, str(tmp_path / "f.tsv"), "Gene Expression").count() == 1
    with pytest.raises(contracts.ContractError):
        tables.read_features(spark, str(tmp_path / "f.tsv"), "Antibody")


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4)]])
    df = spark.createDataFrame([(2.0, 2.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(tables.in_ring(F.col("x"), F.col("y"), ring)).collect()] == [True, False]
    assert spark.range(1).select(tables.ring_area(ring)).first()[0] == 16.0


def test_version_swap(spark, tmp_path):
    df = spark.range(3)
    sinks.swap_table(df, str(tmp_path / "t"), "1")
    sinks.swap_table(df.limit(1), str(tmp_path / "t"), "2")
    assert sinks.read_current(spark, str(tmp_path / "t")).count() == 1


def test_posterior_rising_product(spark):
    got = spark.range(1).select(likelihood.log_rising(F.lit(0.5), F.lit(4))).first()[0]
    assert abs(got - (math.lgamma(4.5) - math.lgamma(0.5))) < 1e-12


def test_poisson_ridge_without_signal_predicts_the_mean(spark):
    df = spark.createDataFrame([(0.0, 10.0), (0.0, 20.0), (0.0, 30.0), (0.0, 40.0)], "f double, y double")
    beta = learn.poisson_ridge(df, ["f"], "y", 1.0)
    assert abs(math.exp(beta[0]) - 25) < 1e-6


def test_nnls():
    a = np.array([[1.0, 1.0], [0.0, 1.0], [1.0, 0.0]])
    x = learn.nnls(a, a @ np.array([2.0, 0.5]))
    assert np.allclose(x, [2.0, 0.5])


def test_capture_probability():
    f = simulate.capture_probability(3.0, np.array([1.0, 2.0, 3.0, 4.0]))
    assert abs(np.minimum(1, f * np.array([1.0, 2.0, 3.0, 4.0])).sum() - 3) < 1e-9
    with pytest.raises(ValueError):
        simulate.capture_probability(9.0, np.array([1.0, 2.0]))


def test_placement_conserves(spark):
    src = spark.createDataFrame([(1, 0, 7), (1, 1, 3), (2, 0, 5)], "cell long, gene long, n long")
    w = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (2, 12, 1.0)], "cell long, bin long, w double")
    got = simulate.place(src, w, 0.5, 1).agg(F.sum("placed").alias("p"), F.sum("captured").alias("c")).first()
    assert got["p"] == 15 and 0 <= got["c"] <= 15


def test_ambient_keeps_totals_and_noise_keeps_the_least(spark):
    counts = spark.createDataFrame([(r, c, 0, 2) for r in range(4) for c in range(4)], "row long, col long, gene long, n long")
    assert simulate.ambient(counts, 0.8, 2, 3).agg(F.sum("n")).first()[0] == 32
    bins = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 5, 5)], "cell long, row long, col long")
    noisy = simulate.nuclear_noise(bins, 1.1, 1, 1.0, 2).collect()
    assert sorted(r["cell"] for r in noisy if not r["claimed"]) == [1, 2]
    assert len({(r["row"], r["col"]) for r in noisy}) == len(noisy)


def test_matched_sources(spark):
    cells = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 7)], "cell long, type string, size long")
    pool = spark.createDataFrame([(10, "a", 1), (11, "a", 2)], "source long, type string, size long")
    assert sorted(tuple(r) for r in simulate.matched_sources(cells, pool).collect()) == [(1, 10), (2, 10), (3, 11)]


def test_quality_filter_align_and_padding(spark):
    from lattica.operators import select

    counts = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 1, 5)], "bin long, gene long, n long")
    assert sorted(tuple(r) for r in select.quality_filter(counts, 2, 1).collect()) == [(0, 0, 1), (1, 0, 1)]
    targets = spark.createDataFrame([("b", 0), ("a", 1)], "k string, o int")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert [r["v"] for r in select.align(rows, targets, "k", "o").orderBy("o").collect()] == [2.0, 1.0]
    with pytest.raises(PySparkException):
        select.align(rows.limit(1), targets, "k", "o").orderBy("o").collect()
