"""Queries over whole tables against brute force, on tables that reach past any strip or prefix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from lattica.plans import catalog

SF = "/root/testdata/sf0.01"


def grid_owners():
    li = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_suppkey", "l_quantity"])
    px = li.assign(q=li.l_quantity.astype("int64")).groupby(["l_orderkey", "l_suppkey"], as_index=False).q.sum()
    own = px.sort_values(["l_orderkey", "q", "l_suppkey"], ascending=[True, False, True]).drop_duplicates("l_orderkey")
    bins = set(pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"]).o_orderkey)
    return {int(b): int(c) % 4 for b, c in zip(own.l_orderkey, own.l_suppkey, strict=True) if b in bins}


def flood(own):
    """{bin: least bin of its eight-connected part}."""
    root = {}
    for start in sorted(own):
        todo = [start] if start not in root else []
        while todo:
            b = todo.pop()
            if b in root:
                continue
            root[b] = start
            r, c = divmod(b, 128)
            near = ((r + i) * 128 + c + j for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= c + j < 128)
            todo += [n for n in near if n not in root and own.get(n) == own[b]]
    return root


def test_islands_and_reach_cover_the_whole_grid(spark):
    own = grid_owners()
    root = flood(own)
    assert max(own) // 128 > 40
    sizes = pd.DataFrame({"cell": own, "root": root}).groupby(["cell", "root"]).size()
    want = {(c, len(s), int(s.max())) for c, s in sizes.groupby("cell")}
    assert {tuple(r) for r in catalog.queries()["hard_islands"](spark, SF).collect()} == want
    reach = {(c, int(s.loc[c, root[min(b for b in own if own[b] == c)]])) for c, s in sizes.groupby("cell")}
    assert {tuple(r) for r in catalog.queries()["seed_reachability"](spark, SF).collect()} == reach


def test_every_bin_with_counts_gets_its_nearest_centre(spark):
    li = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_quantity"])
    n = li.assign(q=li.l_quantity.astype("int64")).groupby("l_orderkey").q.sum()
    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"]).o_orderkey.to_numpy()
    bins = np.sort(np.intersect1d(orders, n[n > 0].index))
    assert len(bins) > 1_536 and bins.max() // 128 * 2 > 200
    cells = np.sort(pd.read_parquet(f"{SF}/supplier.parquet", columns=["s_suppkey"]).s_suppkey.to_numpy())
    dx = (bins % 128 * 2.0)[:, None] - (cells * 37 % 128 * 2.0 + 0.5)
    dy = (bins // 128 * 2.0)[:, None] - (cells * 61 % 97 * 2.0 + 0.25)
    d = np.sqrt(dx * dx + dy * dy)
    got = catalog.queries()["nearest_center_assignment"](spark, SF).toPandas().sort_values("bin")
    assert got.bin.tolist() == bins.tolist()
    assert got.cell.tolist() == cells[d.argmin(axis=1)].tolist()
    assert np.allclose(got.d, d.min(axis=1), atol=1e-6)


def test_field_is_smoothed_over_the_whole_grid(spark):
    from pyspark.sql import functions as F

    from lattica.operators.simulate import hash_uniform

    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"]).o_orderkey
    at = sorted({divmod(int(b), 128) for b in orders})
    assert at[-1][0] > 32
    noise = spark.createDataFrame(at, "row long, col long").select("row", "col", hash_uniform(8, F.col("row"), F.col("col")).alias("v")).collect()
    v = {(r["row"], r["col"]): r["v"] for r in noise}
    steps = [(i, j, math.exp(-(i * i + j * j) / 4.5)) for i in range(-5, 6) for j in range(-5, 6) if i * i + j * j <= 20.25]
    f = {}
    for r, c in at:
        near = [(v[r + i, c + j], w) for i, j, w in steps if (r + i, c + j) in v]
        f[r, c] = sum(x * w for x, w in near) / sum(w for _, w in near)
    mean = sum(f.values()) / len(f)
    got = {(r["row"], r["col"]): r["field"] for r in catalog.queries()["smooth_depth_field"](spark, SF).collect()}
    assert got.keys() == f.keys() and all(abs(got[k] - f[k] / mean) < 2e-6 for k in f)


def test_transport_moves_the_counts_of_the_whole_grid(spark):
    li = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity"])
    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"]).o_orderkey
    li = li[li.l_orderkey.isin(orders)]
    assert li.l_orderkey.max() // 128 > 24
    want = li.l_quantity.astype("int64").groupby(li.l_partkey % 50).sum().to_dict()
    assert {r["gene"]: r["n"] for r in catalog.queries()["molecule_transport"](spark, SF).collect()} == want


def test_whole_table_queries_equal_their_sql_on_larger_tables(spark):
    import duckdb

    from .compare import rows_of, rows_of_sql

    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "part", "lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("normalize_ids", "natural_order", "union_missing_columns", "patch_json_bundle", "barcode_cell_sets", "padded_batches", "local_patch_cap"):
        rows = rows_of(catalog.queries()[name](spark, SF))
        assert rows == rows_of_sql(con, catalog.oracle_sql()[name])[1]


def test_points_that_differ_in_late_components_only_are_told_apart(spark, tmp_path):
    rng = np.random.default_rng(7)
    far = np.repeat(rng.normal(size=(5, 56)) * 50, 8, axis=0)
    e = np.hstack([np.zeros((40, 8)), far + rng.normal(size=(40, 56))])
    # Columns with equal values in the first eight components for all points.
    e[:, :8] = np.arange(1, 9)
    pd.DataFrame({"vec_id": np.arange(40), "label": np.arange(40) // 8, "embedding": [x.astype("float32") for x in e]}).to_parquet(tmp_path / "embeddings.parquet")
    q = catalog.queries()
    e = e.astype("float32").astype("float64")
    clusters = q["kmeans_clusters"](spark, str(tmp_path)).toPandas().sort_values("vec_id").cluster.tolist()
    assert len(set(clusters)) > 1
    centred = e - e.mean(axis=0)
    value, vector = np.linalg.eigh(np.cov(centred.T))
    want = np.abs(e @ vector[:, ::-1][:, :3] - e.mean(axis=0) @ vector[:, ::-1][:, :3])
    got = q["pca_scores"](spark, str(tmp_path)).toPandas().sort_values("vec_id")[["pc1", "pc2", "pc3"]].to_numpy()
    assert value[-1] > 1 and np.allclose(got, want, atol=1e-4)
    z = np.abs(centred / np.maximum(e.std(axis=0), 1e-8)).max(axis=1)
    assert np.allclose(q["shape_zscore"](spark, str(tmp_path)).toPandas().sort_values("vec_id").most, z, atol=1e-5)
    assert q["dimension_cosines"](spark, str(tmp_path)).count() == 64 * 63 // 2
