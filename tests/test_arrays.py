"""Array archives: round trips of all containers, what filters read, ragged rows, checks of counts."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from lattica.sources import arrays as ar


def rows(df):
    return sorted((r.shard, r.row, r.place, tuple(r["values"])) for r in df.collect())


def dense(a):
    return sorted(("", i, 0, tuple(np.atleast_1d(x).astype(float))) for i, x in enumerate(a))


@pytest.mark.parametrize("kind", ["npy", "stored", "deflated"])
@pytest.mark.parametrize("values", [np.arange(60_000, dtype=np.int32).reshape(-1, 3), np.linspace(-1, 1, 999).astype(np.float32), np.zeros((0, 4)), np.array([[True], [False]])])
def test_dense_round_trip(spark, tmp_path, monkeypatch, kind, values):
    path = f"{tmp_path}/a.{'npy' if kind == 'npy' else 'npz'}"
    other = np.ones(7)
    np.save(path, values) if kind == "npy" else (np.savez if kind == "stored" else np.savez_compressed)(path, m=values, other=other)
    df = ar.read_rows(spark, path, "m", part=10_000)
    assert rows(df) == dense(values)
    assert rows(df.filter("row between 5 and 9 and row <> 7")) == [r for r in dense(values) if r[1] in (5, 6, 8, 9)]
    assert rows(df.filter("row in (1, 900, 123456)")) == [r for r in dense(values) if r[1] in (1, 900)]
    if kind != "npy":
        assert rows(ar.read_rows(spark, path, "other")) == dense(other)
        with pytest.raises(Exception, match="has no array"):
            ar.read_rows(spark, path, "absent").collect()


def test_only_wanted_rows_are_read(tmp_path, monkeypatch):
    path = f"{tmp_path}/a.npz"
    np.savez(path, m=np.arange(100_000.0).reshape(-1, 2))
    reader = ar.ArrayReader(path, "m", None, 100_000)
    assert list(reader.pushFilters([GreaterThan(("row",), 30_000), LessThanOrEqual(("row",), 30_010), EqualTo(("place",), 0)])) == [EqualTo(("place",), 0)]
    seen = []
    real = ar._Rows.batches
    monkeypatch.setattr(ar._Rows, "batches", lambda self, lo, hi: seen.append((lo, hi)) or real(self, lo, hi))
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) == 9 and sum(b.num_rows for b in got) == 10
    assert sum(hi - lo for lo, hi in seen) == 10
    few = ar.ArrayReader(path, "m", None, 100_000)
    list(few.pushFilters([In(("row",), (3, 4, 49_999, 60_000))]))
    assert [b.column(3).to_pylist() for p in few.partitions() for b in few.read(p)] == [[[6.0, 7.0], [8.0, 9.0]], [[99998.0, 99999.0]]]


def test_ragged_shards_and_repeated_requests(spark, tmp_path):
    path = str(tmp_path / "e")
    data = [(k, i, float(k * 100 + i), 0.5) for k in (0, 1, 3, 4, 9, 40) for i in range(k % 4 + 1)]
    df = spark.createDataFrame(data, "cell long, i long, v double, w double").repartition(4)
    ar.write_ragged(df, path, "cell", ["i"], ["v", "w"], size=4)
    assert len(json.load(open(f"{path}/shards.json"))) == 4
    index = ar.read_index(spark, path)
    both = ar.read_rows(spark, path, splits="splits", part=16).join(index, ["shard", "row"])
    assert sorted((r.id, r.place, *r["values"]) for r in both.collect()) == data
    asked = spark.createDataFrame([(0, 3), (1, 40), (2, 3), (3, 77)], "n long, id long").join(index, "id")
    for listed in (1, 10):
        got = ar.requested_rows(ar.read_rows(spark, path, splits="splits"), asked, listed).collect()
        assert sorted((r.n, r.place, r["values"][0]) for r in got) == sorted((n, i, v) for n, k in ((0, 3), (1, 40), (2, 3)) for c, i, v, _ in data if c == k)
    reader = ar.ArrayReader(path, "values", "splits", 1 << 20)
    one = index.filter("id = 40").first()
    list(reader.pushFilters([EqualTo(("shard",), one.shard)]))
    assert {p.shard for p in reader.partitions()} == {one.shard}
    for bad in ([(None, 0, 1.0, 1.0)], [(-1, 0, 1.0, 1.0)], [(1, 0, None, 1.0)]):
        with pytest.raises(Exception, match="null"):
            ar.write_ragged(spark.createDataFrame(bad, df.schema), str(tmp_path / "bad"), "cell", ["i"], ["v", "w"])
    ar.write_ragged(df.limit(0), str(tmp_path / "none"), "cell", ["i"], ["v"])
    assert ar.read_rows(spark, str(tmp_path / "none"), splits="splits").count() == 0


def test_folders_of_shards_and_empty_slices(spark, tmp_path):
    for name, splits in (("s1", [0, 2, 2, 3]), ("s2", [0, 1])):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "xy.npy", np.arange(2 * splits[-1]).reshape(-1, 2))
        np.save(tmp_path / name / "cut.npy", np.array(splits))
    got = rows(ar.read_rows(spark, str(tmp_path), "xy", "cut"))
    assert got == [("s1", 0, 0, (0.0, 1.0)), ("s1", 0, 1, (2.0, 3.0)), ("s1", 2, 0, (4.0, 5.0)), ("s2", 0, 0, (0.0, 1.0))]
    assert rows(ar.read_rows(spark, str(tmp_path / "s2"), "xy", "cut")) == [("", 0, 0, (0.0, 1.0))]
    np.save(tmp_path / "s2" / "cut.npy", np.array([0, 2]))
    with pytest.raises(Exception, match="does not split"):
        ar.read_rows(spark, str(tmp_path), "xy", "cut").collect()


def test_counts_are_checked(spark, tmp_path):
    def counts(values, whole=True):
        np.save(tmp_path / "c.npy", np.array(values))
        return sorted((r.row, r.col, r.n) for r in ar.counts_of(ar.read_rows(spark, f"{tmp_path}/c.npy"), whole).collect())

    assert counts([[0, 2, 0], [1, 0, 3]]) == [(0, 1, 2), (1, 0, 1), (1, 2, 3)]
    assert counts([[0.5, 0]], whole=False) == [(0, 0, 0.5)]
    for bad in ([[0.5, 0]], [[-1.0, 0]], [[np.inf, 0]], [[np.nan, 0]]):
        with pytest.raises(Exception, match="not a count"):
            counts(bad)
    np.save(tmp_path / "t.npy", np.array(["a"]))
    with pytest.raises(Exception, match="of numbers"):
        ar.read_rows(spark, f"{tmp_path}/t.npy").collect()
