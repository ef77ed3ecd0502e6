"""The sparse column source: round trips, what a filter reads, repeated requests, bad values."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from lattica.sources import columns as sc


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    rnd = random.Random(4)
    rows = sorted({(rnd.randint(0, 300), rnd.randint(0, 40)): rnd.randint(0, 9) for _ in range(4000)}.items())
    entries = [(c, r, v) for (c, r), v in rows] + [(150, 50 + i, 1) for i in range(500)]
    path = str(tmp_path_factory.mktemp("matrix") / "m")
    sc.write_columns(spark.createDataFrame(entries, "column long, row long, value long").repartition(5), path, chunk=256)
    return path, entries


def read(spark, path, condition="true", **how):
    return sorted(map(tuple, sc.read_columns(spark, path, **how).filter(condition).select("column", "row", "value").collect()))


@pytest.mark.parametrize("per_task", [64, 10_000])
def test_round_trip_and_filters(spark, matrix, per_task):
    path, entries = matrix
    assert len(json.load(open(f"{path}/chunks.json"))) > 10
    for condition, keep in (
        ("true", lambda c, r: True),
        ("column between 20 and 33", lambda c, r: 20 <= c <= 33),
        ("column > 290 and row < 10", lambda c, r: c > 290 and r < 10),
        ("column in (3, 150, 151, 299, 1000)", lambda c, r: c in (3, 150, 151, 299)),
        ("column = 150", lambda c, r: c == 150),
        ("column < 0", lambda c, r: False),
        ("column = 4 or row = 3", lambda c, r: c == 4 or r == 3),
    ):
        assert read(spark, path, condition, per_task=per_task) == sorted(e for e in entries if keep(*e[:2])), condition


def test_only_wanted_ranges_are_read(matrix, monkeypatch):
    path, entries = matrix
    reader = sc.ColumnReader(path, 1 << 20)
    assert [type(f) for f in reader.pushFilters([GreaterThanOrEqual(("column",), 40), LessThan(("column",), 44), IsNotNull(("column",)), EqualTo(("row",), 1)])] == [IsNotNull, EqualTo]
    parts = reader.partitions()
    listed = json.load(open(f"{path}/chunks.json"))
    assert {p.chunk for p in parts} == {c["chunk"] for c in listed if c["first"] <= 43 and c["last"] >= 40}
    assert all(40 <= p.first <= p.last <= 43 for p in parts)
    taken, load = [], sc._load
    monkeypatch.setattr(sc, "_load", lambda fs, at, *span: taken.append((at.rpartition("/")[2], *span)) or load(fs, at, *span))
    got = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == sum(40 <= c <= 43 for c, *_ in entries)
    assert sum(s[2] - s[1] for s in taken if s[0] == "values.npy") == sum(b.num_rows for b in got)
    few = sc.ColumnReader(path, 1 << 20)
    list(few.pushFilters([In(("column",), (7, 200)), In(("column",), (7, 8))]))
    assert few.only == {7} and sum(b.num_rows for p in few.partitions() for b in few.read(p)) == sum(c == 7 for c, *_ in entries)


def test_requests_may_repeat(spark, matrix):
    path, entries = matrix
    asked = [(0, 9), (1, 150), (2, 9), (3, 9999)]
    got = sc.requested(sc.read_columns(spark, path), spark.createDataFrame(asked, "place long, column long")).collect()
    assert sorted(map(tuple, got)) == sorted((p, c, r, v) for p, q in asked for c, r, v in entries if c == q)
    assert sc.requested(sc.read_columns(spark, path), spark.createDataFrame([], "place long, column long")).count() == 0


def test_sums_appends_overwrites_and_bad_values(spark, tmp_path):
    path = str(tmp_path / "m")
    frame = lambda rows: spark.createDataFrame(rows, "column long, row long, value long")
    sc.write_columns(frame([(1, 1, 2), (1, 1, 3), (0, 5, 1)]), path)
    assert read(spark, path) == [(0, 5, 1), (1, 1, 5)]
    frame([(1, 2, 9)]).write.format(sc.FORMAT).mode("append").save(path)
    assert read(spark, path, "column = 1") == [(1, 1, 5), (1, 2, 9)]
    sc.write_columns(frame([]), path)
    assert read(spark, path) == []
    for bad in ((1, 1, -1), (None, 1, 1), (1, None, 1)):
        with pytest.raises(Exception, match="null key or negative"):
            sc.write_columns(frame([bad]), path)
    with pytest.raises(Exception, match="sorted by column"):
        frame([(3, 1, 1), (2, 1, 1)]).coalesce(1).write.format(sc.FORMAT).mode("append").save(path)
