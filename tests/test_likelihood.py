"""The wide plan of the likelihood against the long one."""

from __future__ import annotations

import random

import pytest

from lattica.operators import likelihood as lk


@pytest.mark.parametrize("kinds", [1, 2, 5, lk.WIDE_TYPES + 1])
def test_wide_and_long_plans_agree(spark, kinds):
    rnd = random.Random(kinds)
    counts = spark.createDataFrame([(b, rnd.randrange(6), rnd.randint(1, 5)) for b in range(30) for _ in range(8)], "bin long, gene long, n long")
    reference = spark.createDataFrame([(f"k{k}", g, rnd.randint(0, 9)) for k in range(kinds) for g in range(6)], "k string, gene long, c long")
    theta = lk.theta(reference)
    want = {(r.bin, r.k): (r.ll, r.q) for r in lk.with_softmax(lk.log_likelihood(counts.groupBy("bin", "gene").sum("n").withColumnRenamed("sum(n)", "n"), theta)).collect()}
    got = lk.likelihood_softmax(counts, theta).collect()
    assert len(got) == len(want) == 30 * kinds
    assert all(want[r.bin, r.k] == (pytest.approx(r.ll, abs=1e-9), pytest.approx(r.q, abs=1e-9)) for r in got)


def test_empty_tables(spark):
    counts = spark.createDataFrame([], "bin long, gene long, n long")
    theta = lk.theta(spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "k string, gene long, c long"))
    assert lk.likelihood_softmax(counts, theta).count() == 0
    assert lk.likelihood_softmax(counts, theta.limit(0)).count() == 0
