"""Joint steps: transactions, order of arrival, scales.  Whole results are compared with SQL in test_catalog."""

from __future__ import annotations

import pytest

from lattica.operators.legal import MODES, Rules, denominator, legal_actions, scale_of
from lattica.streaming import joint
from lattica.streaming import windows as st

BINS = "patch long, bin long, row long, col long, cell long, target boolean, allowed boolean"
CLAIMS = "patch long, bin long, cell long, worth double"
REQUESTS = "patch long, step long, n long, cell long, bin long"
#: A row of six bins; cells 1 and 2 own the ends.
ROW = [(0, b, 0, b, {0: 1, 5: 2}.get(b), b == 1, True) for b in range(6)]
WORTH = [(0, b, c, w) for b in range(6) for c, w in ((1, 2.0 - b), (2, b - 3.0))]
RULES = Rules(eps=0.0, support=0.0, scale="sum_patch_cells")


def _start(spark):
    return spark.createDataFrame(ROW, BINS), spark.createDataFrame(WORTH, CLAIMS)


def _rows(spark, steps):
    asked = [(0, s, max(1, len(r)), c, b) for s, r in enumerate(steps, 1) for c, b in (r or [(None, None)])]
    return spark.createDataFrame(asked, REQUESTS)


def _run(spark, steps, rules=RULES, strict=False):
    bins, claims = _start(spark)
    done = joint.in_batch(joint.joint_steps(_rows(spark, steps), bins, claims, rules, strict))
    return [(r.step, r.phase, r.outcome, r.applied, r.masked, r.reward, r.ended) for r in done.orderBy("step").collect()], joint.owners_after(bins, done)


def test_a_step_that_does_not_pay_is_rolled_back_whole(spark):
    rows, owners = _run(spark, [[], [(1, 1), (2, 1)], [(2, 4)], [(1, 2), (2, 3), (2, 0)], [(1, 2)]])
    assert rows == [
        (1, "prefill", "no_proposal", 0, 0, -1.0, None),
        (2, "prefill", "applied", 1, 1, 1.0, None),  # cell 2 does not touch bin 1
        (3, "postfill", "applied", 1, 0, 1.0, None),
        (4, "postfill", "rollback", 0, 1, 0.0, "terminated"),
    ]
    assert {(r.bin, r.cell) for r in owners.collect()} == {(0, 1), (1, 1), (4, 2), (5, 2)}


def test_replacement_and_limits(spark):
    rows, owners = _run(spark, [[(1, 1)], [(2, 4)], [(2, 3)], [(2, 2)], [(1, 2)]], Rules(eps=0.0, support=0.0, scale="sum_patch_cells", most=3))
    assert rows[-1] == (3, "postfill", "rollback", 0, 0, 0.0, "terminated")
    rows, _ = _run(spark, [[(1, 1)], [(2, 4)], [(1, 2)]], Rules(eps=0.0, support=0.0, scale="sum_patch_cells", most=2))
    assert [(r[0], r[-1]) for r in rows] == [(1, None), (2, "truncated")]
    rows, _ = _run(spark, [[(1, 1)], [(2, 4)]], Rules(eps=0.0, support=0.0, replace_only=True))
    assert rows[1][2:5] == ("stop", 0, 1)


def test_strict_requests_raise(spark):
    with pytest.raises(Exception, match="requested twice or not open"):
        _run(spark, [[(1, 1), (2, 1)]], strict=True)


def test_stream_in_any_order_of_arrival_is_the_batch(spark, tmp_path):
    steps = [[], [(1, 1), (2, 1)], [(2, 4)], [(1, 2), (2, 3)], [(1, 2)]]
    expected, _ = _run(spark, steps)
    rows = _rows(spark, steps).collect()
    for i, part in enumerate((rows[3:], rows[1:3], rows[:1])):  # each file is a batch; the first step comes last
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(f"{tmp_path}/f{i}")
    bins, claims = _start(spark)
    schema = spark.read.parquet(f"{tmp_path}/f0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/f*")
    with joint.rocks(spark):
        out = st.run_available(joint.joint_steps(stream, bins, claims, RULES))
    assert [(r.step, r.phase, r.outcome, r.applied, r.masked, r.reward, r.ended) for r in out.orderBy("step").collect()] == expected
    assert spark.conf.get(joint.STORE, None) != joint.ROCKS


def test_legal_actions_of_a_row(spark):
    bins, claims = _start(spark)
    # A repeated claim is one claim; bins of other columns do not matter; nulls are false.
    got = legal_actions(bins, claims.unionByName(claims), "patch", RULES).collect()
    assert {(r.bin, r.cell, r.old, r.replace, r.reward) for r in got} == {(1, 1, None, False, 1.0)}
    full = bins.selectExpr("patch", "bin", "row", "col", "cell", "cast(null as boolean) as target", "true as allowed")
    got = legal_actions(full, claims, "patch", RULES).collect()
    assert {(r.bin, r.cell) for r in got} == {(1, 1), (4, 2)}
    assert legal_actions(bins.limit(0), claims, "patch", RULES).count() == 0
    assert legal_actions(bins, claims.limit(0), "patch", RULES).count() == 0


def test_scales(spark):
    from pyspark.sql import functions as F

    for mode in (*MODES, "mean_core_cells"):
        for cells, targets in ((4, 9), (0, 0)):
            got = spark.range(1).select(denominator(mode, F.lit(cells), F.lit(targets)).alias("d")).first().d
            assert got == scale_of(mode, cells, targets)
    with pytest.raises(ValueError):
        Rules(scale="other")


def _patches(patches: int):
    """Bins, claims and requests of small patches with large ids, holes, nulls and bins without an owner."""
    import random

    rnd, far = random.Random(5), 1 << 50
    bins, claims, asked = [], [], []
    for p in range(patches):
        at = [(r, c) for r in range(5) for c in range(5) if rnd.random() < 0.9]
        ids = {place: far + p * 100 + k for k, place in enumerate(at)}
        bins += [(p, b, r, c, rnd.choice((None, None, None, 0, 1, 2)), rnd.random() < 0.2, rnd.random() < 0.8) for (r, c), b in ids.items()]
        pairs = [(b, c) for b in ids.values() for c in range(4) if rnd.random() < 0.7] + [(far - 1, 0)]
        claims += [(p, b, c, float(rnd.randint(-6, 9))) for b, c in pairs]
        for step in range(1, 1 if p == 3 else 8):
            rows = [rnd.choice(pairs) for _ in range(rnd.randint(1, 25))] + [(None, 1), (far + p * 100, None)]
            asked += [(p, step, len(rows) + (p == 4 and step == 3), c, b) for b, c in rows]
    return bins, claims, asked


def test_a_batch_needs_no_store_and_is_the_stream(spark, tmp_path):
    bins, claims, asked = _patches(12)
    bins, claims = spark.createDataFrame(bins, BINS), spark.createDataFrame(claims, CLAIMS)
    rows, rules = spark.createDataFrame(asked, REQUESTS), Rules(eps=0.5, support=4.0, scale="mean_patch_cells", most=6)
    steps = joint.joint_steps(rows, bins, claims, rules)
    assert "TransformWithState" not in steps._jdf.queryExecution().optimizedPlan().toString()
    steps = joint.in_batch(steps)
    got = sorted(map(tuple, steps.collect()), key=lambda r: r[:2])
    assert max(r[1] for r in got if r[0] == 4) == 2  # the third step of patch 4 is not complete
    assert {r[3] for r in got} >= {"applied", "rollback"}
    rows.write.parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked")
    with joint.rocks(spark):
        out = st.run_available(joint.joint_steps(stream, bins, claims, rules))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == got
    owners = {tuple(r) for r in joint.joint_owners(rows, bins, claims, rules).collect()}
    assert owners == {tuple(r) for r in joint.owners_after(bins, steps).collect()}
    assert {r[0] for r in owners} == set(range(12))  # patch 3 asks for nothing
    # Without n, what is there is the step.
    whole = joint.joint_steps(rows.selectExpr("patch", "step", "null as n", "cell", "bin"), bins, claims, rules).collect()
    assert sorted((tuple(r) for r in whole if r.patch != 4), key=lambda r: r[:2]) == [r for r in got if r[0] != 4]
    assert max(r.step for r in whole if r.patch == 4) > 2


def test_legal_is_the_rule_as_it_is_written(spark):
    bins, claims, asked = _patches(30)
    for replace_only in (False, True):
        rules = Rules(eps=0.5, support=4.0, replace_only=replace_only)
        for p in range(30):
            b = joint.Board({r[1]: r[2:] for r in bins if r[0] == p}, {(r[1], r[2]): r[3] for r in claims if r[0] == p}, rules)
            held = b.held()

            def plain(bin, cell, filled, b=b, held=held, rules=rules):
                old = b.owner.get(bin)
                if (bin, cell) not in b.claims or bin not in b.place or old == cell or (cell in held and not b.near(bin, cell)):
                    return False
                if old is None:
                    return not rules.replace_only if filled else bin in b.target
                pays = (b.worth(bin, cell) - b.worth(bin, old)) / b.scale > rules.eps
                return bin in b.allowed and (filled or bin in b.target) and pays

            for q, _, _, cell, bin in asked:
                for filled in (False, True):
                    if q == p and bin is not None and cell is not None:
                        assert b.legal(bin, cell, filled, held) == plain(bin, cell, filled)
            assert b.can_add() == any(t in b.target and t not in b.owner and t in b.place and (c not in held or b.near(t, c)) for t, c in b.claims)


def test_a_stream_of_pieces_keeps_ids_that_doubles_round(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    far = (1 << 60) + 1
    bins, claims, asked = _patches(8)
    bins, claims = (spark.createDataFrame(r, s).withColumn("bin", F.col("bin") + far) for r, s in ((bins, BINS), (claims, CLAIMS)))
    rows, rules = spark.createDataFrame(asked, REQUESTS).withColumn("bin", F.col("bin") + far), Rules(eps=0.5, support=4.0, most=6)
    want = sorted(map(tuple, joint.joint_steps(rows, bins, claims, rules).collect()), key=lambda r: r[:2])
    assert {c.bin % 2 for r in want for c in r[-1]} == {0, 1}
    rows.write.parquet(f"{tmp_path}/asked")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    # A patch comes in many pieces.
    monkeypatch.setattr(joint, "HELD", 1)
    spark.conf.set(batch, 7)
    try:
        with joint.rocks(spark):
            out = st.run_available(joint.joint_steps(stream, bins, claims, rules))
    finally:
        spark.conf.set(batch, before)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == want


def test_requests_are_dealt_by_patch_only(spark):
    import re
    from collections import Counter

    from lattica.plans.bindings import Tables
    from lattica.plans.suites import joint as suite

    from .conftest import SMALL

    t = Tables(spark, SMALL)
    asked = suite.requests(t, t.raw("lineitem"))
    rows = [(r.patch, r.step, r.n) for r in asked.collect()]
    assert all(n == count for (_, _, n), count in Counter(rows).items())
    assert sorted(r[:2] for r in rows) == sorted(map(tuple, suite.asked(t, t.raw("lineitem")).select("patch", "step").collect()))
    assert not re.search(r"hashpartitioning\(patch#\d+L?, step", asked._jdf.queryExecution().executedPlan().toString())
