"""Seekable replay against a fold from the start."""

from __future__ import annotations

import random

import pytest

from lattica.operators import sequences as sq


@pytest.mark.parametrize("every", [1, 4, 50])
def test_seek_equals_a_fold(spark, every):
    rnd = random.Random(2)
    rows = [(t, s, rnd.randrange(5), rnd.randint(-1, 9)) for t in range(4) for s in sorted(rnd.sample(range(1, 60), 25))]
    actions = spark.createDataFrame(rows, "traj long, step long, item long, owner long")
    asked = [(t, s) for t in range(5) for s in range(0, 70)] + [(0, 3)]
    frames = sq.key_frames(actions, ["traj"], "item", "step", "owner", every)
    got = sq.seek(frames, actions, spark.createDataFrame(asked, "traj long, at long"), ["traj"], "item", "step", "owner", every).collect()
    expected = {}
    for t, at in asked:
        for traj, s, item, owner in rows:
            if traj == t and s <= at:
                expected[t, at, item] = (owner, s)
    assert {(r.traj, r.at, r.item): (r.owner, r.since) for r in got} == expected and len(got) == len(expected)
    empty = actions.limit(0)
    assert sq.seek(sq.key_frames(empty, ["traj"], "item", "step", "owner", every), empty, actions.select("traj", "step").withColumnRenamed("step", "at"), ["traj"], "item", "step", "owner", every).count() == 0
