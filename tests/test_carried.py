"""Units that move on the grid: each draw by hand, over tiles, holes and rows of very many units."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from lattica.operators import simulate

COUNTS = "row long, col long, gene string, n long"


def _draw(start: int, number: int) -> float:
    whole = (1 << 64) - 1
    z = (start + (number + 1) * 0x9E3779B97F4A7C15) & whole
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & whole
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & whole
    return ((z ^ (z >> 31)) >> 11) / 2**53


def _by_hand(rows, seed, p, offset):
    there = {(r, c) for r, c, *_ in rows}
    out = Counter()
    for r, c, g, n in rows:
        start = int(hashlib.sha256(":".join(str(k) for k in (seed, r, c, g) if k is not None).encode()).hexdigest()[:16], 16)
        for i in range(n or 0):
            to = (r, c)
            if None not in to and _draw(start, 3 * i) < p:
                dr, dc = offset(_draw(start, 3 * i + 1), _draw(start, 3 * i + 2))
                to = (r + dr, c + dc) if (r + dr, c + dc) in there else to
            out[*to, g] += 1
    return dict(out)


def _gauss(sigma):
    def offset(u, v):
        far = math.sqrt(-2 * math.log(max(u, 1e-15))) * sigma
        return round(far * math.cos(2 * math.pi * v)), round(far * math.sin(2 * math.pi * v))

    return offset


def _got(df):
    rows = [((r["row"], r["col"], r["gene"]), r["n"]) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_units_move_as_drawn_over_tiles_and_holes(spark, monkeypatch):
    monkeypatch.setattr(simulate, "TILE", 16)
    monkeypatch.setattr(simulate, "UNITS", 50)
    rows = [(r, c, g, (r * 7 + c * 3 + len(g or "")) % 5) for r in range(-20, 30) for c in range(-3, 40, 2) for g in ("a", "bb", None) if (r + c) % 7]
    rows += [(2, 100, "a", None), (None, 3, "a", 4), (None, 3, "a", 2), (None, None, "bb", 0), (3, None, None, 5)]
    counts = spark.createDataFrame(rows, COUNTS)
    moved = _got(simulate.transport(counts, 6, 0.6, 1.1))
    assert moved == _by_hand(rows, 6, 0.6, _gauss(1.1))
    assert moved != _by_hand(rows, 6, 0.0, _gauss(1.1))
    uniform = lambda u, v: (math.floor(u * 7) - 3, math.floor(v * 7) - 3)
    assert _got(simulate.ambient(counts, 0.8, 3, 5)) == _by_hand(rows, 5, 0.8, uniform)
    assert simulate.transport(counts.limit(0), 6, 0.6, 1.1).count() == 0


def test_no_unit_is_a_row(spark):
    counts = spark.createDataFrame([(0, 0, "a", 3_000_000), (0, 1, "a", 1)], COUNTS)
    moved = simulate.transport(counts, 1, 0.3, 1.0)
    assert "explode(sequence" not in moved._jdf.queryExecution().optimizedPlan().toString()
    got = _got(moved)
    assert set(got) == {(0, 0, "a"), (0, 1, "a")} and sum(got.values()) == 3_000_001
    # A unit ends one place to the right when its rounded offset is (0, 1).
    near, far = (0.5 * (math.erf(b / math.sqrt(2)) - math.erf(a / math.sqrt(2))) for a, b in ((-0.5, 0.5), (0.5, 1.5)))
    assert abs(got[0, 1, "a"] / 3e6 - 0.3 * near * far) < 5e-4
