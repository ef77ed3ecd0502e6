"""Online assignment: folds of actions, greedy growth, pluggable scores.

The rules are sequential inside a patch and independent across patches, so a
patch is one group of one Python call; patches are rectangles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Score(Protocol):
    """A pluggable score: rewards of the frontier rows of one patch, given the owners so far and the step."""

    def __call__(self, frontier: pd.DataFrame, owners: dict[int, int], step: int) -> pd.Series: ...


def stored_reward(frontier: pd.DataFrame, owners: dict[int, int], step: int) -> pd.Series:
    return frontier["reward"]


def _grow(pdf: pd.DataFrame, score: Score, eps: float, most: int) -> list[tuple]:
    owners: dict[int, int] = {}
    for r in pdf[pdf["seed"].eq(True)].sort_values(["bin", "cell"]).itertuples():
        owners.setdefault(int(r.bin), int(r.cell))
    place = {int(b): (int(r), int(c)) for b, r, c in zip(pdf["bin"], pdf["row"], pdf["col"], strict=True)}
    at = {v: k for k, v in place.items()}
    by_cell = {int(c): g.set_index("bin") for c, g in pdf.groupby("cell")}
    out = [(b, c, 0) for b, c in owners.items()]
    grown = {c: {b for b, o in owners.items() if o == c} for c in by_cell}
    for step in range(1, most + 1):
        moved = False
        for cell in sorted(by_cell):
            rows = by_cell[cell]
            near = {at.get((r + i, k + j)) for b in grown[cell] for r, k in [place[b]] for i in (-1, 0, 1) for j in (-1, 0, 1)} - {None}
            free = sorted(b for b in near if b not in owners and b in rows.index)
            if not free:
                continue
            frontier = rows.loc[free]
            rewards = score(frontier, owners, step)
            # The first of equals stays: strictly greater wins.
            best, value = None, eps
            for b, v in zip(free, rewards, strict=True):
                if v > value:
                    best, value = b, v
            if best is not None:
                owners[best] = cell
                grown[cell].add(best)
                out.append((best, cell, step))
                moved = True
        if not moved:
            break
    return out


def grow(rows: DataFrame, keys: Sequence[str], score: Score = stored_reward, eps: float = 0.0, most: int = 100) -> DataFrame:
    """(keys, bin, cell, step): seeds at step 0, then one best positive bin for each cell and step; no bin is taken twice.

    rows: (keys, bin, row, col, cell, reward, seed), the candidates of each patch.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in _grow(pdf, score, eps, most)], columns=[*keys, "bin", "cell", "step"])

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, bin long, cell long, step int")


def fold_actions(actions: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, item, owner, applied) after (step, replace, owner) actions: ADD needs an unowned item, REPLACE an owned one.

    No loop: the first ADD of an item applies, and every REPLACE after it.
    """
    first = F.min(F.when(~F.col("replace"), F.col("step")))
    g = [*keys, item]
    start = actions.groupBy(*g).agg(first.alias("_s")).filter("_s is not null")
    valid = actions.join(start, g).filter("(not replace and step = _s) or (replace and step > _s)")
    return valid.groupBy(*g).agg(F.max_by("owner", "step").alias("owner"), F.count("*").alias("applied"))


def joint_step(owners: DataFrame, proposals: DataFrame, gain: Callable[[DataFrame], float], eps: float = 0.0) -> tuple[DataFrame, bool]:
    """All cells act at once: (owners, kept).  Two proposals for one barcode raise; a gain of eps or less rolls the step back."""
    twice = proposals.groupBy("barcode").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"barcode {twice[0][0]} is proposed twice")
    after = owners.join(proposals.select("barcode", F.col("cell").alias("_c")), "barcode", "full_outer").select("barcode", F.coalesce("_c", "cell").alias("cell"))
    return (after, True) if gain(after) > eps else (owners, False)
