"""Policies: what picks one of the valid actions of a state."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .batches import map_groups


class Policy(Protocol):
    """Given the rows of the valid actions of one state, the position of the chosen one."""

    def select_action(self, actions: pd.DataFrame) -> int: ...


class Greedy:
    """The largest reward; of equals the first one."""

    def select_action(self, actions: pd.DataFrame) -> int:
        return int(np.argmax(actions["reward"].to_numpy()))

    def select_all(self, actions: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        """Positions of the choices of many states, whose rows start at ``first``: as ``select_action`` for each, and as there a reward that is no number comes first."""
        state = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(actions))))
        reward = actions["reward"].to_numpy(np.float64)
        order = np.lexsort((-reward, ~np.isnan(reward), state))
        return order[first]


class Random:
    """A draw that depends on the seed and on the state's first action alone, so reruns agree."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def select_action(self, actions: pd.DataFrame) -> int:
        return int(np.random.default_rng([self.seed, int(actions["action"].iloc[0]) & 0xFFFFFFFF, len(actions)]).integers(len(actions)))


def choose(actions: DataFrame, state: Sequence[str], policy: Policy) -> DataFrame:
    """The chosen row of each state among its valid actions (state columns, action, reward, valid); a state is one group.

    Many states share a call; a policy with ``select_all`` chooses for all of them at once.
    A state without a valid action raises.
    """
    keys = list(state)

    def pick(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        valid = pdf["valid"].to_numpy() == True  # noqa: E712  a null is not valid
        empty = np.add.reduceat(valid, first) == 0
        if empty.any():
            raise ValueError(f"state {tuple(pdf[keys].iloc[first[np.argmax(empty)]])} has no valid action")
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pdf))))
        order = np.argsort(pdf["action"].to_numpy(), kind="stable")
        order = order[valid[order]]
        order = order[np.argsort(group[order], kind="stable")]
        pdf, at = pdf.iloc[order].reset_index(drop=True), np.flatnonzero(np.diff(group[order], prepend=-1))
        if hasattr(policy, "select_all"):
            return pdf.iloc[policy.select_all(pdf, at)]
        ends = [*at[1:], len(pdf)]
        return pdf.iloc[[a + policy.select_action(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(at, ends, strict=True)]]

    return map_groups(actions, keys, pick, actions.schema)
