"""Groups in Python many at a time: small groups share a call, so that its arrays are long."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that a call waits for; it holds these and the group that passes them.
ROWS = 40_000


def starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions of the first rows of the groups of a sorted frame."""
    new = np.zeros(len(pdf), dtype=bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    return np.flatnonzero(new)


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The frames of a sorted partition, joined and cut so that no group lies in two."""
    held: list[pd.DataFrame] = []
    most = rows
    for pdf in frames:
        held.append(pdf)
        if sum(map(len, held)) < most:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = int(starts(pdf, keys)[-1])
        if last:
            yield pdf.iloc[:last].reset_index(drop=True)
        held = [pdf.iloc[last:].reset_index(drop=True)]
        most = rows + 2 * len(held[0])
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def map_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """``run(rows, first rows of the groups)`` over whole groups; null keys are a group.

    Few bytes are much work here, so groups are dealt to a stated number of tasks and not packed by size.
    """
    keys = list(keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, keys):
            yield run(pdf, starts(pdf, keys))

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(each, schema)
