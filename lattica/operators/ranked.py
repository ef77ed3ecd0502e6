"""Ranked, windowed and de-duplicating operators.

Where only one row of a group is wanted, an aggregate (pre-aggregated on the map
side, safe for hot keys) is used and no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order`` (ascending structs; negate for descending)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def places(df: DataFrame, order: Column, out: str = "place") -> DataFrame:
    """Row numbers over the whole table, from 1: rows are dealt by ranges of ``order`` and numbered in each range; no task sees all rows.

    Equal values of ``order`` fall in one range, in no fixed order.
    """
    p = cut(df.withColumn("_k", order).repartitionByRange("_k").withColumn("_p", F.spark_partition_id()))
    # One row for each range.
    before = p.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b"))
    ranked = p.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_k")))
    return ranked.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_r")).drop("_p", "_k", "_b", "_r")


def competition_rank(value: Column, partition: Sequence[str], descending: bool = True) -> Column:
    """Rank with gaps; null and NaN are unranked."""
    ok = value.isNotNull() & ~F.isnan(value)
    w = Window.partitionBy(*partition).orderBy(F.when(ok, value).desc_nulls_last() if descending else F.when(ok, value).asc_nulls_last())
    return F.when(ok, F.rank().over(w))


def average_rank(value: Column, partition: Sequence[str]) -> Column:
    """Ascending rank, ties share the mean of their ranks."""
    w = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def average_ranks(df: DataFrame, value: str, keys: Sequence[str], out: str = "rank") -> DataFrame:
    """Average ranks by way of distinct values, so that ties are counted before anything is sorted.

    Only the distinct values of a group pass through the window.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*keys, value])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def top_k_mean(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str = "top_mean") -> DataFrame:
    """Mean of the k greatest values, 0 without any."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())))
    return best.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("_r") <= k, F.col(value))), F.lit(0.0)).alias(out))


def softmax(logit: Column, partition: Sequence[str]) -> Column:
    """Softmax inside each group, shifted by its maximum."""
    w = Window.partitionBy(*partition)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def normalized(value: Column, partition: Sequence[str], target: Column | float = 1.0) -> Column:
    """value * target / sum, 0 when the sum is 0."""
    target = F.lit(target) if isinstance(target, (int, float)) else target
    return F.coalesce(F.try_divide(value * target, F.sum(value).over(Window.partitionBy(*partition))), F.lit(0.0))


def entropy(p: Column, partition: Sequence[str], extra: int = 0) -> Column:
    """-sum p ln p / ln(n + extra) in 0..1; one candidate has 0."""
    w = Window.partitionBy(*partition)
    n = F.count("*").over(w) + extra
    h = -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)).over(w)
    return F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), h / F.ln(n)))).otherwise(F.lit(0.0))


def zscore(value: Column, partition: Sequence[str], floor: float = 1e-8) -> Column:
    """Population z-score, deviation floored."""
    w = Window.partitionBy(*partition)
    return (value - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(floor))


def masked_zscore(value: Column, mask: Column, partition: Sequence[str], delta: float) -> Column:
    """Mean and deviation over the masked rows, applied to all; delta is added to the deviation."""
    w = Window.partitionBy(*partition)
    v = F.when(mask, value)
    return (value - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + delta)


def masked_zscore_or_zero(value: Column, mask: Column, partition: Sequence[str], delta: float) -> Column:
    """As masked_zscore, but 0 when the deviation is not over delta."""
    w = Window.partitionBy(*partition)
    v = F.when(mask, value)
    s = F.stddev_pop(v).over(w)
    return F.when(s > delta, (value - F.avg(v).over(w)) / s).otherwise(F.lit(0.0))


def quantile_cut(df: DataFrame, value: str, keys: Sequence[str], q: int = 4, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins with linear edges; the least value is in the first; equal edges merge."""
    probs = [i / q for i in range(q + 1)]
    edges = df.groupBy(*keys).agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs])).alias("_e")) if keys else df.agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs])).alias("_e"))
    edges = edges.withColumn("_e", F.array_distinct("_e"))
    joined = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return joined.withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_e")


def grid_step(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least positive difference of sorted distinct values, 1.0 without one."""
    d = df.select(*keys, value).distinct()
    gap = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(value))
    return d.withColumn("_g", gap).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_g") > 0, F.col("_g"))), F.lit(1.0)).alias("step"))


def runs(df: DataFrame, keys: Sequence[str], order: str, out: str = "run") -> DataFrame:
    """Number of the run of consecutive integers that each row is in."""
    w = Window.partitionBy(*keys).orderBy(order)
    start = F.when(F.col(order) - F.lag(order).over(w) == 1, 0).otherwise(1)
    return df.withColumn("_s", start).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def row_splits(df: DataFrame, key: str) -> DataFrame:
    """(key, n, start): sizes and exclusive prefix sums of groups in key order."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
