"""Ranks, distances between distributions, correlations, resampling, apportionment.

Where a rank or an empirical distribution is needed, values are counted first,
so that only distinct values pass through an ordered window.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_uniform


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; null when a class is empty.

    Rows are first summed to (score, positives, negatives).
    """
    c = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("q", F.col("n") - F.col("p"))
    c = c.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    total_p, total_q = F.sum("p"), F.sum("q")
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)), (total_p * total_q).cast("double")).alias("auc"), total_p.alias("positives"), total_q.alias("negatives"))


def _steps(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Distinct values of both samples with the empirical distribution of each at the value."""
    u = a.select(*keys, value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, value, F.lit(0).alias("a"), F.lit(1).alias("b")))
    c = u.groupBy(*keys, value).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = c.groupBy(*keys).agg(F.sum("a").cast("double").alias("ta"), F.sum("b").cast("double").alias("tb"))
    c = c.join(totals, list(keys)) if keys else c.crossJoin(F.broadcast(totals))
    w = Window.partitionBy(*keys).orderBy(value)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumns({"fa": F.sum("a").over(up) / F.col("ta"), "fb": F.sum("b").over(up) / F.col("tb"), "gap": F.lead(value).over(w) - F.col(value)})


def two_sample(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 distance of two samples."""
    d = F.abs(F.col("fa") - F.col("fb"))
    return _steps(a, b, value, keys).groupBy(*keys).agg(F.max(d).alias("ks"), F.sum(d * F.coalesce("gap", F.lit(0.0))).alias("wasserstein"))


def jensen_shannon(p: DataFrame, q: DataFrame, on: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Square root of the divergence, natural logarithm, of two count tables (on, n)."""
    j = p.select(*keys, *on, F.col("n").alias("pn")).join(q.select(*keys, *on, F.col("n").alias("qn")), [*keys, *on], "full_outer")
    w = Window.partitionBy(*keys)
    j = j.withColumns({"p": F.coalesce("pn", F.lit(0)) / F.sum(F.coalesce("pn", F.lit(0))).over(w), "q": F.coalesce("qn", F.lit(0)) / F.sum(F.coalesce("qn", F.lit(0))).over(w)})
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return j.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)).alias("js"))


def correlations(df: DataFrame, x: str, y: str, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Pearson and Spearman by group; null when a side is constant or the group is too small.

    Spearman needs ranks within the group; a group is one item's profile, which its genes bound.
    """
    w = Window.partitionBy(*keys)

    def rank(c: str) -> Column:
        ties = Window.partitionBy(*keys, c)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(ties) - 1) / 2.0

    r = df.withColumns({"_rx": rank(x), "_ry": rank(y)})
    varied = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y)) & (F.count("*") >= least)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.when(varied, F.corr(x, y)).alias("pearson"), F.when(varied, F.corr("_rx", "_ry")).alias("spearman"))


def describe(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """n, mean, variance, deviation, coefficient of variation, and exact percentiles."""
    v = F.col(value)
    q = F.percentile(v, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    a = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.stddev_pop(v).alias("sd"), q.alias("_q"))
    names = ("q05", "q25", "median", "q75", "q95")
    return a.select(*keys, "n", "mean", "var", "sd", F.try_divide("sd", "mean").alias("cv"), *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def with_all(df: DataFrame, key: str, label: str = "all") -> DataFrame:
    """Every row twice: under its key and under ``all``; Spark plans it as one expand."""
    return df.withColumn(key, F.explode(F.array(F.col(key).cast("string"), F.lit(label))))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, weight: str, draws: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the pooled weighted mean when whole clusters are drawn with replacement.

    Cluster sums come first, so a draw picks among clusters and not among rows.
    Draws are hashes of (seed, draw, slot): the same on every engine and rerun.
    """
    sums = df.groupBy(*keys, cluster).agg(F.sum(F.col(value) * F.col(weight)).alias("sv"), F.sum(weight).alias("sw"))
    w = Window.partitionBy(*keys).orderBy(cluster)
    numbered = sums.withColumns({"i": F.row_number().over(w) - 1, "k": F.count("*").over(Window.partitionBy(*keys))})
    slots = numbered.select(*keys, "k", F.col("i").alias("slot")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = slots.withColumn("i", F.floor(hash_uniform(seed, *[F.col(x) for x in keys], F.col("draw"), F.col("slot")) * F.col("k")).cast("int"))
    j = picked.join(numbered.select(*keys, "i", "sv", "sw"), [*keys, "i"])
    means = j.groupBy(*keys, "draw").agg((F.sum("sv") / F.sum("sw")).alias("m"))
    interval = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    point = sums.groupBy(*keys).agg((F.sum("sv") / F.sum("sw")).alias("mean"), F.count("*").alias("clusters"))
    out = point.join(interval, list(keys), "left") if keys else point.crossJoin(interval)
    few = F.col("clusters") < 2
    return out.select(*keys, "clusters", "mean", F.when(~few, F.col("low")).alias("low"), F.when(~few, F.col("high")).alias("high"))


def largest_remainder(df: DataFrame, keys: Sequence[str], weight: str, budget: Column, order: Sequence[str], out: str = "share") -> DataFrame:
    """Integer shares of a budget by weight: floors, then one more for the largest fractions."""
    w = Window.partitionBy(*keys)
    exact = budget * F.col(weight) / F.sum(weight).over(w)
    d = df.withColumn("_x", F.coalesce(exact, F.lit(0.0))).withColumn("_f", F.floor("_x"))
    d = d.withColumn("_left", budget - F.sum("_f").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.round(F.col("_x") - F.col("_f"), 9).desc(), *order)))
    return d.withColumn(out, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long")).cast("long")).drop("_x", "_f", "_left", "_r")


#: The most donors whose splits are listed.
DONORS = 20


def donor_splits(totals: dict, least: float) -> list[tuple[tuple, float]]:
    """Splits of a handful of donors (DONORS at most) to two sides with the least share on each, best balanced first, then by name.

    ``totals`` is a small aggregate: donors are people, and 2^n masks are listed.
    """
    names = sorted(totals)
    if len(names) > DONORS:
        raise ValueError(f"{len(names)} donors have too many splits to list; {DONORS} is the most")
    whole = sum(totals.values())
    out = []
    for mask in itertools.product((False, True), repeat=len(names)):
        side = tuple(n for n, m in zip(names, mask, strict=True) if m)
        if not 0 < len(side) < len(names) or not whole:
            continue
        share = math.fsum(totals[n] for n in side) / whole
        if least <= share <= 1 - least:
            out.append((side, abs(share - 0.5)))
    return sorted(out, key=lambda x: (round(x[1], 9), x[0]))
