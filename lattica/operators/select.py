"""Filters, selections and alignments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hash_rank_key
from .lineage import cut
from .ranked import places
from .spatial import in_rectangles, radius_join


def in_any_rectangle(points: DataFrame, rectangles: DataFrame, key: str, tile: float, ids: Sequence[str]) -> DataFrame:
    """Points inside at least one rectangle, each once."""
    return points.join(in_rectangles(points, rectangles, key, tile).select(*ids).distinct(), list(ids), "left_semi")


def quality_filter(counts: DataFrame, least_bins: int, least_counts: int) -> DataFrame:
    """Counts of genes in enough bins and then of bins with enough counts."""
    genes = counts.filter("n > 0").groupBy("gene").agg(F.count("*").alias("_b")).filter(F.col("_b") >= least_bins).select("gene")
    kept = counts.join(genes, "gene", "left_semi")
    bins = kept.groupBy("bin").agg(F.sum("n").alias("_t")).filter(F.col("_t") >= least_counts).select("bin")
    return kept.join(bins, "bin", "left_semi")


def relabel(df: DataFrame, score: str, least: float, key: str) -> DataFrame:
    """Rows with enough confidence, numbered 1..n in key order."""
    return places(df.filter(F.col(score) >= least), F.col(key), "label")


def align(df: DataFrame, targets: DataFrame, key: str, order: str) -> DataFrame:
    """Rows in the order of ``targets`` (key, order); a target without a row raises when it is read."""
    j = targets.join(df.withColumn("_ok", F.lit(True)), key, "left")
    found = F.when(F.col("_ok"), F.col(order)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast(df.sparkSession.createDataFrame([], targets.schema).schema[order].dataType))
    return j.withColumn(order, found).drop("_ok")


def separated(df: DataFrame, key: str, group: Sequence[str], distance: float, seed: int) -> DataFrame:
    """Greedy choice in hash order: a point (key, x, y) stays when none of its group that stayed is nearer than the distance.

    Exactly the points of that sequential rule, found in rounds over pairs of
    near points: a point without an undecided earlier neighbour stays, and what is
    near it goes.  Ranks are random, so rounds are few, and no group is one task.
    """
    ranked = df.select(*group, F.col(key).alias("_k"), "x", "y", hash_rank_key(seed, F.col(key)).alias("_h"))
    later = ranked.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    before = (F.col("_h") < F.col("_h2")) | ((F.col("_h") == F.col("_h2")) & (F.col("_k") < F.col("_k2")))
    pairs = cut(radius_join(ranked, later, distance, reduce(and_, same, before & (F.col("d") < distance))).select(F.col("_k").alias("a"), F.col("_k2").alias("b")))
    gone = []
    while not pairs.isEmpty():
        free = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
        lost = cut(pairs.join(free, "a", "left_semi").select("b").distinct())
        gone.append(lost)
        pairs = cut(pairs.join(lost, "b", "left_anti").join(lost.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    dropped = reduce(DataFrame.unionByName, gone) if gone else pairs.select("b")
    return df.join(dropped.select(F.col("b").alias(key)), key, "left_anti").select(*df.columns)


def close_to(columns: dict[str, float], tolerance: float = 1e-9) -> Column:
    """Rows whose parameters are those given, within a tolerance."""
    out = F.lit(True)
    for c, v in columns.items():
        out = out & (F.abs(F.col(c) - v) <= tolerance * max(1.0, abs(v)))
    return out


def padded(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values, mask): each key's values as an array, padded with zeros to the longest."""
    g = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double")).alias("v"))
    longest = g.agg(F.max(F.size("v")).alias("m"))
    j = g.crossJoin(F.broadcast(longest))
    gap = F.col("m") - F.size("v")
    return j.select(key, F.concat("v", F.array_repeat(F.lit(0.0), gap)).alias("values"), F.concat(F.array_repeat(F.lit(1), F.size("v")), F.array_repeat(F.lit(0), gap)).alias("mask"))
