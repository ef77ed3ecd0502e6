"""Connected components by alternating large-star and small-star steps.

Links stay in Spark; each step is two grouped minima and two joins on the link
table, which is written and read again.  Hubs with many links are no single
group: minima are pre-aggregated and joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _settled(links: DataFrame) -> bool:
    """Every node has one link down, or only links from above: each component is one star around its least node."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def roots(links: DataFrame, scratch: Scratch | None = None, name: str = "roots", limit: int = 60) -> DataFrame:
    """(a, root) for every end of links (a, b), a != b; root is the least node of the component.  Written under ``name``."""
    scratch = scratch or Scratch(links.sparkSession, "components")
    kept = scratch.keep(f"{name}-0", links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    for i in range(1, limit + 1):
        kept = scratch.keep(f"{name}-{i}", _small_star(_large_star(kept)))
        scratch.drop(f"{name}-{i - 1}")
        if _settled(kept):
            return kept.select("a", F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {limit} rounds")
