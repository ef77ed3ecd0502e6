"""Connected components by large-star and small-star steps on the link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(nodes: DataFrame, links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without links are their own.

    Each step replaces a link by one to a smaller node: a grouped minimum and a
    join.  Long chains shrink by powers, so the rounds are logarithmic.
    """
    e = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            root = e.groupBy("a").agg(F.min("b").alias("root"))
            return nodes.join(root, F.col("node") == F.col("a"), "left").select("node", F.coalesce("root", "node").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def reachable(seeds: DataFrame, allowed: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes of ``allowed`` that are in a component with a seed."""
    inside = links.join(allowed.select(F.col("node").alias("a")), "a", "left_semi").join(allowed.select(F.col("node").alias("b")), "b", "left_semi")
    roots = components(allowed, inside)
    hit = roots.join(seeds.select("node"), "node", "left_semi").select("root").distinct()
    return roots.join(hit, "root", "left_semi").select("node")
