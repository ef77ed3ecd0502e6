"""What cells of a patch may do next: frontier, targets, protected owners, and the reward of each action."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial

#: Modes of ``denominator``; the names with core are older words for the same.
MODES = ("sum_patch_cells", "sqrt_patch_cells", "mean_patch_cells", "mean_expression_bins", "sqrt_expression_bins")


@dataclass(frozen=True)
class Rules:
    """Rules of a patch: reward needed by a replacement, weight of support, scale of rewards, what is allowed once all targets are owned."""

    eps: float = 1e-6
    support: float = 1.0
    scale: str = "mean_patch_cells"
    replace_only: bool = False
    most: int = 1_000

    def __post_init__(self) -> None:
        if self.scale.replace("core", "patch") not in MODES:
            raise ValueError(f"unknown scale {self.scale}")


def scale_of(mode: str, cells: int, targets: int) -> float:
    """What a reward is divided by: nothing, the cells or the target bins of the patch, or the root of either."""
    mode = mode.replace("core", "patch")
    n = max(1, targets if mode.endswith("expression_bins") else cells)
    return 1.0 if mode == "sum_patch_cells" else n**0.5 if mode.startswith("sqrt") else float(n)


def denominator(mode: str, cells: Column, targets: Column) -> Column:
    """``scale_of`` as a Column."""
    mode = mode.replace("core", "patch")
    if mode not in MODES:
        raise ValueError(f"unknown scale {mode}")
    n = F.greatest(F.lit(1), targets if mode.endswith("expression_bins") else cells)
    return F.lit(1.0) if mode == "sum_patch_cells" else F.sqrt(n) if mode.startswith("sqrt") else n.cast("double")


def supports(bins: DataFrame, key: str) -> DataFrame:
    """(key, bin, cell, k): how many of the eight neighbours of a bin each cell owns.  Only owned bins are copied, and counted before the shuffle."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spatial.EIGHT])
    around = bins.filter("cell is not null").select(key, "row", "col", "cell", F.explode(steps).alias("o"))
    touched = around.groupBy(key, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "cell").agg(F.count("*").alias("k"))
    return touched.join(bins.select(key, "row", "col", "bin"), [key, "row", "col"]).select(key, "bin", "cell", "k")


def legal_actions(bins: DataFrame, claims: DataFrame, key: str, rules: Rules) -> DataFrame:
    """(key, bin, cell, old, replace, reward): every action that the rules allow.

    bins: (key, bin, row, col, cell, target, allowed), cell null without an owner; allowed says that the owner may be
    replaced.  claims: (key, bin, cell, worth), the bins that a cell may own and what it gets from each.  A cell without
    bins may take any of its claims, others only bins next to their own.  Until every target has an owner only targets
    are open; after that a patch with ``replace_only`` adds nothing.  A replacement must pay more than eps, an ADD not.
    Rows that repeat in claims are one claim of the first worth; a null target or allowed is false.
    """
    b = bins.select(key, "bin", "row", "col", "cell", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("target", "allowed")])
    claims = claims.groupBy(key, "bin", "cell").agg(F.min("worth").alias("worth"))
    patch = b.groupBy(key).agg(F.count_if("target").alias("targets"), F.count_if(F.col("target") & F.col("cell").isNull()).alias("open"))
    patch = patch.join(claims.groupBy(key).agg(F.count_distinct("cell").alias("cells")), key)
    held = b.filter("cell is not null").select(key, "cell").distinct().withColumn("has", F.lit(True))
    near = supports(b, key)
    old = b.select(key, "bin", F.col("cell").alias("old"), "target", "allowed")
    a = claims.join(old, [key, "bin"]).filter("old is null or old <> cell")
    a = a.join(near, [key, "bin", "cell"], "left").join(held, [key, "cell"], "left").filter("k > 0 or has is null")
    a = a.join(claims.select(key, "bin", F.col("cell").alias("old"), F.col("worth").alias("_w")), [key, "bin", "old"], "left")
    a = a.join(near.select(key, "bin", F.col("cell").alias("old"), F.col("k").alias("_k")), [key, "bin", "old"], "left").join(patch, key)
    both, zero = rules.support * 2 / 8, F.lit(0)
    gain = F.col("worth") + both * F.coalesce("k", zero) - F.coalesce("_w", zero) - both * F.coalesce("_k", zero)
    a = a.withColumns({"replace": F.col("old").isNotNull(), "reward": gain / denominator(rules.scale, F.col("cells"), F.col("targets"))})
    filled = F.col("open") == 0
    add = ~F.col("replace") & F.when(filled, F.lit(not rules.replace_only)).otherwise(F.col("target"))
    swap = F.col("replace") & F.col("allowed") & (filled | F.col("target")) & (F.col("reward") > rules.eps)
    return a.filter(add | swap).select(key, "bin", "cell", "old", "replace", "reward")
