"""Comparing owners: overlap, matching, transitions, audits.

Owner tables are (barcode, cell).  Everything is counted on equi-joins of the
barcode; nothing compares cells with cells pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b as double; ``empty`` (null by default) when b is 0."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def set_metrics(inter: Column, pred: Column, truth: Column) -> dict[str, Column]:
    """IoU is null for two empty sets; precision, recall and F1 are 0 where undefined."""
    p, r = ratio(inter, pred, 0.0), ratio(inter, truth, 0.0)
    return {"iou": ratio(inter, pred + truth - inter), "dice": ratio(2 * inter, pred + truth), "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r, 0.0)}


def overlap(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(cell, n_pred, n_truth, n_inter) of cells that own bins in either table."""
    both = pred.select("barcode", "cell", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("barcode", "cell", F.lit(0).alias("p"), F.lit(1).alias("t")))
    pairs = both.groupBy("cell", "barcode").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return pairs.groupBy("cell").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_truth"), F.sum(F.col("p") * F.col("t")).alias("n_inter"))


def fractional_overlap(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell, n_pred, weight, inter): inter sums the weights (barcode, cell, w) of predicted bins."""
    w = weights.groupBy("cell").agg(F.sum("w").alias("weight"))
    n = pred.groupBy("cell").agg(F.count("*").alias("n_pred"))
    inter = pred.join(weights, ["barcode", "cell"]).groupBy("cell").agg(F.sum("w").alias("inter"))
    out = w.join(n, "cell", "full_outer").join(inter, "cell", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("cell", zero("n_pred"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("inter", F.lit(0.0)).alias("inter"))


def pair_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): bins that cell a owns in one table and cell b in the other."""
    return a.select("barcode", F.col("cell").alias("a")).join(b.select("barcode", F.col("cell").alias("b")), "barcode").groupBy("a", "b").agg(F.count("*").alias("n"))


def best_match(counts: DataFrame, key: str, other: str) -> DataFrame:
    """For each key the other side with most bins; of equals the larger id as text."""
    return counts.groupBy(key).agg(F.max_by(F.struct(F.col(other), F.col("n")), F.struct(F.col("n"), F.col(other).cast("string"))).alias("m")).select(key, F.col(f"m.{other}").alias(other), F.col("m.n").alias("n"))


def match_by_overlap(a: DataFrame, b: DataFrame, least: int = 1, share: float = 0.0) -> DataFrame:
    """(a, b, n, fraction): best match with at least so many bins and share of a's bins."""
    sizes = a.groupBy(F.col("cell").alias("a")).agg(F.count("*").alias("size"))
    m = best_match(pair_counts(a, b), "a", "b").join(sizes, "a").withColumn("fraction", F.col("n") / F.col("size"))
    return m.filter((F.col("n") >= least) & (F.col("fraction") >= share)).drop("size")


def reciprocal_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): pairs that are each other's best match."""
    n = pair_counts(a, b)
    return best_match(n, "a", "b").join(best_match(n, "b", "a").select("b", "a"), ["a", "b"])


def owner_map(counts: DataFrame, truth_ids: DataFrame) -> DataFrame:
    """(a, b): best truth for each owner, the least id of equals; an owner that is a truth id but overlaps none maps to itself."""
    best = counts.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b"))
    same = truth_ids.select(F.col("cell").alias("a"), F.col("cell").alias("same"))
    return best.join(same, "a", "full_outer").select("a", F.coalesce("b", "same").alias("b"))


def outcome(before: Column, after: Column, truth: Column) -> Column:
    """What a change of owner means against the truth."""
    was, now = before.eqNullSafe(truth), after.eqNullSafe(truth)
    return F.when(truth.isNull(), "no_gt").when(was & ~now, "damaged").when(~was & now, "corrected").when(was & now, "unchanged_correct").when(before.eqNullSafe(after), "unresolved").otherwise("wrong_to_wrong")


def category(pred: Column, truth: Column, scored: Column) -> Column:
    """Overlap category of one bin."""
    return F.when(~scored, "unscored").when(pred.isNull() & truth.isNull(), "background").when(pred.isNull(), "gt_only").when(truth.isNull(), "pred_only").when(pred == truth, "correct_owner").otherwise("wrong_owner")


def reconcile(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One owner for each barcode from (barcode, cell, patch, score, nuclear), and the barcodes that had several.

    Nuclear owners first, then the greatest score, then the least patch and cell; the
    result does not depend on the order of rows.
    """
    order = F.struct((~F.col("nuclear")).alias("x"), (-F.col("score")).alias("s"), F.col("patch").alias("p"), F.col("cell").alias("c"))
    merged = candidates.groupBy("barcode").agg(F.min_by(F.struct("cell", "patch", "score", "nuclear"), order).alias("r"), F.count_distinct("cell").alias("owners"), F.count("*").alias("claims"))
    best = merged.select("barcode", "r.*")
    conflicts = merged.filter("owners > 1").select("barcode", F.col("r.cell").alias("winner"), "owners", "claims")
    return best, conflicts


def best_patch(cells: DataFrame) -> DataFrame:
    """For each cell the snapshot of the patch with the greatest score, then the least patch, even if it is empty."""
    return cells.groupBy("cell").agg(F.min_by(F.struct("patch", "score"), F.struct((-F.col("score")).alias("s"), F.col("patch").alias("p"))).alias("r")).select("cell", "r.*")
