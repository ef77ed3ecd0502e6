"""Reference profiles, likelihoods and per-cell profiles over sparse counts.

Counts stay long (bin, gene, n).  Tables of types and genes are small next to
the counts; they are joined on the gene and Catalyst broadcasts them when their
measured size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def reference_counts(counts: DataFrame, types: DataFrame) -> DataFrame:
    """(k, gene, c) from counts (bin, gene, n) and types (bin, k)."""
    return counts.join(types, "bin").groupBy("k", "gene").agg(F.sum("n").alias("c"))


def theta(reference: DataFrame, eps: float = EPS) -> DataFrame:
    """(k, gene, theta): smoothed shares; genes without counts are part of the denominator."""
    kinds, genes = reference.select("k").distinct(), reference.select("gene").distinct()
    full = kinds.crossJoin(genes).join(reference, ["k", "gene"], "left")
    c = F.coalesce("c", F.lit(0)) + F.lit(eps)
    return full.select("k", "gene", (c / F.sum(c).over(Window.partitionBy("k"))).alias("theta"))


def log_likelihood(counts: DataFrame, theta_table: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """(bin, k, ll): (1 / N) sum_g n ln theta; a bin of ``bins`` without counts has 0 for each type."""
    ll = counts.join(theta_table, "gene").groupBy("bin", "k").agg((F.sum(F.col("n") * F.ln("theta")) / F.sum("n")).alias("ll"))
    if bins is None:
        return ll
    grid = bins.select("bin").crossJoin(theta_table.select("k").distinct())
    return grid.join(ll, ["bin", "k"], "left").select("bin", "k", F.coalesce("ll", F.lit(0.0)).alias("ll"))


def with_softmax(ll: DataFrame) -> DataFrame:
    """ll with q, the softmax over the types of a bin: an aggregate of e^(ll - max), then a join-free window on the bin."""
    w = Window.partitionBy("bin")
    e = ll.withColumn("_e", F.exp(F.col("ll") - F.max("ll").over(w)))
    return e.withColumn("q", F.col("_e") / F.sum("_e").over(w)).drop("_e")


#: Types that are columns of one aggregate; with more the long form is the better plan.
WIDE_TYPES = 64


def likelihood_softmax(counts: DataFrame, theta_table: DataFrame) -> DataFrame:
    """(bin, k, ll, q) as ``with_softmax(log_likelihood(..))``, of counts (bin, gene, n) whose rows may repeat.

    The sum over genes is linear, so with few types a bin is one row with a sum for each of them: one exchange, combined
    before it, and a softmax without a window.  theta_table is read twice; hand over one that is kept.
    """
    kinds = sorted(r[0] for r in theta_table.filter("k is not null").select("k").distinct().limit(WIDE_TYPES + 1).collect())
    if not 1 < len(kinds) <= WIDE_TYPES:
        return with_softmax(log_likelihood(counts.groupBy("bin", "gene").agg(F.sum("n").alias("n")), theta_table))
    logs = theta_table.groupBy("gene").agg(*[F.max(F.when(F.col("k") == k, F.ln("theta"))).alias(f"_l{i}") for i, k in enumerate(kinds)])
    sums = counts.join(logs, "gene").groupBy("bin").agg(F.sum("n").alias("_n"), *[F.sum(F.col("n") * F.col(f"_l{i}")).alias(f"_s{i}") for i in range(len(kinds))])
    lls = sums.select("bin", *[(F.col(f"_s{i}") / F.col("_n")).alias(f"_s{i}") for i in range(len(kinds))])
    most = F.greatest(*[F.col(f"_s{i}") for i in range(len(kinds))])
    powers = lls.select("*", *[F.exp(F.col(f"_s{i}") - most).alias(f"_e{i}") for i in range(len(kinds))])
    total = sum((F.col(f"_e{i}") for i in range(len(kinds))), F.lit(0.0))
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"_s{i}").alias("ll"), (F.col(f"_e{i}") / total).alias("q")) for i, k in enumerate(kinds)]
    return powers.select("bin", F.inline(F.array(*rows)))


def cell_profile(membership: DataFrame, counts: DataFrame, strength: float) -> tuple[DataFrame, DataFrame]:
    """((cell, gene, n), (cell, total, prior, reliability)) of cells that own bins with a weight.

    prior = strength * median positive total, 1.0 when no total is positive.
    """
    profile = membership.join(counts, "bin").groupBy("cell", "gene").agg(F.sum(F.col("n") * F.col("weight")).alias("n"))
    totals = profile.groupBy("cell").agg(F.sum("n").alias("total"))
    prior = totals.filter("total > 0").agg(F.coalesce(F.percentile("total", F.lit(0.5)) * strength, F.lit(1.0)).alias("prior"))
    return profile, totals.crossJoin(F.broadcast(prior)).withColumn("reliability", F.col("total") / (F.col("total") + F.col("prior")))


def leave_one_out(profile: DataFrame, own: DataFrame, keys: Sequence[str] = ("bin",), tolerance: float = 1e-8) -> DataFrame:
    """Profile counts of a cell without those of one fold: own (cell, fold keys, gene, n).

    (cell, fold keys, gene, n) for the genes of the fold; a negative beyond the tolerance raises.
    """
    joined = own.withColumnRenamed("n", "_own").join(profile, ["cell", "gene"])
    left = F.col("n") - F.col("_own")
    checked = F.when(left < -tolerance, F.raise_error(F.lit("held-out counts are over the profile"))).otherwise(F.greatest(left, F.lit(0.0)))
    return joined.select("cell", *keys, "gene", F.col("_own").alias("own"), checked.alias("n"))


def log_rising(a, x):
    """ln of a (a + 1) ... (a + x - 1) for columns a (double) and x (integer), as a finite sum."""
    return F.when(x > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), x.cast("long") - 1), F.lit(0.0), lambda s, i: s + F.ln(a + i))).otherwise(F.lit(0.0))


def richness(counts: DataFrame, top: int = 10) -> DataFrame:
    """(bin, total, genes, top1, top_share, simpson, entropy) of each bin's counts."""
    w = Window.partitionBy("bin")
    p = counts.filter("n > 0").withColumn("_t", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "gene")))
    share = F.col("n") / F.col("_t")
    return p.groupBy("bin").agg(
        F.max("_t").alias("total"),
        F.count("*").alias("genes"),
        F.max(share).alias("top1"),
        F.sum(F.when(F.col("_r") <= top, share).otherwise(0.0)).alias("top_share"),
        (1 - F.sum(share * share)).alias("simpson"),
        (-F.sum(share * F.ln(share))).alias("entropy"),
    )


def expected_richness(counts: DataFrame, draw: int) -> DataFrame:
    """(bin, expected): genes expected in a draw of ``draw`` counts without replacement; 0 for none."""
    total = counts.groupBy("bin").agg(F.sum("n").alias("_t"))

    def log_choose_ratio(t, n):
        # C(t - n, m) / C(t, m) as a product over the m draws.
        steps = F.sequence(F.lit(0), F.lit(draw - 1))
        return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln((t - n - i) / (t - i)))

    t, n = F.col("_t"), F.col("n")
    m = draw
    none = F.when(t - n < m, F.lit(0.0)).otherwise(F.exp(log_choose_ratio(t.cast("double"), n.cast("double"))))
    if m <= 0:
        return total.select("bin", F.lit(0.0).alias("expected"))
    return counts.join(total, "bin").filter(t >= m).groupBy("bin").agg(F.sum(1 - none).alias("expected"))
