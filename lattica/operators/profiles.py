"""EM with a profile for each cell: the M step on profiles, their likelihood, and the mix with types.

Profiles are long (cell, gene, p).  The mixture of reference profiles by type
posterior is a prior of ``Profiles.prior`` counts; counts of owned bins, weighted
with responsibilities, are added to it.  A cell's reliability says how much its
own profile counts beside its type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from . import em
from .contracts import ContractError
from .lineage import cut


@dataclass(frozen=True)
class Profiles:
    prior: float = 50.0
    epsilon: float = 1e-6
    #: Share of the new profile in an update: 0 keeps the old one, 1 takes the new one, both exactly.
    rate: float = 0.5

    def __post_init__(self) -> None:
        if not (self.prior > 0 and self.epsilon > 0 and 0 <= self.rate <= 1):
            raise ValueError("prior and epsilon must be positive, rate in 0..1")


def mixture(q: DataFrame, theta: DataFrame) -> DataFrame:
    """(cell, gene, m): sum over types of q theta."""
    return q.join(theta, "k").groupBy("cell", "gene").agg(F.sum(F.col("q") * F.col("theta")).alias("m"))


def _normalised(rows: DataFrame, value, epsilon: float) -> DataFrame:
    return rows.select("cell", "gene", ((value + epsilon) / F.sum(value + epsilon).over(Window.partitionBy("cell"))).alias("p"))


def reference_only(mix: DataFrame, s: Profiles) -> DataFrame:
    """(cell, gene, p): the prior alone."""
    return _normalised(mix, s.prior * F.col("m"), s.epsilon)


def updated(pairs: DataFrame, counts: DataFrame, mix: DataFrame, s: Profiles) -> DataFrame:
    """(cell, gene, p): counts weighted with responsibilities, and the prior."""
    x = pairs.filter("r > 0").join(counts, "bin").groupBy("cell", "gene").agg(F.sum(F.col("r") * F.col("n")).alias("x"))
    return _normalised(mix.join(x, ["cell", "gene"], "left"), F.coalesce("x", F.lit(0.0)) + s.prior * F.col("m"), s.epsilon)


def damped(old: DataFrame, new: DataFrame, rate: float) -> DataFrame:
    """(cell, gene, p): the share ``rate`` of the new profile; the end points are exact."""
    both = old.join(new.withColumnRenamed("p", "_n"), ["cell", "gene"])
    return both.select("cell", "gene", maths.damp(F.col("p"), F.col("_n"), 1 - rate).alias("p"))


def compatibility(pairs: DataFrame, counts: DataFrame, profile: DataFrame, epsilon: float) -> DataFrame:
    """(bin, cell, L_cell): mean log chance of the bin's counts under the cell's profile; a bin without counts is absent."""
    mean = F.sum(F.col("n") * F.ln(F.greatest("p", F.lit(epsilon)))) / F.sum("n")
    return pairs.select("bin", "cell").join(counts.filter("n > 0"), "bin").join(profile, ["cell", "gene"]).groupBy("bin", "cell").agg(mean.alias("L_cell"))


def reliability(pairs: DataFrame, counts: DataFrame, strength: float) -> DataFrame:
    """(cell, reliability): locked counts N of a cell as N / (N + strength)."""
    own = pairs.filter("cell = owner").select("bin", "cell").join(counts, "bin").groupBy("cell").agg(F.sum("n").alias("_n"))
    return own.select("cell", (F.col("_n") / (F.col("_n") + F.lit(float(strength)))).alias("reliability"))


def run(pairs: DataFrame, counts: DataFrame, ll: DataFrame, theta: DataFrame, kinds: DataFrame, trust: DataFrame, s: em.Settings, p: Profiles, rounds: int, fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, profile) after so many rounds.  trust: (cell, reliability), 0 for cells that it lacks.

    fixed: (bin, cell, L_cell), a score of the caller's in place of the cells'
    likelihood; it goes with profiles that are not updated (rate 0), and must be
    finite for every pair.
    """
    now = cut(em.initial(em.spatial_prior(pairs, s.d_max)))
    if fixed is not None:
        if p.rate != 0:
            raise ValueError("a fixed score of cells needs profiles that are not updated (rate 0)")
        fixed = cut(fixed.select("bin", "cell", "L_cell"))
        wrong = now.join(fixed, ["bin", "cell"], "left").filter("L_cell is null or isnan(L_cell) or abs(L_cell) = double('inf')").limit(1).collect()
        if wrong:
            raise ContractError(f"the fixed score is not finite for bin {wrong[0]['bin']}, cell {wrong[0]['cell']}")
    profile = None
    for _ in range(rounds):
        q = em.type_posterior(now, ll, kinds)
        mix = cut(mixture(q, theta))
        profile = reference_only(mix, p) if profile is None else profile
        profile = cut(profile if p.rate == 0 else damped(profile, updated(now, counts, mix, p), p.rate))
        own = fixed if fixed is not None else compatibility(now, counts, profile, p.epsilon)
        typed = em.compatibility(now.drop("L", "background"), ll, q).withColumnRenamed("L", "_t")
        both = typed.join(own, ["bin", "cell"], "left").join(trust, "cell", "left")
        w = F.coalesce("reliability", F.lit(0.0))
        both = both.withColumn("L", (1 - w) * F.col("_t") + w * F.coalesce("L_cell", F.lit(0.0))).drop("_t", "L_cell", "reliability")
        now = cut(em.e_step(both, s))
    return now, profile
