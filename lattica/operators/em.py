"""Expectation and maximisation over candidate pairs, as plain DataFrame steps.

A problem is three tables: pairs (bin, cell, d), bins (bin, conf, locked) and
scores by type.  One round is grouped sums and joins on bin or cell; the loop
cuts its lineage with a checkpoint, which outlives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from .lineage import cut


@dataclass(frozen=True)
class Settings:
    d_max: float = 40.0
    alpha: float = 1.0
    beta: float = 1.5
    kappa: float = 2.0
    damping: float = 0.5
    background_a: float | None = None  # gate off when None
    background_w: float = 0.0


def spatial_prior(pairs: DataFrame, d_max: float) -> DataFrame:
    """pairs with pi: softmax of -(d / d_max)^2 over the candidates of a bin."""
    w = Window.partitionBy("bin")
    logit = maths.spatial_logit(F.col("d"), d_max)
    e = pairs.withColumn("_e", F.exp(logit - F.max(logit).over(w)))
    return e.withColumn("pi", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def initial(prior: DataFrame) -> DataFrame:
    """Responsibilities at the start: the prior, with locked bins given to their owner."""
    return lock(prior.withColumn("r", F.col("pi")))


def lock(pairs: DataFrame, value: str = "r") -> DataFrame:
    """One-hot rows of locked bins: their owner has all, the others none."""
    return pairs.withColumn(value, F.when(F.col("owner").isNull(), F.col(value)).when(F.col("cell") == F.col("owner"), 1.0).otherwise(0.0))


def type_posterior(pairs: DataFrame, ll: DataFrame, kinds: DataFrame) -> DataFrame:
    """(cell, k, q): softmax over types of ln prior + sum r conf ll."""
    s = pairs.filter("r > 0").join(ll, "bin").groupBy("cell", "k").agg(F.sum(F.col("r") * F.col("conf") * F.col("ll")).alias("s"))
    grid = pairs.select("cell").distinct().crossJoin(F.broadcast(kinds))
    w = Window.partitionBy("cell")
    logit = grid.join(s, ["cell", "k"], "left").withColumn("l", F.col("log_prior") + F.coalesce("s", F.lit(0.0)))
    e = logit.withColumn("_e", F.exp(F.col("l") - F.max("l").over(w)))
    return e.select("cell", "k", (F.col("_e") / F.sum("_e").over(w)).alias("q"))


def compatibility(pairs: DataFrame, ll: DataFrame, q: DataFrame) -> DataFrame:
    """pairs with L = sum_k q[cell, k] ll[bin, k]."""
    c = pairs.select("bin", "cell").join(ll, "bin").join(q, ["cell", "k"]).groupBy("bin", "cell").agg(F.sum(F.col("q") * F.col("ll")).alias("L"))
    return pairs.join(c, ["bin", "cell"], "left").withColumn("L", F.coalesce("L", F.lit(0.0)))


def e_step(pairs: DataFrame, s: Settings) -> DataFrame:
    """pairs (with pi, conf, L, owner, r) with the next r: softmax of the score, damped, renormalised, locked."""
    w = Window.partitionBy("bin")
    score = maths.score(s.alpha, F.col("pi"), s.beta, F.col("conf"), F.col("L"))
    e = pairs.withColumn("_s", score).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    new = F.col("_e") / F.sum("_e").over(w)
    if s.background_a is not None:
        e = e.withColumn("background", maths.background_gate(F.col("conf"), s.background_a, s.background_w, F.col("owner").isNotNull()))
        new = new * (1 - F.col("background"))
    mixed = e.withColumn("_n", new).withColumn("_m", s.damping * F.col("r") + (1 - s.damping) * F.col("_n"))
    owned = 1 - F.col("background") if s.background_a is not None else F.lit(1.0)
    out = mixed.withColumn("r", F.col("_m") * owned / F.sum("_m").over(w))
    return lock(out.drop("_s", "_e", "_n", "_m"))


def round_of(pairs: DataFrame, ll: DataFrame, kinds: DataFrame, s: Settings) -> DataFrame:
    """One round: M step on types, compatibility, E step."""
    q = type_posterior(pairs, ll, kinds)
    return e_step(compatibility(pairs.drop("L", "background"), ll, q), s)


def run(pairs: DataFrame, ll: DataFrame, kinds: DataFrame, s: Settings, rounds: int, tolerance: float = 0.0) -> tuple[DataFrame, int]:
    """Rounds until the largest change is at most the tolerance, or the limit; (pairs, rounds done)."""
    now = cut(initial(spatial_prior(pairs, s.d_max)))
    for i in range(rounds):
        after = cut(round_of(now, ll, kinds, s))
        moved = after.select("bin", "cell", F.col("r").alias("r1")).join(now.select("bin", "cell", "r"), ["bin", "cell"]).agg(F.max(F.abs(F.col("r1") - F.col("r")))).first()[0]
        now = after
        if moved is None or moved <= tolerance:
            return now, i + 1
    return now, rounds


def top_two(pairs: DataFrame) -> DataFrame:
    """(bin, owner, top, second, margin): candidates by r descending, then cell; a single candidate has second 0."""
    ranked = pairs.groupBy("bin").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("n"), F.col("cell")))), 1, 2).alias("t"))
    top, second = -F.col("t")[0]["n"], F.coalesce(-F.get("t", 1)["n"], F.lit(0.0))
    return ranked.select("bin", F.col("t")[0]["cell"].alias("owner"), top.alias("top"), second.alias("second"), (top - second).alias("margin"))


def entropy(pairs: DataFrame) -> DataFrame:
    """(bin, n, entropy): -sum r ln r / ln n, 0 for one candidate, in 0..1."""
    h = F.sum(F.when(F.col("r") > 0, -F.col("r") * F.ln("r")).otherwise(0.0))
    n = F.count("*")
    return pairs.groupBy("bin").agg(n.alias("n"), F.when(n > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), h / F.ln(n)))).otherwise(0.0).alias("entropy"))


def reliability_bins(value, width: int):
    """Equal bins of 0..1, the last one closed."""
    return F.least(F.floor(value * width), F.lit(width - 1)).cast("int")
