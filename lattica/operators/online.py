"""Scores of the online assignment: exact changes of a cell's objective, stopping, planning, state features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from . import spatial


@dataclass(frozen=True)
class Weights:
    gain: float = 1.0
    support: float = 0.1
    old: float = 0.5
    shape: float = 0.0


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def softmax(a: Column) -> Column:
    share = lambda e: once(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda all_: F.transform(e, lambda x: x / all_))
    return once(a, lambda v: once(F.array_max(v), lambda top: once(F.transform(v, lambda x: F.exp(x - top)), share)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def old_compatibility(posterior: Column, ll: Column, conf: Column) -> Column:
    """conf times the likelihoods of the types, weighted with the cell's posterior."""
    return dot(posterior, ll) * conf


def type_arrays(ll: DataFrame) -> DataFrame:
    """(bin, lls): likelihoods (bin, k, ll) as an array in the order of the types."""
    return ll.groupBy("bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ll"))), lambda s: s["ll"]).alias("lls"))


def cell_states(members: DataFrame, ll: DataFrame | None = None) -> DataFrame:
    """(cell, scores, weighted, expr): of the bins (bin, cell, conf, lls) of each cell the sums of lls and of conf lls by type, and of conf.

    lls may come as likelihoods (bin, k, ll) instead.
    """
    if ll is not None:
        members = members.join(type_arrays(ll), "bin")
    by_type = members.select("cell", "conf", F.posexplode("lls").alias("k", "ll")).groupBy("cell", "k").agg(F.sum("ll").alias("s"), F.sum(F.col("ll") * F.col("conf")).alias("w"), F.sum("conf").alias("c"))
    arrays = by_type.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "s", "w"))).alias("a"), F.max("c").alias("expr"))
    return arrays.select("cell", F.transform("a", lambda x: x["s"]).alias("scores"), F.transform("a", lambda x: x["w"]).alias("weighted"), "expr")


def global_delta(w: Weights, remove: bool = False) -> Column:
    """Change of a cell's objective when a bin is added (or removed).

    Columns: lls, conf, penalty, support, shape of the bin; scores, weighted, expr
    of the cell.  Support counts twice, once for the bin and once for its neighbours.
    """
    sign = -1.0 if remove else 1.0
    lls, conf, expr, weighted = F.col("lls"), F.col("conf"), F.col("expr"), F.col("weighted")
    mass = F.greatest(expr - conf, F.lit(0.0)) if remove else expr + conf
    change = lambda then, now: w.gain * (F.array_max(then) * mass - F.array_max(now) * expr) + w.old * (dot(then, F.zip_with(weighted, lls, lambda a, x: a + sign * x * conf)) - dot(now, weighted))
    moved = once(softmax(F.zip_with("scores", lls, lambda s, x: s + sign * x)), lambda then: once(softmax(F.col("scores")), lambda now: change(then, now)))
    return moved - sign * F.col("penalty") + sign * w.support * 2 * F.col("support") + w.shape * F.col("shape")


def stop_delta(rewards: DataFrame, cells: DataFrame | None = None, stat: str = "max", k: int = 3) -> DataFrame:
    """(cell, delta): the best of the eligible rewards (cell, reward) left, or the mean of the k best; 0 for a cell without any.

    A null reward names its cell alone, so one table without ``cells`` can hold all of them.
    """
    if stat not in ("max", "topk_mean"):
        raise ValueError(f"unknown statistic {stat}")
    n = 1 if stat == "max" else max(1, k)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc_nulls_last("reward")))
    top = rewards.select("cell", "reward").withColumn("_r", rank).filter(F.col("_r") <= n).groupBy("cell").agg(F.avg("reward").alias("delta"))
    if cells is not None:
        top = cells.select("cell").distinct().join(top, "cell", "left")
    return top.select("cell", F.coalesce("delta", F.lit(0.0)).alias("delta"))


def stop_reward(delta: Column, rate: float) -> Column:
    """Stopping costs what is left."""
    return -rate * delta


def frontier_quality(top_mean: Column, has_frontier: Column, tau: float, temperature: float) -> Column:
    return F.when(has_frontier, maths.sigmoid((top_mean - tau) / max(temperature, 1e-8))).otherwise(F.lit(0.0))


def stop_score(stopped: Column, quality: Column, risk: Column) -> Column:
    q, r = F.least(F.greatest(quality, F.lit(0.0)), F.lit(1.0)), F.greatest(risk, F.lit(0.0))
    return F.when(stopped, 1 - 2 * q + r).otherwise(q - r)


@dataclass(frozen=True)
class Planner:
    growth: float = 1.0
    compact: float = 0.5
    explore: float = 0.5
    overgrowth: float = 0.5
    streak: float = 0.1
    shape: float = 0.2


def node_score(mode: Column, s: dict[str, Column], p: Planner) -> Column:
    """Score of a planner's node by its mode: stop, compact, explore, else neutral.

    s: quality, risk, compactness, support, best, drift, streak and shape (-1..1).
    """
    good, bad = F.greatest(s["shape"], F.lit(0.0)), F.greatest(-s["shape"], F.lit(0.0))
    stop = stop_score(F.lit(True), s["quality"], s["risk"]) + p.shape * bad
    compact = p.compact * s["compactness"] + s["support"] + p.shape * good * (0.5 + s["support"]) - p.overgrowth * s["risk"] - p.streak * s["streak"]
    explore = p.explore * s["quality"] + s["best"] + 0.5 * p.shape * good - s["drift"] - p.shape * bad - p.shape * s["risk"] - 0.5 * p.overgrowth * s["risk"]
    neutral = s["quality"] + 0.5 * s["compactness"] - 0.5 * s["risk"] + 0.5 * p.shape * s["shape"]
    by_mode = F.when(mode == "stop", stop).when(mode == "compact", compact).when(mode == "explore", explore).otherwise(neutral)
    return p.growth * (s["quality"] - s["risk"]) + by_mode


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _signed(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def action_features(bins: DataFrame, reach: float) -> DataFrame:
    """bins (cell, bin, row, col, x, y, member, ..) with support, frontier and, for frontier bins (0 elsewhere), what adding them means.

    support: share of the eight neighbours that are members; frontier: not a
    member, with support.  distance, dx and dy are from the members' centroid, in
    units of the reach and clipped; compactness_gain is the change of the
    members' mean support; alignment is the cosine with the drift of the centroid
    from the nucleus (cx, cy).
    """
    near = spatial.neighbours(bins, spatial.EIGHT, ["cell", "bin"], ["cell", "member"]).filter("cell = n_cell and n_member")
    touched = near.groupBy("cell", "bin").agg((F.count("*") / 8.0).alias("support"))
    b = bins.join(touched, ["cell", "bin"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    b = b.withColumn("frontier", ~F.col("member") & (F.col("support") > 0))
    own = b.filter("member").groupBy("cell").agg(F.count("*").alias("_m"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sum("support").alias("_s"))
    b = b.join(own, "cell", "left")
    dx, dy = F.col("x") - F.coalesce("mx", "cx"), F.col("y") - F.coalesce("my", "cy")
    vx, vy = F.coalesce("mx", "cx") - F.col("cx"), F.coalesce("my", "cy") - F.col("cy")
    size, drift = F.sqrt(dx * dx + dy * dy), F.sqrt(vx * vx + vy * vy)
    only = lambda c: F.when(F.col("frontier"), c).otherwise(F.lit(0.0))
    gain = (F.col("_s") + 2 * F.col("support")) / (F.col("_m") + 1) - F.col("_s") / F.col("_m")
    return b.withColumns(
        {
            "distance": only(_unit(size / reach)),
            "compactness_gain": only(F.coalesce(gain, F.lit(0.0))),
            "dx": only(_signed(dx / reach)),
            "dy": only(_signed(dy / reach)),
            "alignment": F.when(F.col("frontier") & (size > 1e-8) & (drift > 1e-8), _signed((dx * vx + dy * vy) / (size * drift))).otherwise(F.lit(0.0)),
        }
    ).drop("_m", "_s")


def state_features(bins: DataFrame, reach: float, k: int = 3, cap: float = 8.0) -> DataFrame:
    """One row for each cell of ``action_features`` (with seed, reward, ll_mean and ll_max): shares, growth, drift, compactness, frontier rewards."""
    w = Window.partitionBy("cell", "frontier").orderBy(F.desc("reward"), "bin")
    b = bins.withColumn("_r", F.row_number().over(w))
    mean_of = lambda c, when: F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    m, f, reward = F.col("member"), F.col("frontier"), F.col("reward")
    g = b.groupBy("cell").agg(
        F.avg(m.cast("double")).alias("assigned_frac"),
        maths.scaled_feature(F.count_if(m) / F.greatest(F.lit(1), F.count_if(F.col("seed"))), cap).alias("grow_ratio"),
        mean_of(F.col("support"), m).alias("compactness"),
        mean_of(F.col("ll_mean"), m).alias("assigned_ll_mean"),
        mean_of(F.col("ll_max"), m).alias("assigned_ll_max"),
        mean_of((reward > 0).cast("double"), f).alias("positive_frontier"),
        mean_of(reward, f).alias("frontier_mean"),
        F.coalesce(F.stddev_pop(F.when(f, reward)), F.lit(0.0)).alias("frontier_std"),
        F.coalesce(F.max(F.when(f, reward)), F.lit(0.0)).alias("frontier_max"),
        mean_of(reward, f & (F.col("_r") <= k)).alias("frontier_top"),
        F.max(F.sqrt((F.col("mx") - F.col("cx")) * (F.col("mx") - F.col("cx")) + (F.col("my") - F.col("cy")) * (F.col("my") - F.col("cy")))).alias("_d"),
    )
    return g.select("cell", "assigned_frac", (1 - F.col("assigned_frac")).alias("remaining_frac"), "grow_ratio", _unit(F.coalesce("_d", F.lit(0.0)) / reach).alias("drift"), *g.columns[3:-1])
