"""Background outside the modelled cells: virtual sources spread over the allowed bins of each tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .contracts import ContractError, assert_non_null, assert_unique
from .lineage import cut


def sources(bins: DataFrame, cells: DataFrame, rate: float, seed: int, area: float = 64.0, tile: float = 128.0, reach: float = 72.0, width: float = 24.0) -> DataFrame:
    """(tx, ty, source, x, y, type, budget, supported): the virtual sources of each tile of allowed bins (bin, x, y).

    A tile of n bins of 4 square units has ceil(4 n / area) sources, the bins of
    least hash.  A source draws its type from the cells (cell, type, x, y) within
    the reach, weighted by a Gaussian of the distance; without one it takes the
    nearest cell's and is not supported.  Its budget is Poisson with mean
    rate * n / sources.  All draws are hashes of the seed and the bin.
    """
    if not (rate >= 0 and area > 0 and tile > 0):
        raise ValueError("rate, area and tile are out of range")
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("source")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    b = bins.select(F.col("bin").alias("source"), "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    n = b.groupBy("tx", "ty").agg(F.count("*").alias("_n")).withColumn("_k", F.ceil(F.col("_n") * 4 / area))
    chosen = b.join(n, ["tx", "ty"]).withColumn("_r", F.row_number().over(Window.partitionBy("tx", "ty").orderBy(draw("centre"), "source"))).filter("_r <= _k")
    chosen = chosen.withColumn("_mean", rate * F.col("_n") / F.col("_k")).select("tx", "ty", "source", "x", "y", "_mean")
    centers = cells.select("type", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("cell").alias("_cell"))
    # Cells of one type at one place count as often as they are there.
    near = spatial.radius_join(chosen, centers.groupBy("type", "cx", "cy").agg(F.count("*").alias("_m")), reach)
    weight = F.col("_m") * F.exp(-(F.col("d") * F.col("d")) / (2 * width * width))
    by_type = near.groupBy("source", "type").agg(F.sum(weight).alias("w"))
    types = by_type.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("type", "w"))).alias("ts"))
    far = chosen.join(types.select("source"), "source", "left_anti")
    fallback = spatial.nearest(far.select("source", "x", "y"), centers, ["source"], reach, [F.col("_cell")]).select("source", F.col("type").alias("_far"))
    total = F.aggregate("ts", F.lit(0.0), lambda s, t: s + t["w"])
    # The first type whose running weight passes the draw.
    picked = F.aggregate("ts", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(cells.schema["type"].dataType).alias("t")), lambda a, t: F.struct((a["s"] + t["w"]).alias("s"), F.coalesce(a["t"], F.when(a["s"] + t["w"] >= draw("type") * total, t["type"])).alias("t")), lambda a: a["t"])
    out = chosen.join(types, "source", "left").join(fallback, "source", "left")
    return out.select("tx", "ty", "source", "x", "y", F.coalesce(picked, "_far").alias("type"), _poisson(F.col("_mean"), draw("budget")).alias("budget"), F.col("ts").isNotNull().alias("supported"))


def _poisson(mean, u):
    """Poisson by inversion of the draw u, from twelve deviations below the mean (0 for small means) to twelve above it.

    The first chance is taken by its logarithm, with Stirling's series for the
    factorial, so that large means do not underflow.
    """
    low = F.when(mean < 500, F.lit(0.0)).otherwise(F.floor(mean - 12 * F.sqrt(mean)).cast("double"))
    most = F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("long")
    factorial = low * F.ln(low) - low + F.ln(2 * math.pi * low) / 2 + 1 / (12 * low) - 1 / (360 * low * low * low)
    first = F.exp(F.when(low > 0, low * F.ln(mean) - mean - factorial).otherwise(-mean))
    start = F.struct(first.alias("p"), first.alias("c"), low.cast("long").alias("k"), F.lit(False).alias("done"))

    def step(a, i):
        stop = a["done"] | (u <= a["c"])
        p = F.when(stop, a["p"]).otherwise(a["p"] * mean / i)
        return F.struct(p.alias("p"), F.when(stop, a["c"]).otherwise(a["c"] + p).alias("c"), F.when(stop, a["k"]).otherwise(a["k"] + 1).alias("k"), stop.alias("done"))

    return F.when(mean <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(low.cast("long") + 1, most), start, step, lambda a: a["k"]))


def spread(bins: DataFrame, found: DataFrame, profiles: DataFrame, seed: int, sigma: float = 8.0, tile: float = 128.0) -> DataFrame:
    """(bin, gene, n): the budgets of the sources dealt over the bins within three sigma in their tile, and over the genes of their type's profile.

    profiles: (type, gene, c).  A tile is one group of a bounded number of bins;
    every budget is dealt whole.  A type without a profile raises.
    """
    found = cut(found)  # read by the check and by the deal
    genes = profiles.filter("c > 0").groupBy("type").agg(F.array_sort(F.collect_list(F.struct("gene", "c"))).alias("gs"))
    lost = found.join(genes, "type", "left_anti").limit(1).collect()
    if lost:
        raise ContractError(f"no profile for background type {lost[0]['type']}")
    tiled = bins.select(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), "bin", F.col("x").alias("hx"), F.col("y").alias("hy"))
    given = found.join(genes, "type").select("tx", "ty", "source", F.col("x").alias("sx"), F.col("y").alias("sy"), "budget", F.transform("gs", lambda g: g["gene"]).alias("genes"), F.transform("gs", lambda g: g["c"].cast("double")).alias("cs"))

    def run(key: tuple, here: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values("bin")
        xy, ids, where, what = here[["hx", "hy"]].to_numpy(), here["bin"].to_numpy(), [], []
        for r in own.sort_values("source").itertuples():
            rng = np.random.default_rng([seed, int(r.source) & 0xFFFFFFFF])
            d2 = ((xy - (r.sx, r.sy)) ** 2).sum(axis=1)
            local = np.flatnonzero(d2 <= 9 * sigma * sigma)
            w, c = np.exp(-d2[local] / (2 * sigma * sigma)), np.asarray(r.cs)
            where.append(ids[rng.choice(local, r.budget, p=w / w.sum())])
            what.append(np.asarray(r.genes)[rng.choice(len(c), r.budget, p=c / c.sum())])
        none = np.zeros(0, dtype=np.int64)
        out = pd.DataFrame({"bin": np.concatenate([none, *where]), "gene": np.concatenate([none, *what])})
        return out.groupby(["bin", "gene"], sort=False).size().rename("n").reset_index()

    # Few bytes are much work here, so tiles are dealt to a stated number of tasks and not packed by size.
    tasks = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled, given = (df.repartition(tasks, "tx", "ty") for df in (tiled, given))
    return tiled.groupBy("tx", "ty").cogroup(given.groupBy("tx", "ty")).applyInPandas(run, "bin long, gene long, n long")


def retention(pseudo_total: int, real_total: int, real_fraction: float) -> float:
    """Share of the pseudo counts to keep so that real counts are ``real_fraction`` of the mixture's total ``real_total``."""
    if pseudo_total <= 0 or real_total <= 0 or not 0 <= real_fraction <= 1:
        raise ValueError("totals must be positive and the fraction in 0..1")
    share = (1 - real_fraction) * real_total / pseudo_total
    if share > 1 + 1e-12:
        raise ValueError("the mixture needs more pseudo counts than there are")
    return min(max(share, 0.0), 1.0)


def shape_weight(expression_weight: float, shape_lambda: float, expression_iqr: float, shape_iqr: float) -> float:
    """Weight of a shape term that brings its spread to a share of the expression term's."""
    values = (expression_weight, shape_lambda, expression_iqr, shape_iqr)
    if not all(map(math.isfinite, values)) or expression_weight <= 0 or shape_lambda < 0 or expression_iqr <= 0 or shape_iqr <= 0:
        raise ValueError("calibration values are out of range")
    return expression_weight * shape_lambda * expression_iqr / shape_iqr


def micron_coordinates(cells: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(cell_id, cell_type, x_um, y_um): recorded microns, or pixels scaled by the areas recorded in both units, whose ratio must be one number."""
    if {"x_um", "y_um"} <= set(cells.columns):
        return cells.select("cell_id", "cell_type", "x_um", "y_um")
    ratio = F.col("area_um2").cast("double") / F.col("area_px")
    seen = cells.agg(F.min(ratio).alias("lo"), F.max(ratio).alias("hi"), F.count_if(ratio.isNull() | F.isnan(ratio) | (ratio <= 0)).alias("bad")).first()
    if seen["lo"] is None:
        return cells.select("cell_id", "cell_type", F.lit(0.0).alias("x_um"), F.lit(0.0).alias("y_um"))
    if seen["bad"] or seen["hi"] - seen["lo"] > tolerance * abs(seen["lo"]):
        raise ContractError("areas in pixels and in microns do not agree")
    scale = math.sqrt(seen["lo"])
    return cells.select("cell_id", "cell_type", (F.col("x_px") * scale).alias("x_um"), (F.col("y_px") * scale).alias("y_um"))


def eligible_sources(metadata: DataFrame, generator: set, reference: set) -> DataFrame:
    """Rows (cell, type, donor) of generator donors.  The donor sets are not empty, share none, and all are there; cells are unique."""
    if not generator or not reference or generator & reference:
        raise ValueError("generator and reference donors must be sets that are not empty and share no donor")
    assert_unique(assert_non_null(metadata, ["cell", "type", "donor"], "sources"), ["cell"], "sources")
    wanted = generator | reference
    there = {r[0] for r in metadata.select("donor").distinct().filter(F.col("donor").isin(*wanted)).collect()}
    if wanted - there:
        raise ContractError(f"no rows of donors {sorted(wanted - there)}")
    return metadata.filter(F.col("donor").isin(*generator))
