"""Seeded count simulation.

Draws are hashes of (seed, keys, number), so they do not depend on partitions,
order or engine, and a lost task repeats them.  Every operator conserves what
it says it conserves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_rank_key, hash_uniform


def _units(df: DataFrame, n: str, out: str = "i") -> DataFrame:
    """One row for each single count."""
    return df.filter(F.col(n) > 0).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))


def thin(counts: DataFrame, keys: Sequence[str], n: str, p: float | Column, seed: int, out: str = "kept") -> DataFrame:
    """Binomial(n, p) for each row, as the number of its unit draws under p; done inside the row, without a shuffle."""
    p = F.lit(p) if isinstance(p, (int, float)) else p
    hits = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n).cast("long") - 1, F.lit(0).cast("long"))), lambda i: hash_uniform(seed, *[F.col(k) for k in keys], i) < p)
    return counts.select(*keys, n, F.when(F.col(n) > 0, F.size(hits)).otherwise(0).cast("long").alias(out))


#: A row of up to this many counts is drawn from in one array.
ARRAY_UNITS = 50_000


def rarefy(counts: DataFrame, row: str, gene: str, n: str, budget: int, seed: int) -> DataFrame:
    """Exactly ``budget`` counts of each row that has them, without replacement: the least unit hashes.

    A row's units are made, hashed and cut to the budget where its genes meet, so
    none is shuffled; rows of very many counts are ranked unit by unit.
    """
    hashed = lambda g, i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string"), g.cast("string"), i.cast("string")), 256)
    rows = counts.filter(F.col(n) > 0).groupBy(row).agg(F.sum(n).alias("_t"), F.collect_list(F.struct(F.col(gene).alias("g"), F.col(n).alias("n"))).alias("_g")).filter(F.col("_t") >= budget)
    units = F.flatten(F.transform("_g", lambda g: F.transform(F.sequence(F.lit(0).cast("long"), g["n"].cast("long") - 1), lambda i: F.struct(hashed(g["g"], i).alias("h"), g["g"].alias("g"), i.alias("i")))))
    drawn = rows.filter(F.col("_t") <= ARRAY_UNITS).select(row, F.explode(F.slice(F.sort_array(units), 1, budget)["g"]).alias(gene))
    large = rows.filter(F.col("_t") > ARRAY_UNITS).select(row, F.explode("_g").alias("_g")).select(row, F.col("_g.g").alias(gene), F.col("_g.n").alias(n))
    ranked = _units(large, n).withColumn("_r", F.row_number().over(Window.partitionBy(row).orderBy(hashed(F.col(gene), F.col("i")), gene, "i"))).filter(F.col("_r") <= budget)
    return drawn.unionByName(ranked.select(row, gene)).groupBy(row, gene).agg(F.count("*").alias(n))


def multinomial(counts: DataFrame, row: str, gene: str, n: str, budget: int, seed: int) -> DataFrame:
    """``budget`` draws for each row with chances in proportion to its counts; totals are the budget."""
    w = Window.partitionBy(row).orderBy(gene)
    s = counts.filter(F.col(n) > 0).select(row, gene, F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), F.sum(n).over(Window.partitionBy(row)).alias("t"))
    table = s.groupBy(row, "t").agg(F.array_sort(F.collect_list(F.struct("hi", gene))).alias("cut"))
    draws = table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    x = F.floor(hash_uniform(seed, F.col(row), F.col("i")) * F.col("t"))
    hit = draws.withColumn("x", x).select(row, F.element_at(F.filter("cut", lambda c: c["hi"] > F.col("x")), 1)[gene].alias(gene))
    return hit.groupBy(row, gene).agg(F.count("*").alias(n))


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """About ``size`` rows: each stratum's quota is max(1, round(size * share)), filled in hash order."""
    c = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    q = c.withColumn("_q", F.greatest(F.lit(1), F.rint(size * F.col("_n") / F.sum("_n").over(Window.partitionBy()).cast("double")).cast("long")))
    w = Window.partitionBy(stratum).orderBy(hash_rank_key(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).join(q.select(stratum, "_q"), stratum).filter("_r <= _q").select(key, stratum)


def exact_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows (or all), the ones with the least hash."""
    return df.orderBy(hash_rank_key(seed, F.col(key)), key).limit(size)


def exclusive(cells: DataFrame, sources: DataFrame, group: str, min_distance: float, seed: int) -> DataFrame:
    """(cell, source) with each source used at most once in ``min_distance`` of another use of it.

    The rule is sequential inside a group (cells by id), independent across
    groups.  A group's cells and sources stream through one Python call; both
    sides are ids and coordinates only.
    """

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("cell"), right.sort_values("_h")
        pool = right["source"].tolist()
        used: dict[int, list[tuple[float, float]]] = {}
        out, turn = [], 0
        for c, x, y in zip(left["cell"], left["x"], left["y"], strict=True):
            for k in range(len(pool)):
                s = pool[(turn + k) % len(pool)]
                if all(math.hypot(x - a, y - b) >= min_distance for a, b in used.get(s, ())):
                    used.setdefault(s, []).append((x, y))
                    out.append((c, s))
                    turn = (turn + k + 1) % len(pool)
                    break
            else:
                raise ValueError(f"no source is left for cell {c} of {key}")
        return pd.DataFrame(out, columns=["cell", "source"])

    right = sources.withColumn("_h", hash_rank_key(seed, F.col("source")))
    return cells.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(assign, "cell long, source long")


def smooth_field(bins: DataFrame, sigma: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, col, field): hash noise on the grid, smoothed by a truncated Gaussian, with mean 1 in each patch."""
    reach = max(1, math.ceil(3 * sigma))
    offsets = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= 9 * sigma * sigma]
    noise = bins.select(*keys, "row", "col", hash_uniform(seed, F.col("row"), F.col("col")).alias("v"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in offsets])
    spread = noise.select(*keys, "v", F.explode(steps).alias("s"), "row", "col").select(*keys, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), (F.col("v") * F.col("s.w")).alias("a"), F.col("s.w").alias("w"))
    smooth = spread.groupBy(*keys, "row", "col").agg((F.sum("a") / F.sum("w")).alias("f")).join(bins.select(*keys, "row", "col"), [*keys, "row", "col"])
    # Means by an aggregate: a window over a patch, or over a grid without keys, would be one task.
    mean = smooth.groupBy(*keys).agg(F.avg("f").alias("m"))
    both = smooth.join(mean, list(keys)) if keys else smooth.crossJoin(F.broadcast(mean))
    return both.withColumn("field", F.col("f") / F.col("m")).drop("f", "m")


#: Least side of a tile of ``_carried``, in places, and units that are drawn at once in it.
TILE, UNITS = 128, 1 << 20


def stream_start(seed: int | str, *key: Column) -> Column:
    """Where the draws of a row start: the first 64 bits of its seeded SHA-256, as a long."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long")


def stream_draw(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Uniform draws in [0, 1): the numbered outputs of SplitMix64 from the start."""
    z = start.view(np.uint64) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _carried(counts: DataFrame, seed: int, p: float, reach: int, offset: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Counts (row, col, gene, n) after each unit moved with chance p by ``offset`` of two draws, at most ``reach`` on either axis.

    Units that would leave the grid stay, as do those without a place.  A tile draws for its own rows and for those
    within reach of it, and keeps what ends in it: no unit is a row, and each (row, col, gene) comes from one tile.  Unit
    i of a row has the draws 3 i to 3 i + 2 of its stream, so a row drawn for two tiles moves the same in both.
    """
    side = max(TILE, 8 * reach)
    wide, units = side + 2 * reach, UNITS
    names = ["row", "col", "gene", "n"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        if None in at:
            return t.filter(pc.greater(t["n"], 0)).group_by(names[:3]).aggregate([("n", "sum")]).rename_columns(names)
        top, left = (k * side - reach for k in at)
        n, start = t["n"].to_numpy(), t["_start"].to_numpy()
        r, c = t["row"].to_numpy() - top, t["col"].to_numpy() - left
        own = lambda r, c: (r >= reach) & (r < side + reach) & (c >= reach) & (c < side + reach)
        inside = own(r, c)
        if not inside.any():
            return t.select(names).slice(0, 0)
        there = np.zeros((wide, wide), dtype=bool)
        there[r, c] = True
        genes = t["gene"].combine_chunks().dictionary_encode()
        none = len(genes.dictionary)
        g = genes.indices.cast("int64").fill_null(none).to_numpy()
        code = lambda r, c, g: (r * wide + c) * (none + 1) + g
        ends, gone = np.cumsum(n), np.zeros_like(n)
        keys, sums = [], []
        for lo in range(0, int(ends[-1]), units):
            u = np.arange(lo, min(lo + units, int(ends[-1])))
            k = np.searchsorted(ends, u, "right")
            i = 3 * (u - (ends[k] - n[k]))
            moves = stream_draw(start[k], i) < p
            k, i = k[moves], i[moves]
            dr, dc = offset(stream_draw(start[k], i + 1), stream_draw(start[k], i + 2))
            r2, c2 = r[k] + dr, c[k] + dc
            # Only rows of other tiles reach beyond what is here, and they do not end in this one.
            ok = ((dr != 0) | (dc != 0)) & (r2 >= 0) & (r2 < wide) & (c2 >= 0) & (c2 < wide)
            ok[ok] = there[r2[ok], c2[ok]]
            gone += np.bincount(k[ok], minlength=len(n))
            ok &= own(r2, c2)
            some, times = np.unique(code(r2[ok], c2[ok], g[k[ok]]), return_counts=True)
            keys.append(some)
            sums.append(times)
        keys.append(code(r, c, g)[inside])
        sums.append((n - gone)[inside])
        some, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(some), dtype=np.int64)
        np.add.at(total, which, np.concatenate(sums))
        some, total = some[total > 0], total[total > 0]
        place, g = np.divmod(some, none + 1)
        return pa.table([place // wide + top, place % wide + left, genes.dictionary.take(pa.array(g, mask=g == none)), total], names=names)

    rows = counts.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "gene", F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0)).alias("n"), stream_start(seed, F.col("row"), F.col("col"), F.col("gene")).alias("_start"))
    # Rows without a place have no tile.
    tiles = lambda c: F.explode_outer(F.when(F.col("row").isNotNull() & F.col("col").isNotNull(), F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side) for d in (-reach, 0, reach)]))))
    dealt = rows.withColumn("_r", tiles("row")).withColumn("_c", tiles("col"))
    return dealt.groupBy("_r", "_c").applyInArrow(run, f"row long, col long, gene {counts.schema['gene'].dataType.simpleString()}, n long")


def transport(counts: DataFrame, seed: int, p: float, sigma: float) -> DataFrame:
    """Counts (row, col, gene, n) after each unit moved with chance p by a rounded Gaussian offset; units that would leave the grid stay.

    Gene totals are conserved.  Offsets end at 8.3 sigma, where the least draw is cut.
    """
    far = lambda u: np.sqrt(-2 * np.log(np.maximum(u, 1e-15))) * sigma

    def offset(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, angle = far(u), 2 * math.pi * v
        return np.rint(r * np.cos(angle)).astype(np.int64), np.rint(r * np.sin(angle)).astype(np.int64)

    return _carried(counts, seed, p, int(np.rint(far(0.0))), offset)


def soft_choice(df: DataFrame, keys: Sequence[str], item: str, weight: str, seed: int, greedy: bool = False) -> DataFrame:
    """One item for each key, with chances in proportion to the weights (exponential races), or the heaviest."""
    race = -F.ln(F.greatest(hash_uniform(seed, *[F.col(k) for k in keys], F.col(item)), F.lit(1e-15))) / F.col(weight)
    order = F.struct(-F.col(weight), F.col(item)) if greedy else F.struct(race, F.col(item))
    return df.filter(F.col(weight) > 0).groupBy(*keys).agg(F.min_by(item, order).alias(item))


def capture_probability(target: float, values: np.ndarray, steps: int = 100) -> float:
    """Factor f with sum(min(1, f v)) = target, by bisection; infeasible targets raise."""
    values = np.asarray(values, dtype=float)
    if target < 0 or target > (values > 0).sum():
        raise ValueError("the target cannot be reached")
    lo, hi = 0.0, 1.0
    while np.minimum(1, hi * values).sum() < target and hi < 1e18:
        hi *= 2
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(1, mid * values).sum() < target else (lo, mid)
    return (lo + hi) / 2



def place(sources: DataFrame, weights: DataFrame, capture: float, seed: int) -> DataFrame:
    """(bin, gene, placed, captured): units of sources (cell, gene, n) dealt to bins by weights (cell, bin, w).

    Each unit picks one bin of its cell and is captured with the given chance;
    placed counts sum to the source counts of cells that have bins.
    """
    w = Window.partitionBy("cell").orderBy("bin")
    cuts = weights.filter("w > 0").select("cell", "bin", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), F.sum("w").over(Window.partitionBy("cell")).alias("t"))
    table = cuts.groupBy("cell", "t").agg(F.array_sort(F.collect_list(F.struct("hi", "bin"))).alias("cut"))
    u = _units(sources, "n").join(table, "cell")
    key = [F.col(c) for c in ("cell", "gene", "i")]
    x = hash_uniform(f"{seed}p", *key) * F.col("t")
    hit = u.withColumn("x", x).select("gene", F.coalesce(F.element_at(F.filter("cut", lambda c: c["hi"] > F.col("x")), 1), F.element_at("cut", -1))["bin"].alias("bin"), (hash_uniform(f"{seed}c", *key) < capture).alias("seen"))
    return hit.groupBy("bin", "gene").agg(F.count("*").alias("placed"), F.count_if("seen").alias("captured"))


def ambient(counts: DataFrame, share: float, reach: int, seed: int) -> DataFrame:
    """Counts (row, col, gene, n) after each unit moved with the given chance to a uniform place within ``reach``; moves off the grid stay."""
    step = lambda u: np.floor(u * (2 * reach + 1)).astype(np.int64) - reach
    return _carried(counts, seed, share, reach, lambda u, v: (step(u), step(v)))


def nuclear_noise(bins: DataFrame, drop: float, least: int, claim: float, seed: int) -> DataFrame:
    """Noisy nuclear bins of (cell, row, col): some drop (``least`` of a cell stay), free neighbours are claimed, each once, by the least cell."""
    h = hash_uniform(f"{seed}d", F.col("cell"), F.col("row"), F.col("col"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("h"), "row", "col"))
    kept = bins.withColumn("h", h).withColumn("_r", rank).filter((F.col("h") >= drop) | (F.col("_r") <= least)).select("cell", "row", "col", F.lit(False).alias("claimed"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    near = bins.withColumn("s", F.explode(steps)).select("cell", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    free = near.join(bins.select("row", "col"), ["row", "col"], "left_anti").groupBy("row", "col").agg(F.min("cell").alias("cell"))
    false = free.filter(hash_uniform(f"{seed}f", F.col("row"), F.col("col")) < claim).select("cell", "row", "col", F.lit(True).alias("claimed"))
    return kept.unionByName(false)


def matched_sources(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(cell, source): sources (source, type, size) matched to cells (cell, type, size) by rank of size inside the type; short pools repeat."""
    c = cells.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("size", "cell")) - 1)
    s = sources.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("size", "source")) - 1).withColumn("pool", F.count("*").over(Window.partitionBy("type")))
    pools = s.select("type", "pool").distinct()
    ranked = c.join(pools, "type").withColumn("k", F.pmod("k", "pool")).select("cell", "type", "k")
    return ranked.join(s.select("type", "k", "source"), ["type", "k"]).select("cell", "source")
