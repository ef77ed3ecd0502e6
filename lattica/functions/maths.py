"""Column functions of the likelihood, reward and geometry formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_2PI = math.log(2 * math.pi)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def confidence(count: Column, a: float) -> Column:
    """c / (c + a), 0 when both are 0."""
    return F.coalesce(F.try_divide(count.cast("double"), count + F.lit(float(a))), F.lit(0.0))


def inverse_confidence(conf: Column, a: float) -> Column:
    """The count that has this confidence; confidence is clipped below 1."""
    c = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1 - 1e-7))
    return c * a / (1 - c)


def spatial_logit(d: Column, d_max: float) -> Column:
    """-(d / d_max)^2; a distance out of range raises."""
    return F.when(d > d_max, F.raise_error(F.lit("distance is over d_max"))).otherwise(-(d / d_max) * (d / d_max))


def score(alpha: float, prior: Column, beta: float, conf: Column, likelihood: Column, eps: float = 1e-12) -> Column:
    return alpha * F.ln(F.greatest(prior, F.lit(eps))) + beta * conf * likelihood


def sigmoid(x: Column, clip: float = 60.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))))


def background_gate(conf: Column, a: float, w: float, locked: Column) -> Column:
    """Share of the background: 1 - sigmoid(a + w conf); a locked bin has none."""
    return F.when(locked, F.lit(0.0)).otherwise(1 - sigmoid(a + w * conf))


def damp(old: Column, new: Column, rate: float) -> Column:
    """Convex mix with exact end points."""
    if rate <= 0:
        return new
    return old if rate >= 1 else rate * old + (1 - rate) * new


def distance_penalty(d: Column, r_max: float) -> Column:
    return d / r_max


def overlap_penalty(d: Column, d_other: Column, r_max: float) -> Column:
    return F.greatest(F.lit(0.0), (d - d_other) / r_max)


def competition_margin(mine: Column, best_other: Column, clip: float, weight: float) -> Column:
    """Clipped lead over the best competitor, 0 without one."""
    return F.when(best_other.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest(mine - best_other, F.lit(-clip)), F.lit(clip)) * weight)


def add_reward(z_new: Column, z_old: Column, p_distance: Column, p_overlap: Column, support: Column, w: tuple[float, float, float, float, float]) -> Column:
    w1, w2, w3, w4, w5 = w
    return w1 * z_new + w5 * z_old - w2 * p_distance - w3 * p_overlap + w4 * support


def gaussian_diagonal(values: Column, mean: Column, variance: Column) -> Column:
    """Log density of a diagonal Gaussian: arrays of values, means and variances."""
    terms = F.zip_with(F.zip_with(values, mean, lambda v, m: (v - m) * (v - m)), variance, lambda d, s: d / s + F.ln(s) + LN_2PI)
    return -0.5 * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def log1p_cpm(n: Column, total: Column, scale: float = 1e4) -> Column:
    return F.when(total > 0, F.log1p(n * scale / total)).otherwise(F.lit(0.0))


def scaled_feature(x: Column, cap: float) -> Column:
    """log1p of the clipped value over log1p of the cap."""
    return F.log1p(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(cap)))) / math.log1p(cap)


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def inverse_affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    det = a * e - b * d
    if det == 0:
        raise ValueError("the transform has no inverse")
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def projective(x: Column, y: Column, h: tuple[float, ...]) -> tuple[Column, Column]:
    """Homography with nine numbers, row by row; on the horizon, where w is 0, infinite by the sign of the numerator as doubles divide."""
    w = h[6] * x + h[7] * y + h[8]
    over = lambda a: F.when(w == 0, a * float("inf")).otherwise(F.try_divide(a, w))
    return over(h[0] * x + h[1] * y + h[2]), over(h[3] * x + h[4] * y + h[5])


def soften(nuclear: Column, cyto: Column, membrane: Column, prior: tuple[float, float, float], strength: float) -> tuple[Column, ...]:
    """Convex mix of normalised compartment weights with a prior."""
    total = nuclear + cyto + membrane
    return tuple(F.coalesce(F.try_divide(c, total), F.lit(0.0)) * (1 - strength) + strength * p for c, p in zip((nuclear, cyto, membrane), prior, strict=True))


def gaussian_kernel(d2: Column, sigma: float) -> Column:
    """exp(-d^2 / 2 sigma^2), 0 beyond three sigma."""
    return F.when(d2 <= (3 * sigma) * (3 * sigma), F.exp(-d2 / (2 * sigma * sigma))).otherwise(F.lit(0.0))


def block_id(v: Column, size: float) -> Column:
    """Absolute block: floor division that goes down for negatives."""
    return F.floor(v / size).cast("long")


def shrink(counts: Column, prior: float, reference: Column, total: Column) -> Column:
    """(counts + prior * reference) over its sum, for a reference that sums to 1."""
    return (counts + prior * reference) / (total + prior)


def shape_delta(area: Column, perimeter: Column, neighbours: Column) -> tuple[Column, Column]:
    """Area and perimeter after a unit bin with so many 4-neighbours in the cell is added."""
    return area + 1, perimeter + 4 - 2 * neighbours


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(0.0))
