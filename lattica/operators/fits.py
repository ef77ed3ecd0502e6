"""Fits from sums: projective transforms with outliers, Gaussians with full covariance.

A pass over the rows gives a fixed number of sums; what is solved from them has
nine unknowns or as many as features, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import LN_2PI, projective


def _residual(h: np.ndarray, x: Column, y: Column, u: Column, v: Column) -> Column:
    px, py = projective(x, y, tuple(float(a) for a in h.ravel()))
    return F.nanvl(F.hypot(px - u, py - v), F.lit(math.inf))


def _project(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, divisor) of ``projective``, digit by digit the same."""
    h = h.ravel()
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w, w


def _over(rows: DataFrame, size: int, part: Callable[..., np.ndarray], combine: Callable = F.sum) -> np.ndarray:
    """``size`` numbers of all rows (x, y, u, v): those that ``part`` gives for the arrays of a batch, combined.

    In arrays, since as many sums of such terms are one Java method too long to be compiled.
    """
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                found = part(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]) for n in found], names=names)

    done = rows.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    return np.array(list(done.agg(*[combine(n) for n in names]).first()), dtype=float)


#: Spreads from the middle beyond which (u, v) weigh as if they were there.
FAR = 10.0
#: Rows that a robust fit starts from, and its trials of four of them.
START_ROWS, START_TRIALS = 2000, 400


def _of_four(few: np.ndarray, shift: list[tuple[float, float]], matrix) -> np.ndarray | None:
    """Of the projective maps through four of the rows (x, y, u, v), the one with the least median residual; only a start, all rows judge it."""
    if len(few) < 8:
        return None
    x, y, u, v = (((few[:, i] - m) / s) for i, (m, s) in enumerate(shift))
    at = np.stack([np.random.default_rng(i).choice(len(few), 4, replace=False) for i in range(START_TRIALS)])
    a, b, p, q, one = x[at], y[at], u[at], v[at], np.ones(at.shape)
    lines = np.concatenate([np.stack((a, b, one, 0 * a, 0 * a, 0 * a, -p * a, -p * b, -p), -1), np.stack((0 * a, 0 * a, 0 * a, a, b, one, -q * a, -q * b, -q), -1)], 1)
    maps = np.linalg.svd(lines)[2][:, -1].reshape(-1, 3, 3)
    with np.errstate(all="ignore"):
        to = maps @ np.stack((x, y, np.ones_like(x)))
        miss = np.hypot((to[:, 0] / to[:, 2] - u) * shift[2][1], (to[:, 1] / to[:, 2] - v) * shift[3][1])
        best = np.linalg.inv(matrix("u", "v")) @ maps[np.argmin(np.nan_to_num(np.median(miss, 1), nan=np.inf))] @ matrix("x", "y")
        best = best / best[2, 2]
    return best if np.isfinite(best).all() else None


def homography(points: DataFrame, x: str, y: str, u: str, v: str, robust: bool = False, tolerance: float | None = None, rounds: int = 30) -> np.ndarray:
    """The 3 x 3 projective matrix, last number 1, that takes (x, y) to (u, v) with least algebraic error.

    ``robust``: rounds of weights that fall with the residual against its median,
    then a fit to the rows within three deviations; up to some 40 % of rows may be
    wrong.  Beyond ``tolerance`` for the largest residual (of the rows that count)
    the fit raises.  Rows with nulls or infinite numbers do not count; fewer than four points raise.

    The horizon of the map, where its divisor is 0, may cross the points.  Near it (u, v) have no bound and the rounding
    of the divisor is all there is in the residuals: places and scales are quantiles, rows over FAR spreads out weigh
    less in the sums, those near the horizon less in the steps, and the tolerance leaves out what rounding can do.
    """
    rows = points.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (u, "u"), (v, "v"))]).dropna()
    names = ("x", "y", "u", "v")
    rows = rows.filter(" and ".join(f"abs({c}) < double('infinity')" for c in names))
    scale = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.1, 0.5, 0.9], 10_000).alias(f"q{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    if scale["n"] < 4:
        raise ValueError("a projective transform needs four points")
    shift = {c: (q[1], max((q[2] - q[0]) / 2 or scale[f"s{c}"], 1e-12)) for c in names for q in (scale[f"q{c}"],)}
    matrix = lambda a, b: np.array([[1 / shift[a][1], 0, -shift[a][0] / shift[a][1]], [0, 1 / shift[b][1], -shift[b][0] / shift[b][1]], [0, 0, 1]])
    normal = lambda c, values: (values - shift[c][0]) / shift[c][1]
    columns = tuple(F.col(c) for c in names)
    inner = lambda h: matrix("u", "v") @ h @ np.linalg.inv(matrix("x", "y"))

    def solve(weight: Callable[..., np.ndarray], affine: bool = False) -> np.ndarray:
        def part(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            p, q, by = normal("u", u), normal("v", v), weight(x, y, u, v)
            far = 1 / np.maximum(1, np.hypot(p, q) / FAR)
            p, q, base = p * far, q * far, np.stack((normal("x", x), normal("y", y), np.ones_like(x)))
            return np.stack([(base * (by * f)) @ base.T for f in (far * far, far * p, far * q, p * p + q * q)]).ravel()

        one, by_u, by_v, both = _over(rows, 36, part).reshape(4, 3, 3)
        zero = np.zeros((3, 3))
        if affine:
            h = np.vstack((np.linalg.lstsq(one, np.stack((by_u[2], by_v[2]), 1), rcond=1e-12)[0].T, [0.0, 0.0, 1.0]))
            return np.linalg.inv(matrix("u", "v")) @ h @ matrix("x", "y")
        h = np.linalg.eigh(np.block([[one, zero, -by_u], [zero, one, -by_v], [-by_u, -by_v, both]]))[1][:, 0].reshape(3, 3)
        h = np.linalg.inv(matrix("u", "v")) @ h @ matrix("x", "y")
        return h / h[2, 2]

    def miss(h: np.ndarray) -> Callable[..., np.ndarray]:
        """The residuals of h."""

        def of(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            pu, pv, _ = _project(h, x, y)
            return np.nan_to_num(np.hypot(pu - u, pv - v), nan=np.inf, posinf=np.inf)

        return of

    def refine(h: np.ndarray, counts: Callable[..., np.ndarray]) -> np.ndarray:
        """A step on the residuals of h itself, so that only its last digits round; near the horizon they count less, as rounding grows there by the square of the divisor."""
        g = inner(h)

        def part(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            pu, pv, divisor = _project(h, x, y)
            some = counts(x, y, u, v) & (divisor != 0)
            x, y, u, v, pu, pv = (c[some] for c in (x, y, u, v, pu, pv))
            base = np.stack((normal("x", x), normal("y", y), np.ones_like(x)))
            w = g[2] @ base
            base, near, zero = base / w, np.minimum(1, (w / np.abs(g[2]).max()) ** 2), np.zeros_like(base)
            slopes = np.hstack((np.concatenate((base, zero, -base * normal("u", pu))) * near, np.concatenate((zero, base, -base * normal("v", pv))) * near))
            short = np.concatenate(((u - pu) / shift["u"][1] * near, (v - pv) / shift["v"][1] * near))
            return np.concatenate(((slopes @ slopes.T).ravel(), slopes @ short))

        sums = _over(rows, 90, part)
        # A map is the same times any number, so its largest entry stays.
        free, step = np.flatnonzero(np.arange(9) != np.abs(g).argmax()), np.zeros(9)
        step[free] = np.linalg.lstsq(sums[:81].reshape(9, 9)[np.ix_(free, free)], sums[81:][free], rcond=1e-14)[0]
        h = h + np.linalg.inv(matrix("u", "v")) @ step.reshape(3, 3) @ matrix("x", "y")
        return h / h[2, 2]

    least = 1e-9 * max(shift["u"][1], shift["v"][1])

    def middle_of(h: np.ndarray) -> float:
        return rows.agg(F.percentile_approx(_residual(h, *columns), 0.5, 10_000)).first()[0]

    def within(h: np.ndarray) -> Callable[..., np.ndarray]:
        """Whether rows are within three deviations of h."""
        far = 3 * 1.4826 * max(middle_of(h), least) + 1e3 * least
        return lambda *row: miss(h)(*row) <= far

    h = solve(lambda x, *_: np.ones_like(x), robust)
    counts = lambda x, *_: np.ones(len(x), dtype=bool)
    if robust:
        # Where four rows of a few fit better than the affine map, the rounds start there; else affine rounds come first,
        # as an early projective fit may bend the plane to please wrong points.
        few = rows.orderBy(F.xxhash64(*columns), *columns).limit(START_ROWS).collect()
        start = _of_four(np.array(few, dtype=float), [shift[c] for c in names], matrix)
        projective_start = start is not None and middle_of(start) < middle_of(h)
        h = start if projective_start else h
        for affine in (False,) if projective_start else (True, False):
            for _ in range(rounds):
                before, middle = h, max(middle_of(h), least)
                h = solve(lambda *row, h=h, middle=middle: 1 / (1 + (miss(h)(*row) / middle) ** 2), affine)
                if np.abs(inner(h - before)).max() <= (1e-4 if affine else 1e-10) * np.abs(inner(h)).max():
                    break
        counts = within(h)
        h = solve(lambda *row, counts=counts: counts(*row).astype(float))
    # Steps on the residuals themselves: sums of squares of coordinates leave half of the digits.
    for i in range(4):
        h = refine(h, counts)
        if robust and i == 1:
            counts = within(h)
    if tolerance is not None:

        def beyond(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
            """The largest residual that counts, less what rounding of the divisor may make of it."""
            pu, pv, w = _project(h, x, y)
            rounding = 2e-15 * np.hypot(pu, pv) * (np.abs(h[2, 0] * x) + np.abs(h[2, 1] * y) + 1) / np.abs(w)
            over = np.where(counts(x, y, u, v) & (w != 0), miss(h)(x, y, u, v) - rounding, 0.0)
            return np.array([over.max(initial=0.0)])

        worst = _over(rows, 1, beyond, F.max)[0]
        if not worst <= tolerance:
            raise ValueError(f"points are not one projective transform: residual {worst}")
    return h


def full_gaussians(points: DataFrame, key: str, features: Sequence[str], epsilon: float = 1e-6) -> DataFrame:
    """(key, n, mean, inverse, logdet) of each cluster: sample covariance plus epsilon on the diagonal, its inverse and log determinant.

    A cluster with no more rows than features has the diagonal of its variances, at
    least a quarter of those of all rows.  A matrix that stays singular gets a
    pseudo-inverse.
    """
    d = len(features)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    whole = points.agg(*[F.var_samp(c) for c in features]).first()
    spread = np.array([v or 0.0 for v in whole])
    sums = points.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in features]).alias("mean"), F.array(*[F.coalesce(F.covar_samp(features[i], features[j]), F.lit(0.0)) for i, j in upper]).alias("_cov"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inverses, logs = [], []
            for n, upper_half in zip(pdf["n"], pdf["_cov"]):
                cov = np.zeros((d, d))
                cov[tuple(np.array(upper).T)] = np.asarray(upper_half)
                cov = cov + np.triu(cov, 1).T
                if n <= d:
                    own = np.diag(cov) * (n - 1) / n if n > 1 else spread
                    cov = np.diag(np.maximum(own, spread * 0.25))
                cov = cov + epsilon * np.eye(d)
                sign, log = np.linalg.slogdet(cov)
                if sign <= 0 or not math.isfinite(log):
                    cov = cov + max(epsilon, 1e-6) * np.eye(d)
                    log = np.linalg.slogdet(cov)[1]
                inverses.append([list(r) for r in np.linalg.pinv(cov, rcond=1e-12)])
                logs.append(float(log) if math.isfinite(log) else 0.0)
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "mean": pdf["mean"], "inverse": inverses, "logdet": logs})

    kind = points.schema[key].dataType.simpleString()
    return sums.mapInPandas(invert, f"`{key}` {kind}, n long, mean array<double>, inverse array<array<double>>, logdet double")


def full_gaussian(values: Column, mean: Column, inverse: Column, logdet: Column, size: int) -> Column:
    """Log density of a Gaussian with full covariance."""
    add = lambda a, x: a + x
    z = F.zip_with(values, mean, lambda a, b: a - b)
    form = F.zip_with(z, inverse, lambda a, row: a * F.aggregate(F.zip_with(z, row, lambda b, c: b * c), F.lit(0.0), add))
    return -0.5 * (size * LN_2PI + logdet + F.aggregate(form, F.lit(0.0), add))
