"""Fits and exact shape changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import fits, moments
from ..bindings import Tables, ctes
from ..catalog import register

#: A projective map of the grid; three bins of ten are far off it.
MAP = (3.65131713, -0.05172931, 500.01373517, 0.02531937, 3.64973119, 700.01719373, 1e-5, -2e-5, 1.0)
_U, _V, _W = (f"({MAP[i]}::double * x + {MAP[i + 1]}::double * y + {MAP[i + 2]}::double)" for i in (0, 3, 6))


@register("homography_fit", ctes("grid") + f" select bin, round({_U} / {_W}, 2) as u, round({_V} / {_W}, 2) as v from grid")
def homography_fit(spark, sf_dir):
    """The map that most bins follow, applied to all."""
    from ...functions.maths import projective

    g = Tables(spark, sf_dir).grid.select("bin", "x", "y")
    u, v = projective(F.col("x"), F.col("y"), MAP)
    off = F.col("bin") % 10 < 3
    seen = g.withColumns({"u": u + F.when(off, 40 + F.col("bin") % 50).otherwise(0), "v": v - F.when(off, 25 + F.col("bin") % 31).otherwise(0)})
    h = fits.homography(seen, "x", "y", "u", "v", robust=True, tolerance=1e-3)
    u, v = projective(F.col("x"), F.col("y"), tuple(float(a) for a in h.ravel()))
    return g.select("bin", F.round(u, 2).alias("u"), F.round(v, 2).alias("v"))


@register(
    "full_gaussian_score",
    """with p as (select c_custkey id, c_mktsegment k, c_acctbal / 1000 + c_custkey % 7 a, (c_custkey % 7)::double b from customer),
m as (select k, avg(a) ma, avg(b) mb, var_samp(a) + 1e-6 va, var_samp(b) + 1e-6 vb, covar_samp(a, b) c from p group by 1)
select id, round(-0.5 * (2 * ln(2 * pi()) + ln(va * vb - c * c) + ((a - ma) ** 2 * vb - 2 * (a - ma) * (b - mb) * c + (b - mb) ** 2 * va) / (va * vb - c * c)), 6) as score from p join m using (k)""",
)
def full_gaussian_score(spark, sf_dir):
    """Each row's log density under its cluster's Gaussian with full covariance; the two features depend on each other."""
    p = Tables(spark, sf_dir).raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("k"), (F.col("c_acctbal") / 1000 + F.col("c_custkey") % 7).alias("a"), (F.col("c_custkey") % 7).cast("double").alias("b"))
    j = p.join(fits.full_gaussians(p, "k", ["a", "b"]), "k")
    return j.select("id", F.round(fits.full_gaussian(F.array("a", "b"), F.col("mean"), F.col("inverse"), F.col("logdet"), 2), 6).alias("score"))


_CHANGES = (
    ctes("grid", "owner_px", "truth")
    + """, own as (select cell, bin, "row" r, col c, x, y from grid join owner_px on bin = barcode),
acts as (select cell, bin, -1 s from own union all select t.cell, o.bin, 1 from own o join truth t on t.barcode = o.bin where t.cell <> o.cell and t.cell in (select cell from own)),
made as (select a.cell, a.bin, a.s, o.bin b, o.r, o.c, o.x, o.y from acts a join own o using (cell) where a.s = 1 or o.bin <> a.bin
  union all select a.cell, a.bin, a.s, o.bin, o.r, o.c, o.x, o.y from acts a join own o on o.bin = a.bin where a.s = 1),
m as (select cell, bin, s, count(*) n, var_pop(x) * count(*) sxx, var_pop(y) * count(*) syy, covar_pop(x, y) * count(*) sxy from made group by 1, 2, 3),
e as (select p.cell, p.bin, p.s, count(*) k from made p join made q on p.cell = q.cell and p.bin = q.bin and p.s = q.s and abs(p.r - q.r) + abs(p.c - q.c) = 1 group by 1, 2, 3)
select m.cell, m.bin, m.s as sign, n, round(ln(1 + sxx), 6) as log_sxx, round(ln(1 + syy), 6) as log_syy, case when sxx * syy > 1e-6 then round(sxy / sqrt(sxx * syy), 6) end as correlation, 4 * n - coalesce(k, 0) as perimeter from m left join e using (cell, bin, s)"""
)


@register("shape_changes", _CHANGES)
def shape_changes(spark, sf_dir):
    """Every removal of a bin from its owner and every addition to its true cell; the SQL builds each changed cell anew."""
    t = Tables(spark, sf_dir)
    own = t.grid.join(t.owners("px").withColumnRenamed("barcode", "bin"), "bin").select("cell", "bin", "row", "col", "x", "y")
    away = own.withColumn("sign", F.lit(-1))
    gained = own.withColumnRenamed("cell", "_old").join(t.truth.select(F.col("barcode").alias("bin"), "cell"), "bin").filter("cell <> _old").drop("_old").withColumn("sign", F.lit(1))
    done = moments.changes(away.unionByName(gained.select(*away.columns)), own.drop("bin")).filter("n > 0")
    return done.select("cell", "bin", "sign", "n", *[F.round(F.log1p(F.greatest(c, F.lit(0.0))), 6).alias(f"log_{c}") for c in ("sxx", "syy")], F.expr("case when sxx * syy > 1e-6 then round(sxy / sqrt(sxx * syy), 6) end").alias("correlation"), "perimeter")
