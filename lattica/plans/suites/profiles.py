"""EM with cell profiles, its fixed-score hook, and background sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import background, em, outline, profiles
from ...operators import likelihood as lk
from ...operators.lineage import cut
from ..bindings import Tables, ctes
from ..catalog import register
from .em import BASE, SETTINGS, kinds, of_candidates, problem
from .likelihood import theta_of

PROFILES = profiles.Profiles()
TRUST = 100.0


def _profile_round(i: int) -> str:
    """SQL of one round from p{i} (and prof{i - 1}) to p{i + 1} and prof{i}."""
    s, p = SETTINGS, PROFILES
    a, b, old = f"p{i}", f"p{i + 1}", "ref0" if i == 0 else f"prof{i - 1}"
    first = f"""ref0 as (select cell, gene, ({p.prior} * m + {p.epsilon}) / sum({p.prior} * m + {p.epsilon}) over (partition by cell) p from mx0),""" if i == 0 else ""
    return f""",
s{i} as (select cell, k, sum(r * conf * ll) s from {a} join ll using (bin) where r > 0 group by 1, 2),
c{i} as (select a.cell, b.k, -ln(b.nk::double) + coalesce(s, 0) l from (select distinct cell from {a}) a cross join (select k, count(*) over () nk from (select distinct k from bin_types)) b left join s{i} using (cell, k)),
q{i} as (select cell, k, exp(l - max(l) over (partition by cell)) e from c{i}),
z{i} as (select cell, k, e / sum(e) over (partition by cell) q from q{i}),
mx{i} as (select cell, gene, sum(q * th) m from z{i} join theta using (k) group by 1, 2),
{first}
x{i} as (select cell, gene, sum(r * n) x from {a} join counts using (bin) where r > 0 group by 1, 2),
raw{i} as (select cell, gene, (coalesce(x, 0) + {p.prior} * m + {p.epsilon}) / sum(coalesce(x, 0) + {p.prior} * m + {p.epsilon}) over (partition by cell) p from mx{i} left join x{i} using (cell, gene)),
prof{i} as (select cell, gene, {1 - p.rate} * o.p + {p.rate} * n.p p from {old} o join raw{i} n using (cell, gene)),
lc{i} as (select bin, cell, sum(n * ln(greatest(p, {p.epsilon}))) / sum(n) lc from {a} join counts using (bin) join prof{i} using (cell, gene) where n > 0 group by 1, 2),
l{i} as (select {a}.bin, {a}.cell, sum(q * ll) L from {a} join ll using (bin) join z{i} on z{i}.cell = {a}.cell and z{i}.k = ll.k group by 1, 2),
t{i} as (select {a}.*, {s.alpha} * ln(greatest(pi, 1e-12)) + {s.beta} * conf * ((1 - coalesce(rel, 0)) * coalesce(L, 0) + coalesce(rel, 0) * coalesce(lc, 0)) sc from {a} left join l{i} using (bin, cell) left join lc{i} using (bin, cell) left join trust using (cell)),
e{i} as (select *, exp(sc - max(sc) over (partition by bin)) e from t{i}),
m{i} as (select *, {s.damping} * r + {1 - s.damping} * (e / sum(e) over (partition by bin)) mx from e{i}),
{b} as (select bin, cell, d, conf, owner, pi, case when owner is null then mx / sum(mx) over (partition by bin) when owner = cell then 1.0::double else 0.0::double end r from m{i})"""


TRUST_SQL = f", trust as (select cell, sum(n) / (sum(n) + {TRUST}) rel from p0 join counts using (bin) where cell = owner group by 1)"
ROUNDS_SQL = BASE + TRUST_SQL + _profile_round(0) + _profile_round(1)


def _rounds(t: Tables, n: int, p: profiles.Profiles = PROFILES, fixed=None):
    theta, pairs = cut(theta_of(t)), cut(problem(t))
    counts = of_candidates(t, pairs)
    trust = profiles.reliability(pairs, counts, TRUST)
    return profiles.run(pairs, counts, cut(lk.log_likelihood(counts, theta)), theta, kinds(t), trust, SETTINGS, p, n, fixed)


@register("em_profile_rounds", ROUNDS_SQL + " select bin, cell, round(r, 5) as r from p2")
def em_profile_rounds(spark, sf_dir):
    """Two rounds with cell profiles: weighted M step, reference prior, damping, mix of type and cell by reliability."""
    done, _ = _rounds(Tables(spark, sf_dir), 2)
    return done.select("bin", "cell", F.round("r", 5).alias("r"))


@register("em_cell_profiles", BASE + TRUST_SQL + _profile_round(0) + " select cell, gene, round(p * 1e6, 2) as ppm from prof0")
def em_cell_profiles(spark, sf_dir):
    _, profile = _rounds(Tables(spark, sf_dir), 1)
    return profile.select("cell", "gene", F.round(F.col("p") * 1e6, 2).alias("ppm"))


@register("em_reference_only_profiles", BASE + TRUST_SQL + _profile_round(0) + " select cell, gene, round(p * 1e6, 2) as ppm from ref0")
def em_reference_only_profiles(spark, sf_dir):
    """Profiles that are never updated are the reference alone."""
    _, profile = _rounds(Tables(spark, sf_dir), 1, profiles.Profiles(rate=0.0))
    return profile.select("cell", "gene", F.round(F.col("p") * 1e6, 2).alias("ppm"))


_FIXED_ROUND = _profile_round(0).replace("left join lc0 using (bin, cell)", "left join (select bin, cell, -(cell % 7) - d / 10 lc from p0) lcf using (bin, cell)")


@register("em_fixed_cell_score", BASE + TRUST_SQL + _FIXED_ROUND + " select bin, cell, round(r, 5) as r from p1")
def em_fixed_cell_score(spark, sf_dir):
    """The scoring hook: a given score takes the place of the cells' likelihood."""
    t = Tables(spark, sf_dir)
    fixed = problem(t).select("bin", "cell", (-(F.col("cell") % 7) - F.col("d") / 10).alias("L_cell"))
    done, _ = _rounds(t, 1, profiles.Profiles(rate=0.0), fixed)
    return done.select("bin", "cell", F.round("r", 5).alias("r"))


@register("background_sources")
def background_sources(spark, sf_dir):
    """Virtual sources tile by tile; draws are hashes of this engine."""
    t = Tables(spark, sf_dir)
    return background.sources(t.grid, t.centers, 0.5, 7).select("source", "type", "budget", "supported")


@register("background_counts")
def background_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = background.sources(t.grid, t.centers, 0.5, 7)
    types = t.raw("part").select((F.col("p_partkey") % 4).alias("type"), (F.col("p_partkey") % 50).alias("gene")).groupBy("type", "gene").agg(F.count("*").alias("c"))
    return background.spread(t.grid, found, types, 7)


@register("alpha_shape_areas")
def alpha_shape_areas(spark, sf_dir):
    """Alpha shapes of the bins of each owner and patch of 32 x 32 bins."""
    t = Tables(spark, sf_dir)
    o = t.owners("px").select(F.col("barcode").alias("bin"), (F.col("cell") % 4).alias("own"))
    g = t.grid.join(o, "bin").select(F.concat_ws(":", F.expr("row div 32"), F.expr("col div 32"), "own").alias("cell"), "x", "y")
    a = outline.alpha_areas(g, 0.25)
    return a.select("cell", "points", "triangles", F.round("area", 4).alias("area"), F.round("rim", 4).alias("rim"))


DONORS = "sources as (select c_custkey cell, c_mktsegment type, c_nationkey donor from customer)"


@register("eligible_donors", f"with {DONORS} select cell, type, donor from sources where donor in (1, 2, 3, 5, 8)")
def eligible_donors(spark, sf_dir):
    """Rows of the generator's donors, which share none with the reference's."""
    c = Tables(spark, sf_dir).raw("customer")
    s = c.select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").alias("donor"))
    return background.eligible_sources(s, {1, 2, 3, 5, 8}, {0, 4, 6})
