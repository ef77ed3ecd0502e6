"""EM over candidate pairs: prior, rounds, gate, entropy, calibration, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import maths
from ...operators import em, graph, spatial
from ...operators import likelihood as lk
from ...operators.lineage import cut, small
from ..bindings import Tables, ctes
from ..catalog import register
from .likelihood import THETA_SQL, theta_of
from .spatial import R6, centers

D_MAX = 12.0
#: Bins of the first rows; the binding's patch.
PROBLEM_SQL = f""", near as (select bin, cell, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) d from grid join (select cell, x cx, y cy from centers) c on x between cx - {D_MAX} and cx + {D_MAX} and y between cy - {D_MAX} and cy + {D_MAX} where (x - cx) * (x - cx) + (y - cy) * (y - cy) <= {D_MAX * D_MAX}),
tot as (select bin, sum(n) t from counts group by 1),
own as (select bin, cell owner from (select *, row_number() over (partition by bin order by d, cell) rn from near) where rn = 1 and d <= 2.5),
pr as (select bin, cell, d, coalesce(t, 0) / (coalesce(t, 0) + 20.0::double) conf, owner from near left join tot using (bin) left join own using (bin)),
pe as (select *, exp(-(d / {D_MAX}) * (d / {D_MAX}) - max(-(d / {D_MAX}) * (d / {D_MAX})) over (partition by bin)) e from pr),
p0 as (select bin, cell, d, conf, owner, e / sum(e) over (partition by bin) pi, case when owner is null then e / sum(e) over (partition by bin) when owner = cell then 1.0::double else 0.0::double end r from pe)"""


def problem(t: Tables):
    """(bin, cell, d, conf, owner): candidates within D_MAX; a bin close to its nearest centre is locked to it."""
    near = spatial.radius_join(t.grid.select("bin", "x", "y"), centers(t).select("cell", "cx", "cy"), D_MAX).select("bin", "cell", "d")
    total = t.counts.groupBy("bin").agg(F.sum("n").alias("t"))
    own = near.groupBy("bin").agg(F.min(F.struct("d", "cell")).alias("m")).filter("m.d <= 2.5").select("bin", F.col("m.cell").alias("owner"))
    p = near.join(total, "bin", "left").join(own, "bin", "left")
    return p.select("bin", "cell", "d", maths.confidence(F.coalesce("t", F.lit(0)), 20.0).alias("conf"), "owner")


def kinds(t: Tables):
    k = t.bin_types.select("k").distinct()
    return k.crossJoin(F.broadcast(k.agg(F.count("*").alias("n")))).select("k", (-F.ln("n")).alias("log_prior"))


def _round_sql(i: int, s: em.Settings) -> str:
    a, b = f"p{i}", f"p{i + 1}"
    return f""",
s{i} as (select cell, k, sum(r * conf * ll) s from {a} join ll using (bin) where r > 0 group by 1, 2),
c{i} as (select a.cell, b.k, -ln(b.nk::double) + coalesce(s, 0) l from (select distinct cell from {a}) a cross join (select k, count(*) over () nk from (select distinct k from bin_types)) b left join s{i} using (cell, k)),
q{i} as (select cell, k, exp(l - max(l) over (partition by cell)) e from c{i}),
z{i} as (select cell, k, e / sum(e) over (partition by cell) q from q{i}),
l{i} as (select {a}.bin, {a}.cell, sum(q * ll) L from {a} join ll using (bin) join z{i} on z{i}.cell = {a}.cell and z{i}.k = ll.k group by 1, 2),
t{i} as (select {a}.*, {s.alpha} * ln(greatest(pi, 1e-12)) + {s.beta} * conf * coalesce(L, 0) sc from {a} left join l{i} using (bin, cell)),
e{i} as (select *, exp(sc - max(sc) over (partition by bin)) e from t{i}),
m{i} as (select *, {s.damping} * r + {1 - s.damping} * (e / sum(e) over (partition by bin)) mx from e{i}),
{b} as (select bin, cell, d, conf, owner, pi, case when owner is null then mx / sum(mx) over (partition by bin) when owner = cell then 1.0::double else 0.0::double end r from m{i})"""


SETTINGS = em.Settings(d_max=D_MAX)
BASE = ctes("counts", "bin_types", "grid", "centers") + "," + THETA_SQL + PROBLEM_SQL
TWO = BASE + _round_sql(0, SETTINGS) + _round_sql(1, SETTINGS)


@register("spatial_prior", BASE + " select bin, cell, round(pi, 6) as pi, round(r, 6) as r from p0")
def spatial_prior(spark, sf_dir):
    p = em.initial(em.spatial_prior(problem(Tables(spark, sf_dir)), D_MAX))
    return p.select("bin", "cell", R6(F.col("pi"), "pi"), R6(F.col("r"), "r"))


def of_candidates(t: Tables, pairs):
    """The counts of bins with candidates: no other bin's take part in a round.  Computed once, as each step of a round reads them."""
    return cut(t.counts.join(small(pairs.select("bin").distinct()), "bin", "left_semi"))


def two_rounds(t: Tables):
    pairs = cut(problem(t))
    ll = cut(lk.log_likelihood(of_candidates(t, pairs), theta_of(t)))
    done, _ = em.run(pairs, ll, kinds(t), SETTINGS, rounds=2, tolerance=-1.0)
    return done


@register("em_two_rounds", TWO + " select bin, cell, round(r, 5) as r from p2")
def em_two_rounds(spark, sf_dir):
    return two_rounds(Tables(spark, sf_dir)).select("bin", "cell", F.round("r", 5).alias("r"))


@register("em_entropy_top2", TWO + ", h as (select bin, count(*) n, -sum(case when r > 0 then r * ln(r) else 0 end) h from p2 group by 1), k as (select bin, cell, r, row_number() over (partition by bin order by r desc, cell) rn from p2), u as (select bin, max(r) filter (rn = 1) top, coalesce(max(r) filter (rn = 2), 0) sec2 from k group by 1) select bin, n, round(case when n > 1 then least(1, greatest(0, h / ln(n))) else 0 end, 5) as entropy, round(top, 5) as top, round(top - sec2, 5) as margin from h join u using (bin)")
def em_entropy_top2(spark, sf_dir):
    p = two_rounds(Tables(spark, sf_dir))
    j = em.entropy(p).join(em.top_two(p), "bin")
    return j.select("bin", "n", F.round("entropy", 5).alias("entropy"), F.round("top", 5).alias("top"), F.round("margin", 5).alias("margin"))


@register("em_background_gate", BASE + " select bin, cell, round(case when owner is null then 1 - 1 / (1 + exp(-(-1.0 + 3.0 * conf))) else 0 end, 6) as background, round(r * (1 - case when owner is null then 1 - 1 / (1 + exp(-(-1.0 + 3.0 * conf))) else 0 end), 6) as owned from p0")
def em_background_gate(spark, sf_dir):
    p = em.initial(em.spatial_prior(problem(Tables(spark, sf_dir)), D_MAX))
    g = maths.background_gate(F.col("conf"), -1.0, 3.0, F.col("owner").isNotNull())
    return p.select("bin", "cell", R6(g, "background"), R6(F.col("r") * (1 - g), "owned"))


@register("responsibility_mass", TWO + " select count(*) as bins, sum(case when abs(s - 1) <= 1e-5 then 1 else 0 end)::bigint as conserved from (select bin, sum(r) s from p2 group by 1)")
def responsibility_mass(spark, sf_dir):
    s = two_rounds(Tables(spark, sf_dir)).groupBy("bin").agg(F.sum("r").alias("s"))
    return s.agg(F.count("*").alias("bins"), F.sum((F.abs(F.col("s") - 1) <= 1e-5).cast("long")).alias("conserved"))


@register(
    "entropy_calibration",
    BASE + """, h as (select bin, count(*) n, -sum(case when r > 0 then r * ln(r) else 0 end) h, arg_max(cell, (r, -cell)) top from p0 group by 1), c as (select bin, round(case when n > 1 then least(1, greatest(0, h / ln(n))) else 0 end, 9) e, top % 3 <> 0 correct from h)
select cast(least(floor(e * 5), 4) as integer) as bucket, count(*) as n, round(avg(e), 6) as mean_entropy, round(avg(case when correct then 1.0 else 0.0 end), 6) as accuracy from c group by 1""",
)
def entropy_calibration(spark, sf_dir):
    """Five equal entropy bins, the last one closed."""
    p = em.initial(em.spatial_prior(problem(Tables(spark, sf_dir)), D_MAX))
    j = em.entropy(p).join(em.top_two(p).select("bin", "owner"), "bin").withColumn("e", F.round("entropy", 9))
    g = j.groupBy(em.reliability_bins(F.col("e"), 5).alias("bucket"))
    return g.agg(F.count("*").alias("n"), R6(F.avg("e"), "mean_entropy"), R6(F.avg((F.col("owner") % 3 != 0).cast("double")), "accuracy"))


@register("entropy_thresholds", BASE + ", h as (select bin, count(*) n, -sum(case when r > 0 then r * ln(r) else 0 end) h from p0 group by 1), c as (select round(case when n > 1 then least(1, greatest(0, h / ln(n))) else 0 end, 9) e from h) select t as threshold, count(*) filter (e > t) as over_n, round(count(*) filter (e > t) / greatest(1, count(*))::double, 6) as share from c, (select unnest([0.2, 0.4, 0.6, 0.8])::double t) group by t")
def entropy_thresholds(spark, sf_dir):
    """Overlapping groups: how many bins exceed each threshold."""
    p = em.initial(em.spatial_prior(problem(Tables(spark, sf_dir)), D_MAX))
    e = em.entropy(p).select(F.round("entropy", 9).alias("e"), F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("threshold"))
    over = F.count_if(F.col("e") > F.col("threshold"))
    return e.groupBy("threshold").agg(over.alias("over_n"), R6(over / F.greatest(F.lit(1), F.count("*")), "share"))


@register("score_decomposition", BASE + """, tk as (select bin, k from bin_types), sc as (select p0.bin, p0.cell, conf * ll base, ln(greatest(pi, 1e-12)) corr from p0 join tk using (bin) join ll using (bin, k)), ch as (select bin, arg_max(cell, (base + corr, -cell)) chosen, min(cell) truth from sc group by 1)
select ch.bin, chosen, truth, round(a.base - b.base, 6) as base_gain, round(a.corr - b.corr, 6) as correction_gain, abs((a.base + a.corr) - (b.base + b.corr) - (a.base - b.base) - (a.corr - b.corr)) <= 2e-5 as identity from ch join sc a on a.bin = ch.bin and a.cell = chosen join sc b on b.bin = ch.bin and b.cell = truth""")
def score_decomposition(spark, sf_dir):
    """Chosen minus truth, split to the type base and the cell correction; the parts must add up."""
    t = Tables(spark, sf_dir)
    p = em.initial(em.spatial_prior(problem(t), D_MAX))
    ll = lk.log_likelihood(t.counts, theta_of(t))
    sc = p.join(t.bin_types, "bin").join(ll, ["bin", "k"]).select("bin", "cell", (F.col("conf") * F.col("ll")).alias("base"), F.ln(F.greatest("pi", F.lit(1e-12))).alias("corr"))
    parts = F.struct("cell", "base", "corr")
    g = sc.groupBy("bin").agg(F.max_by(parts, F.struct(F.col("base") + F.col("corr"), -F.col("cell"))).alias("a"), F.min_by(parts, "cell").alias("b"))
    base, corr = F.col("a.base") - F.col("b.base"), F.col("a.corr") - F.col("b.corr")
    whole = (F.col("a.base") + F.col("a.corr")) - (F.col("b.base") + F.col("b.corr"))
    return g.select("bin", F.col("a.cell").alias("chosen"), F.col("b.cell").alias("truth"), R6(base, "base_gain"), R6(corr, "correction_gain"), (F.abs(whole - base - corr) <= 2e-5).alias("identity"))


@register("competition_margin", BASE + ", k as (select bin, cell, conf * 10 * pi s from p0), o as (select a.bin, a.cell, a.s, max(b.s) best from k a left join k b on a.bin = b.bin and a.cell <> b.cell group by 1, 2, 3) select bin, cell, round(case when best is null then 0 else least(greatest(s - best, -2), 2) * 0.5 end, 6) as margin from o")
def competition_margin(spark, sf_dir):
    """Each candidate's clipped lead over its best rival, from the two best scores of the bin."""
    p = em.initial(em.spatial_prior(problem(Tables(spark, sf_dir)), D_MAX))
    s = p.select("bin", "cell", (F.col("conf") * 10 * F.col("pi")).alias("s"))
    top = s.groupBy("bin").agg(F.max(F.struct("s", "cell")).alias("t1"))
    second = s.join(top, "bin").filter("cell <> t1.cell").groupBy("bin").agg(F.max("s").alias("s2"))
    best = F.when(F.col("cell") == F.col("t1.cell"), F.col("s2")).otherwise(F.col("t1.s"))
    j = s.join(top, "bin").join(second, "bin", "left")
    return j.select("bin", "cell", R6(maths.competition_margin(F.col("s"), best, 2.0, 0.5), "margin"))


def _owned(t: Tables):
    o = t.owners("px").select(F.col("barcode").alias("bin"), (F.col("cell") % 4).alias("cell"))
    return t.grid.select("bin", "row", "col").join(o, "bin")


def _islands(o):
    """(bin, row, col, cell, root): the eight-connected part of each bin."""
    edges = spatial.neighbours(o, spatial.EIGHT, ["bin", "cell"], ["bin", "cell"]).filter("cell = n_cell").select(F.col("bin").alias("a"), F.col("n_bin").alias("b"))
    roots = graph.components(o.select(F.col("bin").alias("node")), edges)
    return o.join(roots, F.col("bin") == F.col("node")).drop("node")


def _island_sizes(o):
    parts = _islands(o).groupBy("cell", "root").agg(F.count("*").alias("n"))
    return parts.groupBy("cell").agg(F.count("*").alias("islands"), F.max("n").alias("largest"))


def _reached(o):
    roots = _islands(o)
    seeds = roots.groupBy("cell").agg(F.min_by("root", "bin").alias("root"))
    return roots.join(seeds, ["cell", "root"]).groupBy("cell").agg(F.count("*").alias("reached"))


@register("hard_islands")
def hard_islands(spark, sf_dir):
    """Eight-connected parts of each owner on the whole grid."""
    return _island_sizes(_owned(Tables(spark, sf_dir)))


@register("seed_reachability")
def seed_reachability(spark, sf_dir):
    """Bins of the whole grid that the seed of a cell (its least bin) reaches through its own bins: the seed's component."""
    return _reached(_owned(Tables(spark, sf_dir)))
