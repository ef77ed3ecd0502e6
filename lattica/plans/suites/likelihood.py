"""Claims, profiles and likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import ids, maths
from ...operators import likelihood as lk
from ...operators import ranked
from ...operators.lineage import small
from ..bindings import Tables, ctes
from ..catalog import register

THETA_SQL = """
ref as (select k, gene, sum(n) c from counts join bin_types using (bin) group by k, gene),
kg as (select a.k, b.gene from (select distinct k from ref) a cross join (select distinct gene from ref) b),
theta as (select k, gene, (coalesce(c, 0) + 1e-6::double) / sum(coalesce(c, 0) + 1e-6::double) over (partition by k) th from kg left join ref using (k, gene)),
ll as (select bin, k, sum(n * ln(th)) / sum(n) ll from counts join theta using (gene) group by bin, k)"""


def theta_of(t: Tables) -> DataFrame:
    return lk.theta(lk.reference_counts(t.counts, t.bin_types))


@register("type_loglik_softmax", ctes("counts", "bin_types") + "," + THETA_SQL + ", sm as (select bin, k, ll, exp(ll - max(ll) over (partition by bin)) e from ll) select bin, k, round(ll, 6) as ll, round(e / sum(e) over (partition by bin), 6) as q from sm")
def type_loglik_softmax(spark, sf_dir):
    """The profile of each type needs no counts by bin: lines are summed by type and gene on the map side.

    Its table is small, which is checked, so the second pass has one exchange, of the sums of
    each bin; a bin is one row until the softmax is known.
    """
    t = Tables(spark, sf_dir)
    line = t.raw("lineitem").select(F.col("l_orderkey").alias("bin"), (F.col("l_partkey") % 50).alias("gene"), F.col("l_quantity").cast("long").alias("n"))
    theta = small(lk.theta(lk.reference_counts(line, t.bin_types)))
    return lk.likelihood_softmax(line, theta).select("bin", "k", F.round("ll", 6).alias("ll"), F.round("q", 6).alias("q"))


@register("loglik_with_empty_bins", ctes("counts", "bin_types") + "," + THETA_SQL + ", bins as (select o_orderkey bin from orders), g as (select bin, k from bins cross join (select distinct k from theta)) select k, count(*) as n_bins, sum(case when ll is null then 1 else 0 end)::bigint as n_empty, round(avg(coalesce(ll, 0)), 6) as mean_ll from g left join ll using (bin, k) group by k")
def loglik_with_empty_bins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    bins = t.raw("orders").select(F.col("o_orderkey").alias("bin"))
    full = lk.log_likelihood(t.counts, theta_of(t), bins)
    return full.groupBy("k").agg(F.count("*").alias("n_bins"), F.sum((F.col("ll") == 0).cast("long")).alias("n_empty"), F.round(F.avg("ll"), 6).alias("mean_ll"))


@register("reference_theta", ctes("counts", "bin_types") + "," + THETA_SQL + " select k, gene, round(th * 1e6, 3) as theta_ppm from theta")
def reference_theta(spark, sf_dir):
    return theta_of(Tables(spark, sf_dir)).select("k", "gene", F.round(F.col("theta") * 1e6, 3).alias("theta_ppm"))


@register(
    "claims_to_barcode",
    ctes("claims")
    + """, a as (select barcode, cast(sum(px) as bigint) total_px, max(px) max_px, count(distinct cell) n_cells, max(weight) max_weight, count(distinct cell) > 1 ambiguous from claims group by 1),
d as (select barcode, cell dominant, weight dominant_weight from (select *, row_number() over (partition by barcode order by px desc, weight desc, ord, cell) rn from claims) where rn = 1)
select barcode, total_px, max_px, n_cells, max_weight, ambiguous, dominant, dominant_weight from a join d using (barcode)""",
)
def claims_to_barcode(spark, sf_dir):
    """One aggregate: sums and the dominant claim together, without a window."""
    c = Tables(spark, sf_dir).claims
    order = F.struct(-F.col("px"), -F.col("weight"), F.col("ord"), F.col("cell"))
    out = c.groupBy("barcode").agg(F.sum("px").alias("total_px"), F.max("px").alias("max_px"), F.count_distinct("cell").alias("n_cells"), F.max("weight").alias("max_weight"), F.min_by(F.struct("cell", "weight"), order).alias("d"))
    return out.select("barcode", "total_px", "max_px", "n_cells", "max_weight", (F.col("n_cells") > 1).alias("ambiguous"), F.col("d.cell").alias("dominant"), F.col("d.weight").alias("dominant_weight"))


@register("confident_seeds", ctes("claims") + ", a as (select barcode, count(distinct cell) nc, min(cell) cell, cast(sum(px) as bigint) px from claims group by 1) select barcode, cell, px from a where nc = 1 and px > 0")
def confident_seeds(spark, sf_dir):
    """Annotated and not ambiguous; without the flag a bin counts as not ambiguous."""
    a = Tables(spark, sf_dir).claims.groupBy("barcode").agg(F.count_distinct("cell").alias("nc"), F.min("cell").alias("cell"), F.sum("px").alias("px"))
    flagged = a.select("barcode", "cell", "px", (F.col("px") > 0).alias("annotated"), (F.col("nc") > 1).alias("ambiguous"))
    return flagged.filter(F.coalesce("annotated", F.lit(False)) & ~F.coalesce("ambiguous", F.lit(False))).select("barcode", "cell", "px")


@register(
    "pixel_compartments",
    """with px as (select l_orderkey bin, l_suppkey cell, case when l_returnflag = 'R' then 1 else 0 end nuc, case when l_returnflag = 'A' then 1 else 0 end cyt, case when l_returnflag = 'N' and l_linestatus = 'O' then 1 else 0 end bnd, l_linenumber from lineitem),
s as (select bin, cell, cast(sum(nuc) as bigint) nuc, cast(sum(cyt) as bigint) cyt, cast(sum(bnd) as bigint) bnd from px group by 1, 2 having sum(nuc) + sum(cyt) + sum(bnd) > 0)
select bin, cell, 'nuclear' as compartment, nuc as pixels, nuc / 10.0::double as weight from s where nuc > 0
union all select bin, cell, 'cytoplasm', cyt, cyt / 10.0::double from s where cyt > 0
union all select bin, cell, 'boundary', bnd, bnd / 20.0::double from s where bnd > 0 and nuc = 0 and cyt = 0""",
)
def pixel_compartments(spark, sf_dir):
    """Pixel sums by bin and cell (all-zero rows go), then one row for each compartment that has pixels."""
    li = Tables(spark, sf_dir).raw("lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    s = li.groupBy(F.col("l_orderkey").alias("bin"), F.col("l_suppkey").alias("cell")).agg(F.count_if(flag == "R").alias("nuc"), F.count_if(flag == "A").alias("cyt"), F.count_if((flag == "N") & (status == "O")).alias("bnd")).filter("nuc + cyt + bnd > 0")
    row = lambda name, n, w, keep: F.when(keep, F.struct(F.lit(name).alias("compartment"), n.alias("pixels"), (n / w).alias("weight")))
    nuc, cyt, bnd = F.col("nuc"), F.col("cyt"), F.col("bnd")
    rows = F.array_compact(F.array(row("nuclear", nuc, 10.0, nuc > 0), row("cytoplasm", cyt, 10.0, cyt > 0), row("boundary", bnd, 20.0, (bnd > 0) & (nuc == 0) & (cyt == 0))))
    return s.select("bin", "cell", F.explode(rows).alias("r")).select("bin", "cell", "r.*")


@register(
    "nuclei_weighted_table",
    ctes("pairs", "grid")
    + """, f as (select cell, x, y, "row", col, least(px / 50.0::double, 1.0) f from pairs join grid on barcode = bin)
select cell, round(sum(x * f) / sum(f), 6) as center_x, round(sum(y * f) / sum(f), 6) as center_y, round(sum(f) * 4.0, 6) as area_um2, round(sqrt(sum(f) * 4.0 / pi()), 6) as radius_um,
cast(round_even(sum(f) * 4.0, 0) as bigint) as pixel_count, count(*) as n_bins, min(col) as col_min, max(col) as col_max, min("row") as row_min, max("row") as row_max from f group by cell""",
)
def nuclei_weighted_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = t.pairs.join(t.grid, F.col("barcode") == F.col("bin")).withColumn("f", F.least(F.col("px") / 50.0, F.lit(1.0)))
    area = F.sum("f") * 4.0
    return f.groupBy("cell").agg(F.round(F.sum(F.col("x") * F.col("f")) / F.sum("f"), 6).alias("center_x"), F.round(F.sum(F.col("y") * F.col("f")) / F.sum("f"), 6).alias("center_y"), F.round(area, 6).alias("area_um2"), F.round(F.sqrt(area / F.pi()), 6).alias("radius_um"), F.rint(area).cast("long").alias("pixel_count"), F.count("*").alias("n_bins"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.min("row").alias("row_min"), F.max("row").alias("row_max"))


@register(
    "multi_owner_export_checks",
    ctes("pairs") + ", t as (select barcode, cast(sum(px) as double) s from pairs group by 1), w as (select barcode, cell, px / s wt from pairs join t using (barcode)), k as (select barcode, count(*) n_owners, sum(wt) tot, max(wt) mx from w group by 1) select barcode, n_owners, round(tot, 6) as weight_sum, abs(tot - 1) <= 1e-7 as conserved, round(mx, 6) as max_weight from k",
)
def multi_owner_export_checks(spark, sf_dir):
    p = Tables(spark, sf_dir).pairs
    w = p.withColumn("wt", F.col("px") / F.sum("px").over(Window.partitionBy("barcode")).cast("double"))
    k = w.groupBy("barcode").agg(F.count("*").alias("n_owners"), F.sum("wt").alias("tot"), F.max("wt").alias("mx"))
    return k.select("barcode", "n_owners", F.round("tot", 6).alias("weight_sum"), (F.abs(F.col("tot") - 1) <= 1e-7).alias("conserved"), F.round("mx", 6).alias("max_weight"))


@register("log1p_cpm", ctes("counts") + " select bin, gene, n, round(ln(1 + n * 1e4::double / sum(n) over (partition by bin)), 6) as value from counts")
def log1p_cpm(spark, sf_dir):
    c = Tables(spark, sf_dir).counts
    return c.select("bin", "gene", "n", F.round(maths.log1p_cpm(F.col("n"), F.sum("n").over(Window.partitionBy("bin"))), 6).alias("value"))


@register(
    "top_variance_genes",
    ctes("counts") + ", nb as (select count(*) nb from orders), m as (select gene, cast(sum(n) as double) s, cast(sum(n * n) as double) ss from counts group by 1), v as (select gene, ss / nb - (s / nb) * (s / nb) var from m, nb) select gene, round(var, 6) as variance from (select *, row_number() over (order by round(var, 9) desc, gene) rn from v) where rn <= 10",
)
def top_variance_genes(spark, sf_dir):
    """Population variance over all bins, zeros included, from two moments of the sparse counts."""
    t = Tables(spark, sf_dir)
    nb = t.raw("orders").count()
    n = F.col("n").cast("double")
    v = t.counts.groupBy("gene").agg((F.sum(n * n) / nb - (F.sum(n) / nb) * (F.sum(n) / nb)).alias("var"))
    return v.orderBy(F.round("var", 9).desc(), "gene").limit(10).select("gene", F.round("var", 6).alias("variance"))


@register(
    "cell_profile_reliability",
    ctes("counts", "owner_px") + ", p as (select cell, gene, sum(n) n from owner_px join counts on barcode = bin group by 1, 2), t as (select cell, cast(sum(n) as double) total from p group by 1), m as (select coalesce(quantile_cont(total, 0.5) * 0.5, 1.0) prior from t where total > 0) select cell, total, prior, round(total / (total + prior), 6) as reliability from t, m",
)
def cell_profile_reliability(spark, sf_dir):
    t = Tables(spark, sf_dir)
    member = t.owners("px").select(F.col("barcode").alias("bin"), "cell", F.lit(1.0).alias("weight"))
    _, totals = lk.cell_profile(member, t.counts, 0.5)
    return totals.select("cell", "total", "prior", F.round("reliability", 6).alias("reliability"))


@register(
    "profile_leave_one_out",
    ctes("counts", "owner_px") + ", own as (select cell, bin, gene, cast(n as double) n from owner_px join counts on barcode = bin), p as (select cell, gene, sum(n) n from own group by 1, 2), t as (select cell, sum(n) t from p group by 1), ot as (select cell, bin, sum(n) ot from own group by 1, 2), l as (select o.cell, o.bin, o.gene, o.n own, p.n - o.n rest from own o join p using (cell, gene)) select bin, cell, round(sum(own * ln((rest + 0.5) / (t - ot + 25.0))) / max(ot), 6) as score from l join t using (cell) join ot using (cell, bin) group by 1, 2",
)
def profile_leave_one_out(spark, sf_dir):
    """Log score of each bin under its owner's profile without the bin itself."""
    t = Tables(spark, sf_dir)
    own = t.owners("px").join(t.counts, F.col("barcode") == F.col("bin")).select("cell", "bin", "gene", F.col("n").cast("double").alias("n"))
    profile = own.groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    left = lk.leave_one_out(profile, own)
    totals = own.groupBy("cell").agg(F.sum("n").alias("t"))
    own_totals = own.groupBy("cell", "bin").agg(F.sum("n").alias("ot"))
    rows = left.join(totals, "cell").join(own_totals, ["cell", "bin"])
    return rows.groupBy("bin", "cell").agg(F.round(F.sum(F.col("own") * F.ln((F.col("n") + 0.5) / (F.col("t") - F.col("ot") + 25.0))) / F.max("ot"), 6).alias("score"))


@register(
    "profile_block_crossfit",
    ctes("counts", "owner_px", "grid") + """, own as (select cell, bin, cast(floor(x / 64) as bigint) bx, cast(floor(y / 64) as bigint) b_y, gene, cast(n as double) n from owner_px join counts on barcode = bin join grid using (bin)),
f as (select *, dense_rank() over (order by b_y, bx) - 1 fold from own), p as (select cell, gene, sum(n) n from f group by 1, 2), o as (select cell, fold, gene, sum(n) n from f group by 1, 2, 3), t as (select cell, sum(n) t from p group by 1), ot as (select cell, fold, sum(n) ot from o group by 1, 2)
select cell, fold, round(sum(o.n * ln((p.n - o.n + 0.5) / (t - ot + 25.0))) / max(ot), 6) as score from o join p using (cell, gene) join t using (cell) join ot using (cell, fold) group by 1, 2""",
)
def profile_block_crossfit(spark, sf_dir):
    """Folds are absolute blocks of the plane, numbered densely in block order."""
    t = Tables(spark, sf_dir)
    own = t.owners("px").join(t.counts, F.col("barcode") == F.col("bin")).join(t.grid, "bin")
    own = own.select("cell", maths.block_id(F.col("x"), 64).alias("bx"), maths.block_id(F.col("y"), 64).alias("by"), "gene", F.col("n").cast("double").alias("n"))
    # Blocks are few next to the bins: number them apart and join back.
    folds = ranked.places(own.select("bx", "by").distinct(), F.struct("by", "bx"), "fold").withColumn("fold", F.col("fold") - 1)
    folded = own.join(small(folds), ["bx", "by"]).groupBy("cell", "fold", "gene").agg(F.sum("n").alias("n"))
    profile = folded.groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    left = lk.leave_one_out(profile, folded, keys=("fold",))
    rows = left.join(folded.groupBy("cell").agg(F.sum("n").alias("t")), "cell").join(folded.groupBy("cell", "fold").agg(F.sum("n").alias("ot")), ["cell", "fold"])
    return rows.groupBy("cell", "fold").agg(F.round(F.sum(F.col("own") * F.ln((F.col("n") + 0.5) / (F.col("t") - F.col("ot") + 25.0))) / F.max("ot"), 6).alias("score"))


LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)


@register(
    "heldout_lambda_grid",
    ctes("counts", "bin_types", "owner_px") + "," + THETA_SQL
    + """, own as (select cell, bin, gene, cast(n as double) n from owner_px join counts on barcode = bin), nb as (select cell, count(distinct bin) nb from own group by 1), p as (select cell, gene, sum(n) n from own group by 1, 2), t as (select cell, sum(n) t from p group by 1), ot as (select cell, bin, sum(n) ot from own group by 1, 2),
m as (select o.cell, o.n, (p.n - o.n + 1e-6::double) / (t - ot + 50e-6::double) lp, th from own o join p using (cell, gene) join t using (cell) join ot using (cell, bin) join bin_types b using (bin) join theta h on h.k = b.k and h.gene = o.gene),
s as (select cell, lam, sum(n * ln(greatest(lam * lp + (1 - lam) * th, 1e-12))) s from m, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double lam) group by 1, 2),
b as (select cell, max(s) best from s group by 1)
select cell, case when nb < 2 then 0.0::double else min(lam) end as lambda from s join b using (cell) join nb using (cell) where s >= best - 1e-10 group by cell, nb""",
)
def heldout_lambda_grid(spark, sf_dir):
    """For each cell the mixing weight with the best held-out log mixture: the first within the tolerance."""
    t = Tables(spark, sf_dir)
    own = t.owners("px").join(t.counts, F.col("barcode") == F.col("bin")).select("cell", "bin", "gene", F.col("n").cast("double").alias("n"))
    profile = own.groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    rows = lk.leave_one_out(profile, own).join(own.groupBy("cell").agg(F.sum("n").alias("t"), F.count_distinct("bin").alias("nb")), "cell").join(own.groupBy("cell", "bin").agg(F.sum("n").alias("ot")), ["cell", "bin"])
    rows = rows.join(t.bin_types, "bin").join(theta_of(t), ["k", "gene"])
    lp = (F.col("n") + 1e-6) / (F.col("t") - F.col("ot") + 50e-6)
    # The grid is a fixed number of columns of one aggregate, not more rows.
    sums = rows.groupBy("cell", "nb").agg(*[F.sum(F.col("own") * F.ln(F.greatest(lam * lp + (1 - lam) * F.col("theta"), F.lit(1e-12)))).alias(f"s{i}") for i, lam in enumerate(LAMBDAS)])
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(LAMBDAS))])
    pick = F.coalesce(*[F.when(F.col(f"s{i}") >= best - 1e-10, F.lit(lam)) for i, lam in enumerate(LAMBDAS)])
    return sums.select("cell", F.when(F.col("nb") < 2, F.lit(0.0)).otherwise(pick).alias("lambda"))


@register(
    "posterior_predictive",
    ctes("counts", "bin_types") + "," + THETA_SQL + ", a as (select bin, n, th * 20.0::double a from counts join bin_types using (bin) join theta using (k, gene)) select bin, round((sum(lgamma(a + n) - lgamma(a)) - (lgamma(20.0::double + sum(n)) - lgamma(20.0::double))) / sum(n), 6) as score from a group by bin",
)
def posterior_predictive(spark, sf_dir):
    """Dirichlet-multinomial score of each bin under its type, as finite rising products."""
    t = Tables(spark, sf_dir)
    a = t.counts.join(t.bin_types, "bin").join(theta_of(t), ["k", "gene"]).withColumn("a", F.col("theta") * 20.0)
    s = a.groupBy("bin").agg(F.sum(lk.log_rising(F.col("a"), F.col("n"))).alias("num"), F.sum("n").alias("total"))
    return s.select("bin", F.round((F.col("num") - lk.log_rising(F.lit(20.0), F.col("total"))) / F.col("total"), 6).alias("score"))


@register("row_richness", ctes("counts") + ", p as (select bin, n, n / cast(sum(n) over (partition by bin) as double) s, row_number() over (partition by bin order by n desc, gene) r, sum(n) over (partition by bin) t from counts where n > 0) select bin, cast(max(t) as bigint) as total, count(*) as genes, round(max(s), 6) as top1, round(sum(case when r <= 3 then s else 0 end), 6) as top_share, round(1 - sum(s * s), 6) as simpson, round(-sum(s * ln(s)), 6) as entropy from p group by bin")
def row_richness(spark, sf_dir):
    r = lk.richness(Tables(spark, sf_dir).counts, top=3)
    return r.select("bin", "total", "genes", *[F.round(c, 6).alias(c) for c in ("top1", "top_share", "simpson")], F.round(F.col("entropy"), 6).alias("entropy"))


@register("expected_richness", ctes("counts") + ", t as (select bin, sum(n) t from counts group by 1) select bin, round(sum(1 - case when t - n < 10 then 0 else exp(lgamma(t - n + 1) - lgamma(t - n - 10 + 1) - lgamma(t + 1) + lgamma(t - 10 + 1)) end), 5) as expected from counts join t using (bin) where t >= 10 group by bin")
def expected_richness(spark, sf_dir):
    return lk.expected_richness(Tables(spark, sf_dir).counts, 10).select("bin", F.round("expected", 5).alias("expected"))


@register("hash_ranked_bins", ctes("counts") + ", b as (select distinct bin from counts) select bin, r as rank from (select bin, row_number() over (order by sha256('7:' || bin), bin) r from b) where r <= 200")
def hash_ranked_bins(spark, sf_dir):
    """Seeded, engine-independent choice: the first 200 bins in hash order (a top-k report)."""
    b = Tables(spark, sf_dir).counts.select("bin").distinct()
    top = b.withColumn("h", ids.hash_rank_key(7, F.col("bin"))).orderBy("h", "bin").limit(200)
    return top.select("bin", F.row_number().over(Window.orderBy("h", "bin")).alias("rank"))


@register("dominant_gene_top3", ctes("counts") + " select bin, gene, n, r as rank from (select *, row_number() over (partition by bin order by n desc, gene) r from counts) where r <= 3")
def dominant_gene_top3(spark, sf_dir):
    return ranked.top_k(Tables(spark, sf_dir).counts, ["bin"], [F.desc("n"), F.col("gene")], 3)
