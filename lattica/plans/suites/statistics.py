"""Ranks, distributions, resampling, shapes of vectors."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import maths
from ...operators import ranked, stats
from ..bindings import Tables, ctes
from ..catalog import register
from .spatial import R6

METHODS = "m as (select c_mktsegment method, c_nationkey split, round(avg(c_acctbal), 4) score from customer group by 1, 2)"


def methods(t: Tables):
    return t.raw("customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("split")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"))


@register("method_rank", f"with {METHODS} select method, split, score, rank() over (partition by split order by score desc) as rank from m")
def method_rank(spark, sf_dir):
    m = methods(Tables(spark, sf_dir))
    return m.withColumn("rank", ranked.competition_rank(F.col("score"), ["split"]))


@register("method_summary", f"with {METHODS} select method, count(*) as n, round(avg(score), 6) as mean, round(median(score), 6) as median, round(stddev_samp(score), 6) as sd, round(min(score), 6) as lo, round(max(score), 6) as hi from m group by method")
def method_summary(spark, sf_dir):
    m = methods(Tables(spark, sf_dir))
    return m.groupBy("method").agg(F.count("*").alias("n"), R6(F.avg("score"), "mean"), R6(F.percentile("score", F.lit(0.5)), "median"), R6(F.stddev_samp("score"), "sd"), R6(F.min("score"), "lo"), R6(F.max("score"), "hi"))


@register("paired_delta_pivot", f"with {METHODS} select split, max(score) filter (method = 'BUILDING') as building, max(score) filter (method = 'MACHINERY') as machinery, round(max(score) filter (method = 'BUILDING') - max(score) filter (method = 'MACHINERY'), 4) as delta from m group by split")
def paired_delta_pivot(spark, sf_dir):
    p = methods(Tables(spark, sf_dir)).groupBy("split").pivot("method", ["BUILDING", "MACHINERY"]).agg(F.max("score"))
    return p.select("split", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"), F.round(F.col("BUILDING") - F.col("MACHINERY"), 4).alias("delta"))


@register("melted_metrics", f"with {METHODS} select split, 'lo' as metric, min(score) as value from m group by split union all select split, 'hi', max(score) from m group by split")
def melted_metrics(spark, sf_dir):
    w = methods(Tables(spark, sf_dir)).groupBy("split").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return w.unpivot(["split"], ["lo", "hi"], "metric", "value")


@register("count_pivot", "with o as (select o_orderpriority p, o_orderstatus s from orders) select p as priority, count(*) filter (s = 'F') as f, count(*) filter (s = 'O') as o, count(*) filter (s = 'P') as p from o group by p")
def count_pivot(spark, sf_dir):
    o = Tables(spark, sf_dir).raw("orders")
    p = o.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return p.select("priority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


DRAWS, SEED = 40, 11


@register(
    "cluster_bootstrap_ci",
    f"""with d as (select c_nationkey cl, c_mktsegment k, c_acctbal v, 1.0::double w from customer), s as (select k, cl, sum(v * w) sv, sum(w) sw from d group by 1, 2), n as (select *, row_number() over (partition by k order by cl) - 1 i, count(*) over (partition by k) c from s),
p as (select k, draw, slot, cast(floor(cast('0x' || substr(sha256('{SEED}:' || k || ':' || draw || ':' || slot), 1, 13) as bigint)::double / {16**13}.0::double * c) as integer) i from (select k, c, i slot from n), range({DRAWS}) r(draw)),
m as (select p.k, draw, sum(sv) / sum(sw) m from p join n on n.k = p.k and n.i = p.i group by 1, 2), ci as (select k, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi from m group by 1)
select k as method, count(*) as clusters, round(sum(sv) / sum(sw), 6) as mean, round(max(lo), 6) as low, round(max(hi), 6) as high from s join ci using (k) group by k""",
)
def cluster_bootstrap_ci(spark, sf_dir):
    d = Tables(spark, sf_dir).raw("customer").select(F.col("c_nationkey").alias("cl"), F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("v"), F.lit(1.0).alias("w"))
    b = stats.cluster_bootstrap(d, "cl", "v", "w", DRAWS, SEED, ["method"])
    return b.select("method", "clusters", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@register("quartile_strata", "with e as (select quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) e from customer), b as (select c_acctbal v, greatest(len(list_filter(list_distinct(e), lambda x: x < c_acctbal)) - 1, 0) stratum from customer, e) select cast(stratum as integer) as stratum, count(*) as n, round(avg(v), 6) as mean, min(v) as lo, max(v) as hi from b group by 1")
def quartile_strata(spark, sf_dir):
    c = ranked.quantile_cut(Tables(spark, sf_dir).raw("customer").select(F.col("c_acctbal").alias("v")), "v", [], 4, "stratum")
    return c.groupBy("stratum").agg(F.count("*").alias("n"), R6(F.avg("v"), "mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@register("auc_corrected_damaged", "with d as (select n_chars s, quality y from documents join labels using (doc_id)), r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 rk from d) select round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 6)::double as auc, count(*) filter (y = 1) as positives, count(*) filter (y = 0) as negatives from r")
def auc_corrected_damaged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.raw("documents").select("doc_id", "n_chars").join(t.raw("labels").select("doc_id", "quality"), "doc_id")
    return stats.auc(d, "n_chars", "quality").select(R6(F.col("auc"), "auc"), "positives", "negatives")


PROFILES = "a as (select l_suppkey cell, l_partkey % 50 gene, sum(l_quantity) n from lineitem where l_linenumber % 2 = 0 group by 1, 2), b as (select l_suppkey cell, l_partkey % 50 gene, sum(l_quantity) n from lineitem where l_linenumber % 2 = 1 group by 1, 2), j as (select coalesce(a.cell, b.cell) cell, coalesce(a.gene, b.gene) gene, coalesce(a.n, 0) x, coalesce(b.n, 0) y from a full join b on a.cell = b.cell and a.gene = b.gene)"


def profiles(t: Tables):
    p = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene"))
    even = F.col("l_linenumber") % 2 == 0
    return p.agg(F.sum(F.when(even, F.col("l_quantity")).otherwise(0.0)).alias("x"), F.sum(F.when(~even, F.col("l_quantity")).otherwise(0.0)).alias("y"))


@register("gene_spearman", f"with {PROFILES}, r as (select cell, x, y, rank() over (partition by cell order by x) + (count(*) over (partition by cell, x) - 1) / 2.0::double rx, rank() over (partition by cell order by y) + (count(*) over (partition by cell, y) - 1) / 2.0::double ry from j) select cell, count(*) as n, round(case when min(x) <> max(x) and min(y) <> max(y) and count(*) >= 3 then corr(x, y) end, 6) as pearson, round(case when min(x) <> max(x) and min(y) <> max(y) and count(*) >= 3 then corr(rx, ry) end, 6) as spearman from r group by cell")
def gene_spearman(spark, sf_dir):
    c = stats.correlations(profiles(Tables(spark, sf_dir)), "x", "y", ["cell"])
    return c.select("cell", "n", R6(F.col("pearson"), "pearson"), R6(F.col("spearman"), "spearman"))


@register("gene_rmse", f"with {PROFILES} select cell, round(sqrt(avg((x - y) * (x - y))), 6) as rmse, count(*) filter (x > 0) as detected_x, count(*) filter (y > 0) as detected_y, round(sum(least(x, y)) / nullif(sum(x), 0), 6) as precision, round(sum(least(x, y)) / nullif(sum(y), 0), 6) as recall from j group by cell")
def gene_rmse(spark, sf_dir):
    p = profiles(Tables(spark, sf_dir))
    d = F.col("x") - F.col("y")
    both = F.sum(F.least("x", "y"))
    return p.groupBy("cell").agg(R6(F.sqrt(F.avg(d * d)), "rmse"), F.count_if(F.col("x") > 0).alias("detected_x"), F.count_if(F.col("y") > 0).alias("detected_y"), R6(F.try_divide(both, F.sum("x")), "precision"), R6(F.try_divide(both, F.sum("y")), "recall"))


@register(
    "ks_wasserstein_js",
    """with a as (select l_returnflag k, round(ln(1 + l_quantity), 6) v from lineitem where l_linestatus = 'O'), b as (select l_returnflag k, round(ln(1 + l_quantity), 6) v from lineitem where l_linestatus = 'F'),
c as (select k, v, sum(a) a, sum(b) b from (select k, v, 1 a, 0 b from a union all select k, v, 0, 1 from b) group by 1, 2), f as (select k, v, a / sum(a) over (partition by k)::double pa, b / sum(b) over (partition by k)::double pb, sum(a) over w / sum(a) over (partition by k)::double fa, sum(b) over w / sum(b) over (partition by k)::double fb, lead(v) over (partition by k order by v) - v gap from c window w as (partition by k order by v rows unbounded preceding))
select k as flag, round(max(abs(fa - fb)), 6) as ks, round(sum(abs(fa - fb) * coalesce(gap, 0)), 6) as wasserstein, round(sqrt(greatest(0, (sum(case when pa > 0 then pa * ln(pa / ((pa + pb) / 2)) else 0 end) + sum(case when pb > 0 then pb * ln(pb / ((pa + pb) / 2)) else 0 end)) / 2)), 6) as js from f group by k""",
)
def ks_wasserstein_js(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_returnflag").alias("flag"), F.round(F.log1p("l_quantity"), 6).alias("v"), "l_linestatus")
    a, b = (li.filter(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("O", "F"))
    counted = lambda d: d.groupBy("flag", "v").agg(F.count("*").alias("n"))
    j = stats.two_sample(a, b, "v", ["flag"]).join(stats.jensen_shannon(counted(a), counted(b), ["v"], ["flag"]), "flag")
    return j.select("flag", R6(F.col("ks"), "ks"), R6(F.col("wasserstein"), "wasserstein"), R6(F.col("js"), "js"))


@register("distribution_summary", "select l_shipdate >= timestamp '2000-01-01' as late, l_linestatus as status, count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_pop(l_extendedprice), 4) as sd, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) as cv, round(quantile_cont(l_extendedprice, 0.05), 4) as q05, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.95), 4) as q95 from lineitem group by 1, 2")
def distribution_summary(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem").select((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("late"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    d = stats.describe(li, "l_extendedprice", ["late", "status"])
    return d.select("late", "status", "n", *[F.round(c, 6 if c == "cv" else 4).alias(c) for c in ("mean", "sd", "cv", "q05", "median", "q95")])


@register("signal_quantiles_with_all", "select coalesce(l_returnflag, 'all') as flag, count(*) as n, round(quantile_cont(l_quantity, 0.5), 6) as median, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) as iqr, round(quantile_cont(l_quantity, 0.05), 6) as q05, round(quantile_cont(l_quantity, 0.95), 6) as q95 from lineitem group by rollup (l_returnflag)")
def signal_quantiles_with_all(spark, sf_dir):
    li = stats.with_all(Tables(spark, sf_dir).raw("lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity"), "flag")
    d = stats.describe(li, "l_quantity", ["flag"])
    return d.select("flag", "n", R6(F.col("median"), "median"), R6(F.col("q75") - F.col("q25"), "iqr"), R6(F.col("q05"), "q05"), R6(F.col("q95"), "q95"))


@register("rollup_cube_totals", "select l_returnflag as flag, l_linestatus as status, cast(sum(cast(l_quantity as bigint)) as bigint) as qty, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def rollup_cube_totals(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem")
    return li.cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count("*").alias("n"))


@register("matched_count_bands", "with t as (select l_orderkey b, sum(l_quantity) q, count(distinct l_suppkey) c from lineitem group by 1), bands as (select * from (values (0, 60), (40, 120), (100, 200), (150, 400)) v(lo, hi)) select lo, hi, count(*) as n, round(avg(c), 6) as mean_cells, count(*) >= 20 as enough from t join bands on q >= lo and q < hi group by lo, hi")
def matched_count_bands(spark, sf_dir):
    """Overlapping bands [lo, hi): an explode of the bands a row is in."""
    bands = [(0, 60), (40, 120), (100, 200), (150, 400)]
    t = Tables(spark, sf_dir).raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count_distinct("l_suppkey").alias("c"))
    hit = F.array_compact(F.array(*[F.when((F.col("q") >= lo) & (F.col("q") < hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for lo, hi in bands]))
    return t.select("c", F.explode(hit).alias("b")).groupBy("b.lo", "b.hi").agg(F.count("*").alias("n"), R6(F.avg("c"), "mean_cells"), (F.count("*") >= 20).alias("enough"))


@register("type_frequency_filter", "select p_type as type, n, row_number() over (order by n desc, p_type) as place from (select p_type, count(*) n from part group by 1) where n >= 20")
def type_frequency_filter(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n")).filter("n >= 20")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "type")))


@register("contingency", "with a as (select distinct p_brand b from part), s as (select distinct p_size % 5 z from part) select b as brand, z as size_class, count(p_partkey) as n from a cross join s left join part on p_brand = b and p_size % 5 = z group by 1, 2")
def contingency(spark, sf_dir):
    """Zero-filled cross table in long form."""
    p = Tables(spark, sf_dir).raw("part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 5).alias("size_class"))
    axes = p.select("brand").distinct().crossJoin(F.broadcast(p.select("size_class").distinct()))
    return axes.join(p.groupBy("brand", "size_class").agg(F.count("*").alias("n")), ["brand", "size_class"], "left").select("brand", "size_class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("group_size_maximum", "select t as type, max(n) as most from (select p_type t, p_brand b, p_size % 7 z, count(*) n from part group by 1, 2, 3) group by 1")
def group_size_maximum(spark, sf_dir):
    g = Tables(spark, sf_dir).raw("part").groupBy(F.col("p_type").alias("type"), "p_brand", F.col("p_size") % 7).agg(F.count("*").alias("n"))
    return g.groupBy("type").agg(F.max("n").alias("most"))


@register(
    "donor_split_best",
    "with d as (select r_name nm, cast(count(*) as double) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1), k as (select *, row_number() over (order by nm) - 1 i, count(*) over () c, sum(n) over () t from d), m as (select mask, sum(n) filter ((mask >> i) & 1 = 1) / max(t) s, string_agg(nm, ',' order by nm) filter ((mask >> i) & 1 = 1) side from k, range(1, 31) r(mask) group by mask) select side, round(s, 6) as share from m where s between 0.2 and 0.8 order by round(abs(s - 0.5), 9), string_split(side, ',') limit 1",
)
def donor_split_best(spark, sf_dir):
    """All splits of the few donors; their totals are one aggregate."""
    t = Tables(spark, sf_dir)
    d = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    totals = {r["r_name"]: float(r["n"]) for r in d.collect()}
    side, _ = stats.donor_splits(totals, 0.2)[0]
    return spark.createDataFrame([(",".join(side), round(sum(totals[s] for s in side) / sum(totals.values()), 6))], "side string, share double")


@register("largest_remainder", "with w as (select l_orderkey k, l_suppkey c, sum(l_quantity) w from lineitem group by 1, 2), x as (select *, 10 * w / sum(w) over (partition by k) x from w), f as (select *, floor(x) fl, 10 - sum(floor(x)) over (partition by k) lft, row_number() over (partition by k order by round(x - floor(x), 9) desc, c) r from x) select k as bin, c as cell, cast(fl + case when r <= lft then 1 else 0 end as bigint) as share from f")
def largest_remainder(spark, sf_dir):
    w = Tables(spark, sf_dir).raw("lineitem").groupBy(F.col("l_orderkey").alias("bin"), F.col("l_suppkey").alias("cell")).agg(F.sum("l_quantity").alias("w"))
    return stats.largest_remainder(w, ["bin"], "w", F.lit(10), ["cell"]).select("bin", "cell", "share")


VALL = "v as (select vec_id, label, [cast(x as double) for x in embedding] e from embeddings)"


def whole_vectors(t: Tables):
    """All components of every vector."""
    return t.raw("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def components(v) -> int:
    """Length of the vectors, from the data."""
    return v.agg(F.max(F.size("e"))).first()[0] or 0


@register(
    "gaussian_mixture_score",
    f"""with {VALL}, m as (select label, i, avg(e[i]) mu, greatest(var_pop(e[i]), 1e-6) s from v, unnest(range(1, len(e) + 1)) r(i) group by 1, 2), p as (select label, count(*) / (select count(*) from v)::double p from v group by 1),
l as (select v.vec_id, m.label, -0.5 * sum((e[i] - mu) * (e[i] - mu) / s + ln(s) + ln(2 * pi())) g from v cross join m group by 1, 2), z as (select vec_id, max(ln(p) + g) mx, max(ln(p) + g) + ln(sum(exp(ln(p) + g - mm))) ls from (select *, max(ln(p) + g) over (partition by vec_id) mm from l join p using (label)) group by vec_id) select vec_id, round(mx, 5) as best, round(ls, 5) as mixture from z""",
)
def gaussian_mixture_score(spark, sf_dir):
    v = whole_vectors(Tables(spark, sf_dir))
    return _mixture(v, components(v))


def _mixture(v, size: int):
    """Diagonal Gaussians by label; the best component and the log of the mixture."""
    stat = v.groupBy("label").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(size)]).alias("mu"), F.array(*[F.greatest(F.var_pop(F.col("e")[i]), F.lit(1e-6)) for i in range(size)]).alias("var"), F.count("*").alias("n"))
    stat = stat.withColumn("lp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy())))
    g = v.select("vec_id", "e").crossJoin(F.broadcast(stat)).select("vec_id", (F.col("lp") + maths.gaussian_diagonal(F.col("e"), F.col("mu"), F.col("var"))).alias("s"))
    top = g.groupBy("vec_id").agg(F.max("s").alias("best"), F.collect_list("s").alias("all"))
    mixture = F.col("best") + F.ln(F.aggregate("all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("best"))))
    # Two steps: an alias of the same name would be taken inside the lambda.
    both = top.select("vec_id", F.col("best").alias("b"), mixture.alias("m"))
    return both.select("vec_id", F.round("b", 5).alias("best"), F.round("m", 5).alias("mixture"))


@register("shape_zscore", f"with {VALL}, u as (select vec_id, i, e[i] x from v, unnest(range(1, len(e) + 1)) r(i)), s as (select i, avg(x) mu, greatest(stddev_pop(x), 1e-8) sd from u group by 1) select vec_id, round(max(abs((x - mu) / sd)), 5) as most, round(avg(least(greatest((x - mu) / sd, -2.5), 2.5)), 5) as mean_clipped from u join s using (i) group by vec_id")
def shape_zscore(spark, sf_dir):
    v = whole_vectors(Tables(spark, sf_dir))
    return _zscore(v, components(v))


def _zscore(v, size: int):
    s = v.agg(F.array(*[F.avg(F.col("e")[i]) for i in range(size)]).alias("mu"), F.array(*[F.greatest(F.stddev_pop(F.col("e")[i]), F.lit(1e-8)) for i in range(size)]).alias("sd"))
    z = F.zip_with(F.zip_with("e", "mu", lambda x, m: x - m), "sd", lambda d, q: d / q)
    clipped = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.least(F.greatest(x, F.lit(-2.5)), F.lit(2.5)))
    d = v.crossJoin(F.broadcast(s)).withColumn("z", z)
    return d.select("vec_id", F.round(F.array_max(F.transform("z", lambda x: F.abs(x))), 5).alias("most"), F.round(clipped / size, 5).alias("mean_clipped"))


@register(
    "small_cluster_merge",
    f"""with {VALL}, c as (select *, label * 7 + vec_id % 7 k from v), n as (select k, count(*) n from c group by 1), q as (select quantile_cont(n, 0.5) q from n), m as (select k, i, avg(e[i]) x from c, unnest(range(1, len(e) + 1)) r(i) group by 1, 2),
d as (select a.k, b.k t, sum((ma.x - mb.x) ** 2) d from n a, n b, q, m ma, m mb where a.n < q and b.n >= q and ma.k = a.k and mb.k = b.k and ma.i = mb.i group by 1, 2), g as (select k, t from (select *, row_number() over (partition by k order by round(d, 12), t) rn from d) where rn = 1),
f as (select coalesce(t, c.k) f from c left join g using (k)) select cast(dense_rank() over (order by f) - 1 as integer) as cluster, count(*) as n from f group by f""",
)
def small_cluster_merge(spark, sf_dir):
    v = whole_vectors(Tables(spark, sf_dir))
    return _merged(v, components(v))


def _merged(v, size: int):
    """Clusters under the median size go to the nearest large centroid; names are made dense in order."""
    from ...operators import learn

    k = v.withColumn("k", F.col("label") * 7 + F.col("vec_id") % 7).select("vec_id", "k", "e")
    return learn.merge_small(k, "k", "e", size).groupBy("cluster").agg(F.count("*").alias("n"))


@register("label_mode_percent", "select p_brand as cell, count(*) as n, sum(case when p_size > 25 then 1 else 0 end)::bigint as large, round(100.0::double * sum(case when p_size > 25 then 1 else 0 end) / count(*), 6) as percent, (select t from (select p_type t, count(*) c from part q where q.p_brand = part.p_brand group by 1) order by c desc, t limit 1) as label from part group by p_brand")
def label_mode_percent(spark, sf_dir):
    """Most frequent label (the least of equals) and a share."""
    p = Tables(spark, sf_dir).raw("part")
    big = F.sum((F.col("p_size") > 25).cast("long"))
    return p.groupBy(F.col("p_brand").alias("cell")).agg(F.count("*").alias("n"), big.alias("large"), R6(100.0 * big / F.count("*"), "percent"), F.mode("p_type", True).alias("label"))


@register("cell_nucleus_argmax", "with c as (select l_suppkey cell, l_partkey % 20 nucleus, count(*) n from lineitem group by 1, 2) select cell, nucleus, n from (select *, row_number() over (partition by cell order by n desc, nucleus) rn from c) where rn = 1")
def cell_nucleus_argmax(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 20).alias("nucleus")).agg(F.count("*").alias("n"))
    return c.groupBy("cell").agg(F.min_by(F.struct("nucleus", "n"), F.struct((-F.col("n")).alias("m"), F.col("nucleus"))).alias("r")).select("cell", "r.*")


@register("transcript_bin_genes", "select cast(ceil(l_extendedprice / 2000) as bigint) as bx, l_suppkey % 8 as b_y, l_partkey % 50 as gene, count(*) as n from lineitem where l_quantity >= 20 group by 1, 2, 3")
def transcript_bin_genes(spark, sf_dir):
    """Quality filter, ceiling bins, counts by bin and gene, kept long."""
    li = Tables(spark, sf_dir).raw("lineitem").filter("l_quantity >= 20")
    return li.groupBy(F.ceil(F.col("l_extendedprice") / 2000).alias("bx"), (F.col("l_suppkey") % 8).alias("b_y"), (F.col("l_partkey") % 50).alias("gene")).agg(F.count("*").alias("n"))


@register("acceptance_gates", f"with {METHODS}, s as (select method, avg(score) mean, min(score) lo, count(*) filter (score > 4500) / count(*)::double share from m group by 1) select method, concat_ws(',', case when mean <= 4500 then 'mean' end, case when lo <= 3000 then 'low' end, case when share <= 0.5 then 'majority' end) as failed from s")
def acceptance_gates(spark, sf_dir):
    """The list of failed checks; empty means accepted."""
    s = methods(Tables(spark, sf_dir)).groupBy("method").agg(F.avg("score").alias("mean"), F.min("score").alias("lo"), (F.count_if(F.col("score") > 4500) / F.count("*")).alias("share"))
    return s.select("method", F.concat_ws(",", F.when(F.col("mean") <= 4500, "mean"), F.when(F.col("lo") <= 3000, "low"), F.when(F.col("share") <= 0.5, "majority")).alias("failed"))


GRID = list(itertools.product((0.5, 1.0), (1, 2, 3), ("a", "b")))


@register("config_sweep", "select a as alpha, k as rounds, m as mode, cast(row_number() over (order by a, k, m) - 1 as integer) as config from (select unnest([0.5, 1.0])::double a), (select unnest([1, 2, 3]) k), (select unnest(['a', 'b']) m)")
def config_sweep(spark, sf_dir):
    """The product of parameter grids."""
    return spark.createDataFrame([(a, k, m, i) for i, (a, k, m) in enumerate(GRID)], "alpha double, rounds int, mode string, config int")


@register("finite_mean_median", "select label, count(*) filter (x is not null) as n, round(avg(x), 6) as mean_x, round(median(x), 6) as median_x from (select label % 3 as label, case when vec_id % 11 = 0 then null else cast(embedding[1] as double) end x from embeddings) group by label")
def finite_mean_median(spark, sf_dir):
    """NaN and infinities are dropped before mean and median."""
    from ...functions.ids import json_number

    v = Tables(spark, sf_dir).raw("embeddings").select((F.col("label") % 3).alias("label"), F.when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("embedding")[0].cast("double")).alias("raw"))
    x = v.withColumn("x", json_number(F.col("raw")))
    return x.groupBy("label").agg(F.count("x").alias("n"), R6(F.avg("x"), "mean_x"), R6(F.percentile("x", F.lit(0.5)), "median_x"))
