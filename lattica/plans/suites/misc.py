"""Selections, scores, summaries and simulations that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import ids, maths
from ...operators import ranked, select, spatial
from ...operators import likelihood as lk
from ..bindings import Tables, ctes
from ..catalog import register
from .likelihood import THETA_SQL, theta_of
from .spatial import NEAR, PATCHES, R6, centers, patches
from .statistics import METHODS, VALL, components, methods, whole_vectors


@register("context_bins", ctes("grid") + "," + PATCHES + " select count(*) as bins, round(sum(x), 3) as sx, round(sum(y), 3) as sy from grid where exists (select 1 from patches where x between x0 and x1 and y between y0 and y1)")
def context_bins(spark, sf_dir):
    """A bin stays when it is inside at least one patch."""
    g = Tables(spark, sf_dir).grid.select("bin", "x", "y")
    kept = select.in_any_rectangle(g, patches(spark), "patch", 64.0, ["bin"])
    return kept.agg(F.count("*").alias("bins"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


@register("quality_filtered_counts", ctes("counts") + ", g as (select gene from counts where n > 0 group by 1 having count(*) >= 1150), k as (select * from counts where gene in (select gene from g)), b as (select bin from k group by 1 having sum(n) >= 40) select bin, gene, n from k where bin in (select bin from b)")
def quality_filtered_counts(spark, sf_dir):
    return select.quality_filter(Tables(spark, sf_dir).counts, 1150, 40).select("bin", "gene", "n")


@register("empty_nucleus_filter", ctes("counts", "pairs") + ", s as (select cell, barcode from pairs where px >= 45), t as (select cell, cast(sum(n) as bigint) t from (select distinct cell, barcode from s) join counts on bin = barcode group by 1) select cell, t as total from t where t > 2000")
def empty_nucleus_filter(spark, sf_dir):
    """Cells whose distinct confident bins have counts over a threshold."""
    t = Tables(spark, sf_dir)
    totals = t.counts.groupBy(F.col("bin").alias("barcode")).agg(F.sum("n").alias("n"))
    s = t.pairs.filter("px >= 45").select("cell", "barcode").distinct()
    return s.join(totals, "barcode").groupBy("cell").agg(F.sum("n").alias("total")).filter("total > 2000")


@register("confidence_relabel", "select c_custkey as id, row_number() over (order by c_custkey) as label from customer where c_acctbal >= 5000")
def confidence_relabel(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"))
    return select.relabel(c, "s", 5000.0, "id").select("id", "label")


@register("first_seen_ids", "with r as (select cast(l_suppkey as varchar) id, min(l_orderkey * 1000 + l_linenumber) f from lineitem group by 1) select id, row_number() over (order by f, id) as place from r")
def first_seen_ids(spark, sf_dir):
    """Distinct normalised ids in the order of first occurrence."""
    li = Tables(spark, sf_dir).raw("lineitem")
    r = li.groupBy(ids.normalize_cell_id(F.col("l_suppkey").cast("double").cast("string")).alias("id")).agg(F.min(F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("f"))
    return ranked.places(r, F.struct("f", "id")).select("id", "place")


@register("best_variant", f"with {METHODS}, s as (select method, split, score, row_number() over (partition by split order by score desc, method) rn from m) select split, method, score from s where rn = 1")
def best_variant(spark, sf_dir):
    m = methods(Tables(spark, sf_dir))
    return m.groupBy("split").agg(F.min_by(F.struct("method", "score"), F.struct((-F.col("score")).alias("s"), F.col("method"))).alias("b")).select("split", "b.*")


@register("largest_means", "with g as (select p_type t, p_brand b, avg(p_retailprice) m from part group by 1, 2) select t as type, b as brand, round(m, 6) as mean, rn as place from (select *, row_number() over (partition by t order by round(m, 9) desc, b) rn from g) where rn <= 5")
def largest_means(spark, sf_dir):
    g = Tables(spark, sf_dir).raw("part").groupBy(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("m"))
    return ranked.top_k(g, ["type"], [F.round("m", 9).desc(), F.col("brand")], 5, "place").select("type", "brand", R6(F.col("m"), "mean"), "place")


@register("head_and_tail", "with r as (select o_custkey k, o_orderkey o, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) a, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) z from orders) select k as key, max(o) filter (a = 1) as head, max(o) filter (z = 1) as tail from r group by k")
def head_and_tail(spark, sf_dir):
    """First and last of each group in one aggregate."""
    o = Tables(spark, sf_dir).raw("orders")
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.min_by("o_orderkey", at).alias("head"), F.max_by("o_orderkey", at).alias("tail"))


@register("nulls_last_order", "with m as (select c_custkey id, case when c_custkey % 7 = 0 then null else c_acctbal end v from customer) select id, row_number() over (order by v nulls last, id) as place from m")
def nulls_last_order(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    return ranked.places(c, F.struct(F.col("v").isNull().alias("null"), "v", "id")).select("id", "place")


@register("float_keyed_point", "select a as alpha, b as beta, n from (select p_size % 5 * 0.1::double a, p_size % 3 * 0.25::double b, count(*) n from part group by 1, 2) where abs(a - 0.3) <= 1e-9 and abs(b - 0.5) <= 1e-9")
def float_keyed_point(spark, sf_dir):
    p = Tables(spark, sf_dir).raw("part")
    g = p.groupBy((F.col("p_size") % 5 * F.lit(0.1)).alias("alpha"), (F.col("p_size") % 3 * F.lit(0.25)).alias("beta")).agg(F.count("*").alias("n"))
    return g.filter(select.close_to({"alpha": 0.3, "beta": 0.5}))


#: The rule as it is said, one point after the other: a row for each tile and step, with the points that stayed.
SEPARATED = ctes("centers").replace("with ", "with recursive ", 1) + """,
ranked as (select cell, x, y, floor(x / 64) tile, row_number() over (partition by floor(x / 64) order by sha256('5:' || cell), cell) r from centers),
walk as (select tile, cast(0 as bigint) r, cast([] as struct(cell bigint, x double, y double)[]) kept from (select distinct tile from ranked)
  union all select walk.tile, ranked.r, case when len(list_filter(kept, lambda k: sqrt((k.x - ranked.x) ** 2 + (k.y - ranked.y) ** 2) < 12)) = 0
    then list_append(kept, {'cell': cast(ranked.cell as bigint), 'x': ranked.x, 'y': ranked.y}) else kept end
  from walk join ranked on ranked.tile = walk.tile and ranked.r = walk.r + 1),
ends as (select tile, unnest(arg_max(kept, r)) k from walk group by tile)
select k.cell as cell, k.x as x, k.y as y, cast(tile as bigint) as tile from ends"""


@register("separated_points", SEPARATED)
def separated_points(spark, sf_dir):
    """Greedy spatially separated centres in each tile."""
    c = Tables(spark, sf_dir).centers.select("cell", "x", "y", F.floor(F.col("x") / 64).alias("tile"))
    return select.separated(c, "cell", ["tile"], 12.0, 5)


@register("padded_batches", "with s as (select c_nationkey k, list(c_acctbal order by c_custkey) v from customer group by 1), m as (select max(len(v)) m from s) select k as key, m as width, len(v) as used, round(list_sum(v), 4) as total from s, m")
def padded_batches(spark, sf_dir):
    return _padded(Tables(spark, sf_dir).raw("customer"))


def _padded(customers):
    """Ragged rows padded to the longest, with a mask."""
    c = customers.select(F.col("c_nationkey").alias("key"), "c_custkey", "c_acctbal")
    p = select.padded(c, "key", "c_custkey", "c_acctbal")
    total = F.aggregate(F.zip_with("values", "mask", lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)
    return p.select("key", F.size("values").cast("long").alias("width"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("used"), F.round(total, 4).alias("total"))


@register("scaled_features", "select o_orderkey as id, round(ln(1 + least(greatest(o_totalprice, 0), 200000)) / ln(1 + 200000::double), 6) as price, round((o_custkey % 97)::double / 97, 6) as phase from orders")
def scaled_features(spark, sf_dir):
    o = Tables(spark, sf_dir).raw("orders")
    return o.select(F.col("o_orderkey").alias("id"), R6(maths.scaled_feature(F.col("o_totalprice"), 200_000), "price"), R6((F.col("o_custkey") % 97) / 97.0, "phase"))


@register("projective_points", ctes("centers") + " select cell, round((1.1 * x + 0.05 * y + 3) / (0.0005 * x + 0.0002 * y + 1), 6) as u, round((-0.02 * x + 0.95 * y + 1) / (0.0005 * x + 0.0002 * y + 1), 6) as v from centers")
def projective_points(spark, sf_dir):
    c = Tables(spark, sf_dir).centers
    u, v = maths.projective(F.col("x"), F.col("y"), (1.1, 0.05, 3.0, -0.02, 0.95, 1.0, 0.0005, 0.0002, 1.0))
    return c.select("cell", R6(u, "u"), R6(v, "v"))


@register("dimension_cosines", f"with {VALL}, u as (select vec_id, i, e[i] x from v, unnest(range(1, len(e) + 1)) r(i)) select cast(a.i as integer) as a, cast(b.i as integer) as b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) as cosine from u a join u b using (vec_id) where a.i < b.i group by 1, 2")
def dimension_cosines(spark, sf_dir):
    """Column-wise cosines of all components: each adds its products with all, so that no aggregate holds every pair."""
    v = whole_vectors(Tables(spark, sf_dir))
    size = components(v)
    rows = v.select("e", F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.array(*[F.sum(F.col("x") * F.col("e")[j]) for j in range(size)]).alias("s"))
    pairs = rows.select("i", F.posexplode("s").alias("j", "s"))
    norms = pairs.filter("i = j").select(F.col("i").alias("k"), F.sqrt("s").alias("l"))
    a, b = (norms.select(F.col("k").alias(c), F.col("l").alias(f"l{c}")) for c in "ij")
    j = pairs.filter("i < j").join(a, "i").join(b, "j")
    return j.select((F.col("i") + 1).alias("a"), (F.col("j") + 1).alias("b"), R6(F.col("s") / (F.col("li") * F.col("lj")), "cosine"))


@register("nearest_seed_distance", ctes("grid", "centers", "pairs") + "," + NEAR + ", s as (select cell, x, y from pairs join grid on barcode = bin where px >= 45), d as (select near.bin, near.cell, near.d, min(sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2)) q from near join grid g on g.bin = near.bin left join s on s.cell = near.cell and (g.x - s.x) ** 2 + (g.y - s.y) ** 2 <= 400 group by 1, 2, 3) select bin, cell, round(coalesce(q, d), 6) as distance, q is not null as by_seed from d")
def nearest_seed_distance(spark, sf_dir):
    """Distance to the nearest own seed within reach, else to the nucleus."""
    t = Tables(spark, sf_dir)
    near = spatial.radius_join(t.grid.select("bin", "x", "y"), centers(t), 20.0).select("bin", "x", "y", "cell", F.col("d").alias("dn"))
    seeds = t.pairs.filter("px >= 45").join(t.grid, F.col("barcode") == F.col("bin")).select(F.col("cell").alias("sc"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    hit = spatial.radius_join(near, seeds, 20.0, F.col("cell") == F.col("sc")).groupBy("bin", "cell").agg(F.min("d").alias("q"))
    return near.join(hit, ["bin", "cell"], "left").select("bin", "cell", R6(F.coalesce("q", "dn"), "distance"), F.col("q").isNotNull().alias("by_seed"))


@register("ratio_scores", ctes("counts", "bin_types") + "," + THETA_SQL + ", s as (select bin, max(ll) - min(ll) g from ll group by 1) select bin, round((g - min(g) over ()) / (max(g) over () - min(g) over ()) + 0.1 * (bin % 7), 6) as score from s")
def ratio_scores(spark, sf_dir):
    """Min-max scaled likelihood gap plus a spatial term; the scale is one aggregate."""
    t = Tables(spark, sf_dir)
    s = lk.log_likelihood(t.counts, theta_of(t)).groupBy("bin").agg((F.max("ll") - F.min("ll")).alias("g"))
    e = s.agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return s.crossJoin(F.broadcast(e)).select("bin", R6((F.col("g") - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.1 * (F.col("bin") % 7), "score"))


@register("objective_components", ctes("pairs") + " select cell, round(sum(px) * 1.0::double / 10, 4) as confidence_part, round(-sum(case when px < 10 then 0.25 else 0 end)::double, 4) as penalty_part, round((sum(px) / 10.0 - sum(case when px < 10 then 0.25 else 0 end))::double / count(*), 6) as objective from pairs group by cell")
def objective_components(spark, sf_dir):
    p = Tables(spark, sf_dir).pairs
    gain, penalty = F.sum("px") / 10.0, F.sum(F.when(F.col("px") < 10, 0.25).otherwise(0.0))
    return p.groupBy("cell").agg(F.round(gain, 4).alias("confidence_part"), F.round(-penalty, 4).alias("penalty_part"), R6((gain - penalty) / F.count("*"), "objective"))


@register("zero_coverage_scopes", "with s as (select o_custkey % 12 patch, o_orderstatus method, count(*) filter (o_totalprice > 400000) c from orders group by 1, 2) select method, count(*) as scopes, count(*) filter (c = 0) as empty, round(count(*) filter (c = 0) / greatest(count(*), 1)::double, 6) as share from s group by method")
def zero_coverage_scopes(spark, sf_dir):
    o = Tables(spark, sf_dir).raw("orders")
    s = o.groupBy(F.col("o_custkey") % 12, F.col("o_orderstatus").alias("method")).agg(F.count_if(F.col("o_totalprice") > 400_000).alias("c"))
    none = F.count_if(F.col("c") == 0)
    return s.groupBy("method").agg(F.count("*").alias("scopes"), none.alias("empty"), R6(none / F.greatest(F.count("*"), F.lit(1)), "share"))


@register("residual_field", ctes("counts", "grid") + ', t as (select "row" rw, col, cast(n as double) n from grid join (select bin, sum(n) n from counts group by 1) using (bin)), m as (select avg(n) mu, var_pop(n) v from t), r as (select rw, col, n / mu - 1 r from t, m), l as (select avg(a.r * b.r) c from r a join r b on a.rw = b.rw and b.col = a.col + 1) select round(mu, 6) as mean, round(greatest(v - mu, 0) / (mu * mu), 6) as excess, round(c, 6) as lag_one from m, l')
def residual_field(spark, sf_dir):
    """Relative residuals of depth: variance beyond counting noise, and the covariance of neighbours."""
    t = Tables(spark, sf_dir)
    bins = t.counts.groupBy("bin").agg(F.sum("n").cast("double").alias("n")).join(t.grid, "bin").select("row", "col", "n")
    m = bins.agg(F.avg("n").alias("mu"), F.var_pop("n").alias("v"))
    r = bins.crossJoin(F.broadcast(m)).select("row", "col", (F.col("n") / F.col("mu") - 1).alias("r"))
    lag = spatial.lag_pairs(r, (0, 1), "r").agg(F.avg(F.col("a") * F.col("b")).alias("c"))
    return m.crossJoin(lag).select(R6(F.col("mu"), "mean"), R6(F.greatest(F.col("v") - F.col("mu"), F.lit(0.0)) / (F.col("mu") * F.col("mu")), "excess"), R6(F.col("c"), "lag_one"))


@register("two_value_pivot", f"with {METHODS} select split, max(score) filter (method = 'BUILDING') as b_max, count(*) filter (method = 'BUILDING') as b_n, max(score) filter (method = 'HOUSEHOLD') as h_max, count(*) filter (method = 'HOUSEHOLD') as h_n from m group by split")
def two_value_pivot(spark, sf_dir):
    p = methods(Tables(spark, sf_dir)).groupBy("split").pivot("method", ["BUILDING", "HOUSEHOLD"]).agg(F.max("score").alias("m"), F.count("score").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return p.select("split", F.col("BUILDING_m").alias("b_max"), zero("BUILDING_n").alias("b_n"), F.col("HOUSEHOLD_m").alias("h_max"), zero("HOUSEHOLD_n").alias("h_n"))


@register("neighbour_ring", ctes("grid", "owner_px") + ', o as (select "row" rw, col from grid join owner_px on barcode = bin) select count(*) as ring from (select distinct rw + i rw, col + j col from o, (select unnest([-1, 0, 1]) i), (select unnest([-1, 0, 1]) j) except select rw, col from o)')
def neighbour_ring(spark, sf_dir):
    """Coordinates next to a set and not in it."""
    t = Tables(spark, sf_dir)
    o = t.grid.join(t.owners("px").select(F.col("barcode").alias("bin")), "bin").select("row", "col")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spatial.EIGHT])
    near = o.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).distinct()
    return near.join(o, ["row", "col"], "left_anti").agg(F.count("*").alias("ring"))


@register("path_guard", "select page_id, not (url like '/%' or contains(url, '..') or regexp_matches(url, '^[A-Za-z]:')) as safe, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) as name from pages")
def path_guard(spark, sf_dir):
    p = Tables(spark, sf_dir).raw("pages")
    return p.select("page_id", ids.safe_path(F.col("url")).alias("safe"), ids.base_name(F.col("url")).alias("name"))


@register("sql_text_view", "select n_regionkey as region, count(*) as n, min(n_name) as first_name from nation group by 1 having count(*) > 1")
def sql_text_view(spark, sf_dir):
    """The same through SQL text over a view."""
    return spark.sql("select n_regionkey as region, count(*) as n, min(n_name) as first_name from {nation} group by 1 having count(*) > 1", nation=Tables(spark, sf_dir).raw("nation"))


@register("gene_reweight", ctes("counts") + ", w as (select bin, gene, n * (1 + gene % 3)::double w, cast(sum(n) over (partition by bin) as bigint) t from counts) select bin, count(*) as genes, max(t) as total from w group by 1")
def gene_reweight(spark, sf_dir):
    """Counts reweighted by gene at a fixed row total, by largest remainders; totals are conserved."""
    from ...operators import stats

    c = Tables(spark, sf_dir).counts
    w = c.withColumns({"w": F.col("n") * (1 + F.col("gene") % 3).cast("double"), "t": F.sum("n").over(Window.partitionBy("bin"))})
    r = stats.largest_remainder(w, ["bin"], "w", F.col("t"), ["gene"])
    return r.groupBy("bin").agg(F.count("*").alias("genes"), F.sum("share").alias("total"))


@register("scaled_cell_areas", ctes("pairs") + ", a as (select cell, count(*)::double n from pairs group by 1), m as (select avg(n) m from a) select cell, round(greatest(n * 0.6, n / m * 500), 6) as area from a, m")
def scaled_cell_areas(spark, sf_dir):
    a = Tables(spark, sf_dir).pairs.groupBy("cell").agg(F.count("*").cast("double").alias("n"))
    m = a.agg(F.avg("n").alias("m"))
    return a.crossJoin(F.broadcast(m)).select("cell", R6(F.greatest(F.col("n") * 0.6, F.col("n") / F.col("m") * 500), "area"))
