"""Rewards, frontier scores, growth, learning, hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import maths
from ...operators import growth, learn, ranked, shapes, simulate, spatial
from ...operators import likelihood as lk
from ..bindings import Tables, ctes
from ..catalog import register
from .em import BASE, D_MAX, problem
from .likelihood import theta_of
from .spatial import NEAR, R6, centers, owned
from .statistics import whole_vectors


@register("expression_confidence", ctes("counts") + ", t as (select bin, cast(sum(n) as double) t from counts group by 1) select bin, round(t / (t + 20), 6) as confidence, round(least(t / (t + 20), 1 - 1e-7) * 20 / (1 - least(t / (t + 20), 1 - 1e-7)), 4) as back from t")
def expression_confidence(spark, sf_dir):
    t = Tables(spark, sf_dir).counts.groupBy("bin").agg(F.sum("n").cast("double").alias("t"))
    c = maths.confidence(F.col("t"), 20.0)
    return t.select("bin", R6(c, "confidence"), F.round(maths.inverse_confidence(c, 20.0), 4).alias("back"))


@register("add_reward_terms", ctes("grid", "centers") + "," + NEAR + ", o as (select bin, min(d) d1 from near group by 1), p as (select near.bin, cell, d, radius, (select min(d) from near q where q.bin = near.bin and q.cell <> near.cell) oth from near) select bin, cell, round(d / 20, 6) as p_distance, round(greatest(0, (d - coalesce(oth, 20.0)) / 20), 6) as p_overlap, round(1.0 - 0.5 * d / 20 - 0.25 * greatest(0, (d - coalesce(oth, 20.0)) / 20), 6) as reward from p")
def add_reward_terms(spark, sf_dir):
    """Distance and overlap penalties; the best other distance comes from the two least of a bin."""
    t = Tables(spark, sf_dir)
    j = spatial.with_other_distance(t.grid.select("bin", "x", "y"), centers(t).select("cell", "cx", "cy"), ["bin"], "cell", 20.0)
    other = F.coalesce("other", F.lit(20.0))
    pd_, po = maths.distance_penalty(F.col("d"), 20.0), maths.overlap_penalty(F.col("d"), other, 20.0)
    reward = maths.add_reward(F.lit(1.0), F.lit(0.0), pd_, po, F.lit(0.0), (1.0, 0.5, 0.25, 0.0, 0.0))
    return j.select("bin", "cell", R6(pd_, "p_distance"), R6(po, "p_overlap"), R6(reward, "reward"))


@register("posterior_gain", ctes("counts", "bin_types") + ", t as (select bin, k, cast(sum(n) as double) n from counts join bin_types using (bin) group by 1, 2), s as (select bin, kk, case when kk = k then ln(1 + n) else 0 end x from t cross join (select distinct k kk from bin_types)), e as (select bin, max(exp(x)) / sum(exp(x)) p from s group by 1) select bin, round(p - 0.2, 6) as gain from e")
def posterior_gain(spark, sf_dir):
    """Gain of the top type posterior over the flat one."""
    t = Tables(spark, sf_dir)
    n = t.counts.groupBy("bin").agg(F.sum("n").cast("double").alias("n")).join(t.bin_types, "bin")
    k = t.bin_types.select(F.col("k").alias("kk")).distinct()
    s = n.crossJoin(F.broadcast(k)).select("bin", F.when(F.col("kk") == F.col("k"), F.log1p("n")).otherwise(0.0).alias("x"))
    return s.groupBy("bin").agg(R6(F.max(F.exp("x")) / F.sum(F.exp("x")) - 0.2, "gain"))


@register("frontier_zscore", ctes("pairs") + ", f as (select barcode, cell, px::double v, cell % 3 <> 0 fr from pairs), s as (select *, avg(case when fr then v end) over w m, stddev_pop(case when fr then v end) over w sd from f window w as (partition by barcode)) select barcode, cell, round((v - m) / (sd + 0.1), 6) as z, round(case when sd > 0.1 then (v - m) / sd else 0 end, 6) as z_or_zero from s")
def frontier_zscore(spark, sf_dir):
    """Mean and deviation over the frontier only, applied to all; and the variant that is 0 without spread."""
    f = Tables(spark, sf_dir).pairs.select("barcode", "cell", F.col("px").cast("double").alias("v"), (F.col("cell") % 3 != 0).alias("fr"))
    v, fr = F.col("v"), F.col("fr")
    return f.select("barcode", "cell", R6(ranked.masked_zscore(v, fr, ["barcode"], 0.1), "z"), R6(ranked.masked_zscore_or_zero(v, fr, ["barcode"], 0.1), "z_or_zero"))


@register("top_k_mean_reward", ctes("pairs") + " select barcode, round(avg(px) filter (rn <= 3), 6) as top_mean, max(px) as best from (select *, row_number() over (partition by barcode order by px desc) rn from pairs) group by barcode")
def top_k_mean_reward(spark, sf_dir):
    p = Tables(spark, sf_dir).pairs
    top = ranked.top_k_mean(p, ["barcode"], "px", 3)
    return top.join(p.groupBy("barcode").agg(F.max("px").alias("best")), "barcode").select("barcode", R6(F.col("top_mean"), "top_mean"), "best")


@register("row_splits", ctes("pairs") + ", s as (select cell, count(*) n from pairs group by 1) select cell, n, cast(coalesce(sum(n) over (order by cell rows between unbounded preceding and 1 preceding), 0) as bigint) as start from s")
def row_splits(spark, sf_dir):
    return ranked.row_splits(Tables(spark, sf_dir).pairs, "cell")


@register("bit_masks", ctes("pairs") + " select barcode, cast(bit_or(cast(1 as bigint) << (cell % 60)) as bigint) as mask, bit_count(bit_or(cast(1 as bigint) << (cell % 60)))::integer as bits from pairs group by 1")
def bit_masks(spark, sf_dir):
    """Membership as a packed 64-bit mask."""
    m = Tables(spark, sf_dir).pairs.groupBy("barcode").agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 60))")).alias("mask"))
    return m.select("barcode", "mask", F.bit_count("mask").alias("bits"))


@register("outline_segments", ctes("grid", "owner_px") + ', o as (select "row" rw, col, cell % 4 cell from grid join owner_px on barcode = bin), n as (select o.*, d.* from o cross join (values (0, 1, \'E\'), (0, -1, \'W\'), (1, 0, \'S\'), (-1, 0, \'N\')) d(dr, dc, side)) select n.cell as cell, side, count(*) as edges from n left join o on o.rw = n.rw + dr and o.col = n.col + dc and o.cell = n.cell where o.cell is null group by 1, 2')
def outline_segments(spark, sf_dir):
    """Edges of each cell without a neighbour of the cell on the other side."""
    o = owned(Tables(spark, sf_dir)).filter("cell is not null").select("row", "col", (F.col("cell") % 4).alias("cell"))
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(s).alias("side")) for i, j, s in ((0, 1, "E"), (0, -1, "W"), (1, 0, "S"), (-1, 0, "N"))])
    e = o.withColumn("s", F.explode(sides)).select("cell", "s.side", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    return e.join(o, ["row", "col", "cell"], "left_anti").groupBy("cell", "side").agg(F.count("*").alias("edges"))


@register("hull_area_by_owner")
def hull_area_by_owner(spark, sf_dir):
    return shapes.hull_area(owned(Tables(spark, sf_dir)).filter("cell is not null"), "cell").select("cell", "n", "hull")


@register("seed_shape_features", ctes("grid", "owner_px") + ", o as (select cell, x, y from grid join owner_px on barcode = bin), c as (select cell, avg(x) mx, avg(y) my from o group by 1), d as (select cell, x - mx dx, y - my dy from o join c using (cell)) select cell, count(*) as n, round(quantile_cont(sqrt(dx * dx + dy * dy), 0.9), 5) as p90_radius from d group by cell")
def seed_shape_features(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.grid.join(t.owners("px").select(F.col("barcode").alias("bin"), "cell"), "bin").select("cell", "x", "y")
    return shapes.seed_features(o, "cell").select("cell", "n", F.round("p90_radius", 5).alias("p90_radius"))


@register("greedy_growth")
def greedy_growth(spark, sf_dir):
    """Cells grow from their seed by the best positive neighbour bin, one bin a round, all cells of a patch in turn."""
    t = Tables(spark, sf_dir)
    p = problem(t).join(t.grid.select("bin", "row", "col"), "bin").withColumn("patch", F.expr("(row div 32) * 8 + col div 32"))
    rewards = p.select("patch", "bin", "row", "col", "cell", (F.col("conf") - F.col("d") / D_MAX * 0.5).alias("reward"), (F.col("owner") == F.col("cell")).alias("seed"))
    return growth.grow(rewards, ["patch"], most=12)


@register("trajectory_fold", ctes("steps") + ", a as (select traj, step, k % 6 item, kind, k from steps), f as (select traj, item, step, kind, k from a where kind in ('signup', 'click', 'purchase')), first as (select traj, item, min(step) s from f where kind <> 'purchase' group by 1, 2), ok as (select f.* from f join first using (traj, item) where (f.kind <> 'purchase' and f.step = first.s) or (f.kind = 'purchase' and f.step > first.s)) select traj, item, arg_max(k, step) as owner, count(*) as applied from ok group by 1, 2")
def trajectory_fold(spark, sf_dir):
    """ADD takes only unowned items, REPLACE only owned ones: the first ADD and every later REPLACE apply."""
    s = Tables(spark, sf_dir).steps
    a = s.filter(F.col("kind").isin("signup", "click", "purchase")).select("traj", "step", (F.col("k") % 6).alias("item"), (F.col("kind") == "purchase").alias("replace"), F.col("k").alias("owner"))
    return growth.fold_actions(a, ["traj"], "item").select("traj", "item", "owner", "applied")


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    out, _ = learn.kmeans(whole_vectors(Tables(spark, sf_dir)), "e", 5)
    return out.select("vec_id", "cluster")


@register("pca_scores")
def pca_scores(spark, sf_dir):
    p = learn.pca(whole_vectors(Tables(spark, sf_dir)), "e", 3)
    return p.select("vec_id", *[F.round(F.abs(F.col("scores")[i]), 6).alias(f"pc{i + 1}") for i in range(3)])


@register("poisson_depth_fit")
def poisson_depth_fit(spark, sf_dir):
    """Coefficients of the regional depth model."""
    t = Tables(spark, sf_dir)
    rows = t.counts.groupBy("bin").agg(F.sum("n").cast("double").alias("target")).join(t.grid.select("bin", F.col("x").alias("fx"), F.col("y").alias("fy")), "bin")
    beta = learn.poisson_ridge(rows, ["fx", "fy"], "target", 0.01)
    return spark.createDataFrame([(i, round(float(b), 6)) for i, b in enumerate(beta)], "term int, value double")


@register("smooth_depth_field")
def smooth_depth_field(spark, sf_dir):
    """The field of the whole grid, with mean 1 over all bins."""
    return simulate.smooth_field(Tables(spark, sf_dir).grid.select("row", "col"), 1.5, 8).select("row", "col", F.round("field", 6).alias("field"))


@register("molecule_transport", ctes("counts", "grid") + " select gene, cast(sum(n) as bigint) as n from counts join grid using (bin) group by 1")
def molecule_transport(spark, sf_dir):
    """Gene totals after the transport of all counts are those before it."""
    t = Tables(spark, sf_dir)
    c = t.counts.join(t.grid, "bin").select("row", "col", "gene", "n")
    return simulate.transport(c, 6, 0.3, 1.0).groupBy("gene").agg(F.sum("n").alias("n"))


@register("sampled_actions")
def sampled_actions(spark, sf_dir):
    p = Tables(spark, sf_dir).pairs
    return simulate.soft_choice(p, ["barcode"], "cell", "px", 12)


@register("greedy_actions", ctes("owner_px") + " select barcode, cell from owner_px")
def greedy_actions(spark, sf_dir):
    return simulate.soft_choice(Tables(spark, sf_dir).pairs, ["barcode"], "cell", "px", 12, greedy=True)


@register("profile_shrinkage", ctes("counts", "bin_types") + ", c as (select k, gene, cast(sum(n) as double) n from counts join bin_types using (bin) group by 1, 2), g as (select gene, sum(n) / (select sum(n) from c) ref from c group by 1), t as (select k, sum(n) t from c group by 1) select k, gene, round((n + 500 * ref) / (t + 500) * 1000, 6) as share from c join g using (gene) join t using (k)")
def profile_shrinkage(spark, sf_dir):
    """Type profiles shrunk toward the profile of all."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    c = lk.reference_counts(t.counts, t.bin_types).withColumn("c", F.col("c").cast("double"))
    ref = F.sum("c").over(Window.partitionBy("gene")) / F.sum("c").over(Window.partitionBy())
    d = c.withColumn("ref", ref).withColumn("t", F.sum("c").over(Window.partitionBy("k")))
    return d.select("k", "gene", R6(maths.shrink(F.col("c"), 500.0, F.col("ref"), F.col("t")) * 1000, "share"))


@register("em_input_pairs", BASE + " select count(*) as pairs, count(distinct bin) as bins, count(distinct cell) as cells, count(distinct bin) filter (owner is not null) as locked from p0")
def em_input_pairs(spark, sf_dir):
    p = problem(Tables(spark, sf_dir))
    return p.agg(F.count("*").alias("pairs"), F.count_distinct("bin").alias("bins"), F.count_distinct("cell").alias("cells"), F.count_distinct(F.when(F.col("owner").isNotNull(), F.col("bin"))).alias("locked"))


@register("type_theta_entropy", ctes("counts", "bin_types") + ", ref as (select k, gene, sum(n) c from counts join bin_types using (bin) group by 1, 2), kg as (select a.k, b.gene from (select distinct k from ref) a cross join (select distinct gene from ref) b), theta as (select k, gene, (coalesce(c, 0) + 1e-6::double) / sum(coalesce(c, 0) + 1e-6::double) over (partition by k) th from kg left join ref using (k, gene)) select k, round(-sum(th * ln(th)), 6) as entropy from theta group by k")
def type_theta_entropy(spark, sf_dir):
    return theta_of(Tables(spark, sf_dir)).groupBy("k").agg(R6(-F.sum(F.col("theta") * F.ln("theta")), "entropy"))
