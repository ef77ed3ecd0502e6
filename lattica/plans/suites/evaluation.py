"""Owners against owners: overlap, matching, transitions, conflicts, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import evaluate as ev
from ..bindings import Tables, ctes
from ..catalog import register

R6 = lambda c, name: F.round(c, 6).alias(name)

METRICS_SQL = "round(case when np + nt - ni > 0 then ni / (np + nt - ni)::double end, 6) as iou, round(case when np + nt > 0 then 2 * ni / (np + nt)::double end, 6) as dice, round(case when np > 0 then ni / np::double else 0 end, 6) as precision, round(case when nt > 0 then ni / nt::double else 0 end, 6) as recall, round(case when ni > 0 then 2 * (ni / np::double) * (ni / nt::double) / (ni / np::double + ni / nt::double) else 0 end, 6) as f1"


@register(
    "overlap_metrics",
    ctes("owner_px", "owner_price") + ", a as (select cell, count(*) np from owner_px group by 1), b as (select cell, count(*) nt from owner_price group by 1), i as (select cell, count(*) ni from owner_px join owner_price using (barcode, cell) group by 1), j as (select cell, coalesce(np, 0) np, coalesce(nt, 0) nt, coalesce(ni, 0) ni from a full join b using (cell) left join i using (cell)) select cell, np as n_pred, nt as n_truth, ni as n_inter, " + METRICS_SQL + " from j",
)
def overlap_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = ev.overlap(t.owners("px"), t.owners("price"))
    m = ev.set_metrics(F.col("n_inter"), F.col("n_pred"), F.col("n_truth"))
    return o.select("cell", "n_pred", "n_truth", "n_inter", *[R6(c, n) for n, c in m.items()])


@register(
    "fractional_overlap_metrics",
    ctes("pairs", "owner_price") + ", tot as (select barcode, cast(sum(px) as double) s from pairs group by 1), w as (select barcode, cell, px / s w from pairs join tot using (barcode)), ws as (select cell, sum(w) weight from w group by 1), n as (select cell, count(*) n from owner_price group by 1), i as (select cell, sum(w) inter from owner_price join w using (barcode, cell) group by 1), j as (select cell, coalesce(n, 0) n, coalesce(weight, 0) weight, coalesce(inter, 0) inter from ws full join n using (cell) left join i using (cell)) select cell, n as n_pred, round(weight, 6) as weight, round(inter, 6) as inter, round(case when n + weight - inter > 0 then inter / (n + weight - inter) end, 6) as iou, round(case when n > 0 then inter / n else 0 end, 6) as precision, round(case when weight > 0 then inter / weight else 0 end, 6) as recall from j",
)
def fractional_overlap_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.pairs
    totals = p.groupBy("barcode").agg(F.sum("px").cast("double").alias("s"))
    w = p.join(totals, "barcode").select("barcode", "cell", (F.col("px") / F.col("s")).alias("w"))
    o = ev.fractional_overlap(t.owners("price"), w)
    m = ev.set_metrics(F.col("inter"), F.col("n_pred"), F.col("weight"))
    return o.select("cell", "n_pred", R6(F.col("weight"), "weight"), R6(F.col("inter"), "inter"), *[R6(m[n], n) for n in ("iou", "precision", "recall")])


@register(
    "nuclear_overlap_match",
    ctes("owner_px", "owner_price") + ", c as (select a.cell a, b.cell b, count(*) n from owner_px a join owner_price b using (barcode) group by 1, 2), r as (select *, row_number() over (partition by a order by n desc, cast(b as varchar) desc) rn from c), z as (select cell a, count(*) size from owner_px group by 1) select a, b, n, round(n / size::double, 6) as fraction from r join z using (a) where rn = 1 and n >= 2 and n / size::double >= 0.1",
)
def nuclear_overlap_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ev.match_by_overlap(t.owners("px"), t.owners("price"), 2, 0.1).select("a", "b", "n", R6(F.col("fraction"), "fraction"))


@register(
    "reciprocal_best_match",
    ctes("owner_px", "owner_price") + ", c as (select a.cell a, b.cell b, count(*) n from owner_px a join owner_price b using (barcode) group by 1, 2), f as (select *, row_number() over (partition by a order by n desc, cast(b as varchar) desc) ra, row_number() over (partition by b order by n desc, cast(a as varchar) desc) rb from c) select a, b, n from f where ra = 1 and rb = 1",
)
def reciprocal_best_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ev.reciprocal_match(t.owners("px"), t.owners("price")).select("a", "b", "n")


@register("owner_to_gt_map", ctes("owner_px", "truth") + ", c as (select a.cell a, b.cell b, count(*) n from owner_px a join truth b using (barcode) group by 1, 2), m as (select a, b from (select *, row_number() over (partition by a order by n desc, b) rn from c) where rn = 1), ids as (select distinct cell from truth) select coalesce(a, cell) as a, coalesce(b, cell) as b from m full join ids on a = cell")
def owner_to_gt_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ev.owner_map(ev.pair_counts(t.owners("px"), t.truth), t.truth.select("cell").distinct())


OUTCOME_SQL = "case when t.cell is null then 'no_gt' when a.cell = t.cell and b.cell <> t.cell then 'damaged' when a.cell <> t.cell and b.cell = t.cell then 'corrected' when a.cell = t.cell then 'unchanged_correct' when a.cell = b.cell then 'unresolved' else 'wrong_to_wrong' end"


def _transitions(t: Tables):
    a, b = t.owners("px").withColumnRenamed("cell", "before"), t.owners("price").withColumnRenamed("cell", "after")
    return a.join(b, "barcode").join(t.truth.withColumnRenamed("cell", "truth"), "barcode", "left").withColumn("outcome", ev.outcome(F.col("before"), F.col("after"), F.col("truth")))


@register("transition_outcomes", ctes("owner_px", "owner_price", "truth") + f" select barcode, {OUTCOME_SQL} as outcome from owner_px a join owner_price b using (barcode) left join truth t using (barcode)")
def transition_outcomes(spark, sf_dir):
    return _transitions(Tables(spark, sf_dir)).select("barcode", "outcome")


@register(
    "transition_counts",
    ctes("owner_px", "owner_price", "truth") + f", o as (select a.cell cell, {OUTCOME_SQL} oc, a.cell <> b.cell ch from owner_px a join owner_price b using (barcode) left join truth t using (barcode)) select cell, count(*) filter (ch) as changed, count(*) filter (oc = 'corrected') as corrected, count(*) filter (oc = 'damaged') as damaged, count(*) filter (oc = 'wrong_to_wrong') as wrong_to_wrong, count(*) filter (oc = 'corrected') - count(*) filter (oc = 'damaged') as net from o group by cell",
)
def transition_counts(spark, sf_dir):
    o = _transitions(Tables(spark, sf_dir))
    n = lambda k: F.count_if(F.col("outcome") == k)
    return o.groupBy(F.col("before").alias("cell")).agg(F.count_if(F.col("before") != F.col("after")).alias("changed"), n("corrected").alias("corrected"), n("damaged").alias("damaged"), n("wrong_to_wrong").alias("wrong_to_wrong"), (n("corrected") - n("damaged")).alias("net"))


@register(
    "evolution_tolerance",
    ctes("owner_px", "owner_price", "truth") + ", g as (select t.cell, avg(case when a.cell = t.cell then 1.0 else 0.0 end) x, avg(case when b.cell = t.cell then 1.0 else 0.0 end) y from truth t join owner_px a using (barcode) join owner_price b using (barcode) group by 1) select case when y - x > 1e-12 then 'improved' when y - x < -1e-12 then 'damaged' else 'unchanged' end as state, count(*) as n, round(avg(y - x), 6) as mean_delta, round(min(y - x), 6) as min_delta, round(max(y - x), 6) as max_delta from g group by 1",
)
def evolution_tolerance(spark, sf_dir):
    o = _transitions(Tables(spark, sf_dir))
    g = o.groupBy("truth").agg(F.avg((F.col("before") == F.col("truth")).cast("double")).alias("x"), F.avg((F.col("after") == F.col("truth")).cast("double")).alias("y"))
    d = F.col("y") - F.col("x")
    g = g.withColumn("d", d).withColumn("state", F.when(d > 1e-12, "improved").when(d < -1e-12, "damaged").otherwise("unchanged"))
    return g.groupBy("state").agg(F.count("*").alias("n"), R6(F.avg("d"), "mean_delta"), R6(F.min("d"), "min_delta"), R6(F.max("d"), "max_delta"))


@register(
    "patch_category_metrics",
    ctes("owner_px", "truth", "grid") + """, b as (select cast(floor(x / 64) as bigint) px, cast(floor(y / 64) as bigint) py, case when bin % 5 <> 0 then p.cell end p, case when bin % 7 <> 0 then t.cell end t from grid left join owner_px p on p.barcode = bin left join truth t on t.barcode = bin),
k as (select px, py, count(*) filter (p is not null and t is not null) both_n, count(*) filter (p is not null and t is null) pred_only, count(*) filter (p is null and t is not null) gt_only, count(*) filter (p = t) correct from b group by 1, 2)
select px, py, both_n, pred_only, gt_only, correct, round(both_n / nullif(both_n + pred_only + gt_only, 0)::double, 6) as foreground_iou, round(both_n / nullif(both_n + pred_only, 0)::double, 6) as precision, round(both_n / nullif(both_n + gt_only, 0)::double, 6) as recall, round(correct / nullif(both_n, 0)::double, 6) as owner_accuracy from k""",
)
def patch_category_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = t.grid.join(t.owners("px").select(F.col("barcode").alias("bin"), F.col("cell").alias("p")), "bin", "left").join(t.truth.select(F.col("barcode").alias("bin"), F.col("cell").alias("t")), "bin", "left")
    b = g.select(F.floor(F.col("x") / 64).alias("px"), F.floor(F.col("y") / 64).alias("py"), F.when(F.col("bin") % 5 != 0, F.col("p")).alias("p"), F.when(F.col("bin") % 7 != 0, F.col("t")).alias("t"))
    b = b.withColumn("c", ev.category(F.col("p"), F.col("t"), F.lit(True)))
    n = lambda *ks: F.count_if(F.col("c").isin(*ks))
    k = b.groupBy("px", "py").agg(n("correct_owner", "wrong_owner").alias("both_n"), n("pred_only").alias("pred_only"), n("gt_only").alias("gt_only"), n("correct_owner").alias("correct"))
    c = F.col
    return k.select("px", "py", "both_n", "pred_only", "gt_only", "correct", R6(ev.ratio(c("both_n"), c("both_n") + c("pred_only") + c("gt_only")), "foreground_iou"), R6(ev.ratio(c("both_n"), c("both_n") + c("pred_only")), "precision"), R6(ev.ratio(c("both_n"), c("both_n") + c("gt_only")), "recall"), R6(ev.ratio(c("correct"), c("both_n")), "owner_accuracy"))


@register("unique_owner_audit", ctes("claims") + ", a as (select barcode, count(*) n, count(distinct cell) u from claims group by 1), d as (select cast(sum(c - 1) as bigint) dup from (select count(*) c from claims group by barcode, cell, px, weight, ord)) select cast(sum(n) as bigint) as rows, count(*) as barcodes, (select dup from d) as duplicate_rows, count(*) filter (u > 1) as multi_owner, max(u) as max_owners from a")
def unique_owner_audit(spark, sf_dir):
    c = Tables(spark, sf_dir).claims
    a = c.groupBy("barcode").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("u"))
    d = c.groupBy("barcode", "cell", "px", "weight", "ord").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))
    s = a.agg(F.sum("n").alias("rows"), F.count("*").alias("barcodes"), F.count_if(F.col("u") > 1).alias("multi_owner"), F.max("u").alias("max_owners"))
    return s.crossJoin(F.broadcast(d)).select("rows", "barcodes", "duplicate_rows", "multi_owner", "max_owners")


def _patched(t: Tables):
    """Two overlapping patch outputs: each claim's patch is its part modulo 8."""
    return t.claims.groupBy("barcode", "cell", (F.col("ord") % 8).alias("patch")).agg(F.sum("px").alias("score"), F.max(F.col("weight") > 0.08).alias("nuclear"))


PATCHED = "pc as (select barcode, cell, ord % 8 patch, cast(sum(px) as bigint) score, bool_or(weight > 0.08) nuclear from claims group by 1, 2, 3), rk as (select *, row_number() over (partition by barcode order by nuclear desc, score desc, patch, cell) rn from pc)"


@register("merge_patch_owners", ctes("claims") + "," + PATCHED + " select barcode, cell, patch, score, nuclear from rk where rn = 1")
def merge_patch_owners(spark, sf_dir):
    return ev.reconcile(_patched(Tables(spark, sf_dir)))[0]


@register("owner_conflicts", ctes("claims") + "," + PATCHED + ", n as (select barcode, count(distinct cell) owners, count(*) claims from pc group by 1) select barcode, cell as winner, owners, claims from rk join n using (barcode) where rn = 1 and owners > 1")
def owner_conflicts(spark, sf_dir):
    return ev.reconcile(_patched(Tables(spark, sf_dir)))[1]


@register("best_patch_snapshot", ctes("claims") + "," + PATCHED + ", c as (select cell, patch, cast(sum(score) as bigint) score from pc group by 1, 2) select cell, patch, score from (select *, row_number() over (partition by cell order by score desc, patch) r from c) where r = 1")
def best_patch_snapshot(spark, sf_dir):
    return ev.best_patch(_patched(Tables(spark, sf_dir)).groupBy("cell", "patch").agg(F.sum("score").alias("score")))


@register("owner_agreement", ctes("owner_px", "owner_price") + " select a.cell as cell, count(*) as common, count(*) filter (a.cell = b.cell) as same, round(avg(case when a.cell <> b.cell then 1.0 else 0.0 end), 6) as changed_share from owner_px a join owner_price b using (barcode) group by 1")
def owner_agreement(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.owners("px").join(t.owners("price").withColumnRenamed("cell", "other"), "barcode")
    same = F.col("cell") == F.col("other")
    return j.groupBy("cell").agg(F.count("*").alias("common"), F.count_if(same).alias("same"), R6(F.avg((~same).cast("double")), "changed_share"))


@register("rna_vs_area_owner", ctes("pairs") + ", m as (select barcode, max(px) mp, max(price) mr from pairs group by 1), k as (select barcode, count(*) filter (px = mp) tp, count(*) filter (price = mr) tr, min(cell) filter (px = mp) cp, min(cell) filter (price = mr) cr from pairs join m using (barcode) group by 1) select count(*) as bins, count(*) filter (tp > 1) as area_ties, count(*) filter (tr > 1) as rna_ties, count(*) filter (tp = 1 and tr = 1 and cp <> cr) as disagree, round(count(*) filter (tp = 1 and tr = 1 and cp <> cr) / greatest(1, count(*) filter (tp = 1 and tr = 1))::double, 6) as disagree_share from k")
def rna_vs_area_owner(spark, sf_dir):
    p = Tables(spark, sf_dir).pairs
    # Arg-max with a tie count in one pass: the top two values of each measure.
    top = p.groupBy("barcode").agg(F.max("px").alias("mp"), F.max("price").alias("mr"))
    k = p.join(top, "barcode").groupBy("barcode").agg(F.count_if(F.col("px") == F.col("mp")).alias("tp"), F.count_if(F.col("price") == F.col("mr")).alias("tr"), F.min(F.when(F.col("px") == F.col("mp"), F.col("cell"))).alias("cp"), F.min(F.when(F.col("price") == F.col("mr"), F.col("cell"))).alias("cr"))
    clear = (F.col("tp") == 1) & (F.col("tr") == 1)
    bad = F.count_if(clear & (F.col("cp") != F.col("cr")))
    return k.agg(F.count("*").alias("bins"), F.count_if(F.col("tp") > 1).alias("area_ties"), F.count_if(F.col("tr") > 1).alias("rna_ties"), bad.alias("disagree"), R6(bad / F.greatest(F.lit(1), F.count_if(clear)), "disagree_share"))


@register("gt_rows_by_patch", ctes("pairs", "grid") + ", p as (select r * 4 + c patch, c * 64.0::double x0, c * 64.0::double + 66.0 x1, r * 64.0::double y0, r * 64.0::double + 66.0 y1 from range(4) a(r), range(4) b(c)), g as (select patch, barcode, cell, px from pairs join grid on barcode = bin join p on x between x0 and x1 and y between y0 and y1) select patch, barcode, cell, px from (select *, row_number() over (partition by patch, barcode order by px desc, cell) rn from g) where rn = 1")
def gt_rows_by_patch(spark, sf_dir):
    """Closed rectangles: a bin on a border is in several patches; then the greatest weight for each barcode."""
    from ...operators import spatial

    t = Tables(spark, sf_dir)
    r, c = F.col("id").cast("long") % 4, F.floor(F.col("id") / 4)
    patches = spark.range(16).select((c * 4 + r).alias("patch"), (r * 64.0).alias("x0"), (r * 64.0 + 66.0).alias("x1"), (c * 64.0).alias("y0"), (c * 64.0 + 66.0).alias("y1"))
    bins = spatial.in_rectangles(t.grid.select("bin", "x", "y"), patches, "patch", tile=64.0)
    g = bins.join(t.pairs, F.col("bin") == F.col("barcode"))
    best = g.groupBy("patch", "barcode").agg(F.min_by(F.struct("cell", "px"), F.struct((-F.col("px")).alias("w"), F.col("cell"))).alias("r"))
    return best.select("patch", "barcode", "r.*")


@register("drop_one_counterfactual", "with c as (select l_orderkey k, round(sum(l_extendedprice) / 1000, 3) price, round(sum(l_quantity), 3) qty, round(sum(l_discount * 100), 3) disc from lineitem group by 1), u as (select k, price + qty - disc reward, unnest([{'n': 'price', 'v': price}, {'n': 'qty', 'v': qty}, {'n': 'disc', 'v': -disc}], recursive := true) from c) select n as component, count(*) as cases, count(*) filter (reward > 100) as accepted, count(*) filter (reward - v > 100) as accepted_without, round(avg(v), 4) as mean_part from u group by n")
def drop_one_counterfactual(spark, sf_dir):
    """Components to rows with stack, then the decision with each part taken out."""
    li = Tables(spark, sf_dir).raw("lineitem")
    # Sums of decimals do not hang on the order of rows, so no tie of the third digit falls now up, now down.
    exact = lambda v: F.sum(v.cast("decimal(20,6)")).cast("double")
    digits = lambda v: F.signum(v) * F.floor(F.abs(v) * 1000 + 0.5) / 1000
    c = li.groupBy("l_orderkey").agg(digits(exact(F.col("l_extendedprice")) / 1000).alias("price"), digits(exact(F.col("l_quantity"))).alias("qty"), digits(exact(F.col("l_discount") * 100)).alias("disc"))
    u = c.selectExpr("price + qty - disc as reward", "stack(3, 'price', price, 'qty', qty, 'disc', -disc) as (component, v)")
    return u.groupBy("component").agg(F.count("*").alias("cases"), F.count_if(F.col("reward") > 100).alias("accepted"), F.count_if(F.col("reward") - F.col("v") > 100).alias("accepted_without"), F.round(F.avg("v"), 4).alias("mean_part"))


@register("component_scales", "with c as (select l_orderkey k, round(sum(l_extendedprice) / 1000, 3) price, round(sum(l_discount * 1000), 3) disc from lineitem group by 1), s as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double scale) select scale, count(*) filter (price - scale * disc > 0) as kept, round(avg(price - scale * disc), 4) as mean_score from c, s group by scale")
def component_scales(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem")
    c = li.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice") / 1000, 3).alias("price"), F.round(F.sum(F.col("l_discount") * 1000), 3).alias("disc"))
    s = c.withColumn("scale", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    score = F.col("price") - F.col("scale") * F.col("disc")
    return s.groupBy("scale").agg(F.count_if(score > 0).alias("kept"), F.round(F.avg(score), 4).alias("mean_score"))


@register("em_input_dedup", ctes("claims") + ", d as (select barcode, count(distinct cell) seeds, count(*) rows, min(weight) w0, max(weight) w1 from claims group by 1) select barcode, rows, seeds > 1 as seed_conflict, w1 - w0 <= 1e-4 as agree, w0 as confidence from d")
def em_input_dedup(spark, sf_dir):
    """One row for each barcode over all its rows, with what must agree checked."""
    c = Tables(spark, sf_dir).claims
    d = c.groupBy("barcode").agg(F.count("*").alias("rows"), (F.count_distinct("cell") > 1).alias("seed_conflict"), (F.max("weight") - F.min("weight") <= 1e-4).alias("agree"), F.min("weight").alias("confidence"))
    return d.select("barcode", "rows", "seed_conflict", "agree", "confidence")


@register("soft_row_l1", ctes("pairs") + ", s as (select barcode, cell, px / cast(sum(px) over (partition by barcode) as double) a, price / cast(sum(price) over (partition by barcode) as double) b from pairs) select barcode, round(sum(abs(a - b)), 6) as l1, arg_max(cell, (a, -cell)) <> arg_max(cell, (b, -cell)) as owner_changed from s group by barcode")
def soft_row_l1(spark, sf_dir):
    """L1 over the union of candidates of two soft assignments, absent is 0."""
    p = Tables(spark, sf_dir).pairs
    totals = p.groupBy("barcode").agg(F.sum("px").cast("double").alias("sp"), F.sum("price").cast("double").alias("sr"))
    s = p.join(totals, "barcode").select("barcode", "cell", (F.col("px") / F.col("sp")).alias("a"), (F.col("price") / F.col("sr")).alias("b"))
    top = lambda c: F.max_by("cell", F.struct(F.col(c), -F.col("cell")))
    return s.groupBy("barcode").agg(R6(F.sum(F.abs(F.col("a") - F.col("b"))), "l1"), (top("a") != top("b")).alias("owner_changed"))


@register("full_outer_indicator", ctes("owner_px", "truth") + ", a as (select * from owner_px where barcode % 3 <> 0), b as (select * from truth where barcode % 5 <> 0) select case when a.barcode is not null and b.barcode is not null then 'both' when a.barcode is not null then 'left_only' else 'right_only' end as merge, count(*) as n from a full join b on a.barcode = b.barcode group by 1")
def full_outer_indicator(spark, sf_dir):
    from ...operators.contracts import outer_with_indicator

    t = Tables(spark, sf_dir)
    a, b = t.owners("px").filter("barcode % 3 <> 0"), t.truth.filter("barcode % 5 <> 0").withColumnRenamed("cell", "truth")
    return outer_with_indicator(a, b, ["barcode"]).groupBy("merge").agg(F.count("*").alias("n"))
