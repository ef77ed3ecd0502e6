"""Radius, nearest, rectangle and neighbour joins over the bin grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import ids, maths
from ...operators import ranked, spatial
from ..bindings import Tables, ctes
from ..catalog import register

R6 = lambda c, name: F.round(c, 6).alias(name)
NEAR = 'near as (select bin, cell, radius, type, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) d from grid join (select cell, x cx, y cy, radius, type from centers) c on x between cx - 20 and cx + 20 and y between cy - 20 and cy + 20 where (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 400)'


def centers(t: Tables):
    return t.centers.withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")


@register("episode_candidates_radius", ctes("grid", "centers") + "," + NEAR + " select bin, cell, round(d, 6) as d, abs(radius - d) <= 2.0 as in_band from near")
def episode_candidates_radius(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = spatial.radius_join(t.grid.select("bin", "x", "y"), centers(t), 20.0)
    return p.select("bin", "cell", R6(F.col("d"), "d"), (F.abs(F.col("radius") - F.col("d")) <= 2.0).alias("in_band"))


@register("episode_candidate_summary", ctes("grid", "centers") + "," + NEAR + " select cell, count(*) as n, round(min(d), 6) as d_min, round(quantile_cont(d, 0.5), 6) as d_median, round(quantile_cont(d, 0.95), 6) as d_p95 from near group by cell")
def episode_candidate_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = spatial.radius_join(t.grid.select("bin", "x", "y"), centers(t), 20.0)
    return p.groupBy("cell").agg(F.count("*").alias("n"), R6(F.min("d"), "d_min"), R6(F.percentile("d", F.lit(0.5)), "d_median"), R6(F.percentile("d", F.lit(0.95)), "d_p95"))


@register("nearest_other_nucleus", ctes("centers") + ", p as (select a.cell, b.cell other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from centers a join centers b on a.cell <> b.cell) select cell, other, round(d, 6) as d from (select *, row_number() over (partition by cell order by d, other) rn from p) where rn = 1")
def nearest_other_nucleus(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return spatial.nearest_other(centers(t).select("cell", "cx", "cy"), "cell", 16.0).select("cell", "other", R6(F.col("d"), "d"))


@register("typed_neighbour_weights", ctes("centers") + ", p as (select a.cell, b.type, exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 200.0) w from centers a join centers b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900) select cell, type, round(sum(w) / sum(sum(w)) over (partition by cell), 6) as weight from p group by cell, type")
def typed_neighbour_weights(spark, sf_dir):
    """Gaussian weights by type of all centres within three scales; a centre is its own fallback."""
    w = spatial.typed_sums(centers(Tables(spark, sf_dir)), "cell", 10.0)
    return w.select("cell", "type", R6(ranked.normalized(F.col("w"), ["cell"]), "weight"))


@register(
    "local_type_shares",
    ctes("grid", "centers")
    + """, blocks as (select "row" // 8 br, col // 8 bc, avg(x) x, avg(y) y from grid group by 1, 2),
d as (select br, bc, type, cell, (b.x - c.x) ** 2 + (b.y - c.y) ** 2 d2 from blocks b, centers c),
n as (select br, bc, type, sum(exp(-d2 / 32)) w from d where d2 <= 144 group by 1, 2, 3),
s as (select br, bc, type, w / sum(w) over (partition by br, bc) share from n),
f as (select br, bc, type, 1.0::double share from (select *, row_number() over (partition by br, bc order by round(sqrt(d2), 9), cell) k from d) where k = 1 and (br, bc) not in (select (br, bc) from n))
select br, bc, type, round(share, 6) as share from (select * from s union all select * from f)""",
)
def local_type_shares(spark, sf_dir):
    """Types around blocks of 8 x 8 bins; blocks without a near centre take the type of the nearest."""
    t = Tables(spark, sf_dir)
    b = t.grid.groupBy(F.expr("row div 8").alias("br"), F.expr("col div 8").alias("bc")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    w = spatial.typed_weights(b, centers(t), ["br", "bc"], 4.0, [F.col("cell")])
    return w.select("br", "bc", "type", R6(F.col("weight"), "share"))


@register("k_nearest_mean", ctes("grid", "centers") + "," + NEAR + ", k as (select *, row_number() over (partition by bin order by d, cell) rn from near) select bin, count(*) as n, round(sum(radius * exp(-d * d / 128.0)) / sum(exp(-d * d / 128.0)), 6) as smoothed from k where rn <= 3 group by bin")
def k_nearest_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = spatial.k_nearest(t.grid.select("bin", "x", "y"), centers(t), ["bin"], 20.0, 3, [F.col("cell")])
    w = F.exp(-F.col("d") * F.col("d") / 128.0)
    return k.groupBy("bin").agg(F.count("*").alias("n"), R6(F.sum(F.col("radius") * w) / F.sum(w), "smoothed"))


@register("nearest_center_assignment")
def nearest_center_assignment(spark, sf_dir):
    """Every bin with counts to its nearest centre, however far."""
    t = Tables(spark, sf_dir)
    counted = t.counts.groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 0").select("bin")
    bins = t.grid.select("bin", "x", "y").join(counted, "bin", "left_semi")
    return spatial.nearest(bins, centers(t).select("cell", "cx", "cy"), ["bin"], 16.0, [F.col("cell")]).select("bin", "cell", R6(F.col("d"), "d"))


PATCHES = "patches as (select r * 4 + c patch, c * 64.0::double x0, c * 64.0::double + 64.0 x1, r * 48.0::double y0, r * 48.0::double + 48.0 y1 from range(4) a(r), range(4) b(c))"


def patches(spark):
    i = F.col("id")
    r, c = F.floor(i / 4), i % 4
    return spark.range(16).select((r * 4 + c).alias("patch"), (c * 64.0).alias("x0"), (c * 64.0 + 64.0).alias("x1"), (r * 48.0).alias("y0"), (r * 48.0 + 48.0).alias("y1"))


@register(
    "patch_membership",
    ctes("centers") + "," + PATCHES + ", m as (select patch, cell, x between x0 + 6 and x1 - 6 and y between y0 + 6 and y1 - 6 core, x between x0 and x1 and y between y0 and y1 in_outer from centers join patches on x between x0 - 20 and x1 + 20 and y between y0 - 20 and y1 + 20), n as (select patch, count(*) n from m group by 1 having count(*) between 2 and 400) select patch, cell, case when core then 'core' when in_outer then 'margin' else 'context' end as place from m join n using (patch)",
)
def patch_membership(spark, sf_dir):
    """Context rectangle = outer + 20; core = outer - 6; a patch with too few or too many cells is skipped whole."""
    t = Tables(spark, sf_dir)
    p = patches(spark)
    wide = p.select("patch", (F.col("x0") - 20).alias("x0"), (F.col("x1") + 20).alias("x1"), (F.col("y0") - 20).alias("y0"), (F.col("y1") + 20).alias("y1"))
    m = spatial.in_rectangles(t.centers.select("cell", "x", "y"), wide, "patch", 64.0)
    m = m.join(F.broadcast(p), "patch")
    within = lambda a: F.col("x").between(F.col("x0") + a, F.col("x1") - a) & F.col("y").between(F.col("y0") + a, F.col("y1") - a)
    m = m.withColumn("place", F.when(within(6), "core").when(within(0), "margin").otherwise("context"))
    sizes = m.groupBy("patch").agg(F.count("*").alias("n")).filter("n between 2 and 400").select("patch")
    return m.join(sizes, "patch", "left_semi").select("patch", "cell", "place")


@register("patch_leakage_overlap", "with " + PATCHES + " select a.patch as a, b.patch as b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) as area from patches a join patches b on a.patch % 2 = 0 and b.patch % 2 = 1 and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
def patch_leakage_overlap(spark, sf_dir):
    """Closed rectangles of one split that touch one of the other split; neighbours share a border of area 0."""
    p = patches(spark)
    side = lambda n, odd: p.filter(F.col("patch") % 2 == odd).select(F.col("patch").alias(n), *[F.col(c).alias(n + c) for c in ("x0", "x1", "y0", "y1")])
    o = spatial.rectangle_overlaps(side("a", 0), side("b", 1), 64.0)
    area = (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) * (F.least("ay1", "by1") - F.greatest("ay0", "by0"))
    return o.select("a", "b", R6(area, "area"))


OWN = ', ow as (select "row" rw, col, bin, cell from grid left join owner_px on barcode = bin)'
N8 = ", n8 as (select a.bin, a.cell, b.bin nb, b.cell ncell from ow a join ow b on b.rw between a.rw - 1 and a.rw + 1 and b.col between a.col - 1 and a.col + 1 and a.bin <> b.bin)"


def owned(t: Tables):
    return t.grid.select("bin", "row", "col").join(t.owners("px").select(F.col("barcode").alias("bin"), "cell"), "bin", "left")


@register("eight_neighbour_support", ctes("grid", "owner_px") + OWN + N8 + " select bin, count(*) filter (ncell is not null and ncell % 10 < 3) as assigned, round(count(*) filter (ncell is not null and ncell % 10 < 3) / 8.0, 6) as support from n8 group by bin")
def eight_neighbour_support(spark, sf_dir):
    n = spatial.neighbours(owned(Tables(spark, sf_dir)), spatial.EIGHT, ["bin"], ["cell"])
    hit = F.count_if(F.col("n_cell").isNotNull() & (F.col("n_cell") % 10 < 3))
    return n.groupBy("bin").agg(hit.alias("assigned"), R6(hit / 8.0, "support"))


@register("frontier_mask", ctes("grid", "owner_px") + OWN + N8 + " select bin from n8 where not (cell is not null and cell % 10 < 3) group by bin having count(*) filter (ncell is not null and ncell % 10 < 3) > 0")
def frontier_mask(spark, sf_dir):
    """Unassigned bins with an assigned neighbour."""
    n = spatial.neighbours(owned(Tables(spark, sf_dir)), spatial.EIGHT, ["bin", "cell"], ["cell"])
    taken = lambda c: F.col(c).isNotNull() & (F.col(c) % 10 < 3)
    return n.filter(~taken("cell")).groupBy("bin").agg(F.count_if(taken("n_cell")).alias("n")).filter("n > 0").select("bin")


@register(
    "exposed_edges_shape",
    ctes("grid", "owner_px") + OWN + """, e as (select a.cell, count(*) adj from ow a join ow b on a.cell = b.cell and abs(a.rw - b.rw) + abs(a.col - b.col) = 1 group by 1), m as (select cell, count(*) n, avg(col) mx, avg(rw) my, avg(col * col) - avg(col) * avg(col) vxx, avg(rw * rw) - avg(rw) * avg(rw) vyy, avg(col * rw) - avg(col) * avg(rw) vxy from ow where cell is not null group by 1),
s as (select m.*, 4 * n - coalesce(adj, 0) p, greatest(vxx, 0) sxx, greatest(vyy, 0) syy from m left join e using (cell)), q as (select *, (sxx + syy) / 2 h, sqrt(greatest((sxx - syy) * (sxx - syy) / 4 + vxy * vxy, 0)) r from s)
select cell, n as area, p as perimeter, round(ln(n + 1), 6) as log_area, round(4 * pi() * n / (p * p)::double, 6) as compactness, round(case when n < 3 then 1 else (h + r) / greatest(h - r, 1e-6) end, 4) as axis_ratio from q""",
)
def exposed_edges_shape(spark, sf_dir):
    """Area, exposed edges (4 n - adjacent pairs), compactness, and the ratio of the axes' variances."""
    o = owned(Tables(spark, sf_dir)).filter("cell is not null")
    adj = spatial.neighbours(o, spatial.FOUR, ["cell"], ["cell"]).filter("cell = n_cell").groupBy("cell").agg(F.count("*").alias("adj"))
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    m = o.groupBy("cell").agg(F.count("*").alias("n"), (F.avg(x * x) - F.avg(x) * F.avg(x)).alias("vxx"), (F.avg(y * y) - F.avg(y) * F.avg(y)).alias("vyy"), (F.avg(x * y) - F.avg(x) * F.avg(y)).alias("vxy"))
    s = m.join(adj, "cell", "left").withColumns({"p": 4 * F.col("n") - F.coalesce("adj", F.lit(0)), "sxx": F.greatest("vxx", F.lit(0.0)), "syy": F.greatest("vyy", F.lit(0.0))})
    h = (F.col("sxx") + F.col("syy")) / 2
    d = F.col("sxx") - F.col("syy")
    r = F.sqrt(F.greatest(d * d / 4 + F.col("vxy") * F.col("vxy"), F.lit(0.0)))
    ratio = F.when(F.col("n") < 3, 1.0).otherwise((h + r) / F.greatest(h - r, F.lit(1e-6)))
    return s.select("cell", F.col("n").alias("area"), F.col("p").alias("perimeter"), R6(F.ln(F.col("n") + 1), "log_area"), R6(maths.compactness(F.col("n"), F.col("p")), "compactness"), F.round(ratio, 4).alias("axis_ratio"))


@register("full_block_aggregate", ctes("counts", "grid") + ', b as (select "row" // 4 br, col // 4 bc, bin from grid), t as (select bin, sum(n) n from counts group by 1) select br as brow, bc as bcol, cast(sum(coalesce(n, 0)) as bigint) as n from b left join t using (bin) group by 1, 2 having count(*) = 16')
def full_block_aggregate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    totals = t.counts.groupBy("bin").agg(F.sum("n").alias("n"))
    bins = t.grid.join(totals, "bin", "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))
    return spatial.block_sums(bins, 4, "n").select(F.col("brow").cast("long").alias("brow"), F.col("bcol").cast("long").alias("bcol"), "n")


@register(
    "lag_neighbour_correlation",
    ctes("counts", "grid") + ', t as (select "row" rw, col, coalesce(n, 0)::double n from grid left join (select bin, sum(n) n from counts group by 1) using (bin)), l as (select lag, a.n a, b.n b from t a cross join (select unnest([1, 2, 3]) lag) join t b on b.rw = a.rw and b.col = a.col + lag) select lag, count(*) as pairs, round(corr(a, b), 6) as correlation from l group by lag',
)
def lag_neighbour_correlation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    totals = t.counts.groupBy("bin").agg(F.sum("n").alias("n"))
    bins = t.grid.join(totals, "bin", "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    out = None
    for lag in (1, 2, 3):
        p = spatial.lag_pairs(bins, (0, lag), "v").agg(F.lit(lag).alias("lag"), F.count("*").alias("pairs"), R6(F.corr("a", "b"), "correlation"))
        out = p if out is None else out.unionByName(p)
    return out


@register("boundary_f1", ctes("grid", "owner_px", "owner_price") + """, a as (select "row" rw, col, bin, p.cell pc, q.cell qc from grid left join owner_px p on p.barcode = bin left join owner_price q on q.barcode = bin),
pb as (select a.bin, a.pc cell from a left join a b on abs(a.rw - b.rw) <= 1 and abs(a.col - b.col) <= 1 and a.bin <> b.bin and a.pc = b.pc where a.pc is not null group by 1, 2 having count(b.bin) < 8),
qb as (select a.bin, a.qc cell from a left join a b on abs(a.rw - b.rw) <= 1 and abs(a.col - b.col) <= 1 and a.bin <> b.bin and a.qc = b.qc where a.qc is not null group by 1, 2 having count(b.bin) < 8),
i as (select cell, count(*) n from pb join qb using (bin, cell) group by 1), p as (select cell, count(*) n from pb group by 1), q as (select cell, count(*) n from qb group by 1)
select cell, p.n as pred_boundary, q.n as truth_boundary, coalesce(i.n, 0) as common, round(2 * coalesce(i.n, 0) / (p.n + q.n)::double, 6) as f1 from p join q using (cell) left join i using (cell)""")
def boundary_f1(spark, sf_dir):
    """A bin is on the boundary of its cell when one of its eight neighbours is not in it."""
    t = Tables(spark, sf_dir)

    def boundary(owner):
        o = t.grid.select("bin", "row", "col").join(owner.select(F.col("barcode").alias("bin"), "cell"), "bin")
        same = spatial.neighbours(o, spatial.EIGHT, ["bin", "cell"], ["cell"]).filter("cell = n_cell").groupBy("bin").agg(F.count("*").alias("n"))
        return o.join(same, "bin", "left").filter("coalesce(n, 0) < 8").select("bin", "cell")

    p, q = boundary(t.owners("px")), boundary(t.owners("price"))
    n = lambda d, name: d.groupBy("cell").agg(F.count("*").alias(name))
    j = n(p, "pred_boundary").join(n(q, "truth_boundary"), "cell").join(n(p.join(q, ["bin", "cell"]), "common"), "cell", "left")
    common = F.coalesce("common", F.lit(0))
    return j.select("cell", "pred_boundary", "truth_boundary", common.alias("common"), R6(2 * common / (F.col("pred_boundary") + F.col("truth_boundary")), "f1"))


@register("outer_ring_fp", ctes("grid", "owner_px", "owner_price") + """, a as (select "row" rw, col, bin, p.cell pc, q.cell qc from grid left join owner_px p on p.barcode = bin left join owner_price q on q.barcode = bin),
ring as (select distinct q.qc cell, b.bin, b.pc from a q join a b on abs(q.rw - b.rw) + abs(q.col - b.col) = 1 and b.qc is distinct from q.qc where q.qc is not null)
select cell, count(*) as ring, count(*) filter (pc = cell) as ring_fp from ring group by cell""")
def outer_ring_fp(spark, sf_dir):
    """Four-neighbour dilation minus the cell; how many ring bins the prediction claims."""
    t = Tables(spark, sf_dir)
    o = t.grid.select("bin", "row", "col").join(t.owners("px").select(F.col("barcode").alias("bin"), F.col("cell").alias("pc")), "bin", "left").join(t.owners("price").select(F.col("barcode").alias("bin"), F.col("cell").alias("qc")), "bin", "left")
    left = o.filter("qc is not null").select("row", "col", "qc")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spatial.FOUR])
    moved = left.select(F.col("qc").alias("cell"), "row", "col", F.explode(steps).alias("s")).select("cell", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).distinct()
    ring = moved.join(o, ["row", "col"]).filter(~F.col("qc").eqNullSafe(F.col("cell")))
    return ring.groupBy("cell").agg(F.count("*").alias("ring"), F.count_if(F.col("pc") == F.col("cell")).alias("ring_fp"))


@register("parse_barcodes", ctes("grid") + """, b as (select bin, printf('s_002um_%05d_%05d-1', "row", col) barcode from grid) select bin, barcode, cast(regexp_extract(barcode, '^s_002um_([0-9]+)_([0-9]+)-1$', 1) as integer) as row, cast(regexp_extract(barcode, '^s_002um_([0-9]+)_([0-9]+)-1$', 2) as integer) as col, cast(regexp_extract(barcode, '_([0-9]{5})_([0-9]{5})', 2) as integer) * 2 - 1 as nb_x from b""")
def parse_barcodes(spark, sf_dir):
    g = Tables(spark, sf_dir).grid.select("bin", ids.format_barcode(F.col("row"), F.col("col")).alias("barcode"))
    row, col = ids.parse_barcode(F.col("barcode"))
    return g.select("bin", "barcode", row.alias("row"), col.alias("col"), ids.notebook_bin(F.col("barcode"))[0].alias("nb_x"))


@register("crop_region", ctes("grid", "owner_px") + ', k as (select g.* from grid g join owner_px on barcode = bin), b as (select min("row") r0, max("row") + 1 r1, min(col) c0, max(col) + 1 c1 from k where "row" >= 10 and col between 16 and 95) select bin, "row" - r0 as crop_row, col - c0 as crop_col from k, b where "row" >= r0 and "row" < r1 and col >= c0 and col < c1')
def crop_region(spark, sf_dir):
    """Half-open box around selected in-tissue bins; rows move to crop coordinates."""
    t = Tables(spark, sf_dir)
    k = t.grid.join(t.owners("px").select(F.col("barcode").alias("bin")), "bin")
    b = k.filter("row >= 10 and col between 16 and 95").agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))
    return k.crossJoin(F.broadcast(b)).filter("row >= r0 and row < r1 and col >= c0 and col < c1").select("bin", (F.col("row") - F.col("r0")).alias("crop_row"), (F.col("col") - F.col("c0")).alias("crop_col"))


@register("grid_step_and_runs", ctes("grid", "owner_px") + ', o as (select "row" rw, col from grid join owner_px on barcode = bin), s as (select rw, col, case when col - lag(col) over (partition by rw order by col) = 1 then 0 else 1 end n from o) select rw as row, cast(sum(n) as bigint) as runs, count(*) as bins from s group by rw')
def grid_step_and_runs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.grid.join(t.owners("px").select(F.col("barcode").alias("bin")), "bin").select("row", "col")
    return ranked.runs(o, ["row"], "col").groupBy("row").agg(F.max("run").cast("long").alias("runs"), F.count("*").alias("bins"))


@register("affine_round_trip", ctes("centers") + " select cell, round(x / 0.5 * 1.25 + 10, 6) as px, round(y / 0.5 * 0.75 - 4, 6) as py, round(x, 6) as back_x, round(y, 6) as back_y from centers")
def affine_round_trip(spark, sf_dir):
    m = (2.5, 0.0, 10.0, 0.0, 1.5, -4.0)
    c = Tables(spark, sf_dir).centers
    px, py = maths.affine(F.col("x"), F.col("y"), m)
    p = c.select("cell", px.alias("px"), py.alias("py"))
    bx, by = maths.inverse_affine(F.col("px"), F.col("py"), m)
    return p.select("cell", R6(F.col("px"), "px"), R6(F.col("py"), "py"), R6(bx, "back_x"), R6(by, "back_y"))


@register("distance_band_summary", ctes("grid", "centers") + "," + NEAR + ", b as (select cell, d, case when d <= 5 then '0-5' when d <= 10 then '5-10' when d <= 15 then '10-15' else '15-20' end band from near) select band, count(*) as n, round(avg(d), 6) as mean_d, round(quantile_cont(d, 0.5), 6) as median_d, round(quantile_cont(d, 0.99), 6) as p99_d from b group by band")
def distance_band_summary(spark, sf_dir):
    """Bands closed on the right."""
    t = Tables(spark, sf_dir)
    p = spatial.radius_join(t.grid.select("bin", "x", "y"), centers(t), 20.0)
    d = F.col("d")
    b = p.withColumn("band", F.when(d <= 5, "0-5").when(d <= 10, "5-10").when(d <= 15, "10-15").otherwise("15-20"))
    return b.groupBy("band").agg(F.count("*").alias("n"), R6(F.avg("d"), "mean_d"), R6(F.percentile("d", F.lit(0.5)), "median_d"), R6(F.percentile("d", F.lit(0.99)), "p99_d"))


@register("top_cell_order", ctes("centers") + " select cell, row_number() over (order by type desc, x, cell) as place from centers")
def top_cell_order(spark, sf_dir):
    """Stable sort by mixed keys, made total by the id."""
    c = Tables(spark, sf_dir).centers
    return ranked.places(c, F.struct((-F.col("type")).alias("t"), "x", "cell")).select("cell", "place")
