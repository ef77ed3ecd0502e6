"""Trajectories, replay, logs, strings, simulation by hash draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import ids
from ...operators import evaluate as ev
from ...operators import sequences as sq
from ...operators import ranked, simulate
from ..bindings import Tables, ctes
from ..catalog import register
from .spatial import R6

GAMMA, LAM = 0.9, 0.8


@register("discounted_returns", ctes("steps") + f", recursive_ret as (with recursive m as (select traj, max(step) n from steps group by 1), r as (select s.traj, s.step, s.reward::double ret from steps s join m on m.traj = s.traj and s.step = m.n union all select s.traj, s.step, s.reward + {GAMMA} * r.ret from r join steps s on s.traj = r.traj and s.step = r.step - 1) select * from r) select traj, step, round(ret, 4) as ret from recursive_ret")
def discounted_returns(spark, sf_dir):
    s = Tables(spark, sf_dir).steps
    return sq.discounted_returns(s, "traj", "step", "reward", GAMMA).select("traj", "step", F.round("ret", 4).alias("ret"))


@register("gae", ctes("steps") + f""", d as (select traj, step, reward + {GAMMA} * coalesce(lead(value) over (partition by traj order by step), 0) * (case when done then 0.0::double else 1.0::double end) - value d, {GAMMA * LAM} * (case when done then 0.0::double else 1.0::double end) k from steps),
rec as (with recursive m as (select traj, max(step) n from d group by 1), r as (select d.traj, d.step, d.d::double a from d join m on m.traj = d.traj and d.step = m.n union all select d.traj, d.step, d.d + d.k * r.a from r join d on d.traj = r.traj and d.step = r.step - 1) select * from r) select traj, step, round(a, 4) as adv from rec""")
def gae(spark, sf_dir):
    s = Tables(spark, sf_dir).steps
    return sq.gae(s, "traj", "step", "reward", "value", "done", GAMMA, LAM).select("traj", "step", F.round("adv", 4).alias("adv"))


@register("monte_carlo_advantage", ctes("steps") + f", recursive_ret as (with recursive m as (select traj, max(step) n from steps group by 1), r as (select s.traj, s.step, s.reward::double ret, s.value from steps s join m on m.traj = s.traj and s.step = m.n union all select s.traj, s.step, s.reward + {GAMMA} * r.ret, s.value from r join steps s on s.traj = r.traj and s.step = r.step - 1) select * from r) select traj, count(*) as n, round(avg(ret - value), 4) as mean_adv from recursive_ret group by traj")
def monte_carlo_advantage(spark, sf_dir):
    s = sq.discounted_returns(Tables(spark, sf_dir).steps, "traj", "step", "reward", GAMMA)
    return s.groupBy("traj").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ret") - F.col("value")), 4).alias("mean_adv"))


@register("group_advantage", ctes("steps") + ', g as (select *, cast(floor((step - 1) / 8.0) as integer) grp from steps) select traj, step, grp as "group", round((reward - avg(reward) over w) / (stddev_pop(reward) over w + 1e-8), 5) as adv from g window w as (partition by traj, grp)')
def group_advantage(spark, sf_dir):
    s = sq.group_advantage(Tables(spark, sf_dir).steps, "traj", "step", "reward", 8)
    return s.select("traj", "step", "group", F.round("adv", 5).alias("adv"))


@register("moving_average_reward", ctes("steps") + ", m as (select traj, step, avg(reward) over w m, count(*) over w c from steps window w as (partition by traj order by step rows between 4 preceding and current row)) select traj, step, round(case when c >= 5 then m end, 6) as moving from m")
def moving_average_reward(spark, sf_dir):
    s = sq.moving_mean(Tables(spark, sf_dir).steps, "traj", "step", "reward", 5)
    return s.select("traj", "step", R6(F.col("moving"), "moving"))


@register("patience_fold", ctes("steps") + ", b as (select traj, step, reward, max(reward) over (partition by traj order by step rows between unbounded preceding and 1 preceding) pb from steps), i as (select *, pb is null or reward > pb im from b) select traj, step, greatest(coalesce(pb, reward), reward) as best, step - max(case when im then step end) over (partition by traj order by step rows unbounded preceding) as stale from i")
def patience_fold(spark, sf_dir):
    return sq.patience(Tables(spark, sf_dir).steps, "traj", "step", "reward").select("traj", "step", "best", "stale")


@register("owner_replay_at_step", ctes("steps") + ", a as (select traj, k % 10 item, step, case when kind = 'error' then -1 else k end owner from steps where kind <> 'view' and step <= 30) select traj, item, arg_max(owner, step) as owner, max(step) as since from a group by 1, 2")
def owner_replay_at_step(spark, sf_dir):
    s = Tables(spark, sf_dir).steps.filter("kind <> 'view'")
    a = s.select("traj", (F.col("k") % 10).alias("item"), "step", F.when(F.col("kind") == "error", F.lit(-1).cast("long")).otherwise(F.col("k")).alias("owner"))
    return sq.owner_at(a, ["traj"], "item", "step", 30, "owner")


@register(
    "seek_replay",
    ctes("steps")
    + """, a as (select traj, k % 10 item, step, case when kind = 'error' then -1 else k end owner from steps where kind <> 'view'),
h as (select s.traj, s.step at_, item, arg_max(owner, a.step) owner from steps s join a on a.traj = s.traj and a.step <= s.step group by 1, 2, 3)
select traj, at_ as step, count(*) filter (owner >= 0) as owned, cast(sum((item + 1) * (owner + 2)) as bigint) as mark from h group by 1, 2""",
)
def seek_replay(spark, sf_dir):
    """The owners after every step of every trajectory, from key frames eight steps apart."""
    s = Tables(spark, sf_dir).steps
    a = s.filter("kind <> 'view'").select("traj", (F.col("k") % 10).alias("item"), "step", F.when(F.col("kind") == "error", F.lit(-1).cast("long")).otherwise(F.col("k")).alias("owner"))
    frames = sq.key_frames(a, ["traj"], "item", "step", "owner", 8)
    held = sq.seek(frames, a, s.select("traj", F.col("step").alias("at")), ["traj"], "item", "step", "owner", 8)
    return held.groupBy("traj", F.col("at").alias("step")).agg(F.count_if(F.col("owner") >= 0).alias("owned"), F.sum(F.expr("(item + 1) * (owner + 2)")).alias("mark"))


@register(
    "evolution_grid",
    ctes("steps")
    + """, p as (select traj, (step - 1) / (max(step) over (partition by traj) - 1)::double x, sum(reward) over (partition by traj order by step) y from steps), s as (select traj, x x0, y y0, lead(x) over w x1, lead(y) over w y1 from p window w as (partition by traj order by x)),
g as (select traj, g, case when x1 is null or x1 = x0 then y0 else y0 + (y1 - y0) * (g / 20.0::double - x0) / (x1 - x0) end v from s, range(21) r(g) where (g / 20.0::double >= x0 - 1e-9/20 and (g / 20.0::double < x1 - 1e-9/20)) or (x1 is null and g = 20))
select cast(g as integer) as g, count(*) as n, round(avg(v), 4) as mean, round(stddev_samp(v) / sqrt(count(*)), 4) as sem from g group by g""",
)
def evolution_grid(spark, sf_dir):
    """Cumulated reward of each trajectory on a common grid of 21 points; mean and standard error."""
    s = Tables(spark, sf_dir).steps
    w = Window.partitionBy("traj")
    p = s.select("traj", ((F.col("step") - 1) / (F.max("step").over(w) - 1)).alias("x"), F.sum("reward").over(w.orderBy("step")).alias("y"))
    g = sq.on_grid(p, "traj", "x", "y", 21)
    return g.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")), 4).alias("sem"))


@register("chosen_action_rank", "with a as (select l_orderkey k, l_extendedprice r, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 c from lineitem), m as (select k, max(r) filter (c) rc, max(r) best from a group by 1) select a.k as bin, count(*) filter (a.r > rc) + 1 as rank, best, round(best - rc, 2) as regret from a join m using (k) group by a.k, best, rc")
def chosen_action_rank(spark, sf_dir):
    li = Tables(spark, sf_dir).raw("lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    a = li.select(F.col("l_orderkey").alias("bin"), F.col("l_extendedprice").alias("r"), (F.row_number().over(w) == 1).alias("c"))
    return sq.choice_rank(a, ["bin"], "r", "c").select("bin", "rank", "best", F.round("regret", 2).alias("regret"))


@register("step_log_updates", "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n, round(sum(value), 4) as total, max(event_id) as last_event from events where event_type = 'click' group by 1")
def step_log_updates(spark, sf_dir):
    e = Tables(spark, sf_dir).raw("events").filter("event_type = 'click'")
    k = F.from_json("props", "k bigint")["k"]
    return e.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_event"))


@register("first_last_per_key", "select user_id as key, arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_id, (ts, event_id)) as last_event, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def first_last_per_key(spark, sf_dir):
    """drop_duplicates keep first and keep last, with the order made explicit."""
    from ...operators import ranked

    e = Tables(spark, sf_dir).raw("events").select(F.col("user_id").alias("key"), "event_id", "event_type", "ts")
    order = [F.col("ts"), F.col("event_id")]
    a = ranked.first_by(e, ["key"], order).select("key", F.col("event_id").alias("first_event"))
    b = ranked.last_by(e, ["key"], order).select("key", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"))
    return a.join(b, "key")


@register("normalize_ids", "with i as (select 0 o, cast(o_orderkey as varchar) t from orders union all select 1, cast(o_orderkey as varchar) || '.0' from orders union all select 2, '  ' || cast(o_orderkey as varchar) || ' ' from orders union all select 3, '' union all select 4, 'NaN' union all select 5, '12.5') select o as form, t as raw, case when trim(t) = '' or lower(trim(t)) in ('nan', 'none', 'null') then null when regexp_matches(trim(t), '^[+-]?[0-9]+\\.0+$') then regexp_extract(trim(t), '^([+-]?[0-9]+)\\.0+$', 1) else trim(t) end as id from i".replace("\\\\", "\\"))
def normalize_ids(spark, sf_dir):
    return _id_forms(spark, Tables(spark, sf_dir).raw("orders"))


def _id_forms(spark, orders):
    o = orders.select(F.col("o_orderkey").cast("string").alias("k"))
    forms = o.select(F.posexplode(F.array(F.col("k"), F.concat("k", F.lit(".0")), F.concat(F.lit("  "), "k", F.lit(" ")))).alias("form", "raw"))
    odd = spark.createDataFrame([(3, ""), (4, "NaN"), (5, "12.5")], "form int, raw string")
    return forms.unionByName(odd).select("form", "raw", ids.normalize_cell_id(F.col("raw")).alias("id"))


@register("slugify", "select page_id, case when s = '' then 'item' else s end as slug from (select page_id, regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') s from pages)")
def slugify(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").select("page_id", ids.slugify(F.col("url")).alias("slug"))


@register("method_tokens", "select c_custkey as id, case when c_mktsegment like '%BUILD%' then 'built' when c_mktsegment like '%MACH%' then 'machine' else 'other' end as label, 'run_s' || c_mktsegment || '_n' || c_nationkey as variant from customer")
def method_tokens(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("customer")
    label = ids.method_token(F.col("c_mktsegment"), [("build", "built"), ("mach", "machine")], "other")
    return c.select(F.col("c_custkey").alias("id"), label.alias("label"), ids.variant_name("run", s=F.col("c_mktsegment"), n=F.col("c_nationkey")).alias("variant"))


@register("cell_lists_json", "select n_regionkey as region, to_json(list(cast(n_nationkey as varchar) order by n_nationkey)) as cells, count(*) as n from nation group by 1")
def cell_lists_json(spark, sf_dir):
    """Lists of ids as JSON text and back."""
    n = Tables(spark, sf_dir).raw("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("l"))
    j = n.select("region", ids.to_cell_list(F.transform("l", lambda x: x.cast("string"))).alias("cells"))
    return j.select("region", "cells", F.size(ids.cell_list(F.col("cells"))).cast("long").alias("n"))


@register("natural_order", "with k as (select case when c_custkey % 3 = 0 then 'c' || c_custkey else cast(c_custkey as varchar) end id from customer) select id, row_number() over (order by not regexp_matches(id, '^[0-9]+$'), try_cast(id as bigint) nulls first, id) as place from k")
def natural_order(spark, sf_dir):
    k = Tables(spark, sf_dir).raw("customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return ranked.places(k, ids.natural_key(F.col("id")))


@register("markdown_table", "select n_nationkey as k, '| ' || replace(n_name, '|', '\\|') || ' | ' || printf('%.4f', n_regionkey / 3.0) || ' |' as line from nation".replace("\\\\", "\\"))
def markdown_table(spark, sf_dir):
    n = Tables(spark, sf_dir).raw("nation")
    return n.select(F.col("n_nationkey").alias("k"), ids.markdown_row(F.col("n_name"), F.format_string("%.4f", F.col("n_regionkey") / 3.0)).alias("line"))


@register("run_stamps", "select event_id as id, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from events")
def run_stamps(spark, sf_dir):
    e = Tables(spark, sf_dir).raw("events")
    ts = F.col("ts")
    return e.select(F.col("event_id").alias("id"), ids.run_stamp(ts).alias("stamp"), ids.iso_utc(ts).alias("iso"))


@register("newest_run", "select event_type as kind, max(strftime(ts, '%Y%m%dT%H%M%SZ')) as newest from events group by 1")
def newest_run(spark, sf_dir):
    return Tables(spark, sf_dir).raw("events").groupBy(F.col("event_type").alias("kind")).agg(F.max(ids.run_stamp(F.col("ts"))).alias("newest"))


DRAW = "cast('0x' || substr(sha256({}), 1, 13) as bigint)::double / " + f"{16**13}.0::double"


@register("thin_counts_hash", ctes("counts") + f" select bin, gene, n, count(*) filter ({DRAW.format(repr('5:') + ' || bin || ' + repr(':') + ' || gene || ' + repr(':') + ' || i')} < 0.4) as kept from counts, unnest(range(n)) u(i) group by 1, 2, 3")
def thin_counts_hash(spark, sf_dir):
    """Binomial thinning: each single count is kept when its own hash draw is under p."""
    return simulate.thin(Tables(spark, sf_dir).counts, ["bin", "gene"], "n", 0.4, 5)


@register(
    "rarefy_exact_hash",
    ctes("counts") + """, t as (select bin from counts group by 1 having sum(n) >= 20), u as (select bin, gene, i from counts join t using (bin), unnest(range(n)) x(i)), r as (select *, row_number() over (partition by bin order by sha256('9:' || bin || ':' || gene || ':' || i), gene, i) rn from u) select bin, gene, count(*) as n from r where rn <= 20 group by 1, 2""",
)
def rarefy_exact_hash(spark, sf_dir):
    """Exactly twenty counts of each bin that has them, without replacement: the first in hash order."""
    return simulate.rarefy(Tables(spark, sf_dir).counts, "bin", "gene", "n", 20, 9)


@register("multinomial_profiles", "with c as (select l_suppkey cell, cast(l_partkey % 10 as bigint) gene, cast(sum(l_quantity) as bigint) n from lineitem group by 1, 2), s as (select cell, gene, n, coalesce(sum(n) over (partition by cell order by gene rows between unbounded preceding and 1 preceding), 0) lo, sum(n) over (partition by cell) t from c), d as (select cell, i, floor(" + DRAW.format("'3:' || cell || ':' || i") + " * t) x from (select distinct cell, t from s), range(30) r(i)) select s.cell, s.gene, count(*) as n from d join s on s.cell = d.cell and x >= lo and x < lo + n group by 1, 2")
def multinomial_profiles(spark, sf_dir):
    """Thirty draws for each cell from its own profile; draws depend on the cell alone, not on the order of rows."""
    li = Tables(spark, sf_dir).raw("lineitem")
    c = li.groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 10).alias("gene")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return simulate.multinomial(c, "cell", "gene", "n", 30, 3)


@register("exclusive_assignment")
def exclusive_assignment(spark, sf_dir):
    """Sources to cells of their type, each source once: hash order against hash order, conserved by construction."""
    t = Tables(spark, sf_dir)
    cells = t.raw("customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 128 * 2.0).alias("x"), (F.col("c_custkey") % 97 * 2.0).alias("y"))
    sources = t.raw("customer").select((F.col("c_custkey") + 1_000_000).alias("source"), F.col("c_mktsegment").alias("type"))
    return simulate.exclusive(cells, sources, "type", min_distance=6.0, seed=4)


@register("set_operations", "with a as (select distinct l_suppkey k from lineitem where l_partkey % 2 = 0), b as (select distinct l_suppkey k from lineitem where l_partkey % 3 = 0 and l_suppkey % 2 = 0) select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'only_a', count(*) from (select * from a except select * from b) union all select 'only_b', count(*) from (select * from b except select * from a) union all select 'all', count(*) from (select * from a union select * from b)")
def set_operations(spark, sf_dir):
    """Shared axis and both differences from one tagged aggregate, not from three set operators."""
    li = Tables(spark, sf_dir).raw("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p"))
    g = li.groupBy("k").agg(F.bool_or(F.col("p") % 2 == 0).alias("a"), F.bool_or((F.col("p") % 3 == 0) & (F.col("k") % 2 == 0)).alias("b")).filter("a or b")
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b")
    rows = g.select(F.explode(F.array(part, F.lit("all"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(x,) for x in ("both", "only_a", "only_b", "all")], "part string")
    return names.join(rows, "part", "left").select("part", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@register("union_missing_columns", "select n_nationkey as id, n_name as name, null::bigint as size from nation union all select p_partkey, null, p_size from part")
def union_missing_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _nations_and_parts(t, t.raw("part"))


def _nations_and_parts(t: Tables, part):
    a = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    b = part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@register("stratified_quota", "with c as (select c_mktsegment s, count(*) n from customer group by 1), q as (select s, greatest(1, cast(round_even(100 * n / sum(n) over ()::double, 0) as bigint)) quota from c), r as (select c_custkey k, c_mktsegment s, row_number() over (partition by c_mktsegment order by sha256('2:' || c_custkey), c_custkey) rn from customer) select k as id, s as stratum from r join q using (s) where rn <= quota")
def stratified_quota(spark, sf_dir):
    """A sampling operator: a quota for each stratum by its share, filled in hash order."""
    c = Tables(spark, sf_dir).raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"))
    return simulate.stratified(c, "stratum", "id", 100, 2)


@register("split_by_position", "with r as (select c_custkey id, row_number() over (partition by c_nationkey order by sha256('6:' || c_custkey), c_custkey) rn from customer) select id, case when rn <= 10 then 'calibration' when rn <= 20 then 'validation' else 'test' end as split from r")
def split_by_position(spark, sf_dir):
    c = Tables(spark, sf_dir).raw("customer")
    w = Window.partitionBy("c_nationkey").orderBy(ids.hash_rank_key(6, F.col("c_custkey")), "c_custkey")
    rn = F.row_number().over(w)
    return c.select(F.col("c_custkey").alias("id"), F.when(rn <= 10, "calibration").when(rn <= 20, "validation").otherwise("test").alias("split"))


@register("patch_json_bundle", ctes("pairs") + ", p as (select barcode % 16 patch, barcode, cell, px from pairs) select patch, count(*) as n, cast(sum(px) as bigint) as px from p group by 1")
def patch_json_bundle(spark, sf_dir):
    return _json_bundle(Tables(spark, sf_dir).pairs)


def _json_bundle(pairs):
    """One JSON document for each patch, and its rows back from the text."""
    p = pairs.select((F.col("barcode") % 16).alias("patch"), "barcode", "cell", "px")
    doc = p.groupBy("patch").agg(F.to_json(F.struct(F.col("patch"), F.sort_array(F.collect_list(F.struct("barcode", "cell", "px"))).alias("bins"))).alias("doc"))
    back = doc.select("patch", F.explode(F.from_json("doc", "patch bigint, bins array<struct<barcode:bigint,cell:bigint,px:bigint>>")["bins"]).alias("b"))
    return back.groupBy("patch").agg(F.count("*").alias("n"), F.sum("b.px").alias("px"))


@register("outcome_components", ctes("owner_px", "owner_price", "truth") + " , o as (select case when t.cell is null then 'no_gt' when a.cell = t.cell and b.cell <> t.cell then 'damaged' when a.cell <> t.cell and b.cell = t.cell then 'corrected' when a.cell = t.cell then 'unchanged_correct' when a.cell = b.cell then 'unresolved' else 'wrong_to_wrong' end oc, o_totalprice v from owner_px a join owner_price b using (barcode) left join truth t using (barcode) join orders on o_orderkey = barcode) select oc as outcome, count(*) as n, round(sum(v), 2) as total, round(avg(v), 4) as mean from o group by 1")
def outcome_components(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t.owners("px").withColumnRenamed("cell", "x"), t.owners("price").withColumnRenamed("cell", "y")
    o = a.join(b, "barcode").join(t.truth.withColumnRenamed("cell", "z"), "barcode", "left").join(t.raw("orders").select(F.col("o_orderkey").alias("barcode"), "o_totalprice"), "barcode")
    g = o.groupBy(ev.outcome(F.col("x"), F.col("y"), F.col("z")).alias("outcome"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
