"""Patches whose cells act together: legal actions, joint steps with rollback in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.legal import Rules, legal_actions
from ...streaming import joint
from ...streaming import windows as st
from ..bindings import Tables, ctes
from ..catalog import register

RULES = Rules(eps=0.5, support=8.0, scale="mean_expression_bins", most=9)
CELLS, STEPS = 5, 12
#: A cell asks for each of its claims three times, these steps apart.
AGAIN = (0, 5, 7)

#: Patches of 16 x 16 bins with five cells each; an eighth of the bins is owned at the start, in every third patch all targets are; worth is in pixels.
_BOARD = (
    ctes("grid", "pairs")
    + f""",
cl as (select ("row" // 16) * 8 + col // 16 patch, bin, p.cell % {CELLS} cell, cast(sum(px) - 24 as double) worth from pairs p join grid on bin = barcode group by all),
top as (select patch, bin, cell from (select *, row_number() over (partition by patch, bin order by worth desc, cell) r from cl) where r = 1),
bn as (select ("row" // 16) * 8 + col // 16 patch, bin, "row" rw, col, case when (bin + "row") % 8 = 0 or (bin % 24 = 5 and ("row" // 16) % 3 = 0) then coalesce(top.cell, -1) else -1 end cell, bin % 24 = 5 target, bin % 5 <> 0 allowed from grid left join top using (bin)),
of as (select i, j from (select unnest([-1, 0, 1]) i), (select unnest([-1, 0, 1]) j) where i <> 0 or j <> 0),
nt as (select patch, greatest(1, count(*) filter (target)) den from bn group by 1)"""
)


def _legal(board: str, p: str = "") -> str:
    """CTEs of the legal actions (bin, cell, old, reward) on a board."""
    return f"""
{p}su as (select a.patch, a.bin, b.cell, count(*) k from {board} a, of join {board} b on a.patch = b.patch and a.rw + i = b.rw and a.col + j = b.col where b.cell >= 0 group by all),
{p}ha as (select distinct patch, cell from {board} where cell >= 0),
{p}pf as (select patch, coalesce(bool_or(target and cell < 0), false) pre from {board} group by 1),
{p}fr as (select cl.patch, cl.bin, cl.cell, b.cell old, b.target, b.allowed, pre, cl.worth + {RULES.support} / 4 * coalesce(su.k, 0) gain from cl join {board} b using (patch, bin) join {p}pf using (patch) left join {p}su su on su.patch = cl.patch and su.bin = cl.bin and su.cell = cl.cell left join {p}ha ha on ha.patch = cl.patch and ha.cell = cl.cell where b.cell <> cl.cell and (su.k > 0 or ha.cell is null)),
{p}la as (select fr.patch, fr.bin, fr.cell, fr.old, (fr.gain - coalesce(o.worth, 0) - {RULES.support} / 4 * coalesce(so.k, 0)) / den reward from {p}fr fr join nt using (patch) left join cl o on o.patch = fr.patch and o.bin = fr.bin and o.cell = fr.old left join {p}su so on so.patch = fr.patch and so.bin = fr.bin and so.cell = fr.old
  where (fr.old < 0 and (target or not pre)) or (fr.old >= 0 and allowed and (target or not pre) and (fr.gain - coalesce(o.worth, 0) - {RULES.support} / 4 * coalesce(so.k, 0)) / den > {RULES.eps}))"""


#: The recursion carries the whole board of each patch from step to step.
_STEPS_SQL = (
    _BOARD.replace("with ", "with recursive ", 1)
    + f""",
rq as (select patch, 1 + (bin * 7 + cell * 3 + j) % {STEPS} step, cell, bin, m from (select unnest({list(AGAIN)}) j), (select ("row" // 16) * 8 + col // 16 patch, bin, l_suppkey % {CELLS} cell, count(*) m from lineitem join grid on bin = l_orderkey group by all)),
nq as (select patch, step, sum(m) n from rq group by all),
r as (
select patch, 0::bigint step, bin, rw, col, cell, target, allowed, '' phase, '' outcome, 0::bigint applied, 0::bigint masked, 0.0::double reward, null::varchar ended from bn
union all
(with b0 as (select patch, step + 1 step, bin, rw, col, cell, target, allowed from r where ended is null and step < {STEPS} and (patch, step + 1) in (select patch, step from nq)),
{_legal("b0")},
ap as (select patch, bin, min(cell) cell from rq join (select distinct patch, step from b0) using (patch, step) join la using (patch, bin, cell) group by 1, 2),
b1 as (select b0.* exclude (cell), b0.cell old, coalesce(ap.cell, b0.cell) cell from b0 left join ap using (patch, bin)),
su1 as (select a.patch, a.bin, b.cell, count(*) k from b1 a, of join b1 b on a.patch = b.patch and a.rw + i = b.rw and a.col + j = b.col where b.cell >= 0 group by all),
o0 as (select patch, sum(coalesce(worth, 0) + {RULES.support} / 8 * coalesce(k, 0)) v from b0 left join cl using (patch, bin, cell) left join su using (patch, bin, cell) where cell >= 0 group by 1),
o1 as (select patch, sum(coalesce(worth, 0) + {RULES.support} / 8 * coalesce(k, 0)) v from b1 left join cl using (patch, bin, cell) left join su1 using (patch, bin, cell) where cell >= 0 group by 1),
ha1 as (select distinct patch, cell from b1 where cell >= 0),
ca as (select distinct cl.patch from cl join b1 using (patch, bin) left join su1 s on s.patch = cl.patch and s.bin = cl.bin and s.cell = cl.cell left join ha1 h on h.patch = cl.patch and h.cell = cl.cell where b1.cell < 0 and target and (s.k > 0 or h.cell is null)),
su2 as (select patch, count(*) filter (cell <> old) moved, bool_or(target and old < 0) pre, not bool_or(target and cell < 0) filled, any_value(step) step from b1 group by 1),
re as (select s.*, n - moved masked, ca.patch is not null can, (coalesce(o1.v, 0) - coalesce(o0.v, 0)) / den gain from su2 s join nq using (patch, step) join nt using (patch) left join o0 using (patch) left join o1 using (patch) left join ca using (patch)),
vd as (select re.*, case when moved = 0 then case when pre and can then 'no_proposal' else 'stop' end when not pre and gain <= {RULES.eps} then 'rollback' else 'applied' end outcome from re)
select b1.patch, b1.step, bin, rw, col, case when outcome = 'rollback' then old else b1.cell end, target, allowed, case when pre then 'prefill' else 'postfill' end, outcome, case when outcome = 'applied' then moved else 0 end, masked,
  case outcome when 'no_proposal' then -1.0::double / den when 'stop' then 0 else gain end,
  coalesce(case outcome when 'stop' then case when pre then 'truncated' else 'terminated' end when 'rollback' then 'terminated' when 'applied' then case when pre and not filled and not can then 'truncated' end end, case when b1.step >= {RULES.most} then 'truncated' end)
from b1 join vd using (patch) join nt using (patch)))"""
)


def _patch():
    return (F.expr("row div 16") * 8 + F.expr("col div 16")).alias("patch")


def board(t: Tables):
    """(bins, claims) of all patches at the start."""
    at = t.grid.select(_patch(), "bin", "row", "col")
    # Bins meet their places before the sum, so one exchange by bin serves the join, the sum and the best claim.
    claims = t.claims.select(F.col("barcode").alias("bin"), (F.col("cell") % CELLS).alias("cell"), "px").join(at, "bin").groupBy("patch", "bin", "cell").agg((F.sum("px") - 24).cast("double").alias("worth"))
    top = claims.groupBy("bin").agg(F.max_by("cell", F.struct(F.col("worth"), -F.col("cell"))).alias("top"))
    target = F.col("bin") % 24 == 5
    cell = F.when(((F.col("bin") + F.col("row")) % 8 == 0) | (target & (F.expr("row div 16") % 3 == 0)), F.col("top"))
    bins = at.join(top, "bin", "left").select("patch", "bin", "row", "col", cell.alias("cell"), target.alias("target"), (F.col("bin") % 5 != 0).alias("allowed"))
    return bins, claims


def _asks(t: Tables, lines):
    """(patch, cell, bin) of lines, which may be a stream; each is asked again at several steps."""
    return lines.select(F.col("l_orderkey").alias("bin"), (F.col("l_suppkey") % CELLS).alias("cell")).join(t.grid.select("bin", _patch()), "bin").select("patch", "cell", "bin")


def _step(again):
    return 1 + (F.col("bin") * 7 + F.col("cell") * 3 + again) % STEPS


def asked(t: Tables, lines):
    """What cells ask for: (patch, step, cell, bin) of lines, which may be a stream."""
    again = F.explode(F.array(*map(F.lit, AGAIN))).alias("_j")
    return _asks(t, lines).select("patch", "cell", "bin", again).withColumn("step", _step(F.col("_j"))).drop("_j")


def requests(t: Tables, lines):
    """What cells ask for, with the number n of rows of the step, counted from the table.

    A patch has one row of counts and its lines meet it before they are copied to their steps, so all is dealt by patch once.
    """
    counts = [F.sum(sum((_step(F.lit(j)) == s).cast("long") for j in AGAIN)) for s in range(1, STEPS + 1)]
    sizes = _asks(t, t.raw("lineitem")).groupBy("patch").agg(F.array(*counts).alias("_sizes"))
    met = _asks(t, lines).join(sizes, "patch").withColumn("step", F.explode(F.array(*[_step(F.lit(j)) for j in AGAIN])))
    return met.select("patch", "step", "cell", "bin", F.get("_sizes", (F.col("step") - 1).cast("int")).alias("n"))


_LEGAL_SQL = _BOARD + "," + _legal("bn") + " select patch, bin, cell, nullif(old, -1) as old, old >= 0 as replace, round(reward, 6) as reward from la"


@register("legal_actions", _LEGAL_SQL)
def legal_actions_query(spark, sf_dir):
    """Every action open to the cells of all patches, with its reward."""
    bins, claims = board(Tables(spark, sf_dir))
    a = legal_actions(bins, claims, "patch", RULES)
    return a.withColumn("reward", F.round("reward", 6))


@register("joint_steps", _STEPS_SQL + " select distinct patch, step, phase, outcome, applied, masked, round(reward, 6) as reward, ended from r where step > 0")
def joint_steps_query(spark, sf_dir):
    """Joint steps of all patches over a stream of requests, run to the end of what is there."""
    t = Tables(spark, sf_dir)
    bins, claims = board(t)
    lines = st.read_files(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    with joint.rocks(spark):
        out = st.run_available(joint.joint_steps(requests(t, lines), bins, claims, RULES))
    return out.select("patch", "step", "phase", "outcome", "applied", "masked", F.round("reward", 6).alias("reward"), "ended")


@register("joint_owners", _STEPS_SQL + " select patch, bin, cell from (select patch, bin, arg_max(cell, step) cell from r group by 1, 2) where cell >= 0")
def joint_owners_query(spark, sf_dir):
    """Owners after the joint steps: the board of the stream over the whole table, a patch with all its requests in one group."""
    t = Tables(spark, sf_dir)
    bins, claims = board(t)
    whole = asked(t, t.raw("lineitem")).withColumn("n", F.lit(None))
    return joint.joint_owners(whole, bins, claims, RULES)
