"""Mixing sources to target weights by a time-varying curriculum (operator 10, native).

1. Sizes in words per document, summed per source.
2. Targets: the budget is shared by weight; a target stops at ``repeat`` times
   its source's size and the excess goes to the others by weight.  Sorted by
   cap per unit of weight, that water level is one prefix sum.
3. Every source has a weight schedule over training time t in 0..1,
   f(t) = 1 + a (2t - 1); its integral F(t) = t + a (t*t - t) times the target
   is the cumulative token demand.  A source's documents stand in hash order;
   the words before a document, seen as supply, give its training position by
   inverting the demand: t = F^-1(words before / target).
4. Documents are range-sorted by position.

A source with a third of all rows is no single task: words before a document
are the sum of whole hash bins (one row per source and bin) plus a window
inside its bin.  Only the boundary document of a source is taken in part.
The sources themselves, one row each, are ranked in one task.

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source
is a source of its own, sorted last; ties in hash order are rows with equal id
and text, which are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, columns, fresh, require

#: Contract: weights of the sorted sources, repeating, and the slope of each one's schedule.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
REPEAT = 2
#: Hexadecimal digits of the hash bin: 4096 bins for each source.
BIN_DIGITS = 3


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """(_s, _sn, source_size, weight, slope, target) from rows (_s, _sn, _size); one row per source."""
    per = sizes.groupBy("_s", "_sn").agg(F.sum("_size").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy("_sn", "_s")) - 1)
    ranked = ranked.withColumn("weight", _cycle(WEIGHTS, F.col("_rank"))).withColumn("slope", _cycle(SLOPES, F.col("_rank")))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    everything = Window.partitionBy()
    level = ranked.withColumn("_cap", F.col("source_size") * REPEAT)
    level = level.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(SHARE)).alias("_budget"),
        F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_full"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
    ).withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    # The level is the first one at which the source itself is not above its cap.
    level = level.withColumn("_water", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("weight")).alias("o"), F.col("_rank").alias("r"), F.col("_level").alias("l")))).over(everything)["l"])
    return level.select("_s", "_sn", "source_size", "weight", "slope", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap").cast("double"))).alias("target"))


def position(u: Column, a: Column) -> Column:
    """t with t + a (t*t - t) = u."""
    return F.when(a == 0, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a))


def plan(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(row, _size, _source_size, _target, _taken, _words_1, _words_2, _first, _second): each row of docs as a struct, its
    words, what the mix takes, in the first and second copy, and the positions of the copies.

    The struct has the columns ``carried`` (all).  Without the text the keys of all rows are few bytes each: they are
    written once, so that texts are read and their words counted a single time, and no text is shuffled.
    """
    require(docs, "doc_id", "text", "source")
    keyed = docs.select(
        F.struct(*columns(carried or docs.columns)).alias("row"),
        F.coalesce("source", F.lit("")).alias("_s"),
        F.col("source").isNull().alias("_sn"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("_h"),
    ).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    if carried and "text" not in carried:
        keyed = Scratch(docs.sparkSession, "mix").keep("keys", keyed)
    bins = keyed.groupBy("_s", "_sn", "_bin").agg(F.sum("_size").alias("_size"))
    goal = targets(bins.select("_s", "_sn", "_size"))
    before = Window.partitionBy("_s", "_sn").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_s", "_sn", "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead")).join(goal, ["_s", "_sn"])
    inside = Window.partitionBy("_s", "_sn", "_bin").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("_in_bin", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(bins, ["_s", "_sn", "_bin"])
    rows = rows.withColumn("_at", F.col("_ahead") + F.col("_in_bin")).withColumn("_goal", F.floor(F.col("target") + 0.5))

    def words(copy: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_goal") - F.col("source_size") * copy - F.col("_at")))

    def place(copy: int) -> Column:
        middle = F.col("source_size") * copy + F.col("_at") + words(copy) / 2
        return F.when(words(copy) > 0, position(middle / F.col("_goal"), F.col("slope")))

    return rows.select("row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), sum((words(i) for i in range(REPEAT)), F.lit(0)).alias("_taken"), words(0).alias("_words_1"), words(1).alias("_words_2"), place(0).alias("_first"), place(1).alias("_second"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix: one row per taken copy with ``position`` and ``words`` added, range-sorted by position.

    Where docs has a column of such a name, the added one gets an underscore before it.
    """
    copies = F.array(F.struct(F.col("_first").alias("position"), F.col("_words_1").alias("words")), F.struct(F.col("_second").alias("position"), F.col("_words_2").alias("words")))
    taken = plan(docs).select("row", F.explode(F.filter(copies, lambda c: c["words"] > 0)).alias("copy")).orderBy("copy.position", "row.doc_id")
    return taken.select("row.*", F.col("copy.position").alias(fresh(docs, "position")), F.col("copy.words").alias(fresh(docs, "words")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    return plan(docs, ["doc_id"]).select("row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"), F.round("_first", 9).alias("position_1"), F.round("_second", 9).alias("position_2"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus, one row per taken copy, sorted by training position."""
    return mix(docs)


def _pick(values: tuple) -> str:
    return "(" + "[" + ", ".join(f"cast({x} as {'double' if isinstance(x, float) else 'bigint'})" for x in values) + "]" + f")[cast(rk % {len(values)} as integer) + 1]"


def mix_sql(source: str = "documents") -> str:
    """CTEs ending in ``placed``: the plan of the mix over table ``source``, for DuckDB."""
    return rf"""
sized as (select *, coalesce(source, '') s, source is null sn,
    cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) sz,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) h from {source}),
per as (select s, sn, cast(sum(sz) as bigint) source_size from sized group by s, sn),
ranked as (select *, row_number() over (order by sn, s) - 1 rk from per),
weighted as (select *, {_pick(WEIGHTS)} weight, {_pick(SLOPES)} slope, source_size * {REPEAT} cap from ranked),
levels as (select *, (cast(sum(source_size) over () as double) * {SHARE}
      - cast(coalesce(sum(cap) over (order by cast(cap as double) / weight, rk rows between unbounded preceding and 1 preceding), 0) as double))
      / cast(sum(weight) over (order by cast(cap as double) / weight, rk rows between current row and unbounded following) as double) lv from weighted),
water as (select lv from levels where lv * weight <= cap order by cast(cap as double) / weight, rk limit 1),
goals as (select s, sn, source_size, slope, least(cast(cap as double), coalesce((select lv from water) * weight, cast(cap as double))) target from levels),
laid as (select sized.*, source_size, slope, target, cast(floor(target + 0.5) as bigint) goal,
    cast(coalesce(sum(sz) over (partition by sized.s, sized.sn order by h rows between unbounded preceding and 1 preceding), 0) as bigint) ahead
  from sized join goals on sized.s = goals.s and sized.sn = goals.sn),
counted as (select *, greatest(0, least(sz, goal - ahead)) w1, greatest(0, least(sz, goal - source_size - ahead)) w2 from laid),
placed as (select *, case when w1 > 0 then (ahead + w1 / 2.0::double) / goal end u1, case when w2 > 0 then (source_size + ahead + w2 / 2.0::double) / goal end u2 from counted)"""


def position_sql(u: str) -> str:
    return f"case when slope = 0 then {u} else (sqrt((1 - slope) * (1 - slope) + 4 * slope * {u}) - (1 - slope)) / (2 * slope) end"


ORACLE = f"""with {mix_sql()}
select doc_id, sz as size, source_size, target, cast(w1 + w2 as bigint) as taken,
  round({position_sql("u1")}, 9) as position_1, round({position_sql("u2")}, 9) as position_2 from placed"""
