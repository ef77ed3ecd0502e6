"""Sharding by proportional stratified interleaving (operator 13, native).

1. Every source's rows are shuffled by a seeded hash of their key and ranked.
2. Row r of a source of n rows has the fractional rank (r + 1/2) / n, so each
   source is spread evenly over 0..1 however large it is.
3. All rows are sorted by fractional rank (ties by source, null last) and cut
   into runs of equal length: a shard holds every source in the proportion of
   the whole, to within a row at either end.  The law is ``rows``: counts of two
   shards differ by one at most.  ``slot`` is the place in the shard.

No rank needs one task.  A source is ranked as whole hash bins before a row
(one row for each source and bin) plus a window inside its bin, so that a source
with a third of all rows is thousands of windows.  The global order is ranked
the same way over bins of the fractional rank, which are even because all
sources are; their number grows with the rows, ROWS_PER_BIN in each.  Rows with
equal keys are one row with a count until their ranks are known.

Texts are read once for their size and checksum; ``plan`` shuffles only keys.

Edge cases: a null or empty text has size 8 and checksum 0; a null source is a
source of its own, sorted last; a null doc_id is an id like others; rows that
repeat are rows, each in a place of its own, and which of them has which place
makes no difference; an empty table gives an empty result; fewer rows than
shards leave shards empty; further columns of any name pass through ``shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, fresh, require

SHARDS = 24
SEED = 13
#: Bytes that a row takes beside its text.
OVERHEAD = 8
#: Hexadecimal digits of a source's hash bin: 4096 bins.
BIN_DIGITS = 3
#: Rows in a bin of the global order.
ROWS_PER_BIN = 1 << 16
#: Copies of a row in one list while they are spread.
_REPEAT = 4096

_KEY = ("_id", "_s", "_sn", "_size", "_crc")


def _keyed(docs: DataFrame) -> list[Column]:
    return [
        F.col("doc_id").alias("_id"),
        F.coalesce("source", F.lit("")).alias("_s"),
        F.col("source").isNull().alias("_sn"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("_size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("_crc"),
    ]


def _before(value: str, partition: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows before this one."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(_id, _s, _sn, _size, _crc, _copies, _copy, shard, slot): a row for each of docs (doc_id, text, source), without texts.

    ``_copy`` counts the rows of one key from 0; ``_copies`` is their number.
    """
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), "_size", "_crc")
    keys = require(docs, "doc_id", "text", "source").select(*_keyed(docs)).groupBy(*_KEY).agg(F.count("*").alias("_copies"))
    keys = Scratch(docs.sparkSession, "shards").keep("keys", keys.withColumn("_h", F.md5(text.cast("binary"))).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS)))
    # Rows of the source before the bin; a source has 16 ** BIN_DIGITS bins at most.
    bins = keys.groupBy("_s", "_sn", "_bin").agg(F.sum("_copies").alias("_rows"))
    bins = bins.select("_s", "_sn", "_bin", _before("_rows", ["_s", "_sn"], ["_bin"]).alias("_ahead"), F.sum("_rows").over(Window.partitionBy("_s", "_sn")).alias("_of"))
    ranked = keys.withColumn("_inside", _before("_copies", ["_s", "_sn", "_bin"], ["_h", "_id"])).join(bins, ["_s", "_sn", "_bin"])
    # Copies in two steps, so that no row holds a list of all.
    rows = ranked.withColumn("_block", F.explode(F.expr(f"sequence(0, (_copies - 1) div {_REPEAT})")))
    rows = rows.withColumn("_copy", F.explode(F.expr(f"sequence(_block * {_REPEAT}, least(_copies, (_block + 1) * {_REPEAT}) - 1)")))
    rows = rows.withColumn("_part", (2 * (F.col("_ahead") + F.col("_inside") + F.col("_copy")) + 1).cast("double") / (2 * F.col("_of")).cast("double"))
    total = keys.agg(F.sum("_copies").alias("_all"))  # one row
    rows = rows.crossJoin(F.broadcast(total)).withColumn("_place", F.floor(F.col("_part") * F.ceil(F.col("_all") / ROWS_PER_BIN)))
    rows = rows.select(*_KEY, "_copies", "_copy", "_part", "_place", "_all")
    places = rows.groupBy("_place").agg(F.count("*").alias("_rows")).select("_place", _before("_rows", [], ["_place"]).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_place").orderBy("_part", "_sn", "_s")) - 1
    at = rows.withColumn("_inside", inside).join(places, "_place").withColumn("_at", F.col("_first") + F.col("_inside"))
    at = at.withColumn("shard", F.expr(f"int(_at * {shards} div _all)"))
    return at.select(*_KEY, "_copies", "_copy", "shard", (F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of docs with ``shard`` and ``slot`` added (with underscores before them where docs has such names).

    Rows with a key of their own, which are nearly all, are joined with their
    place.  Among rows that share a key, equal rows count once with their
    number, and take the key's places in turn.
    """
    placed = Scratch(docs.sparkSession, "shards").keep("placed", plan(docs, shards, seed))
    names = [fresh(docs, "shard"), fresh(docs, "slot")]
    given = docs.select(F.struct(*columns(docs.columns)).alias("row"), *_keyed(docs))
    key = [F.col("g._s") == F.col("p._s"), F.col("g._sn") == F.col("p._sn"), F.col("g._id").eqNullSafe(F.col("p._id")), F.col("g._size") == F.col("p._size"), F.col("g._crc") == F.col("p._crc")]
    out = [F.col("row"), F.col("p.shard").alias("shard"), F.col("p.slot").alias("slot")]
    one = given.alias("g").join(placed.filter("_copies = 1").alias("p"), key).select(*out)
    many = given.alias("g").join(placed.filter("_copies > 1 and _copy = 0").alias("p"), key, "left_semi")
    many = many.groupBy("row", *_KEY).agg(F.count("*").alias("_rows"))
    many = many.withColumn("_from", _before("_rows", list(_KEY), ["row"])).withColumn("_block", F.explode(F.expr(f"sequence(0, (_rows - 1) div {_REPEAT})")))
    many = many.withColumn("_copy", F.explode(F.expr(f"sequence(_from + _block * {_REPEAT}, _from + least(_rows, (_block + 1) * {_REPEAT}) - 1)")))
    many = many.alias("g").join(placed.filter("_copies > 1").alias("p"), [*key, F.col("g._copy") == F.col("p._copy")]).select(*out)
    return one.unionByName(many).select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, parts: int = 1) -> None:
    """Parquet under ``path``, a folder for each shard, its rows in the order of their slots; ``parts`` files for a shard,
    each a run of slots, for shards that are larger than a task should write."""
    placed = shard(docs, shards, seed)
    at, slot = fresh(docs, "shard"), fresh(docs, "slot")
    part = F.expr(f"int(`{slot}` div {ROWS_PER_BIN}) % {parts}")
    placed.repartition(shards * parts, F.col(at), part).sortWithinPartitions(at, slot).write.partitionBy(at).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    placed = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.when(~F.col("_sn"), F.col("_s")).alias("source"),
    )


#: CRC-32 has no function in DuckDB: its table of 256 entries, and one step for each byte.
CRC_TABLE = "crc_table as materialized (select list(v order by i) tab from (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, b: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) v from (select cast(range as bigint) i from range(256))))"


def crc32_sql(hexadecimal: str) -> str:
    """CRC-32 of the bytes that the column has in hexadecimal, where ``crc_table`` is joined."""
    numbers = f"list_transform(range(1, len({hexadecimal}) + 1, 2), lambda p: cast('0x' || substr({hexadecimal}, p, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295)"


ORACLE = f"""with {CRC_TABLE},
bytes as materialized (select doc_id, source, hex(encode(coalesce(text, ''))) hx from documents),
sized as materialized (select doc_id, source, cast(len(hx) // 2 + {OVERHEAD} as bigint) sz, {crc32_sql("hx")} crc from bytes, crc_table),
ranked as (select *, row_number() over (partition by source order by md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || sz || ':' || crc), doc_id) - 1 r,
    count(*) over (partition by source) n from sized),
placed as (select *, row_number() over (order by cast(2 * r + 1 as double) / cast(2 * n as double), source nulls last) - 1 g, count(*) over () total from ranked)
select doc_id, sz as size, crc as text_crc32, 'rows' as law, cast(g * {SHARDS} // total as integer) as shard,
  cast(g - (g * {SHARDS} // total * total + {SHARDS - 1}) // {SHARDS} as bigint) as slot, cast(null as integer) as grown_shard, source from placed"""
