"""How the TPC-H-like tables stand in for bins, counts, cells, claims and owners.

``Tables`` gives them as DataFrames; ``CTE`` gives the same tables as SQL common
table expressions for the oracle texts, written independently of the former.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENES = 50
GRID_COLUMNS = 128
BIN_UM = 2.0


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def counts(self) -> DataFrame:
        """(bin, gene, n): sparse counts."""
        line = self.raw("lineitem")
        return line.groupBy(F.col("l_orderkey").alias("bin"), (F.col("l_partkey") % GENES).alias("gene")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))

    @cached_property
    def bin_types(self) -> DataFrame:
        """(bin, k): the type of each bin."""
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("bin"), F.col("c_mktsegment").alias("k"))

    @cached_property
    def grid(self) -> DataFrame:
        """(bin, row, col, x, y): the square grid, 2 um apart."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("bin"), F.expr(f"o_orderkey div {GRID_COLUMNS}").alias("row"), (F.col("o_orderkey") % GRID_COLUMNS).alias("col"))
        return o.select("bin", "row", "col", (F.col("col") * BIN_UM).alias("x"), (F.col("row") * BIN_UM).alias("y"))

    @cached_property
    def centers(self) -> DataFrame:
        """(cell, x, y, radius, type): nuclei."""
        s = self.raw("supplier")
        return s.select(F.col("s_suppkey").alias("cell"), ((F.col("s_suppkey") * 37 % 128) * 2.0 + 0.5).alias("x"), ((F.col("s_suppkey") * 61 % 97) * 2.0 + 0.25).alias("y"), (F.col("s_suppkey") % 5 + 3).cast("double").alias("radius"), (F.col("s_suppkey") % 4).alias("type"))

    @cached_property
    def claims(self) -> DataFrame:
        """(barcode, cell, weight, px, ord): several claims for one barcode."""
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("barcode"), F.col("l_suppkey").alias("cell"), F.col("l_discount").alias("weight"), F.col("l_quantity").cast("long").alias("px"), F.col("l_partkey").alias("ord"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(barcode, cell, px, price): claims summed to one row for each pair."""
        li = self.raw("lineitem")
        return li.groupBy(F.col("l_orderkey").alias("barcode"), F.col("l_suppkey").alias("cell")).agg(F.sum(F.col("l_quantity").cast("long")).alias("px"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("price"))

    def owners(self, by: str) -> DataFrame:
        """(barcode, cell): one owner for each barcode, the cell with most ``by`` (px or price), then the least cell."""
        best = self.pairs.groupBy("barcode").agg(F.max_by("cell", F.struct(F.col(by), -F.col("cell"))).alias("cell"))
        return best

    @cached_property
    def truth(self) -> DataFrame:
        """(barcode, cell): ground truth; agrees with the px owner for three bins of four."""
        o = self.owners("px")
        return o.select("barcode", F.when(F.col("barcode") % 4 == 0, (F.col("cell") + 1) % 50).otherwise(F.col("cell")).alias("cell"))

    @cached_property
    def steps(self) -> DataFrame:
        """(traj, step, reward, value, done, kind, k, event_id): ordered steps of each trajectory."""
        from pyspark.sql import Window

        e = self.raw("events")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return e.select(F.col("user_id").alias("traj"), F.row_number().over(w).alias("step"), F.round("value", 2).alias("reward"), F.round(F.col("value") / 2, 3).alias("value"), (F.col("event_type") == "purchase").alias("done"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")


CTE: dict[str, str] = {
    "counts": "counts as (select l_orderkey bin, l_partkey % 50 gene, cast(sum(cast(l_quantity as bigint)) as bigint) n from lineitem group by 1, 2)",
    "bin_types": "bin_types as (select o_orderkey bin, c_mktsegment k from orders join customer on o_custkey = c_custkey)",
    "grid": 'grid as (select o_orderkey bin, o_orderkey // 128 "row", o_orderkey % 128 col, (o_orderkey % 128) * 2.0::double x, (o_orderkey // 128) * 2.0::double y from orders)',
    "centers": "centers as (select s_suppkey cell, (s_suppkey * 37 % 128) * 2.0::double + 0.5::double x, (s_suppkey * 61 % 97) * 2.0::double + 0.25::double y, cast(s_suppkey % 5 + 3 as double) radius, s_suppkey % 4 type from supplier)",
    "claims": "claims as (select l_orderkey barcode, l_suppkey cell, l_discount weight, cast(l_quantity as bigint) px, l_partkey ord from lineitem)",
    "pairs": "pairs as (select l_orderkey barcode, l_suppkey cell, cast(sum(cast(l_quantity as bigint)) as bigint) px, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) price from lineitem group by 1, 2)",
    "owner_px": "owner_px as (select barcode, cell from (select *, row_number() over (partition by barcode order by px desc, cell) rn from pairs) where rn = 1)",
    "owner_price": "owner_price as (select barcode, cell from (select *, row_number() over (partition by barcode order by price desc, cell) rn from pairs) where rn = 1)",
    "truth": "truth as (select barcode, case when barcode % 4 = 0 then (cell + 1) % 50 else cell end cell from owner_px)",
    "steps": "steps as (select user_id traj, row_number() over (partition by user_id order by ts, event_id) step, round(value, 2) reward, round(value / 2, 3) value, event_type = 'purchase' done, event_type kind, cast(json_extract_string(props, '$.k') as bigint) k, event_id from events)",
}

_NEEDS = {"owner_px": ["pairs"], "owner_price": ["pairs"], "truth": ["owner_px"]}


def ctes(*names: str) -> str:
    """``with`` clause of the named tables and what they need."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if CTE[name] not in out:
            out.append(CTE[name])

    for n in names:
        add(n)
    return "with " + ",\n".join(out)
