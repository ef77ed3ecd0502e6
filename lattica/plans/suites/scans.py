"""Scans of sparse matrices by column range and of array archives by row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators.lineage import shared_folder
from ...sources import arrays, columns
from ..bindings import GENES, Tables, ctes
from ..catalog import register


def _matrix(t: Tables):
    """The counts as a matrix on disk: bins are columns, genes rows."""
    path = f"{shared_folder(t.spark)}/matrix-{uuid.uuid4().hex}"
    columns.write_columns(t.counts.select(F.col("bin").alias("column"), F.col("gene").alias("row"), F.col("n").alias("value")), path)
    return columns.read_columns(t.spark, path)


@register("column_range_scan", ctes("counts") + ", m as (select max(bin) m from counts) select bin, count(*) as genes, cast(sum(n) as bigint) as total from counts, m where bin between m // 4 and m // 2 group by bin")
def column_range_scan(spark, sf_dir):
    """Bins of a range: only their chunks and bytes are read."""
    t = Tables(spark, sf_dir)
    most = t.raw("lineitem").agg(F.max("l_orderkey")).first()[0]
    wanted = _matrix(t).filter(F.col("column").between(most // 4, most // 2))
    return wanted.groupBy(F.col("column").alias("bin")).agg(F.count("*").alias("genes"), F.sum("value").alias("total"))


@register("requested_columns", ctes("counts", "centers") + ", asked as (select cell place, cell * 3 % 97 bin from centers) select place, bin, gene, n from asked join counts using (bin)")
def requested_columns(spark, sf_dir):
    """Columns by a list of requests, in which a column may stand more than once."""
    t = Tables(spark, sf_dir)
    asked = t.centers.select(F.col("cell").alias("place"), (F.col("cell") * 3 % 97).alias("column"))
    return columns.requested(_matrix(t), asked).select("place", F.col("column").alias("bin"), F.col("row").alias("gene"), F.col("value").alias("n"))


def _scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@register("episode_rows", ctes("pairs", "centers") + ", asked as (select cell place, cell * 3 % 97 + 1 cell from centers), ep as (select cell, barcode, px, price, row_number() over (partition by cell order by barcode) - 1 nth from pairs) select place, a.cell, nth, barcode as bin, px, price from asked a join ep using (cell)")
def episode_rows(spark, sf_dir):
    """Candidates of cells in ragged shards; the rows of requested cells, some of them asked for more than once."""
    t = Tables(spark, sf_dir)
    path = _scratch(t, "episodes")
    arrays.write_ragged(t.pairs, path, "cell", ["barcode"], ["barcode", "px", "price"], size=16)
    asked = t.centers.select(F.col("cell").alias("id"), (F.col("cell") * 3 % 97 + 1).alias("wanted"))
    at = asked.join(arrays.read_index(spark, path).withColumnRenamed("id", "wanted"), "wanted")
    got = arrays.requested_rows(arrays.read_rows(spark, path, splits="splits"), at)
    value = lambda i, name: F.element_at("values", i).cast("long").alias(name)
    return got.select(F.col("id").alias("place"), F.col("wanted").alias("cell"), F.col("place").alias("nth"), value(1, "bin"), value(2, "px"), value(3, "price"))


@register("dense_count_rows", ctes("counts") + ", m as (select max(bin) m from counts) select bin, gene, n from counts, m where bin >= m // 3")
def dense_count_rows(spark, sf_dir):
    """A dense matrix of counts in array shards, read back as checked sparse counts of the later bins."""
    t = Tables(spark, sf_dir)
    dense = t.counts.groupBy("bin").agg(*[F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("n"))), F.lit(0)).alias(f"g{g}") for g in range(GENES)])
    path = _scratch(t, "dense")
    arrays.write_ragged(dense, path, "bin", [], [f"g{g}" for g in range(GENES)], size=4096)
    least = t.raw("lineitem").agg(F.max("l_orderkey")).first()[0] // 3
    wanted = arrays.read_index(spark, path).filter(F.col("id") >= least)
    counts = arrays.counts_of(arrays.read_rows(spark, path))
    return counts.join(wanted, ["shard", "row"]).select(F.col("id").alias("bin"), F.col("col").alias("gene"), "n")
