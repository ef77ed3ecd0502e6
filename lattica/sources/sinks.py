"""Writers.  Spark's commit protocol makes them atomic: a failed job leaves no part files in the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """parquet, or csv and tsv with header and gzip."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    else:
        w.option("header", True).option("compression", "gzip").option("sep", "\t" if fmt == "tsv" else ",").csv(path)


def write_counts(counts: DataFrame, path: str, buckets: int = 64) -> None:
    """Counts dealt by bin, so that reads of a bin range and joins on the bin find few files."""
    counts.withColumn("bucket", F.pmod(F.xxhash64("bin"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bin", "gene").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_matrix_market(counts: DataFrame, path: str, genes: int, bins: int) -> None:
    """Coordinate text, one based, gzip.  The header is a file of its own that sorts before the entries."""
    n = counts.count()
    head = [(0, "%%MatrixMarket matrix coordinate integer general"), (1, f"{genes} {bins} {n}")]
    spark = counts.sparkSession
    spark.createDataFrame(head, "o int, value string").coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").option("compression", "gzip").text(f"{path}/head")
    body = counts.repartitionByRange("bin_idx", "gene_idx").sortWithinPartitions("bin_idx", "gene_idx")
    body.select(F.concat_ws(" ", F.col("gene_idx") + 1, F.col("bin_idx") + 1, F.col("n"))).write.mode("overwrite").option("compression", "gzip").text(f"{path}/body")


def append_log(df: DataFrame, path: str) -> None:
    """Append events (ts, event, payload) as JSON lines with UTC and local time."""
    ts = F.col("ts")
    local = F.date_format(F.from_utc_timestamp(ts, "America/Chicago"), "yyyy-MM-dd'T'HH:mm:ss")
    df.select(F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp_utc"), local.alias("timestamp_local"), F.col("event"), F.col("payload"))).alias("value")).write.mode("append").text(path)


def write_bundles(df: DataFrame, key: str, path: str) -> None:
    """One JSON document for each key, in a folder of its own; a key's rows are one patch, which is bounded."""
    rest = [c for c in df.columns if c != key]
    doc = df.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))).alias("value"))
    doc.write.mode("overwrite").partitionBy(key).text(path)


def write_shards(episodes: DataFrame, path: str, cell: str = "cell", size: int = 256) -> None:
    """Episode rows in chunks of ``size`` cells by cell number, sorted by cell."""
    episodes.withColumn("chunk", F.floor(F.col(cell) / size).cast("long")).repartitionByRange("chunk").sortWithinPartitions("chunk", cell).write.mode("overwrite").partitionBy("chunk").parquet(path)


def swap_table(df: DataFrame, path: str, stamp: str) -> str:
    """Write a new version beside the old ones, then the pointer to it: readers see the old or the new table."""
    version = f"{path}/version={stamp}"
    df.write.mode("errorifexists").parquet(version)
    df.sparkSession.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def read_current(spark, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/current").first()["value"])
