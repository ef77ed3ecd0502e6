"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the engine; it sorts first.
NULL_ID = -(1 << 63)

#: The word pattern of all contracts, as a Java and RE2 regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes in one Arrow batch between Spark and Python; the session's default is sixteen times as much.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    """Lower the session's default batch size, which bounds what a task holds of long texts; a smaller one stays."""
    now = spark.conf.get(_BATCH_SETTING).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def require(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; a clear error when one is missing."""
    _bound_batches(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_key() -> list[Column]:
    """``_id`` and ``_th`` tell rows apart: the id and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th")]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset one (tests) gets a local folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lattica-checkpoints")
    context.setCheckpointDir(named)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends: its result is written and nothing reads them again."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables of one operator run, written under the checkpoint folder that all executors share.

    A written table cuts the lineage as a checkpoint does and outlives lost
    executors; it is smaller, its size is known to the planner, and it is
    deleted as soon as no later step reads it.  Shuffle files of the plan that
    wrote it are dropped at once.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_checkpoint_dir(spark)
        self._spark = spark
        self._root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{self._root}/{name}"
        with _shuffles_dropped(self._spark):
            df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables; without names all of them."""
        for path in [f"{self._root}/{n}" for n in names] or [self._root]:
            at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the filter in ``mark_needed`` for each needed row, and the least and the most in all; as a table of 64-bit words the largest has 2**18 rows.
BITS_PER_ROW = 8
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 24


def mark_needed(rows: DataFrame, needed: DataFrame, *on: str) -> DataFrame:
    """rows and ``_needed``: false only for rows whose columns ``on`` (_id and _th) are not in ``needed``.

    A Bloom filter of bounded size, broadcast, so that rows which cannot join
    are not shuffled for a join.  It may let others pass; the join itself
    decides.  Beyond MOST_BITS / BITS_PER_ROW needed rows it lets more and more pass.
    ``needed`` is counted, so it should be a written table.
    """
    on = on or ("_id", "_th")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * needed.count()).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = needed.select(at.alias("i")).groupBy(F.expr("i div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(i % 64))")).alias("_bits"))
    marked = rows.withColumn("_i", at).withColumn("_w", F.expr("_i div 64")).join(F.broadcast(words), "_w", "left")
    return marked.withColumn("_needed", F.coalesce(F.expr("shiftright(_bits, int(_i % 64)) & 1L = 1L"), F.lit(False))).drop("_i", "_w", "_bits")


def only_needed(rows: DataFrame, needed: DataFrame, *on: str) -> DataFrame:
    """The rows that ``mark_needed`` lets pass."""
    return mark_needed(rows, needed, *on).filter("_needed").drop("_needed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it when the table has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def columns(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]
