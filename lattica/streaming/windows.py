"""Structured Streaming over ordered events.

Every query here is defined by its batch result: run with availableNow over the
same files it gives the same rows.  Event time must be a timestamp with zone;
tables without zone are cast in UTC.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _folder(spark: SparkSession, name: str) -> str:
    """A folder for a query's state in the shared checkpoint folder; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lattica-streams")
    return f"{named}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of parquet rows (a folder or one file)."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    return reader.option("pathGlobFilter", file).parquet(folder) if "." in file else reader.parquet(path)


def read_events(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A file stream of parquet events (a folder or one file) with a usable event time."""
    return read_files(spark, path).withColumn(time, F.col(time).cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there and return its result as a table in the shared folder."""
    spark = stream.sparkSession
    base = _folder(spark, "stream")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        # Complete results replace the table at each trigger.
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, width: str, late: str, keys: tuple[str, ...], value: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sliding(events: DataFrame, width: str, slide: str, late: str, keys: tuple[str, ...], value: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


REPLAY = "traj long, item long, owner long, step long"


def replay(actions: DataFrame) -> DataFrame:
    """Owner of each item per trajectory as actions (traj, item, owner, step) arrive: the state is the owner map.

    A later step overwrites an earlier one whatever the order of arrival; only changed owners are emitted.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owners: dict[int, tuple[int, int]] = {int(i): (int(s), int(o)) for i, s, o in state.get[0]} if state.exists else {}
        changed: set[int] = set()
        for pdf in batches:
            for item, owner, step in zip(pdf["item"].tolist(), pdf["owner"].tolist(), pdf["step"].tolist(), strict=True):
                if item not in owners or owners[item][0] < step:
                    owners[item] = (step, owner)
                    changed.add(item)
        state.update(([(i, s, o) for i, (s, o) in owners.items()],))
        yield pd.DataFrame([(key[0], i, owners[i][1], owners[i][0]) for i in sorted(changed)], columns=["traj", "item", "owner", "step"])

    return actions.groupBy("traj").applyInPandasWithState(fold, REPLAY, "m array<struct<i:long,s:long,o:long>>", "append", GroupStateTimeout.NoTimeout)
