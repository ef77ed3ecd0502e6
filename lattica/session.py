"""Spark session with the settings that the engine expects, and the engine's code on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "lattica", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; skewed joins are split and small partitions merged at run time.

    Partition counts are left to the cluster's configuration unless given.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


#: Applications that have the package already.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of a cluster that do not have it; local tasks share the driver's.

    The archive is fetched whenever an executor starts, so it has to last as long as the application: it lies in the
    shared folder that spark.checkpoint.dir names, or, where none is named, in a folder of the driver's that goes with
    the process and that the driver serves.
    """
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or context.applicationId in _SHIPPED:
        return spark
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip":  # the driver itself runs from an archive that was sent
        return spark
    folder = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = shutil.make_archive(f"{folder}/lattica", "zip", root.parent, root.name)
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared}/{context.applicationId}-lattica.zip")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}"), at)
        path = at.toString()
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
    return spark
