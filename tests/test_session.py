"""Sessions of more than one process: executors get the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from .conftest import SMALL

ROOT = Path(__file__).resolve().parent.parent

PLAIN = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", {shared!r}).config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["alpha_shape_areas"](spark, {small!r}).count() > 0
"""
OWN = """
import sys; sys.path.insert(0, {root!r})
from lattica.session import session
from lattica.plans import catalog
spark = session("cluster", "local-cluster[1,1,1024]", **{{"spark.ui.enabled": "false"}})
assert catalog.queries()["alpha_shape_areas"](spark, {small!r}).count() > 0
"""


@pytest.mark.parametrize("code", [PLAIN, OWN], ids=["plain session", "own session"])
def test_executors_of_another_folder_have_the_package(tmp_path, code):
    (tmp_path / "shared").mkdir()
    (tmp_path / "here").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    script = code.format(root=str(ROOT), shared=f"file://{tmp_path}/shared", small=SMALL)
    done = subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path / "here", env=env, timeout=300, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
