"""Array archives (npz) of episodes and soft assignments, shape models, and sweeps that can be resumed."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError, assert_unique

BACKGROUND = "__background__"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, bin, x, y, center_x, center_y, column): candidates of one-cell archives, an archive for each task's turn.

    column is the matrix column of a candidate, null in archives that hold expression itself.
    Archives are read without pickled objects.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    xy, center = z["candidate_bin_xy_um"].astype(float).reshape(-1, 2), z["nucleus_center_xy_um"].astype(float)
                    column = pd.array(z["candidate_matrix_col_index"], dtype="Int64") if "candidate_matrix_col_index" in z else pd.array([pd.NA] * len(xy), dtype="Int64")
                    yield pd.DataFrame({"path": where, "position": np.arange(len(xy)), "bin": z["candidate_bin_ids"].astype(str), "x": xy[:, 0], "y": xy[:, 1], "center_x": center[0], "center_y": center[1], "column": column})

    return _archives(spark, path).mapInPandas(load, "path string, position long, bin string, x double, y double, center_x double, center_y double, column long")


def read_soft(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, owner, entropy, ambiguous, locked): soft assignments of all patches; a barcode without owner belongs to the background, one that occurs twice raises."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    cells, top = z["cell_ids"].astype(str), z["top1_cell_index"].astype(np.int64)
                    owner = np.where(top >= 0, cells[np.maximum(top, 0)] if len(cells) else BACKGROUND, BACKGROUND)
                    yield pd.DataFrame({"barcode": z["barcode_ids"].astype(str), "owner": owner, "entropy": z["normalized_entropy"].astype(float), "ambiguous": z["is_ambiguous"].astype(bool), "locked": z["is_nuclear_locked"].astype(bool)})

    files = _archives(spark, path)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no soft assignments under {path}")
    return assert_unique(files.mapInPandas(load, "barcode string, owner string, entropy double, ambiguous boolean, locked boolean"), ["barcode"], "soft assignments")


def write_soft(df: DataFrame, path: str) -> None:
    """Soft assignments as a table, dealt by barcode."""
    df.repartitionByRange("barcode").sortWithinPartitions("barcode").write.mode("overwrite").parquet(path)


def save_shape_model(model: DataFrame, path: str, features: Sequence[str], scale: Sequence[tuple[float, float]] | None = None) -> None:
    """One row for each cluster (cluster, n, mean, covariance as arrays), with the names and scales of the features."""
    scale = list(scale or [(0.0, 1.0)] * len(features))
    model.withColumns({"features": F.array(*[F.lit(f) for f in features]), "center": F.array(*[F.lit(float(m)) for m, _ in scale]), "spread": F.array(*[F.lit(float(s)) for _, s in scale])}).write.mode("overwrite").parquet(path)


def load_shape_model(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """The saved model; one of other features raises."""
    model = spark.read.parquet(path)
    first = model.select("features").first()
    if first is None or list(first["features"]) != list(features):
        raise ContractError(f"the shape model under {path} has other features")
    return model


def save_step(results: dict[str, DataFrame], path: str, split: str, formula: dict, patches: Sequence[str]) -> None:
    """Tables of one formula of a sweep, then the manifest that makes them count."""
    spark = next(iter(results.values())).sparkSession
    rows = {}
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    manifest = json.dumps({"split": split, "formula": formula, "patches": list(patches), "rows": rows}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def resume_step(spark: SparkSession, path: str, split: str, formula: dict, patches: Sequence[str]) -> dict[str, DataFrame] | None:
    """The saved tables, None when the step was not finished; another split, formula, patch list or number of rows raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    for name, now in (("split", split), ("formula", formula), ("patches", list(patches))):
        if found[name] != now:
            raise ContractError(f"the saved step has another {name}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in found["rows"]}
    for name, df in tables.items():
        if df.count() != found["rows"][name]:
            raise ContractError(f"the saved step lacks rows of {name}")
    return tables
