"""Readers of bins, counts, claims, polygons, logs and fingerprints.

All readers take schemas or check columns; projections and filters reach the
scan because nothing is cached or converted on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import cell_list
from ..operators.contracts import ContractError, assert_unique, require_columns

POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double"
PIXELS = "x int, y int, cell_id bigint, is_boundary tinyint, is_interior tinyint, is_nuclear tinyint, is_cytoplasm tinyint"


def read_table(spark: SparkSession, path: str, fmt: str = "auto", columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """parquet, csv, tsv, json or orc, by suffix when the format is "auto"; only the named columns are read."""
    name = path.lower().removesuffix("/").removesuffix(".gz")
    if fmt == "auto":
        known = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".json": "json", ".jsonl": "json", ".orc": "orc"}
        fmt = next((f for s, f in known.items() if name.endswith(s)), None) or _unknown(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("csv", "tsv"):
        df = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("mode", "FAILFAST").csv(path)
    else:
        df = reader.format(fmt).load(path)
    return require_columns(df, columns).select(*columns) if columns else df


def _unknown(path: str) -> str:
    raise ContractError(f"the format of {path} is not known")


def read_positions(spark: SparkSession, path: str, microns_per_pixel: float) -> DataFrame:
    """Bin positions with x_um and y_um."""
    p = require_columns(spark.read.parquet(path), ["barcode", "pxl_row_in_fullres", "pxl_col_in_fullres"])
    return p.withColumns({"x_um": F.col("pxl_col_in_fullres") * microns_per_pixel, "y_um": F.col("pxl_row_in_fullres") * microns_per_pixel})


def read_names(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Headerless lines with their dense position: the file's own row order, from its byte ranges.

    One file is one order; a bounded list of partition sizes goes to the driver.
    """
    lines = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = sorted((r["_p"], r["n"]) for r in lines.groupBy("_p").agg(F.count("*").alias("n")).collect())
    start, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, start))
        start += n
    base = spark.createDataFrame(offsets or [(0, 0)], "_p int, _start long")
    inside = F.col("_i").bitwiseAND((1 << 33) - 1)
    return lines.join(F.broadcast(base), "_p").select((F.col("_start") + inside).alias("idx"), F.split("value", "\t")[0].alias(name))


def read_features(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Feature table padded to four columns; a type filter that matches nothing raises."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("v"))
    names = ("feature_id", "feature_name", "feature_type", "genome")
    out = lines.select(*[F.coalesce(F.get("v", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    if kind is None:
        return out
    out = out.filter(F.col("feature_type") == kind)
    if out.isEmpty():
        raise ContractError(f"no feature has type {kind}")
    return out


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(gene_idx, bin_idx, n), zero based, from coordinate text: comments and the size line fall out, entries of one place are summed."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%"))
    v = F.split(F.trim("value"), r"\s+")
    rows = lines.select(v[0].cast("long").alias("g"), v[1].cast("long").alias("b"), v[2].cast("double").alias("n"))
    first = lines.limit(1).select(v.alias("v")).first()
    if first is None:
        raise ContractError(f"{path} has no size line")
    shape = [int(x) for x in first["v"][:3]]
    body = rows.groupBy((F.col("g") - 1).alias("gene_idx"), (F.col("b") - 1).alias("bin_idx")).agg(F.sum("n").alias("n"), F.count("*").alias("_k"))
    # The size line looks like an entry; take it away once.
    is_size = (F.col("gene_idx") == shape[0] - 1) & (F.col("bin_idx") == shape[1] - 1)
    body = body.withColumn("n", F.when(is_size, F.col("n") - shape[2]).otherwise(F.col("n"))).filter(~(is_size & (F.col("_k") == 1)))
    return body.select("gene_idx", "bin_idx", F.col("n").cast("long").alias("n"))


def read_claims(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Fractional truth (cell_id, barcode, w): coverage is preferred to weight, must be in (0, 1], one row a pair."""
    name = next((c for c in ("cell_coverage_fraction", "weight") if c in df.columns), None)
    if name is None:
        raise ContractError("no weight column")
    w = df.select(F.col("cell_id").cast("string").alias("cell_id"), "barcode", F.col(name).cast("double").alias("w"))
    if not w.filter("w is null or isnan(w) or w <= 0 or w > 1").isEmpty():
        raise ContractError(f"{name} is not in (0, 1]")
    return assert_unique(w, ["cell_id", "barcode"], "truth")


def read_seeds(df: DataFrame) -> DataFrame:
    """Annotated and not ambiguous rows; without the ambiguity column none is ambiguous."""
    ambiguous = F.coalesce(F.col("ambiguous_nuclear_assignment"), F.lit(False)) if "ambiguous_nuclear_assignment" in df.columns else F.lit(False)
    return df.filter(F.coalesce(F.col("has_nuclear_annotation"), F.lit(False)) & ~ambiguous)


def read_patches(df: DataFrame) -> DataFrame:
    """Patch index with its JSON lists as arrays of strings."""
    lists = [c for c in ("patch_cell_ids", "core_cell_ids", "margin_cell_ids") if c in df.columns]
    return df.withColumns({c: cell_list(F.col(c)) for c in lists})


def read_polygons(df: DataFrame) -> DataFrame:
    """(cell_id, label_id, ring): vertices in their order as one array; a ring is one outline, which is bounded."""
    v = F.sort_array(F.collect_list(F.struct("ord", F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y"))))
    return df.groupBy("cell_id", "label_id").agg(F.transform(v, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def ring_area(ring):
    """Signed shoelace area of a ring of points."""
    n = F.size(ring)
    i = F.sequence(F.lit(0), n - 1)
    at = lambda k: F.element_at(ring, (k % n + 1).cast("int"))
    return F.aggregate(i, F.lit(0.0), lambda a, k: a + (at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"]) / 2)


def in_ring(x, y, ring):
    """Even-odd test of a point against a ring."""
    n = F.size(ring)
    at = lambda k: F.element_at(ring, (k % n + 1).cast("int"))

    def crosses(a, k):
        p, q = at(k), at(k + 1)
        hit = ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        return F.when(hit, ~a).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Event log: one JSON object a line, payload kept as text."""
    return spark.read.schema("timestamp_utc timestamp, timestamp_local string, event string, payload string").json(path)


def read_10x_h5(spark: SparkSession, path: str) -> DataFrame:
    """(bin_idx, gene_idx, n) from HDF5 files, where h5py is installed; files are dealt over the tasks."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise ContractError("reading HDF5 needs h5py; convert to parquet or Matrix Market text") from e

    def load(it):
        import io

        import h5py
        import numpy as np
        import pandas as pd

        for pdf in it:
            for data in pdf["content"]:
                with h5py.File(io.BytesIO(data)) as f:
                    m = f["matrix"]
                    ptr = m["indptr"][:]
                    yield pd.DataFrame({"bin_idx": np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), "gene_idx": m["indices"][:], "n": m["data"][:].astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "bin_idx long, gene_idx long, n long")


def fingerprints(spark: SparkSession, path: str, limit: int = 8 << 20) -> DataFrame:
    """(path, size, sha256) of files: whole up to the limit, else of the first and last ``limit`` bytes."""
    f = spark.read.format("binaryFile").load(path)
    part = F.when(F.col("length") <= limit, F.col("content")).otherwise(F.concat(F.substring("content", 1, limit), F.expr(f"substring(content, -{limit}, {limit})")))
    return f.select("path", F.col("length").alias("size"), F.sha2(part, 256).alias("sha256"))


def is_fresh(recorded: DataFrame, current: DataFrame) -> bool:
    """True when the recorded fingerprints are those of the sources now."""
    cols = ["path", "size", "sha256"]
    return recorded.select(*cols).exceptAll(current.select(*cols)).isEmpty() and current.select(*cols).exceptAll(recorded.select(*cols)).isEmpty()


def discover_runs(spark: SparkSession, pattern: str, method_pattern: str) -> DataFrame:
    """(path, method) of matching files; a method with two runs raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(pattern).select("path", F.regexp_extract("path", method_pattern, 1).alias("method")).filter("method <> ''")
    return assert_unique(files, ["method"], "runs")
