"""Sparse matrices by column, in chunks, read by column range: a Spark data source.

A matrix is a folder of chunks and a list of them.  A chunk holds a run of
columns in compressed form: the column numbers, where each starts, the row
numbers and the values, each a plain array file.  Filters on the column reach
the source: chunks without a wanted column are no partitions, and of the others
only the bytes of the wanted columns are read.

    counts.repartitionByRange("column").sortWithinPartitions("column", "row").write.format("sparse_columns").mode("overwrite").save(path)
    spark.read.format("sparse_columns").load(path).filter("column between 100 and 200")
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "sparse_columns"
#: Stored values in a chunk and in a partition that is read, about.
CHUNK = 1 << 20
_LIST = "chunks.json"
_SCHEMA = "column long, row long, value long"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _save(fs: pyarrow.fs.FileSystem, path: str, values: np.ndarray) -> None:
    with fs.open_output_stream(path) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(values), allow_pickle=False)


def _load(fs: pyarrow.fs.FileSystem, path: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Elements lo to hi of an array file; no other elements are read."""
    with fs.open_input_file(path) as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        hi = shape[0] if hi is None else hi
        f.seek(f.tell() + lo * kind.itemsize)
        return np.frombuffer(f.read((hi - lo) * kind.itemsize), dtype=kind)


@dataclass
class Chunks(WriterCommitMessage):
    listed: list[dict]


@dataclass
class Range(InputPartition):
    """Columns first to last of a chunk."""

    chunk: str
    first: int
    last: int


class ColumnWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, chunk: int) -> None:
        self.path, self.overwrite, self.chunk, self.run = path.rstrip("/"), overwrite, chunk, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Chunks:
        """The rows of one task, sorted by column: chunks of a bounded size; a column may go on in the next."""
        fs, root = _open(self.path)
        listed: list[dict] = []
        held: list[tuple[int, int, int]] = []

        def flush() -> None:
            if not held:
                return
            column, row, value = (np.array(x, dtype=np.int64) for x in zip(*held))
            if (np.diff(column) < 0).any():
                raise ValueError("rows must be sorted by column")
            ids, start = np.unique(column, return_index=True)
            name = f"{self.run}-{uuid.uuid4().hex[:12]}"
            fs.create_dir(f"{root}/{name}", recursive=True)
            for key, values in (("columns", ids), ("starts", np.append(start, len(column)).astype(np.int64)), ("rows", row), ("values", value)):
                _save(fs, f"{root}/{name}/{key}.npy", values)
            listed.append({"chunk": name, "first": int(ids[0]), "last": int(ids[-1]), "stored": len(column)})
            held.clear()

        for r in rows:
            held.append((r[0], r[1], r[2]))
            if len(held) >= self.chunk:
                flush()
        flush()
        return Chunks(listed)

    def commit(self, messages: list[Chunks | None]) -> None:
        """The list makes the chunks of this run, and of those before unless it overwrites, the matrix."""
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        listed = [c for m in messages if m for c in m.listed]
        if not self.overwrite and fs.get_file_info(f"{root}/{_LIST}").type != pyarrow.fs.FileType.NotFound:
            with fs.open_input_stream(f"{root}/{_LIST}") as f:
                listed = json.loads(f.read()) + listed
        with fs.open_output_stream(f"{root}/{_LIST}.{self.run}") as out:
            out.write(json.dumps(sorted(listed, key=lambda c: (c["first"], c["chunk"]))).encode())
        fs.move(f"{root}/{_LIST}.{self.run}", f"{root}/{_LIST}")

    def abort(self, messages: list[Chunks | None]) -> None:
        """Chunks that no list names are never read; those that are known go."""
        fs, root = _open(self.path)
        for c in (c for m in messages if m for c in m.listed):
            fs.delete_dir(f"{root}/{c['chunk']}")


class ColumnReader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path.rstrip("/"), per_task
        self.first, self.last, self.only = -math.inf, math.inf, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds and lists of columns prune; all else is left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("column",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = _open(self.path)
        with fs.open_input_stream(f"{root}/{_LIST}") as f:
            listed = json.loads(f.read())
        out = []
        for c in listed:
            first, last = max(c["first"], self.first), min(c["last"], self.last)
            if first > last or (self.only is not None and not any(first <= x <= last for x in self.only)):
                continue
            parts = max(1, round(c["stored"] / self.per_task * (last - first + 1) / (c["last"] - c["first"] + 1)))
            step = -(-(last - first + 1) // parts)
            out += [Range(c["chunk"], int(lo), int(min(last, lo + step - 1))) for lo in range(int(first), int(last) + 1, int(step))]
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.chunk:
            return
        fs, root = _open(self.path)
        at = f"{root}/{partition.chunk}"
        ids, starts = (_load(fs, f"{at}/{x}.npy") for x in ("columns", "starts"))
        lo, hi = np.searchsorted(ids, partition.first), np.searchsorted(ids, partition.last, side="right")
        wanted = np.arange(lo, hi)
        if self.only is not None:
            wanted = wanted[np.isin(ids[lo:hi], list(self.only))]
        # Runs of wanted columns that lie side by side are one read.
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
            if len(run):
                a, b = int(starts[run[0]]), int(starts[run[-1] + 1])
                column = np.repeat(ids[run], np.diff(starts[run[0] : run[-1] + 2]))
                rows, values = (_load(fs, f"{at}/{x}.npy", a, b) for x in ("rows", "values"))
                yield pa.RecordBatch.from_arrays([pa.array(column), pa.array(rows), pa.array(values)], names=["column", "row", "value"])


class SparseColumns(DataSource):
    """Options: ``path``; ``chunk``, stored values in a chunk that is written; ``per_task``, about as many in a partition that is read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> ColumnReader:
        return ColumnReader(self.options["path"], int(self.options.get("per_task", CHUNK)))

    def writer(self, schema: StructType, overwrite: bool) -> ColumnWriter:
        if [f.name for f in schema.fields] != ["column", "row", "value"]:
            raise ValueError(f"columns must be column, row, value; got {schema.names}")
        return ColumnWriter(self.options["path"], overwrite, int(self.options.get("chunk", CHUNK)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SparseColumns)


def write_columns(entries: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write (column, row, value), integers; entries of one column and row are summed, negative values and null keys raise."""
    register(entries.sparkSession)
    bad = F.col("column").isNull() | F.col("row").isNull() | (F.col("value") < 0)
    checked = entries.select(F.when(bad, F.raise_error(F.lit("null key or negative value"))).otherwise(F.col("column")).cast("long").alias("column"), F.col("row").cast("long").alias("row"), F.col("value").cast("long").alias("value"))
    summed = checked.groupBy("column", "row").agg(F.sum("value").alias("value"))
    summed.repartitionByRange("column").sortWithinPartitions("column", "row").write.format(FORMAT).option("chunk", chunk).mode("overwrite").save(path)


def read_columns(spark: SparkSession, path: str, per_task: int = CHUNK) -> DataFrame:
    """(column, row, value); filters on the column decide what is read."""
    register(spark)
    return spark.read.format(FORMAT).option("per_task", per_task).load(path)


def requested(matrix: DataFrame, requests: DataFrame) -> DataFrame:
    """(place, column, row, value): the columns that are asked for (place, column), each as often as it is asked.

    The asked range prunes what is read; the join with the requests decides.
    """
    span = requests.agg(F.min("column").alias("lo"), F.max("column").alias("hi")).first()
    if span["lo"] is None:
        return matrix.limit(0).select(F.lit(0).cast("long").alias("place"), "*")
    return requests.join(matrix.filter(F.col("column").between(span["lo"], span["hi"])), "column").select("place", "column", "row", "value")
