"""Array archives read by row ranges: single arrays, zipped archives of them, and shards of ragged arrays; a Spark data source.

A shard is an array file, an archive of arrays, or a folder with one array file
for each name.  Each of its arrays is read in runs of rows by as many tasks as
its size asks for, and no task holds more than a batch.  With ``splits`` an
array is ragged: row i is the slice from splits[i] to splits[i + 1].

    spark.read.format("array_rows").option("member", "counts").load("reference.npz").filter("row < 1000")

Arrays that an archive holds deflated can only be read from their start, so one
task reads each of those, in a stream; stored ones are read from any place.
"""

from __future__ import annotations

import json
import math
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "array_rows"
#: Bytes of an array in a partition, about, and in a batch.
PART, BATCH = 64 << 20, 4 << 20
_LIST = "shards.json"
_FILE = pyarrow.fs.FileType.File
_SCHEMA = "shard string, row long, place long, values array<double>"


@dataclass
class Part(InputPartition):
    """Part i of n of a shard."""

    shard: str
    i: int
    n: int


@dataclass
class Shards(WriterCommitMessage):
    names: list[str]


@contextmanager
def _member(fs: pyarrow.fs.FileSystem, path: str, name: str):
    """(file after the header, shape, kind, whether any place can be read at once) of an array of a shard."""
    info = fs.get_file_info(path)
    alone = info.type == _FILE and not path.endswith(".npz")
    at = path if info.type == _FILE else f"{path}/{name}.npy"
    if fs.get_file_info(at).type != _FILE:
        raise FileNotFoundError(f"shard {path} has no array {name}")
    with fs.open_input_file(at) as raw:
        if alone or at != path:
            yield raw, *_header(raw), True
            return
        with zipfile.ZipFile(raw) as z:
            if f"{name}.npy" not in z.namelist():
                raise FileNotFoundError(f"archive {path} has no array {name}")
            with z.open(f"{name}.npy") as f:
                yield f, *_header(f), z.getinfo(f"{name}.npy").compress_type == zipfile.ZIP_STORED


def _header(f) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(f)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column and len(shape) > 1:
        raise ValueError("arrays must be stored by rows")
    if kind.hasobject or kind.kind not in "biuf":
        raise ValueError(f"arrays must be of numbers, not of {kind}")
    return shape or (1,), kind


class _Rows:
    """Rows of an open array, read forwards."""

    def __init__(self, f, shape: tuple[int, ...], kind: np.dtype) -> None:
        self.f, self.kind, self.start = f, kind, f.tell()
        self.count, self.width = shape[0], math.prod(shape[1:])
        self.step = max(1, self.width * kind.itemsize)

    def batches(self, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, rows) of bounded size."""
        self.f.seek(self.start + lo * self.width * self.kind.itemsize)
        most = max(1, BATCH // self.step)
        for at in range(lo, hi, most):
            n = min(most, hi - at)
            need = n * self.width * self.kind.itemsize
            data = self.f.read(need)
            if len(data) < need:
                raise ValueError("the array ends before its last row")
            yield at, np.frombuffer(data, dtype=self.kind).reshape(n, self.width).astype(np.float64)

    def all(self, lo: int, hi: int) -> np.ndarray:
        return np.concatenate([b for _, b in self.batches(lo, hi)]).ravel() if hi > lo else np.empty(0)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, member: str, splits: str | None, part: int) -> None:
        self.path, self.member, self.splits, self.part = path.rstrip("/"), member, splits, part
        self.first, self.last, self.only, self.shards = 0, math.inf, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Shards and bounds of rows decide what is read; all else is left to Spark."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and at in (("row",), ("shard",)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = "only" if at == ("row",) else "shards"
                have = getattr(self, name)
                setattr(self, name, wanted if have is None else have & wanted)
            elif at == ("row",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif at == ("row",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _listed(self) -> list[tuple[str, int]]:
        """(shard, bytes): the path itself, or what its list or its folder names."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == _FILE:
            return [("", info.size)]
        inside = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        size = {i.path[len(root) :].strip("/"): i.size or 0 for i in inside if i.type == _FILE}
        if f"{self.member}.npy" in size:
            return [("", size[f"{self.member}.npy"])]
        if _LIST in size:
            with fs.open_input_stream(f"{root}/{_LIST}") as f:
                return [(s, size[f"{s}/{self.member}.npy"]) for s in json.loads(f.read())]
        files = [(p, n) for p, n in size.items() if "/" not in p and p.endswith((".npz", ".npy"))]
        folders = [(p.rpartition("/")[0], n) for p, n in size.items() if p.count("/") == 1 and p.endswith(f"/{self.member}.npy")]
        return sorted(files + folders)

    def partitions(self) -> list[Part]:
        out = []
        for shard, size in self._listed():
            if self.shards is None or shard in self.shards:
                n = max(1, -(-size // self.part))
                out += [Part(shard, i, n) for i in range(n)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        at = f"{root}/{part.shard}".rstrip("/")
        if self.splits is None:
            with _member(fs, at, self.member) as (f, shape, kind, anywhere):
                rows = _Rows(f, shape, kind)
                for lo, hi in self._spans(part, rows.count, anywhere):
                    for first, values in rows.batches(lo, hi):
                        n = np.arange(first, first + len(values))
                        yield self._batch(part.shard, n, np.zeros_like(n), values)
            return
        with _member(fs, at, self.splits) as (f, shape, kind, _):
            splits = _Rows(f, shape, kind)
            bounds = splits.all(0, splits.count).astype(np.int64)
        with _member(fs, at, self.member) as (f, shape, kind, anywhere):
            rows = _Rows(f, shape, kind)
            if not len(bounds) or bounds[0] != 0 or bounds[-1] != rows.count or (np.diff(bounds) < 0).any():
                raise ValueError(f"{self.splits} of {at} does not split its {rows.count} rows")
            for lo, hi in self._spans(part, len(bounds) - 1, anywhere):
                for first, values in rows.batches(int(bounds[lo]), int(bounds[hi])):
                    place = np.arange(first, first + len(values))
                    row = np.searchsorted(bounds, place, side="right") - 1
                    yield self._batch(part.shard, row, place - bounds[row], values)

    def _spans(self, part: Part, count: int, anywhere: bool) -> list[tuple[int, int]]:
        """Runs of wanted rows in this part."""
        i, n = (part.i, part.n) if anywhere else (0, 1 if part.i == 0 else 0)
        if not n:
            return []
        lo, hi = max(count * i // n, math.ceil(self.first)), min(count * (i + 1) // n, math.floor(min(self.last, count)) + 1)
        if self.only is None:
            return [(lo, hi)] if lo < hi else []
        wanted = np.array(sorted(x for x in self.only if x is not None and lo <= x < hi), dtype=np.int64)
        return [(int(r[0]), int(r[-1]) + 1) for r in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(r)]

    def _batch(self, shard: str, row: np.ndarray, place: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(row), pa.string()), pa.array(row, pa.int64()), pa.array(place, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))], names=["shard", "row", "place", "values"])


class RaggedWriter(DataSourceArrowWriter):
    """Rows (chunk, id, values), sorted by chunk and id: a shard for each chunk, with the ids, the splits and the values."""

    def __init__(self, path: str) -> None:
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        chunk = None

        def flush() -> None:
            if not held:
                return
            every, values = (np.concatenate(x) for x in zip(*held))
            if (np.diff(every) < 0).any():
                raise ValueError("rows must be sorted by id")
            ids, first = np.unique(every, return_index=True)
            name = f"{self.run}-{chunk:08d}-{uuid.uuid4().hex[:8]}"
            fs.create_dir(f"{root}/{name}", recursive=True)
            for key, array in (("ids", ids), ("splits", np.append(first, len(every)).astype(np.int64)), ("values", values)):
                with fs.open_output_stream(f"{root}/{name}/{key}.npy") as out:
                    np.lib.format.write_array(out, array, allow_pickle=False)
            names.append(name)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            of, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for run in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(of)) + 1):
                if int(of[run[0]]) != chunk:
                    flush()
                    chunk = int(of[run[0]])
                held.append((ids[run], values[run]))
        flush()
        return Shards(names)

    def commit(self, messages: list[Shards | None]) -> None:
        """The list names the shards of this run; what a failed or doubled task left behind is in no list."""
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{_LIST}.{self.run}") as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        fs.move(f"{root}/{_LIST}.{self.run}", f"{root}/{_LIST}")

    def abort(self, messages: list[Shards | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_dir(f"{root}/{name}")


class ArrayRows(DataSource):
    """Options: ``path``; ``member``, the array; ``splits``, the array of row splits of a ragged one; ``part``, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options.get("member", "values"), self.options.get("splits"), int(self.options.get("part", PART)))

    def writer(self, schema: StructType, overwrite: bool) -> RaggedWriter:
        return RaggedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayRows)


def read_rows(spark: SparkSession, path: str, member: str = "values", splits: str | None = None, part: int = PART) -> DataFrame:
    """(shard, row, place, values): every row of the array, place counting inside a ragged row; integers are exact to 2^53."""
    register(spark)
    r = spark.read.format(FORMAT).option("member", member).option("part", part)
    return (r.option("splits", splits) if splits else r).load(path)


def write_ragged(df: DataFrame, path: str, key: str, order: Sequence[str], values: Sequence[str], size: int = 256) -> None:
    """Rows of each key (an integer of 0 or more), in their order, as one ragged row of shards of ``size`` keys.

    Null keys and values raise.  A shard is held by one task: a key stands for a cell, whose rows its area bounds.
    """
    register(df.sparkSession)
    bad = F.col(key).isNull() | (F.col(key) < 0)
    for v in values:
        bad = bad | F.col(v).isNull()
    k = F.when(bad, F.raise_error(F.lit("null or negative key, or null value"))).otherwise(F.col(key)).cast("long")
    rows = df.select(F.floor(k / size).cast("long").alias("chunk"), k.alias("id"), F.array(*[F.col(v).cast("double") for v in values]).alias("values"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    ranged = rows.repartitionByRange("chunk").sortWithinPartitions("chunk", "id", *[f"_o{i}" for i in range(len(order))])
    ranged.select("chunk", "id", "values").write.format(FORMAT).mode("append").save(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, shard, row): where each key of ``write_ragged`` lies."""
    return read_rows(spark, path, "ids").select(F.element_at("values", 1).cast("long").alias("id"), "shard", "row")


def requested_rows(rows: DataFrame, requests: DataFrame, listed: int = 1000) -> DataFrame:
    """(requests.., place, values): the rows asked for by (shard, row), each as often as it is asked.

    Up to ``listed`` shards are named to the source, which then opens no other; with more the join alone decides.
    """
    shards = [r[0] for r in requests.select("shard").distinct().limit(listed + 1).collect()]
    wanted = rows.filter(F.col("shard").isin(shards)) if len(shards) <= listed else rows
    return requests.join(wanted, ["shard", "row"])


def counts_of(rows: DataFrame, whole: bool = True) -> DataFrame:
    """(shard, row, col, n): entries above 0 of a matrix of counts; negative, infinite and, if ``whole``, broken numbers raise."""
    e = rows.select("shard", "row", F.posexplode("values").alias("col", "n"))
    bad: Column = F.col("n").isNull() | F.isnan("n") | (F.col("n") < 0) | (F.col("n") == math.inf)
    if whole:
        bad = bad | (F.col("n") != F.floor("n"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a count in row "), F.col("row").cast("string"), F.lit(": "), F.col("n").cast("string")))).otherwise(F.col("n"))
    n = checked.cast("long") if whole else checked.cast("double")
    return e.select("shard", "row", F.col("col").cast("long").alias("col"), n.alias("n")).filter("n > 0")
