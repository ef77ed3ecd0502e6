"""Joint steps of all cells of a patch as a stateful operator: one transaction for each step, in batch and as a stream.

The state of a patch of a stream lies in the state store: its bins with their owners, the claims of its cells,
requests of steps that are not complete, and its progress.  In a batch all requests of a patch are there at once, so they
meet its bins and claims in one group and nothing is stored.  A patch is a rectangle of bounded size, so its state is, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.legal import Rules, scale_of
from ..operators.lineage import cut

OUT = "patch long, step long, phase string, outcome string, applied long, masked long, reward double, ended string, changes array<struct<bin:long,cell:long>>"
OWNERS = "patch long, bin long, cell long"
STEPS = pa.schema([("patch", "int64"), ("step", "int64"), ("phase", "string"), ("outcome", "string"), ("applied", "int64"), ("masked", "int64"), ("reward", "float64"), ("ended", "string"), ("changes", pa.list_(pa.struct([("bin", pa.int64()), ("cell", pa.int64())])))])
START = pa.schema([("bin", "int64"), ("row", "int64"), ("col", "int64"), ("cell", "int64"), ("target", "bool"), ("allowed", "bool"), ("worth", "float64")])
ASKED = pa.schema([("step", "int64"), ("n", "int64"), ("cell", "int64"), ("bin", "int64")])
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Board:
    """Owners of one patch while its steps are applied."""

    def __init__(self, bins: dict[int, tuple], claims: dict[tuple[int, int], float], rules: Rules) -> None:
        self.rules, self.claims = rules, claims
        self.place = {b: (r, c) for b, (r, c, *_) in bins.items()}
        self.at = {p: b for b, p in self.place.items()}
        self.target = {b for b, v in bins.items() if v[3]}
        self.allowed = {b for b, v in bins.items() if v[4]}
        self.owner = {b: v[2] for b, v in bins.items() if v[2] is not None}
        self.scale = scale_of(rules.scale, len({c for _, c in claims}), len(self.target))
        self.around: dict[int, list[int]] = {}
        self.wanted = [(b, c) for b, c in claims if b in self.target]

    def near(self, bin: int, cell: int) -> int:
        if bin not in self.around:
            r, c = self.place[bin]
            self.around[bin] = [b for i, j in AROUND if (b := self.at.get((r + i, c + j))) is not None]
        owner = self.owner.get
        return [owner(b) for b in self.around[bin]].count(cell)

    def filled(self) -> bool:
        return all(b in self.owner for b in self.target)

    def held(self) -> set[int]:
        return set(self.owner.values())

    def worth(self, bin: int, cell: int) -> float:
        """What the objective gains if the cell takes the bin: its worth, and support on both sides."""
        return self.claims.get((bin, cell), 0.0) + self.rules.support * 2 * self.near(bin, cell) / 8

    def legal(self, bin: int, cell: int, filled: bool, held: set[int]) -> bool:
        old = self.owner.get(bin)
        if (bin, cell) not in self.claims or bin not in self.place or old == cell:
            return False
        # What looks at neighbours comes last.
        if not filled and bin not in self.target or (self.rules.replace_only and filled if old is None else bin not in self.allowed):
            return False
        if cell in held and not self.near(bin, cell):
            return False
        return old is None or (self.worth(bin, cell) - self.worth(bin, old)) / self.scale > self.rules.eps

    def can_add(self) -> bool:
        held = self.held()
        return any(b not in self.owner and (c not in held or self.near(b, c)) for b, c in self.wanted)

    def move(self, bin: int, cell: int | None) -> float:
        """Change the owner; what the objective gains."""
        old = self.owner.pop(bin, None)
        gain = -self.worth(bin, old) if old is not None else 0.0
        if cell is not None:
            gain += self.worth(bin, cell)
            self.owner[bin] = cell
        return gain

    def step(self, requests: list[tuple[int, int]], strict: bool) -> tuple:
        """(phase, outcome, applied, masked, reward, ended, changes) of one step of requests (cell, bin), all judged on the state before it."""
        filled, held = self.filled(), self.held()
        phase = "postfill" if filled else "prefill"
        moves: dict[int, int] = {}
        for cell, bin in requests:
            if bin not in moves and self.legal(bin, cell, filled, held):
                moves[bin] = cell
            elif strict:
                raise ValueError(f"bin {bin} is requested twice or not open to cell {cell}")
        masked = len(requests) - len(moves)
        if not moves:
            if not filled and self.can_add():
                return phase, "no_proposal", 0, masked, -1.0 / self.scale, None, []
            return phase, "stop", 0, masked, 0.0, "terminated" if filled else "truncated", []
        before = {b: self.owner.get(b) for b in moves}
        reward = sum(self.move(b, c) for b, c in moves.items()) / self.scale
        if filled and reward <= self.rules.eps:
            for b, c in before.items():
                self.move(b, c)
            return phase, "rollback", 0, masked, reward, "terminated", []
        ended = None if filled or self.filled() or self.can_add() else "truncated"
        return phase, "applied", len(moves), masked, reward, ended, sorted(moves.items())

    def play(self, take: Callable[[int], list[tuple[int, int]] | None], at: int, strict: bool) -> tuple[list[tuple], int, str | None]:
        """(rows, next step, how it ended) of the steps from ``at`` on; ``take`` gives the sorted requests (cell, bin) of one that is complete."""
        out, ended = [], None
        while not ended and (asked := take(at)) is not None:
            phase, outcome, applied, masked, reward, ended, changes = self.step(asked, strict)
            ended = ended or ("truncated" if at >= self.rules.most else None)
            out.append((at, phase, outcome, applied, masked, reward, ended, [{"bin": b, "cell": c} for b, c in changes]))
            at += 1
        return out, at, ended


class JointSteps(StatefulProcessor):
    """Applies complete steps in their order; requests of later steps wait in the state."""

    def __init__(self, rules: Rules, strict: bool) -> None:
        self.rules, self.strict = rules, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Tables as Arrow streams, since a board is read whole: rows of their own would pass the store one by one.
        self.start = handle.getListState("start", "rows binary")
        self.owners = handle.getValueState("owners", "rows binary")
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.progress = handle.getValueState("progress", "next long, ended string")
        self.fresh: tuple = (None, None)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        pieces = self.fresh[1] if self.fresh[0] == key else []
        # The first requests come right after it, so they need not ask the store for it.
        self.fresh = key, [*pieces, *initialState["rows"]]
        for rows in initialState["rows"]:
            self.start.appendValue((rows,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ended = self.progress.get() if self.progress.exists() else (1, None)
        asked = [_unpacked(r) for pdf in rows for r in pdf["rows"]]
        if ended:
            return
        if self.waiting.exists():
            asked.append(_unpacked(self.waiting.get()[0]))
        asked = pa.concat_tables(asked) if asked else ASKED.empty_table()
        take, out = _taken(asked), []
        if take(at) is not None:
            pieces = self.fresh[1] if self.fresh[0] == key else [r[0] for r in self.start.get()] if self.start.exists() else []
            board = _board(pa.concat_tables([START.empty_table(), *map(_unpacked, pieces)]), self.rules)
            if self.owners.exists():
                now = _unpacked(self.owners.get()[0])
                board.owner = dict(zip(*(now[n].to_numpy().tolist() for n in ("bin", "cell")), strict=True))
            out, at, ended = board.play(take, at, self.strict)
            if any(r[-1] for r in out):
                self.owners.update((_packed(pa.table({n: pa.array(v, "int64") for n, v in (("bin", board.owner.keys()), ("cell", board.owner.values()))})),))
            self.progress.update((at, ended))
        left = asked.slice(0, 0) if ended else asked.filter(pc.greater_equal(asked["step"], at))
        if len(left):
            self.waiting.update((_packed(left),))
        elif self.waiting.exists():
            self.waiting.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["patch", "step", "phase", "outcome", "applied", "masked", "reward", "ended", "changes"])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


#: Rows that are cut into patches at a time.
HELD = 100_000


def _pieces(rows: DataFrame, schema: pa.Schema) -> DataFrame:
    """(patch, rows): the rows of a patch that come together as an Arrow stream; what comes sorted by patch is few pieces."""

    def cuts(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = pc.dictionary_encode(table["patch"], null_encoding="encode").combine_chunks().indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        table, ends = table.take(order), np.flatnonzero(np.diff(codes[order], append=-1)) + 1
        plain, begins = table.select(schema.names).cast(schema).combine_chunks(), np.r_[0, ends[:-1]]
        return pa.RecordBatch.from_arrays([table["patch"].take(begins).combine_chunks(), pa.array([_packed(plain.slice(i, j - i)) for i, j in zip(begins, ends)], "binary")], names=["patch", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= HELD:
                yield cuts(held)
                held = []
        if held:
            yield cuts(held)

    return rows.mapInArrow(run, "patch long, rows binary")


def joint_steps(requests: DataFrame, bins: DataFrame, claims: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """One row for each step of a patch that was applied, refused or rolled back; requests may be a stream.

    requests: (patch, step, n, cell, bin), steps from 1, n the number of rows of the step, so that a step is known to be
    complete in whatever order its rows come (null: what is there is the step, as in a batch); a null cell or bin abstains.  bins and claims as in ``legal_actions``, with
    unique keys: the state at the start.  All requests of a step are judged on the state before it.  Of two for one bin
    the lower cell's stands; the other, and those that are not legal, are masked (``strict`` raises).  Before all targets
    are owned a step always stands; after that one that pays eps or less is rolled back whole and ends the patch.  Steps
    after the end are ignored.  For a stream the session must keep state in RocksDB (``rocks``).
    """
    rows, start = _sides(requests, bins, claims)
    if not requests.isStreaming:
        return _groups(rows, start, rules, strict, OUT)
    start = _pieces(start.withColumn("patch", F.col("patch").cast("long")).repartition("patch").sortWithinPartitions("patch"), START)
    return _pieces(rows, ASKED).groupBy("patch").transformWithStateInPandas(JointSteps(rules, strict), OUT, "Append", "None", start.groupBy("patch"))


def joint_owners(requests: DataFrame, bins: DataFrame, claims: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """(patch, bin, cell): owners once the steps of a batch are done, of patches without requests those at the start."""
    return _groups(*_sides(requests, bins, claims), rules, strict, OWNERS)


def _sides(requests: DataFrame, bins: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, bins and claims in one table) with the types that the steps need."""
    none = "cast(null as {})"
    start = bins.selectExpr("patch", "bin", "row", "col", "cell", "coalesce(target, false) as target", "coalesce(allowed, false) as allowed", none.format("double") + " as worth")
    start = start.unionByName(claims.selectExpr("patch", "bin", "cell", "cast(worth as double) as worth"), allowMissingColumns=True)
    return requests.selectExpr("cast(patch as long) as patch", "cast(step as long) as step", "cast(n as long) as n", "cast(cell as long) as cell", "cast(bin as long) as bin"), start


def _groups(rows: DataFrame, start: DataFrame, rules: Rules, strict: bool, schema: str) -> DataFrame:
    """Steps or owners of patches whose requests are all there."""

    def run(key: tuple, asked: pa.Table, start: pa.Table) -> pa.Table:
        patch, board, take = key[0].as_py(), _board(start, rules), _taken(asked)
        out, _, _ = board.play(take, 1, strict)
        if schema == OUT:
            columns = list(zip(*out, strict=True)) or [()] * 8
            return pa.Table.from_arrays([pa.array(v, t) for v, t in zip([[patch] * len(out), *columns], STEPS.types, strict=True)], schema=STEPS)
        return pa.table({"patch": pa.array([patch] * len(board.owner), "int64"), "bin": pa.array(board.owner.keys(), "int64"), "cell": pa.array(board.owner.values(), "int64")})

    return rows.groupBy("patch").cogroup(start.groupBy("patch")).applyInArrow(run, schema)


def _board(start: pa.Table, rules: Rules) -> Board:
    """The board of a patch from the rows of its bins and, where there is a worth, of its claims."""
    claimed = start["worth"].is_valid()
    c, b = start.filter(claimed), start.filter(pc.invert(claimed))
    claims = dict(zip(zip(*(c[n].to_numpy().tolist() for n in ("bin", "cell")), strict=True), c["worth"].to_numpy().tolist(), strict=True))
    owner = np.where(b["cell"].is_valid().to_numpy(), b["cell"].fill_null(0).to_numpy(), None).tolist()
    row, col, target, allowed = (b[n].to_numpy().tolist() for n in ("row", "col", "target", "allowed"))
    return Board(dict(zip(b["bin"].to_numpy().tolist(), zip(row, col, owner, target, allowed, strict=True), strict=True)), claims, rules)


def _taken(asked: pa.Table) -> Callable[[int], list[tuple[int, int]] | None]:
    """The requests of a step of one patch, as ``Board.play`` takes them, from all its rows."""
    step, n, cell, bin = (asked[c].fill_null(0).to_numpy() for c in ("step", "n", "cell", "bin"))
    real = pc.and_(asked["cell"].is_valid(), asked["bin"].is_valid()).to_numpy()
    order = np.lexsort((bin, cell, step))
    step, n, cell, bin, real = (x[order] for x in (step, n, cell, bin, real))

    def take(at: int) -> list[tuple[int, int]] | None:
        lo, hi = np.searchsorted(step, [at, at + 1])
        if lo == hi or hi - lo < n[lo]:
            return None
        some = real[lo:hi]
        return list(zip(cell[lo:hi][some].tolist(), bin[lo:hi][some].tolist(), strict=True))

    return take


def owners_after(bins: DataFrame, steps: DataFrame) -> DataFrame:
    """(patch, bin, cell): owners once the steps are done, the last change of each bin over its owner at the start."""
    moved = steps.select("patch", "step", F.inline("changes")).groupBy("patch", "bin").agg(F.max_by("cell", "step").alias("_c"))
    after = bins.select("patch", "bin", "cell").join(moved, ["patch", "bin"], "left")
    return after.select("patch", "bin", F.coalesce("_c", "cell").alias("cell")).filter("cell is not null")


def in_batch(steps: DataFrame) -> DataFrame:
    """The steps of a batch, run now and kept as a checkpoint."""
    return cut(steps)


class rocks:
    """Within it the session keeps streaming state in RocksDB, which named state variables need; the setting before comes back."""

    def __init__(self, spark) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.set(STORE, self.before) if self.before else self.conf.unset(STORE)
