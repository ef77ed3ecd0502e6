"""Chat formatting: a hidden Markov model recovers roles, then turns are rendered (operator 1).

Each turn (or line of a raw transcript) is an observation: the speaker marker at
its start, its length, whether it ends as a question, its number of lines.  The
hidden states are the roles.  Emissions, starts and transitions are smoothed
counts over all labelled conversations outside the held-out fold
(crc32(conv_id) mod 4 is 2).  Viterbi decoding gives the most likely roles.

Viterbi is a product of matrices over (max, +), which is associative.  Turns are
cut into blocks of BLOCK; a block is reduced to one matrix, blocks of blocks
likewise, and the best roles at block ends are handed down again.  So a
conversation with a third of all rows is many small groups, and the result is
that of one pass.  With short conversations there is one level and one shuffle.
Many texts of one turn (of a null turn, say) are parted by ranges of their hash
and become one matrix of that turn in the same way.

Edge cases: null and empty texts are observations of length 0 and render an
empty body; a null conv_id is one conversation, a null turn stands first; rows
of one conversation with equal turn stand in order of their text hash, and rows
that repeat whole (same text) are one observation and get the same role; unknown
given roles are not learned from; an empty table gives no rows; with nothing to
learn, markers and alternation decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, require

ROLES = ("user", "assistant", "system", "tool")
#: Turns in one block.
BLOCK = 256

# Names that mark a speaker, by role.
MARKERS = {
    "user": ("user", "human", "customer", "question", "prompter", "you", "q"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "model", "agent", "answer", "a"),
    "system": ("system", "instructions", "instruction"),
    "tool": ("tool", "function", "observation"),
}
_NAMES = "|".join(sorted((n for names in MARKERS.values() for n in names), key=len, reverse=True))
MARKER = rf"(?i)^[\s>#*\[<|]*({_NAMES})(?:[ \t]*[\]|>*]+[ \t]*:?|[ \t]*:)\s*"

#: Chance that a turn carries the marker of a certain other role.
OTHER_MARKER = 1e-7

_LENGTHS, _LINES = 18, 4
#: Log chances are whole multiples of 2**-20, held as floats: sums are exact and do not depend on how turns are cut.
_GRAIN = float(1 << 20)
_K = len(ROLES)
_S = _K + 1  # and one state before the first turn
_FLOOR = -1e4


def _observed(text: Column) -> list[Column]:
    """marker (0: none, else role + 1), length, question, lines of a text."""
    text = F.coalesce(text, F.lit(""))
    name = F.lower(F.regexp_extract(text, MARKER, 1))
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(name.isin(*MARKERS[role]), i + 1).otherwise(marker)
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return [
        marker.alias("marker"),
        F.least(F.floor(F.log2(F.length(text) + 1)).cast("int"), F.lit(_LENGTHS - 1)).alias("length"),
        F.rtrim(text).endswith("?").cast("int").alias("question"),
        F.when(lines == 0, 0).when(lines == 1, 1).when(lines <= 3, 2).otherwise(3).alias("lines"),
    ]


def _keys() -> list[Column]:
    return [F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("_conv"), F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)).alias("_turn"), F.xxhash64("text").alias("_th")]


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """step[s, t]: log chance of role t after s (last s: at the start); emit[observation, t]; both times _GRAIN."""

    def __init__(self, seen: list, moves: list) -> None:
        role_of = {r: i for i, r in enumerate(ROLES)}
        tables = {"length": np.full((_K, _LENGTHS), 0.5), "question": np.full((_K, 2), 0.5), "lines": np.full((_K, _LINES), 0.5)}
        for r in seen:
            for name, t in tables.items():
                t[role_of[r["role"]], r[name]] += r["n"]
        logs = {n: np.log(t / t.sum(axis=1, keepdims=True)) for n, t in tables.items()}
        # That there is a marker says nothing of the role; which one it is says nearly all.
        logs["marker"] = np.full((_K, _K + 1), np.log(OTHER_MARKER))
        logs["marker"][:, 0] = 0.0
        logs["marker"][np.arange(_K), np.arange(_K) + 1] = np.log1p(-OTHER_MARKER * (_K - 1))
        m, le, q, li = np.meshgrid(np.arange(_K + 1), np.arange(_LENGTHS), np.arange(2), np.arange(_LINES), indexing="ij")
        self.emit = np.full((m.size, _S), _FLOOR)
        self.emit[:, :_K] = (logs["marker"][:, m.ravel()] + logs["length"][:, le.ravel()] + logs["question"][:, q.ravel()] + logs["lines"][:, li.ravel()]).T
        # Before anything is learned: user first, then turns alternate.
        step = np.full((_S, _K), 0.05)
        step[0, 1] = step[1, 0] = step[2, 0] = step[3, 1] = step[_K, 0] = 0.5
        for r in moves:
            step[role_of[r["before"]] if r["before"] else _K, role_of[r["role"]]] += r["n"]
        self.step = np.full((_S, _S), _FLOOR)
        self.step[:, :_K] = np.log(step / step.sum(axis=1, keepdims=True))
        self.emit, self.step = np.rint(self.emit * _GRAIN), np.rint(self.step * _GRAIN)

    @staticmethod
    def code() -> Column:
        return ((F.col("marker") * _LENGTHS + F.col("length")) * 2 + F.col("question")) * _LINES + F.col("lines")


def train(conversations: DataFrame) -> Model:
    """Counts over all labelled turns outside the held-out fold; the driver sees tables of fixed size."""
    rows = require(conversations, "conv_id", "turn", "role", "text").filter(~held_out(F.col("conv_id")) & F.col("role").isin(*ROLES))
    seen = rows.select("role", *_observed(F.col("text"))).groupBy("role", "marker", "length", "question", "lines").agg(F.count("*").alias("n")).collect()
    one = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    before = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    moves = one.join(before, ["conv_id", "turn"], "left").groupBy("before", "role").agg(F.count("*").alias("n")).collect()
    return Model(seen, moves)


Step = Callable[[np.ndarray], np.ndarray]


def decode(step: Step, starts: np.ndarray, lengths: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Best state of every element of every group; leave[g] < 0 leaves the last state free.  Groups step together."""
    out = np.zeros(int(lengths.sum()), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    delta = np.full((len(lengths), _S), _FLOOR * _GRAIN * 1e3)
    delta[np.arange(len(lengths)), enter] = 0
    trail = []
    for t in range(int(ranked[0]) if len(ranked) else 0):
        live = order[: int(np.searchsorted(-ranked, -t, side="left"))]
        scores = delta[live][:, :, None] + step(starts[live] + t)
        trail.append((live, scores.argmax(axis=1)))
        delta[live] = scores.max(axis=1)
    state = np.where(leave >= 0, leave, delta.argmax(axis=1))
    for t in range(len(trail) - 1, -1, -1):
        live, came = trail[t]
        out[starts[live] + t] = state[live]
        state[live] = came[np.arange(len(live)), state[live]]
    return out


def product(step: Step, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The (max, +) product of the matrices of each group."""
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    out = step(starts)
    for t in range(1, int(ranked[0]) if len(ranked) else 0):
        live = order[: int(np.searchsorted(-ranked, -t, side="left"))]
        out[live] = (out[live][:, :, :, None] + step(starts[live] + t)[:, None, :, :]).max(axis=2)
    return out


def _groups(rows: DataFrame, work: Callable, schema: str, most: int = 50_000) -> DataFrame:
    """Whole (_conv, _block) groups, sorted by _at and _th, many at once, to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        names: list[str] = []

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            cols = {n: table.column(n) for n in names}
            conv, block = cols["_conv"].to_numpy(), cols["_block"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))))
            return work(cols, starts, np.diff(np.concatenate((starts, [len(conv)]))))

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            conv, block = batch.column("_conv").to_numpy(), batch.column("_block").to_numpy()
            if size >= most:
                # Up to the last group change in this batch, or before it.
                change = np.flatnonzero((conv[1:] != conv[:-1]) | (block[1:] != block[:-1])) + 1
                last = kept[-1]
                if (last.column("_conv")[-1].as_py(), last.column("_block")[-1].as_py()) != (int(conv[0]), int(block[0])):
                    yield settle(kept)
                    kept, size = [], 0
                elif len(change):
                    kept.append(batch.slice(0, int(change[-1])))
                    yield settle(kept)
                    batch, kept, size = batch.slice(int(change[-1])), [], 0
            kept.append(batch)
            size += batch.num_rows
        if kept:
            yield settle(kept)

    return rows.repartition("_conv", "_block").sortWithinPartitions("_conv", "_block", "_at", "_th").mapInArrow(run, schema)


def _matrices(model: Model, cols: dict) -> Step:
    """The matrix of each row: of its observation _m, or _x where that is null."""
    code = cols["_m"].fill_null(-1).to_numpy()
    given = np.flatnonzero(code < 0)
    out = np.zeros((len(code), _S, _S))
    seen = code >= 0
    out[seen] = model.step[None] + model.emit[code[seen]][:, None, :]
    if len(given):
        out[given] = np.frombuffer(b"".join(cols["_x"].take(pa.array(given)).to_pylist()), dtype=np.float64).reshape(-1, _S, _S)
    return lambda i: out[i]


def _above(at: Column, block: int) -> Column:
    """The block of a place.  The block before the first one is part of it, so that all places come to one block in the end."""
    found = F.floor(at / F.lit(block)).cast("long")
    return F.when(found == -1, 0).otherwise(found)


_ROW = ("_conv", "_block", "_at", "_th", "_m", "_x")


def _up(leaf: DataFrame, model: Model, block: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """leaf (_ROW) and the levels above it, until each conversation is one block."""

    def reduce(cols: dict, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        p = product(_matrices(model, cols), starts, lengths)
        return pa.RecordBatch.from_arrays([pa.array(cols["_conv"].to_numpy()[starts]), pa.array(cols["_block"].to_numpy()[starts]), pa.array([x.tobytes() for x in p], type=pa.binary())], names=["_conv", "_at", "_x"])

    levels = [leaf]
    while not levels[-1].groupBy("_conv").agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).filter("lo < hi").isEmpty():
        up = scratch.keep(f"{name}-{len(levels)}", _groups(levels[-1], reduce, "_conv long, _at long, _x binary"))
        levels.append(up.select("_conv", _above(F.col("_at"), block).alias("_block"), "_at", F.lit(0).cast("long").alias("_th"), F.lit(None).cast("int").alias("_m"), "_x"))
    return levels


def _down(levels: list[DataFrame], ends: DataFrame | None, model: Model) -> DataFrame:
    """(_conv, _at, _th, _enter, _leave) of the rows of the lowest level, by the states (_enter, _leave) around each conversation."""

    def walk(cols: dict, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        enter, leave = cols["_enter"].to_numpy()[starts], cols["_leave"].to_numpy()[starts]
        state = decode(_matrices(model, cols), starts, lengths, enter, leave)
        came = np.concatenate(([0], state[:-1]))
        came[starts] = enter
        return pa.RecordBatch.from_arrays([*(pa.array(cols[c].to_numpy()) for c in ("_conv", "_at", "_th")), pa.array(came), pa.array(state)], names=["_conv", "_at", "_th", "_enter", "_leave"])

    bounds = None
    for level in reversed(levels):
        if bounds is not None:
            rows = level.join(bounds.select("_conv", F.col("_at").alias("_block"), "_enter", "_leave"), ["_conv", "_block"])
        elif ends is not None:
            rows = level.join(ends, "_conv")
        else:
            rows = level.withColumns({"_enter": F.lit(_K).cast("long"), "_leave": F.lit(-1).cast("long")})
        bounds = _groups(rows, walk, "_conv long, _at long, _th long, _enter long, _leave long")
    return bounds


def roles(conversations: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(_conv, _turn, _th, _state): the decoded role of every distinct turn."""
    scratch = Scratch(conversations.sparkSession, "chat")
    seen = require(conversations, "conv_id", "turn", "text").select(*_keys(), *_observed(F.col("text"))).select("_conv", "_turn", "_th", Model.code().cast("int").alias("_m")).distinct()
    seen = scratch.keep("seen", seen)
    none = F.lit(None).cast("binary").alias("_x")
    # Turns before this one share a block, as null turns do.
    place = F.greatest("_turn", F.lit(-block * block))
    crowded = scratch.keep("crowded", seen.groupBy("_conv", "_turn").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    if crowded.isEmpty():
        leaf = seen.select("_conv", _above(place, block).alias("_block"), F.col("_turn").alias("_at"), "_th", "_m", none)
        return _down(_up(leaf, model, block, scratch, "turns"), None, model).select("_conv", F.col("_at").alias("_turn"), "_th", F.col("_leave").alias("_state"))
    # The texts of a crowded turn are a conversation of their own, in ranges of their hash.
    marked = seen.join(crowded, ["_conv", "_turn"], "left")
    range_of = F.floor((F.col("_th").cast("double") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / block)).cast("long")
    inner = marked.filter("n is not null").select(F.xxhash64("_conv", "_turn").alias("_conv"), range_of.alias("_block"), F.lit(0).cast("long").alias("_at"), "_th", "_m", none)
    inner_levels = _up(inner, model, block, scratch, "texts")
    whole = _groups(inner_levels[-1], lambda cols, starts, lengths: pa.RecordBatch.from_arrays([pa.array(cols["_conv"].to_numpy()[starts]), pa.array([x.tobytes() for x in product(_matrices(model, cols), starts, lengths)], type=pa.binary())], names=["_inner", "_x"]), "_inner long, _x binary")
    whole = scratch.keep("whole", whole)
    one = crowded.select("_conv", "_turn", F.xxhash64("_conv", "_turn").alias("_inner")).join(whole, "_inner").select("_conv", "_turn", F.lit(0).cast("long").alias("_th"), F.lit(None).cast("int").alias("_m"), "_x")
    rows = marked.filter("n is null").select("_conv", "_turn", "_th", "_m", none).unionByName(one)
    leaf = rows.select("_conv", _above(place, block).alias("_block"), F.col("_turn").alias("_at"), "_th", "_m", "_x")
    outer = scratch.keep("outer", _down(_up(leaf, model, block, scratch, "turns"), None, model))
    # What is around a crowded turn is around its texts.
    ends = outer.join(crowded.select("_conv", F.col("_turn").alias("_at")), ["_conv", "_at"]).select(F.xxhash64("_conv", "_at").alias("_conv"), "_enter", "_leave")
    texts = _down(inner_levels, ends, model).select(F.col("_conv").alias("_inner"), "_th", F.col("_leave").alias("_state"))
    texts = texts.join(crowded.select("_conv", "_turn", F.xxhash64("_conv", "_turn").alias("_inner")), "_inner").select("_conv", "_turn", "_th", "_state")
    plain = outer.join(crowded.select("_conv", F.col("_turn").alias("_at")), ["_conv", "_at"], "left_anti")
    return plain.select("_conv", F.col("_at").alias("_turn"), "_th", F.col("_leave").alias("_state")).unionByName(texts)


def render(role: Column, text: Column) -> Column:
    """The canonical turn: role tag, body without its speaker marker, end tag."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, "")), F.lit("<|end|>"))


def format_chats(conversations: DataFrame, model: Model | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, parsed_role, rendered, _text) for every row of conversations."""
    model = model or train(conversations)
    names = F.array(*[F.lit(r) for r in ROLES])
    keyed = require(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", *_keys())
    out = keyed.join(roles(conversations, model, block), ["_conv", "_turn", "_th"])
    return out.withColumn("parsed_role", F.get(names, F.col("_state").cast("int"))).select("conv_id", "turn", "role", "parsed_role", render(F.col("parsed_role"), F.col("text")).alias("rendered"))


def lines_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): one row for each non-blank line of raw transcripts (conv_id, text)."""
    return require(transcripts, "conv_id", "text").select("conv_id", F.posexplode(F.split("text", "\n")).alias("turn", "text")).filter("trim(text) != ''").select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
