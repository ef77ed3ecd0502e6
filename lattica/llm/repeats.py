"""Windows that repeat, found through content-chosen anchors.

A *window* is W consecutive symbols (bytes or words) of one document.  Each
window is attributed to its anchor: the leftmost k-gram of least hash inside
it.  Equal windows have equal anchors, so they meet under one anchor key.
Neighbouring windows with the same anchor position travel as one *stretch*
(start, number of windows), which makes about one row for w / 2 symbols.

    stretches --(in each batch)--> contents --(key)--> copies, contents per key

* A content that occurs twice or more repeats in all its windows; this costs a
  count and needs no text.
* Contents that occur once under a key which has other contents may share some
  of their windows: they are *probed*, by a judge that sees the symbols.
* Probes of a key with over ``hot`` contents go to window level and are counted
  with map-side aggregation, so no task ever receives an unbounded group.

Digests are 64 bit under a 64-bit key.  Ids order documents; rows with the same
id and text count as one document for ``first`` and as two for ``any``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector as v
from .common import cut, mark_needed, only_needed, require, row_key

_U = np.uint64
#: Bits of the packed value that hold the position in a block.
_PLACE = 30


@dataclass(frozen=True)
class Windows:
    """What a window is: W symbols, anchors of k symbols, of bytes or words."""

    symbols: str  # "bytes" or "words"
    window: int
    gram: int

    def sequence(self, raw: np.ndarray, offsets: np.ndarray):
        """(codes, bounds): a 64-bit code per symbol, row i has bounds[i]:bounds[i + 1]."""
        if self.symbols == "bytes":
            return v.BYTE_CODE[raw], offsets
        _, _, h, first = v.words(raw, offsets)
        return h, first

    def stretches(self, raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        codes, bounds = self.sequence(raw, offsets)
        n, w = len(codes), self.window - self.gram + 1
        empty = {c: np.zeros(0, dtype=np.int64) for c in ("row", "start", "nwin", "anchor", "key", "digest")}
        if n < self.window:
            return empty
        prefix = v.prefix_sums(codes)
        at = np.arange(n - self.gram + 1)
        gram = v.span_hash(prefix, at, at + self.gram)
        packed = (gram >> _U(_PLACE) << _U(_PLACE)) | at.astype(_U)
        least = v.sliding_minimum(packed, w)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        m = n - self.window + 1
        valid = row[:m] == row[self.window - 1 :]
        place = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
        opens = valid.copy()
        opens[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]) & (row[1:m] == row[: m - 1]))
        s = np.flatnonzero(opens)
        if not len(s):
            return empty
        marks = np.concatenate((np.flatnonzero(opens | ~valid), [m]))
        nwin = marks[np.searchsorted(marks, s, side="right")] - s
        r = row[s]
        return {"row": r, "start": s - bounds[r], "nwin": nwin, "anchor": place[s] - s, "key": gram[place[s]].view(np.int64), "digest": v.span_hash(prefix, s, s + nwin + self.window - 1).view(np.int64)}


#: start, nwin and anchor travel as one number, twelve bits for each of the last two.
STRETCH = "_id long, _th long, place long, key long, digest long"
START, NWIN, ANCHOR = "int(shiftright(place, 24))", "int(shiftright(place, 12) & 4095)", "int(place & 4095)"


def stretches(docs: DataFrame, kind: Windows) -> DataFrame:
    """All stretches of the rows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, raw, offsets in v.blocks(batch.column(2)):
                s = kind.stretches(raw, offsets)
                r = s["row"] + lo
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(th[r]), pa.array(s["start"] << 24 | s["nwin"] << 12 | s["anchor"]), pa.array(s["key"]), pa.array(s["digest"])], names=["_id", "_th", "place", "key", "digest"])

    return require(docs, "doc_id", "text").select(*row_key(), "text").mapInArrow(run, STRETCH)


def _combined(batch: pa.RecordBatch, kind: Windows) -> pa.RecordBatch:
    """Contents of the rows of one batch: copies and first occurrence in (_id, _th, place)."""
    parts: list[dict[str, np.ndarray]] = []
    for lo, raw, offsets in v.blocks(batch.column(2)):
        s = kind.stretches(raw, offsets)
        parts.append({"row": s["row"] + lo, "place": s["start"] << 24 | s["nwin"] << 12 | s["anchor"], "key": s["key"], "digest": s["digest"]})
    row, place, key, digest = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for c in ("row", "place", "key", "digest"))
    ids, th = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
    order = np.argsort(v.mix(key.view(_U)) ^ digest.view(_U))
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (key[order[1:]] != key[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])
    at = np.flatnonzero(opens)
    copies = np.diff(np.concatenate((at, [len(order)])))
    first = order[at]
    group = np.cumsum(opens) - 1
    several = copies[group] > 1 if len(order) else np.zeros(0, dtype=bool)
    same, group = order[several], group[several]
    by = np.lexsort((place[same], th[same], ids[same], group))
    heads = np.ones(len(by), dtype=bool)
    heads[1:] = group[by[1:]] != group[by[:-1]]
    first[group[by[heads]]] = same[by[heads]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first], digest[first], copies.astype(np.int64), ids[first], th[first], place[first])], names=["key", "digest", "copies", "_id", "_th", "place"])


def contents(docs: DataFrame, kind: Windows) -> DataFrame:
    """One row per content that can repeat: its copies, its first occurrence, and the contents under its key.

    Copies are combined in each batch of documents before anything is shuffled,
    so a key that many documents share brings one row a batch.  One exchange, by
    key, serves the contents and the sums of their keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _combined(batch, kind)

    rows = require(docs, "doc_id", "text").select(*row_key(), "text").mapInArrow(run, "key long, digest long, copies long, _id long, _th long, place long").repartition("key")
    each = rows.groupBy("key", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("_id", "_th", "place")).alias("rep"))
    # ``rep`` is kept on this side too, so that both sides read the one exchange.
    keys = each.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("rows_of_key"), F.sum(F.when(F.col("copies") == 1, 1).otherwise(0)).alias("singles"), F.max("rep").alias("_rep")).filter("rows_of_key >= 2 and _rep is not null").drop("_rep")
    return each.join(keys, "key").select("key", "digest", "copies", "kinds", "singles", "rep.*")


def probe_symbols(docs: DataFrame, probes: DataFrame, kind: Windows) -> DataFrame:
    """probes with the symbols of their content: raw bytes, or eight bytes of hash per word."""
    wanted = probes.select("_id", "_th", F.struct("key", "digest", "copies", "kinds", F.expr(START).alias("start"), F.expr(NWIN).alias("nwin"), F.expr(ANCHOR).alias("anchor")).alias("p")).groupBy("_id", "_th").agg(F.collect_list("p").alias("ps"))
    wanted = cut(wanted)
    texts = only_needed(require(docs, "doc_id", "text").select(*row_key(), "text"), wanted)
    # Rows that repeat whole (same id, same text) carry the same probes: one is enough.
    if kind.symbols == "words":

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, raw, offsets in v.blocks(batch.column(2)):
                    n = len(offsets) - 1
                    _, _, h, first = v.words(raw, offsets)
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((first * 8).astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), data.cast(pa.binary()), batch.column(3).slice(lo, n)], names=["_id", "_th", "raw", "ps"])

        found = texts.join(wanted, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        found = found.select("_id", "_th", "text", "ps").mapInArrow(code, found.select("_id", "_th", F.lit(b"").alias("raw"), "ps").schema)
    else:
        found = texts.join(wanted, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("_id", "_th", F.col("text").cast("binary").alias("raw"), "ps")
    size = 8 if kind.symbols == "words" else 1
    pieces = F.transform("ps", lambda p: F.struct(p["key"].alias("key"), p["digest"].alias("digest"), p["copies"].alias("copies"), p["kinds"].alias("kinds"), p["start"].alias("start"), p["nwin"].alias("nwin"), p["anchor"].alias("anchor"), F.substring(F.col("raw"), p["start"] * size + 1, (p["nwin"] + kind.window - 1) * size).alias("symbols")))
    return found.select("_id", "_th", F.explode(pieces).alias("p")).select("_id", "_th", "p.*")


FLAGS = "key long, digest long, spans array<int>"


def _runs(flags: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of the true runs."""
    return np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))).tolist()


Judge = Callable[[dict[str, np.ndarray], list[bytes]], list[np.ndarray]]


def judge_cold(probes: DataFrame, judge: Judge, limit: int = 1 << 20) -> DataFrame:
    """Whole keys, in batches of about ``limit`` bytes, to the judge; it says for each content which windows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def settle(part: pa.RecordBatch) -> pa.RecordBatch:
            cols = {c: part.column(i).to_numpy() for i, c in enumerate(names[:-1])}
            flags = judge(cols, part.column(len(names) - 1).to_pylist())
            has = [i for i, f in enumerate(flags) if f.any()]
            return pa.RecordBatch.from_arrays([pa.array(cols["key"][has]), pa.array(cols["digest"][has]), pa.array([_runs(flags[i]) for i in has], type=pa.list_(pa.int32()))], names=["key", "digest", "spans"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [False]))) + 1
            bytes_to = pc.binary_length(batch.column(len(names) - 1)).to_numpy().astype(np.int64).cumsum()
            lo = 0
            if kept and kept[-1].column(0)[-1].as_py() != int(key[0]) and size >= limit:
                yield settle(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                kept, size = [], 0
            for e in ends:
                if size + bytes_to[e - 1] - (bytes_to[lo - 1] if lo else 0) >= limit:
                    kept.append(batch.slice(lo, e - lo))
                    yield settle(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                    kept, size, lo = [], 0, e
            kept.append(batch.slice(lo))
            size += int(bytes_to[-1] - (bytes_to[lo - 1] if lo else 0))
        if kept:
            yield settle(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    names = ["key", "digest", "_id", "_th", "copies", "start", "nwin", "anchor", "symbols"]
    return probes.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, FLAGS)


def judge_hot(probes: DataFrame, kind: Windows, first: bool) -> DataFrame:
    """The same verdict for keys with many contents: windows become rows and are counted with map-side aggregation."""
    size = 8 if kind.symbols == "words" else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(6).to_pylist()
            codes = [np.frombuffer(s, dtype=_U) if size == 8 else v.BYTE_CODE[np.frombuffer(s, dtype=np.uint8)] for s in symbols]
            if not codes:
                continue
            nwin = batch.column(5).to_numpy()
            prefix = v.prefix_sums(np.concatenate(codes))
            base = np.concatenate(([0], np.cumsum([len(c) for c in codes])))[:-1]
            i = np.repeat(np.arange(len(codes)), nwin)
            off = np.arange(len(i)) - np.repeat(np.cumsum(nwin) - nwin, nwin)
            at = base[i] + off
            h = v.span_hash(prefix, at, at + kind.window).view(np.int64)
            take = [pa.array(batch.column(c).to_numpy()[i]) for c in range(5)]
            yield pa.RecordBatch.from_arrays([take[0], take[1], take[2], take[3], pa.array((batch.column(4).to_numpy()[i] + off).astype(np.int64)), pa.array(batch.column(7).to_numpy()[i]), pa.array(off.astype(np.int32)), pa.array(h)], names=["key", "digest", "_id", "_th", "at", "copies", "off", "wh"])

    rows = probes.select("key", "digest", "_id", "_th", "start", "nwin", "symbols", "copies").mapInArrow(run, "key long, digest long, _id long, _th long, at long, copies long, off int, wh long")
    rows = rows.withColumn("place", F.struct("_id", "_th", "at"))
    seen = rows.groupBy("key", "wh").agg(F.sum("copies").alias("total"), F.min("place").alias("earliest")).filter("total >= 2")
    hit = rows.join(seen, ["key", "wh"])
    hit = hit.filter("place > earliest") if first else hit
    return hit.groupBy("key", "digest").agg(F.flatten(F.transform(F.sort_array(F.collect_set("off")), lambda o: F.array(o, o + 1))).alias("spans"))


def repeated_spans(docs: DataFrame, kind: Windows, judge: Judge, first: bool, hot: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """(_id, _th, spans): per document the symbol runs covered by repeated windows, unsorted.

    first=False takes every occurrence of a window that occurs twice or more;
    first=True spares the earliest one in (doc_id, text hash, position).
    """
    rows = stretches(docs, kind)
    known = cut(contents(docs, kind))
    copied = known.filter("copies >= 2").select("key", "digest", F.struct("_id", "_th", "place").alias("r"))
    whole = rows.join(copied, ["key", "digest"])
    if first:
        whole = whole.filter("struct(_id, _th, place) > r")
    whole = whole.select("_id", "_th", F.expr(START).alias("s"), (F.expr(START) + F.expr(NWIN) + (kind.window - 1)).alias("e"))
    asked = known.filter("kinds >= 2") if first else known.filter("kinds >= 2 and singles >= 1")
    probes = probe_symbols(docs, asked, kind)
    if known.filter(F.col("kinds") > hot).isEmpty():
        flags = judge_cold(probes, judge, batch_bytes)
    else:
        probes = cut(probes)
        flags = judge_cold(probes.filter(F.col("kinds") <= hot), judge, batch_bytes).unionByName(judge_hot(probes.filter(F.col("kinds") > hot), kind, first))
    part = flags.join(known.select("key", "digest", "copies", "_id", "_th", "place"), ["key", "digest"])
    if not first:
        part = part.filter("copies = 1")  # the others are whole
    pairs = F.transform(F.expr("sequence(0, size(spans) div 2 - 1)"), lambda i: F.struct((F.expr(START) + F.get("spans", i * 2)).cast("int").alias("s"), (F.expr(START) + F.get("spans", i * 2 + 1) + (kind.window - 1)).cast("int").alias("e")))
    part = part.select("_id", "_th", F.explode(pairs).alias("x")).select("_id", "_th", "x.s", "x.e")
    # Rows that repeat whole have the same spans: sets are combined in each task, so that they count once.
    each = whole.unionByName(part).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return each.mapInArrow(_united, each.schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row united to maximal runs, sorted; touching ones join."""
    for batch in batches:
        lists = batch.column(2)
        flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
        row = np.repeat(np.arange(len(size)), size) << 40
        s, e = row + flat.field(0).to_numpy(), row + flat.field(1).to_numpy()
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order])
        opens = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1]))) if len(s) else np.zeros(0, dtype=np.int64)
        closes = e[np.concatenate((opens[1:] - 1, [len(e) - 1]))] if len(s) else opens
        r = s[opens] >> 40
        low = (1 << 40) - 1
        runs = pa.StructArray.from_arrays([pa.array((s[opens] & low).astype(np.int32)), pa.array((closes & low).astype(np.int32))], names=["s", "e"])
        at = np.searchsorted(r, np.arange(len(size) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), runs)], names=["_id", "_th", "spans"])


def with_spans(base: DataFrame, spans: DataFrame) -> DataFrame:
    """base (with _id, _th) with its ``spans``; rows that have none are not shuffled."""
    spans = cut(spans)
    marked = mark_needed(base, spans)
    joined = marked.filter("_needed").drop("_needed").join(spans, ["_id", "_th"], "left")
    bare = marked.filter("not _needed").drop("_needed").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return joined.unionByName(bare)


def merge_spans(spans: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the spans, touching ones joined."""
    if not spans:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, [x["s"] for x in spans], 1)
    np.add.at(edge, [x["e"] for x in spans], -1)
    covered = np.concatenate(([False], np.cumsum(edge[:n]) > 0, [False])).astype(np.int8)
    d = np.diff(covered)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
