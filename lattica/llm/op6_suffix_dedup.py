"""Suffix-array dedup by a run-length index (operator 6).

Bytes covered by any ``length``-byte string that also starts anywhere else in
the corpus are removed, every occurrence.  Work is dealt by content-chosen
anchors (see :mod:`.repeats`).  What cannot be settled by counting whole
stretches goes to a run-compressed index, built for a bounded batch of anchors:

1. suffixes are sorted by prefix doubling and give the Burrows-Wheeler text;
2. only its run ends are sampled: at a boundary of two runs the two suffixes
   and their common prefix are kept (r of them, few in repetitive text);
3. matching statistics are streamed in text order from the samples: the longest
   match elsewhere of position i is the best of sample length minus distance,
   since inside a run a match shrinks by one for each step to the right.

Edge cases: null and empty texts, and texts shorter than ``length``, lose
nothing; an empty table gives an empty result; rows that repeat whole are all
removed, as any other repeat (also under one id); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from . import vector as v
from .common import columns, require, row_key

#: Contract: strings of 200 bytes.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 32
#: Contents under one anchor that one index takes; more go to window counts.
HOT = 4096
#: Bytes of text in one index.
INDEX_BYTES = 1 << 17


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)  # ties need no order: they get one rank
    sorted_key = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
    return order, rank


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler index of several strings, sampled at run ends."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
        n = int(self.bounds[-1])
        codes = np.zeros(n, dtype=np.int64)  # 0 ends a string, bytes are 1..256
        body = np.ones(n, dtype=bool)
        body[self.bounds[1:] - 1] = False
        codes[body] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
        self.ends = np.repeat(self.bounds[1:] - 1, sizes + 1)
        longest = int(sizes.max()) + 1 if len(sizes) else 1
        # Suffix order by prefix doubling from seven symbols of nine bits.
        step, packed = 7, np.zeros(n, dtype=np.int64)
        padded = np.concatenate((codes, np.zeros(7, dtype=np.int64)))
        for j in range(7):
            packed = packed << 9 | padded[j : j + n]
        order, rank = _ranks(packed)
        levels = [(step, rank)]
        while step < longest and rank[order[-1]] < n - 1:
            behind = np.zeros(n, dtype=np.int64)
            if step < n:
                behind[: n - step] = rank[step:] + 1
            order, rank = _ranks(rank * (n + 1) + behind)
            step *= 2
            levels.append((step, rank))
        # Burrows-Wheeler text; the start of a string ends every run.
        before = np.where(np.isin(order, self.bounds[:-1]), 0, codes[order - 1])
        cut = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0))
        self.runs = len(cut) + 1
        a, b = order[cut], order[cut + 1]
        common = np.zeros(len(a), dtype=np.int64)
        x, y = a.copy(), b.copy()
        for step, rank in reversed(levels):
            same = (x < n) & (y < n)
            same[same] = rank[x[same]] == rank[y[same]]
            for z in (x, y, common):
                z[same] += step
        for _ in range(6):
            same = (x < n) & (y < n)
            same[same] = (codes[x[same]] == codes[y[same]]) & (codes[x[same]] > 0)
            for z in (x, y, common):
                z[same] += 1
        self.place = np.concatenate((a, b))
        self.length = np.minimum(np.concatenate((common, common)), self.ends[self.place] - self.place)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts elsewhere."""
        n = int(self.bounds[-1])
        reach = np.zeros(n, dtype=np.int64)
        np.maximum.at(reach, self.place, self.place + self.length)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def _with_partner(key: np.ndarray, anchor: np.ndarray, strings: list[bytes], side: int, gram: int) -> np.ndarray:
    """Strings that agree with another one under their key in the ``side`` bytes before or after the anchor.

    A window has ``2 * side`` bytes or more besides its anchor, so it holds all
    of one side: strings without such a partner share no window.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    prefix = v.prefix_sums(v.BYTE_CODE[np.frombuffer(b"".join(strings), dtype=np.uint8)])
    out = np.zeros(len(strings), dtype=bool)
    for start, fits in ((anchor - side, anchor >= side), (anchor + gram, anchor + gram + side <= sizes)):
        at = base[fits] + start[fits]
        h = v.mix(v.span_hash(prefix, at, at + side) ^ v.mix(key[fits].view(np.uint64)))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        out[np.flatnonzero(fits)[count[inverse] > 1]] = True
    return out


def _judge(length: int, gram: int) -> repeats.Judge:
    def judge(cols: dict[str, np.ndarray], strings: list[bytes]) -> list[np.ndarray]:
        out = [np.zeros(n, dtype=bool) for n in cols["nwin"]]
        some = np.flatnonzero(_with_partner(cols["key"], cols["anchor"].astype(np.int64), strings, (length - gram) // 2, gram))
        if len(some):
            index = RunLengthIndex([strings[i] for i in some])
            long = index.matching_statistics() >= length
            for b, i in zip(index.bounds[:-1], some, strict=True):
                out[i] = long[b : b + len(out[i])]
        return out

    return judge


def repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT, anchor: int = ANCHOR) -> DataFrame:
    """(_id, _th, spans) of the rows of docs that have repeated strings."""
    return repeats.repeated_spans(docs, repeats.Windows("bytes", length, anchor), _judge(length, anchor), first=False, hot=hot, batch_bytes=INDEX_BYTES)


def _whole_characters(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the runs [s, e) that are whole UTF-8 characters; a character that is cut stays."""
    inner = (np.frombuffer(text + b"\0", dtype=np.uint8) & 0xC0) == 0x80
    place = np.arange(len(inner))
    after = np.minimum.accumulate(np.where(inner, len(text), place)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(inner, 0, place))
    s, e = after[s], before[e]
    return s[s < e], e[s < e]


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, anchor: int = ANCHOR, characters: bool = False) -> DataFrame:
    """(row, _kept, _n_bytes, _n_removed, _n_spans): each row of docs as a struct, its remaining bytes, and counts.

    With ``characters`` only whole characters are removed, so that what remains is text.
    """
    base = docs.select(F.struct(*columns(docs.columns)).alias("row"), *row_key())
    joined = repeats.with_spans(base, repeated_bytes(docs, length, hot, anchor)).select("row", F.col("row.text").cast("binary").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, lost, runs = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                s, e = repeats.merge_spans(spans, len(text))
                if characters and len(s):
                    s, e = _whole_characters(text, s, e)
                total.append(len(text))
                lost.append(int((e - s).sum()))
                runs.append(len(s))
                if len(s):
                    view, edges = memoryview(text), [0, *np.stack((s, e), 1).ravel().tolist(), len(text)]
                    text = b"".join(view[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                kept.append(text)
            extra = [pa.array(kept, type=pa.binary()), *(pa.array(x, type=pa.int64()) for x in (total, lost, runs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *extra], names=names)

    out = joined.select("row", F.lit(b"").alias("_kept"), *(F.lit(0).cast("long").alias(c) for c in ("_n_bytes", "_n_removed", "_n_spans")))
    names = out.columns
    return joined.mapInArrow(run, out.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated strings; rows all stay, n_chars follows the text.

    Characters that a repeated string covers in part stay.
    """
    out = remove_repeats(docs, characters=True)
    changed = F.col("_n_removed") > 0
    out = out.select("row", changed.alias("changed"), F.when(changed, F.col("_kept").cast("string")).otherwise(F.col("row.text")).alias("text"))
    picked = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in picked:
        picked["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[c.alias(n) for n, c in picked.items()])
