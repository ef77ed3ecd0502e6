"""Document fingerprints by MinHash (operator 5).

A text becomes its set of word shingles (five words; a shorter text is one
shingle).  Each of PERMUTATIONS universal hash functions h(x) = a x + b, a odd,
modulo 2**64, gives the least value over the set; 15 bits of its mixed value are
kept, over a set lowest bit, so that no value is 0.  The fingerprint is their
hexadecimal string, so equal texts have equal fingerprints; the likeness of two
fingerprints is the share of equal values, an estimate of the Jaccard similarity.

Near copies are found by joining signature bands in Spark; Jaccard is verified
on full sets (``near.py``).  ``near_id`` is the least doc_id of the documents
that links at 0.8 or more reach.

The edited text of a document needs the next document in order of doc_id and
text hash.  Texts are shuffled once, by ranges of that order in two passes, and
sorted; a task pairs each document with the one after it.  The last document of a range waits
for the first of the next range: a row or two for each task.  Rows that repeat
whole go as one row with their number, so neither a null nor a common id fills
one range.

Edge cases: a null text is empty; the fingerprint of a text without words is the
same for all such texts, like each other by 1 and unlike all others (0), and its
near_id is its own doc_id.  The last document takes the first as its next; a
single document is its own next.  Rows of one doc_id stand in order of their
text hash; a null doc_id sorts first.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from . import vector as v
from .common import NULL_ID, Scratch, cut, mark_needed, require, row_key

PERMUTATIONS = 128
SHINGLE = 5
BAND = 4

_U = np.uint64
_A = v.splitmix(PERMUTATIONS, 51) | _U(1)
_B = v.splitmix(PERMUTATIONS, 52)


def sign(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint16 [row, permutation]; zeros for a row without shingles (others have no zero)."""
    out = np.zeros((len(bounds) - 1, PERMUTATIONS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    at = bounds[:-1][full]
    with np.errstate(over="ignore"):
        for i in range(PERMUTATIONS):
            least = np.minimum.reduceat(shingles * _A[i] + _B[i], at)
            out[full, i] = (v.mix(least) >> _U(48)).astype(np.uint16) | np.uint16(1)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 [row, band]: the four values of a band are one 64-bit word."""
    with np.errstate(over="ignore"):
        return v.mix(np.ascontiguousarray(sig).view(_U) + v.splitmix(PERMUTATIONS // BAND, 53)).view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def signatures(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """uint16 [text, permutation]; zeros for a text without words."""
    out = np.zeros((len(texts), PERMUTATIONS), dtype=np.uint16)
    for lo, raw, offsets in v.blocks(pa.array(texts, type=pa.large_binary())):
        _, _, h, first = v.words(raw, offsets, v.LOWER_CODE)
        g, row, _ = v.grams(h, first, shingle)
        s, short = v.whole_rows(h, first, shingle)
        g, row = np.concatenate((g, s)), np.concatenate((row, short))
        if len(short):
            order = np.argsort(row, kind="stable")
            g, row = g[order], row[order]
        out[lo : lo + len(offsets) - 1] = sign(g, np.searchsorted(row, np.arange(len(offsets))))
    return out


def described(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, digests, signatures) of the shingle sets of texts."""
    sizes, digests = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), 2), dtype=_U)
    sigs = np.zeros((len(texts), PERMUTATIONS), dtype=np.uint16)
    for lo, raw, offsets in v.blocks(pa.array(texts, type=pa.large_binary())):
        g, bounds = v.shingle_sets(raw, offsets, SHINGLE)
        here = slice(lo, lo + len(offsets) - 1)
        sizes[here], digests[here], sigs[here] = np.diff(bounds), near.set_digests(g, bounds), sign(g, bounds)
    return sizes, digests, sigs


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Finished rows have no edge and stand for ``copies`` rows; the first (0) and the last (1) document of a range come with their text.
_ROW = "_id long, _th long, copies long, n long, node binary, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, edge int, text string"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[t]) for n, t in (c.split() for c in _ROW.split(", "))])
#: Documents whose Python strings are held at once, and rows that one row is repeated to in a step.
_ROWS, _REPEAT = 512, 10_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _pairs(keys: list[tuple], texts: list[str], nexts: list[str], sigs: np.ndarray, next_sigs: np.ndarray) -> list[tuple]:
    """Finished rows of documents (keys: _id, _th, copies, size and digest of the set) and those that follow them."""
    made = [edited(a, b).encode() for a, b in zip(texts, nexts, strict=True)]
    after = signatures(made)
    near_edited, near_next = likeness(sigs, after).tolist(), likeness(sigs, next_sigs).tolist()
    return [(*keys[i], len(texts[i]), hashlib.sha256(made[i]).digest(), sigs[i].tobytes(), after[i].tobytes(), near_edited[i], near_next[i], None, None) for i in range(len(texts))]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_id, _th, copies, text) of one range to rows of _ROW."""
    held: tuple | None = None  # key, text and signature of the document that waits for its next
    for batch in batches:
        texts = batch.column(3)
        size = pc.binary_length(texts.fill_null("")).to_numpy().cumsum()
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 16 * v.BLOCK_BYTES, side="right"))
            hi = max(lo + 1, min(hi, lo + _ROWS))
            keys = list(zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(3)), strict=True))
            strings = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
            sizes, digests, sigs = described([t.encode() for t in strings])
            keys = [(*k, n_set, d.tobytes()) for k, n_set, d in zip(keys, sizes.tolist(), digests, strict=True)]
            out = [] if held else [(*keys[0], *[None] * 6, 0, strings[0])]
            # All but the last of equal rows are followed by their own text.
            some = [i for i, k in enumerate(keys) if k[2] > 1]
            if some:
                own = [strings[i] for i in some]
                out += _pairs([(*keys[i][:2], keys[i][2] - 1, *keys[i][3:]) for i in some], own, own, sigs[some], sigs[some])
            if held:
                keys, strings, sigs = [held[0], *keys], [held[1], *strings], np.concatenate((held[2][None, :], sigs))
            if len(keys) > 1:
                out += _pairs([(*k[:2], 1, *k[3:]) for k in keys[:-1]], strings[:-1], strings[1:], sigs[:-1], sigs[1:])
            held = (keys[-1], strings[-1], sigs[-1])
            yield _batch(out)
            lo = hi
    if held:
        yield _batch([(*held[0], *[None] * 6, 1, held[1])])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _th, n, node, text, following) to finished rows."""
    for batch in batches:
        ids, ths, sizes, digests, texts, nexts = (batch.column(i).to_pylist() for i in range(6))
        sigs, after = (signatures([t.encode() for t in x]) for x in (texts, nexts))
        yield _batch(_pairs([(i, t, 1, n, d) for i, t, n, d in zip(ids, ths, sizes, digests, strict=True)], texts, nexts, sigs, after))


def _hexadecimal(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c, t in df.dtypes if t == "binary"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row for each of docs (doc_id, text)."""
    return _hexadecimal(_spread(_fingerprints(docs)).drop("_id", "_th", "n", "node"))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(_id, _th, copies, n, node, n_chars, ...): the table of ``fingerprints`` before rows that repeat are spread, with the
    size and the digest of each set of shingles; digests and fingerprints as bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    base = require(docs, "doc_id", "text").select(*row_key(), "text")
    equal = scratch.keep("equal", base.groupBy("_id", "_th").agg(F.count("*").alias("copies")).filter("copies > 1"))
    marked = mark_needed(base, equal)
    # Rows of equal texts and others that the filter lets pass; only these meet in a join.
    asked = marked.filter("_needed").join(equal, ["_id", "_th"], "left")
    once = asked.filter("copies is not null").groupBy("_id", "_th").agg(F.first("copies").alias("copies"), F.first("text").alias("text"))
    single = marked.filter("not _needed").unionByName(asked.filter("copies is null").drop("copies")).select("_id", "_th", F.lit(1).cast("long").alias("copies"), "text")
    every = single.unionByName(once)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Two passes, under the median id and over it, so that only half of the texts are on disk as shuffle files at a time.
    middle = base.approxQuantile("_id", [0.5], 0.05)
    parts = [F.col("_id") <= int(middle[0]), F.col("_id") > int(middle[0])] if middle else [F.lit(True)]

    def walked(i: int) -> DataFrame:
        ordered = every.filter(parts[i]).repartitionByRange(tasks, "_id", "_th").sortWithinPartitions("_id", "_th", "text")
        return scratch.keep(f"rows-{i}", ordered.mapInArrow(_walk, _ROW))

    rows = reduce(DataFrame.unionByName, [walked(i) for i in range(len(parts))])
    scratch.drop("equal")
    # Two rows for each range: the last document of one is followed by the first of the next.
    edges = rows.filter("edge is not null").select("_id", "_th", "n", "node", "edge", "text")
    later = Window.orderBy("_id", "_th", "edge").rowsBetween(1, Window.unboundedFollowing)
    all_rows = Window.orderBy("_id", "_th", "edge").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.when(F.col("edge") == 0, F.col("text"))
    waiting = edges.withColumn("following", F.coalesce(F.first(head, ignorenulls=True).over(later), F.first(head, ignorenulls=True).over(all_rows))).filter("edge = 1")
    closed = waiting.select("_id", "_th", "n", "node", "text", "following").mapInArrow(_close, _ROW)
    return rows.filter("edge is null").unionByName(closed).drop("edge", "text")


def _spread(done: DataFrame) -> DataFrame:
    """Each row of done as many times as its ``copies`` say, which go, and its doc_id; in two steps, so that no row holds a list of all."""
    many = done.filter("copies > 1").withColumn("_block", F.explode(F.expr(f"sequence(0, (copies - 1) div {_REPEAT})")))
    many = many.withColumn("_one", F.explode(F.expr(f"sequence(1, least({_REPEAT}, copies - _block * {_REPEAT}))"))).drop("_block", "_one")
    every = done.filter("copies = 1").unionByName(many)
    return every.select(F.nullif("_id", F.lit(NULL_ID)).alias("doc_id"), *[F.col(c) for c in done.columns if c not in ("_id", "_th", "copies")], "_id", "_th")


def sketch(shingle: int = SHINGLE, percent: int = 80) -> near.Sketch:
    """Five standard deviations of the estimate from 128 values are 0.18."""
    return near.Sketch(shingle, percent, sign, band_keys, likeness, 0.18, PERMUTATIONS)


def near_pairs(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): doc_ids of pairs that share a signature band and are verified on full sets; they connect all such pairs at the threshold.

    A pair stands for the least doc_ids of two different sets, a >= b; null is
    the least.  Documents with equal sets are not listed: ``near_groups`` has them.
    """
    links = near.near_links(docs, sketch(shingle, percent))
    return links.select(*(F.nullif(F.col(c), F.lit(NULL_ID)).alias(c) for c in ("a", "b")))


def near_groups(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(_id, _th, n_shingles, component): one row for each of docs; component is the least _id that links reach, null without words."""
    return near.near_components(docs, sketch(shingle, percent))


OUTPUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def query(spark, sf_dir: str) -> DataFrame:
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    done = _fingerprints(docs)
    scratch = Scratch(spark, "near")
    # The fingerprints serve as signatures of the sets, so texts are not signed a second time.
    groups = cut(near.components_of_sets(done.select("_id", "_th", "n", "node", F.col("fingerprint").alias("sig")), docs, sketch(), scratch))
    scratch.drop()
    out = _spread(done).join(groups, "node", "left")
    return _hexadecimal(out.select(*OUTPUT, F.nullif(F.coalesce("component", "_id"), F.lit(NULL_ID)).alias("near_id")))
