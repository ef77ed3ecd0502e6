"""Substring dedup by seed and extend (operator 7).

Documents meet on winnowed anchors (:mod:`.repeats`): of every ``window``
consecutive words, the leftmost run of ``ANCHOR`` words with the least hash.
From each shared anchor the matches are extended word by word to the left and
to the right; occurrences whose left context agrees for r words and whose right
context agrees for the rest of the window share that window.  The extension is
done for all occurrences of an anchor at once, by prefix hashes of both
contexts, so its cost is linear in the occurrences.  Overlapping windows unite
to maximal repeats; the earliest occurrence (smaller doc_id, then earlier
start) stays, later ones go.

Edge cases: null, empty and short texts lose nothing; an empty table gives an
empty result; a null doc_id sorts first; rows with equal id and text are one
document and get the same result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from . import vector as v
from .common import require, row_key

#: Contract: windows of 20 words.
WINDOW = 20
#: Words of an anchor: long enough that few anchors meet by chance.
ANCHOR = 8
#: Occurrence kinds of one anchor that one task extends; more go to window counts.
HOT = 8192

_U = np.uint64


def _judge(window: int, anchor: int) -> repeats.Judge:
    reach = window - anchor  # words that an extension can need on either side

    def judge(cols: dict[str, np.ndarray], symbols: list[bytes]) -> list[np.ndarray]:
        m, nwin = len(symbols), cols["nwin"]
        lengths = np.array([len(s) // 8 for s in symbols])
        codes = np.frombuffer(b"".join(symbols), dtype=_U)
        base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        seed = base + cols["anchor"]
        left, right = np.zeros((m, reach + 1), dtype=_U), np.zeros((m, reach + 1), dtype=_U)
        with np.errstate(over="ignore"):
            for j in range(1, reach + 1):  # one more word on each side
                at = seed - j
                left[:, j] = left[:, j - 1] * _U(v._BASE) + np.where(at >= base, codes[np.maximum(at, 0)], _U(1))
                at = seed + anchor + j - 1
                right[:, j] = right[:, j - 1] * _U(v._BASE) + np.where(at < base + lengths, codes[np.minimum(at, len(codes) - 1)], _U(2))
        order = np.lexsort((cols["start"] + cols["anchor"], cols["_th"], cols["_id"]))
        place = np.empty(m, dtype=np.int64)
        place[order] = np.arange(m)
        i = np.repeat(np.arange(m), nwin)
        off = np.arange(len(i)) - np.repeat(np.cumsum(nwin) - nwin, nwin)
        r = cols["anchor"][i] - off  # words of the window before the anchor
        kind = v.mix(v.mix(cols["key"][i].view(_U) + r.astype(_U)) ^ v.mix(left[i, r]) * _U(3) ^ right[i, reach - r])
        by = np.lexsort((place[i], kind))
        later = np.zeros(len(i), dtype=bool)
        later[by[1:]] = kind[by[1:]] == kind[by[:-1]]
        edges = np.concatenate(([0], np.cumsum(nwin)))
        return [later[edges[j] : edges[j + 1]] for j in range(m)]

    return judge


def repeated_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(_id, _th, spans): word spans of maximal repeats that have an earlier occurrence."""
    return repeats.repeated_spans(docs, repeats.Windows("words", window, anchor), _judge(window, anchor), first=True, hot=hot)


RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, texts: bool = False) -> DataFrame:
    """One row per row of docs: counts, digest of the kept words, and with ``texts`` the kept words themselves."""
    base = require(docs, "doc_id", "text")
    joined = repeats.with_spans(base.select("doc_id", "text", *row_key()), repeated_words(docs, window, anchor, hot)).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_spans = batch.column(0), batch.column(2).to_pylist()
            for lo, raw, offsets in v.blocks(batch.column(1)):
                start, end, _, first = v.words(raw, offsets)
                data, n = raw.tobytes(), len(offsets) - 1
                # All words joined by one space: copy bytes through one index.
                counts, lost, runs, digests, kept_texts = np.diff(first), [], [], [], []
                for i in range(n):
                    a, b = int(first[i]), int(first[i + 1])
                    s, e = repeats.merge_spans(all_spans[lo + i], b - a)
                    lost.append(int((e - s).sum()))
                    runs.append(len(s))
                    pieces = []
                    edges = [0, *np.stack((s, e), 1).ravel().tolist(), b - a]
                    for x, y in zip(edges[::2], edges[1::2], strict=True):
                        if x < y:
                            pieces.extend(data[int(start[a + x]) : int(end[a + y - 1])].split())
                    kept = b" ".join(pieces)
                    digests.append(repeats.sha256(kept))
                    if texts:
                        kept_texts.append(kept.decode("utf-8"))
                cols = [ids.slice(lo, n).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(lost, type=pa.int64()), pa.array(runs, type=pa.int64()), pa.array(digests, type=pa.string())]
                names = ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols, names = [*cols, pa.array(kept_texts, type=pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, RESULT + (", kept string" if texts else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
