"""Toxicity by a misspelling-tolerant lexicon and context windows (operator 9).

1. Learning uses labelled rows with crc32(doc_id) mod 4 other than 2, at most
   TRAIN_ROWS of them, the ones with the least hash of doc_id.  Words, and stems
   as four to seven first letters, whose counts differ between toxic and clean
   rows beyond chance (likelihood ratio) become the lexicon.  A word counts once
   for each text and once for each pair of neighbours, whichever is less, a stem
   for each set of words with it that a text has: copies and near copies of one
   text are no further evidence.
2. Levenshtein automata of its terms, intersected with its trie, find terms and
   misspelled terms in all words of a text at once (:mod:`.levenshtein`).
3. A window of CONTEXT words around each hit decides whether it is quoted
   (quotation marks around it, or a verb of speech before it) or abuse.
4. A logistic model weighs the counts.  Its only inputs come from the text.

Edge cases: null and empty texts get the score of a text without hits; with no
usable labels the lexicon is empty and every score is the share of toxic rows;
duplicate labels of a document count once (toxic if any says so); labels of
unknown documents count for nothing; repeated rows each get a row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as v
from .common import Scratch, columns, fresh, require
from .levenshtein import EXACT, MISSPELLED, NONE, STEM, LexiconAutomaton

#: Bound of the training sample, in rows, and of the lexicon, in entries.
TRAIN_ROWS = 20_000
MAX_TERMS = 120
MAX_STEMS = 120
#: Least likelihood-ratio statistic of a lexicon entry, and its least share of toxic rows.
LEAST_G = 24.0
LEAST_SHARE = 0.7
#: The same for stems, of which a text needs two words.
STEM_G, STEM_SHARE, STEM_TEXTS = 15.0, 0.8, 3
THRESHOLD = 0.3
CONTEXT = 6

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: Letters, digits and the bytes of non-ASCII letters make words here; the rest parts them.
GAP = np.ones(256, dtype=bool)
GAP[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SPEECH = re.compile(rb"\b(?:said|says|say|wrote|writes|called|calls|quoted|quote|quoting|term|word|words|meaning|means)\b[\s,:]*(?:\S+\s+){0,2}\S*$", re.I)
_MARKS = re.compile("[\"“”„«»‘’]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    automaton: LexiconAutomaton
    exceptions: np.ndarray  # hashes of ordinary words that a misspelled term may look like
    weights: np.ndarray
    terms: list[str]
    stems: list[str]


#: again: hits of stems after the first one.
FEATURES = ("terms", "misspelled", "stems", "quoted", "again")


def _quoted(text: bytes, start: int, end: int, before: int, after: int) -> bool:
    left, right = text[before:start].decode("utf-8", "replace"), text[end:after].decode("utf-8", "replace")
    if _MARKS.search(left) and _MARKS.search(right):
        return True
    return bool(_SPEECH.search(text[before:start]))


def features(raw: np.ndarray, offsets: np.ndarray, automaton: LexiconAutomaton, exceptions: np.ndarray) -> np.ndarray:
    """log(1 + count) of each feature for each row of a block."""
    n = len(offsets) - 1
    start, end, h, first = v.words(raw, offsets, v.LOWER_CODE, GAP)
    out = np.zeros((n, len(FEATURES)))
    verdict = automaton.match(raw, start, end, FOLD)
    hits = np.flatnonzero(verdict != NONE)
    if len(exceptions) and len(hits):
        hits = hits[~((verdict[hits] == MISSPELLED) & np.isin(h[hits], exceptions))]
    if not len(hits):
        return out
    row = np.searchsorted(first, hits, side="right") - 1
    text = raw.tobytes()
    for i, r in zip(hits.tolist(), row.tolist(), strict=True):
        a, b = max(int(first[r]), i - CONTEXT), min(int(first[r + 1]), i + CONTEXT + 1)
        # The window includes the marks right before its first and after its last word.
        before = int(end[a - 1]) if a > first[r] else int(offsets[r])
        after = int(start[b]) if b < first[r + 1] else int(offsets[r + 1])
        kind = 3 if _quoted(text, int(start[i]), int(end[i]), before, after) else (EXACT, MISSPELLED, STEM).index(verdict[i])
        out[r, kind] += 1
    out[:, 4] = np.maximum(out[:, 2] - 1, 0)
    return np.log1p(out)


def _g(tox: float, clean: float, n1: float, n0: float) -> float:
    """Likelihood-ratio statistic of a word in tox of n1 toxic and clean of n0 clean rows."""
    total, every = tox + clean, n1 + n0
    out = 0.0
    for k, n in ((tox, n1), (clean, n0)):
        e = total * n / every
        out += k * math.log(k / e) if k else 0.0
        out += (n - k) * math.log((n - k) * every / (n * (every - total))) if n > k and every > total else 0.0
    return 2 * out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic model; row i stands for n[i] equal ones."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (n * (y - p)) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    # A hit never speaks for a text.
    w[1:] = np.maximum(w[1:], 0)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    picked = require(labels, "doc_id", "toxic").filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    picked = picked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # TRAIN_ROWS short rows at most: a proven bound.
    sample = F.broadcast(picked.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_ROWS))
    rows = require(docs, "doc_id", "text").join(sample, "doc_id").select("text", "toxic")
    # Equal texts are one row; it is toxic if any of them is.
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("doc", F.xxhash64("text"))
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n1, n0 = float(totals[0]), float(totals[1] - totals[0])
    empty = Model(LexiconAutomaton([], []), np.zeros(0, dtype=np.uint64), np.array([math.log((n1 + 0.5) / (n0 + 0.5)), *[0.0] * len(FEATURES)]) if n1 + n0 else np.array([-5.0, *[0.0] * len(FEATURES)]), [], [])
    if not n1 or not n0:
        return empty
    listed = rows.select("toxic", "doc", F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), WORD_GAP), lambda w: w != "").alias("ws"))
    tokens = Scratch(docs.sparkSession, "toxicity").keep("tokens", listed.select("toxic", "doc", F.explode(F.array_distinct("ws")).alias("w")))
    counts = tokens.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.cache()
    try:
        least = max(4.0, LEAST_G / (2 * math.log((n1 + n0) / n1)) - 1)
        telling = (F.col("t") >= least) & (F.col("t") / (F.col("t") + F.col("c")) >= LEAST_SHARE)
        likely = counts.filter(telling).orderBy(F.desc("t"), "w").limit(50 * MAX_TERMS)
        # The pairs of neighbours that such words have, in texts of each kind.
        zipped = F.arrays_zip(F.col("ws").alias("w"), F.concat(F.array(F.lit("")), "ws").alias("l"), F.concat(F.expr("slice(ws, 2, size(ws))"), F.array(F.lit(""))).alias("r"))
        pairs = listed.filter("size(ws) > 0").select("toxic", F.explode(zipped).alias("x")).filter("x.w is not null").select("toxic", "x.w", F.xxhash64("x.l", "x.r").alias("at"))
        pairs = pairs.join(F.broadcast(likely.select("w")), "w").distinct().groupBy("w").agg(F.sum("toxic").alias("t_at"), F.sum(1 - F.col("toxic")).alias("c_at"))
        words = likely.join(pairs, "w").select("w", F.least("t", "t_at").alias("t"), F.least("c", "c_at").alias("c")).filter(telling).collect()
        # A stem counts once for each set of two or more words with it in one text.
        begins = F.explode(F.expr("transform(sequence(4, least(7, char_length(w))), n -> substring(w, 1, n))")).alias("s")
        long = counts.filter("char_length(w) >= 4").select(begins, "t", "c").groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("k"))
        stemmed = long.filter((F.col("k") >= 4) & (F.col("t") >= 2 * STEM_TEXTS) & (F.col("t") >= F.col("c"))).orderBy(F.desc("t"), "s").limit(50 * MAX_STEMS).select("s")
        held = tokens.filter("char_length(w) >= 4").select("doc", "toxic", "w", begins).join(F.broadcast(stemmed), "s")
        held = held.groupBy("s", "doc", "toxic").agg(F.sort_array(F.collect_set("w")).alias("ws")).filter("size(ws) >= 2").select("s", "toxic", F.xxhash64("ws").alias("h")).distinct()
        stems = held.groupBy("s").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter((F.col("t") >= STEM_TEXTS) & (F.col("t") / (F.col("t") + F.col("c")) >= STEM_SHARE)).collect()
        chosen_stems: list[str] = []
        ranked = sorted(((_g(min(r["t"], n1), min(r["c"], n0), n1, n0), r["s"]) for r in stems), key=lambda x: (-x[0], len(x[1]), x[1]))
        for g, stem in ranked:
            if g >= STEM_G and len(chosen_stems) < MAX_STEMS and not any(stem.startswith(x) or x.startswith(stem) for x in chosen_stems):
                chosen_stems.append(stem)
        good = [(r["w"], _g(r["t"], r["c"], n1, n0)) for r in words]
        good = [w for w, g in sorted(good, key=lambda x: (-x[1], x[0])) if g >= LEAST_G and not any(w.startswith(x) for x in chosen_stems)][:MAX_TERMS]
        if not good and not chosen_stems:
            return empty
        automaton = LexiconAutomaton([w.encode() for w in good], [s.encode() for s in chosen_stems])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, raw, offsets in v.blocks(batch.column(0)):
                    verdict = automaton.match(raw, offsets[:-1], offsets[1:], FOLD)
                    yield batch.slice(lo, len(verdict)).filter(pa.array(verdict == MISSPELLED)).select([0])

        # Ordinary words that look like a term: seen mostly in clean rows; at most those near a bounded lexicon.
        plain = counts.filter("c >= 2 and c > t").select("w").mapInArrow(near, "w string").collect()
        exceptions = [r["w"].encode() for r in plain]
        data, at = np.frombuffer(b"".join(exceptions), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(e) for e in exceptions]))).astype(np.int64)
        ex = np.sort(v.span_hash(v.prefix_sums(v.LOWER_CODE[data]), at[:-1], at[1:])) if exceptions else np.zeros(0, dtype=np.uint64)
    finally:
        counts.unpersist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, raw, offsets in v.blocks(batch.column(0)):
                f = features(raw, offsets, automaton, ex)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, i]) for i in range(f.shape[1])] + [batch.column(1).slice(lo, len(f))], names=[*FEATURES, "toxic"])

    # Four numbers for each of TRAIN_ROWS rows at most, summed by equal values.
    table = rows.select("text", "toxic").mapInArrow(measure, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").groupBy(*FEATURES, "toxic").count().orderBy(*FEATURES, "toxic").collect()
    x = np.array([[r[f] for f in FEATURES] for r in table])
    y, n = (np.array([r[c] for r in table], dtype=float) for c in ("toxic", "count"))
    return Model(automaton, ex, _logistic(x, y, n), good, chosen_stems)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (all columns) with ``_score`` (a name that docs has gets another underscore), from the text alone."""
    automaton, ex, weights = model.automaton, model.exceptions, model.weights
    at, schema = docs.columns.index("text"), docs.withColumn(fresh(docs, "_score"), F.lit(0.0)).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, raw, offsets in v.blocks(batch.column(at)):
                z = features(raw, offsets, automaton, ex) @ weights[1:] + weights[0]
                parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts))], names=names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the model is the one of the query, fitted on these documents."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).filter(F.col(fresh(docs, "_score")) < THRESHOLD).select(*columns(docs.columns))
