"""Ranked lexical search by inverted treaps (operator 11).

1. Items are the queries.  One pass over all documents counts words and the
   terms that items hold: a row (doc_id, words, terms, counts) for each
   document, written once.  Corpus counts (documents, words, document
   frequencies) are aggregated from these rows.
2. Each task packs its rows into blocks and builds for every term of a block a
   treap: search order is doc_id, heap order is impact (the term's whole part of
   a document's score), ties in heap order fall to a hash, so that equal impacts
   make no chain.  In-order place and array index are the same.
3. All terms of an item are traversed together.  A state is an interval of
   documents with each term's subtree in it; the sum of the subtrees' maxima
   bounds every score inside, and a state that cannot enter the item's top k
   goes.  The most promising states are split at the document of their largest
   impact, which is scored; intervals of at most LEAF documents are scored
   whole.  Many states of many items are handled at once, as arrays.
4. A task carries its top k from block to block, so later blocks start with a
   threshold; ranks over what tasks found give the result.

No posting is shuffled: documents stay in the task that reads them, so a term
that every document holds is many small treaps.  What grows with the items
(terms, weights, item lists) is sent to tasks in groups of items of at most
ITEM_BYTES; more items mean more passes.  All numbers but the logarithm of a
weight are 64-bit integers.

Edge cases: null, empty and term-free texts have no terms, are not counted and
never listed; an item without terms, or whose terms no document holds, has no
rows; a null doc_id sorts first and is returned as null; documents that repeat
are ranked each, equal scores by ascending doc_id; items that repeat an item_id
are ranked each on its own; an empty table gives an empty result; a single item
longer than ITEM_BYTES is a group of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, require

TOP = 20
#: Documents and postings in a block of treaps.
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 20
#: Width of an interval that is scored whole, and states of an item that are handled at once.
LEAF = 32
STATES = 64
#: Bytes of item texts in one pass, and terms of items that a task traverses together.
ITEM_BYTES = 8 << 20
ITEM_TERMS = 1 << 14

#: The term pattern on UTF-8 bytes: digits, letters and all bytes of characters beyond ASCII.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item int, doc_id long, score long"
_I = np.int64


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, lower-cased in A-Z, as UTF-8."""
    return _TERM.findall(text.encode().lower()) if text else []


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with terms: its number of terms, and those of the vocabulary with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            ids, sizes, at, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (found := terms_of(text.as_py())):
                    continue
                held = Counter(found)
                for term in held.keys() & numbers.keys():
                    terms.append(numbers[term])
                    counts.append(held[term])
                ids.append(doc_id)
                sizes.append(len(found))
                at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "text").mapInArrow(run, _POSTINGS)


class Treaps:
    """The treaps of one block: postings by term and document, each with its impact, its children and the root of its term."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        """ids: doc_ids, ascending; docs, terms, impacts: postings, docs as places in ids."""
        self.ids, self.width = ids, len(ids)
        key = terms.astype(_I) * self.width + docs
        by = np.argsort(key)
        self.key, self.doc, self.impact = key[by], docs[by].astype(_I), impacts[by]
        self.start = np.searchsorted(self.key, np.arange(n_terms + 1, dtype=_I) * self.width)
        noise = (self.key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(_I)
        self.left, self.right, self.root = self._link(((self.impact << 18) | noise).tolist(), self.start.tolist())

    @staticmethod
    def _link(rank: list[int], start: list[int]) -> tuple[np.ndarray, ...]:
        left, right, roots = [-1] * len(rank), [-1] * len(rank), [-1] * (len(start) - 1)
        for term, (a, b) in enumerate(zip(start, start[1:])):
            spine: list[int] = []
            for i in range(a, b):
                last, r = -1, rank[i]
                while spine and rank[spine[-1]] < r:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            if spine:
                roots[term] = spine[0]
        return tuple(np.array(x, dtype=_I) for x in (left, right, roots))

    def inside(self, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Roots of the postings [a, b), none empty, that the subtrees at ``node`` have: the way down from node ends at the first inside."""
        node = node.copy()
        at = np.arange(len(node))
        while len(at := at[(node[at] < a[at]) | (node[at] >= b[at])]):
            node[at] = np.where(node[at] < a[at], self.right[node[at]], self.left[node[at]])
        return node


class Best:
    """The top k of each item so far: scores and doc_ids, kept across blocks."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.item, self.score, self.id = (np.empty(0, dtype=_I) for _ in range(3))
        self.least, self.last = np.zeros(items, dtype=_I), np.full(items, np.iinfo(_I).min)

    def open(self, item: np.ndarray, score: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a score of an id from first_id on could enter the item's list."""
        return (score > self.least[item]) | ((score == self.least[item]) & (first_id < self.last[item]))

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ok = self.open(item, score, ids)
        if not ok.any():
            return
        item, score, ids = (np.concatenate((a, b[ok])) for a, b in ((self.item, item), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, -score, item))
        item, score, ids = item[by], score[by], ids[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.id = item[keep], score[keep], ids[keep]
        full = np.flatnonzero(place == self.top - 1)
        self.least[item[full]], self.last[item[full]] = score[full], ids[full]


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all [a, b), and which of them each is from."""
    n = b - a
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum(), dtype=_I) - np.repeat(np.cumsum(n) - n, n) + a[which], which


def traverse(block: Treaps, items: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best, leaf: int = LEAF, states: int = STATES) -> int:
    """Update ``best`` from one block.  items, terms, times: a row for each item and distinct term, items ascending.  Returns the postings scored."""
    ok = block.root[terms] >= 0
    items, term, times = items[ok], terms[ok], times[ok]
    q, of = np.unique(items, return_inverse=True)  # item of each state, state of each entry
    lo, hi = np.zeros(len(q), dtype=_I), np.full(len(q), block.width, dtype=_I)
    a, b, node = block.start[term], block.start[term + 1], block.root[term]
    scored = 0
    while len(q):
        value = times * block.impact[node]
        first = np.searchsorted(of, np.arange(len(q)))
        bound = np.add.reduceat(value, first)
        keep = best.open(q, bound, block.ids[lo])
        # The states of each item with the largest bounds are handled now.
        by = np.lexsort((-bound, q, ~keep))
        rank = np.empty(len(q), dtype=_I)
        rank[by] = np.arange(len(q)) - np.searchsorted(np.where(keep, q, best.items)[by], np.where(keep, q, best.items)[by])
        now = keep & (rank < states)
        small = now & (hi - lo <= leaf)
        cut = now & ~small
        pieces = []

        if small.any():
            e = np.flatnonzero(small[of])
            at = np.cumsum(small) - 1
            i, which = _ranges(a[e], b[e])
            scored += len(i)
            sums = np.zeros((int(small.sum()), leaf), dtype=_I)
            state = of[e][which]
            np.add.at(sums, (at[state], block.doc[i] - lo[state]), times[e][which] * block.impact[i])
            s, d = np.nonzero(sums)
            of_item, from_doc = q[small], lo[small]
            best.add(of_item[s], sums[s, d], block.ids[from_doc[s] + d])

        if cut.any():
            e = np.flatnonzero(cut[of])
            number = (np.cumsum(cut) - 1)[of[e]]
            head = np.searchsorted(number, np.arange(int(cut.sum())))
            top = np.flatnonzero(value[e] == np.maximum.reduceat(value[e], head)[number])
            top = top[np.searchsorted(number[top], np.arange(len(head)))]
            pivot = block.doc[node[e][top]]
            goal = term[e] * block.width + pivot[number]
            s = np.searchsorted(block.key, goal)
            hit = (s < b[e]) & (block.key[np.minimum(s, len(block.key) - 1)] == goal)
            scored += int(hit.sum())
            best.add(q[cut], np.add.reduceat(np.where(hit, times[e] * block.impact[np.minimum(s, len(block.key) - 1)], 0), head), block.ids[pivot])
            for side, start, stop in ((0, a[e], s), (1, s + hit, b[e])):
                some = start < stop
                x, start, stop = e[some], start[some], stop[some]
                pieces.append((2 * number[some] + side, term[x], times[x], start, stop, block.inside(node[x], start, stop)))

        wait = np.flatnonzero((keep & ~now)[of])
        n_cut = int(cut.sum())
        pieces.append((2 * n_cut + of[wait], term[wait], times[wait], a[wait], b[wait], node[wait]))
        of, term, times, a, b, node = (np.concatenate(x) for x in zip(*pieces, strict=True))
        by = np.argsort(of, kind="stable")
        of, term, times, a, b, node = (x[by] for x in (of, term, times, a, b, node))
        halves_q = np.repeat(q[cut], 2)
        halves_lo, halves_hi = np.repeat(lo[cut], 2), np.repeat(hi[cut], 2)
        if n_cut:
            halves_hi[::2], halves_lo[1::2] = pivot, pivot + 1
        there, of = np.unique(of, return_inverse=True)
        q, lo, hi = (np.concatenate(x)[there] for x in ((halves_q, q), (halves_lo, lo), (halves_hi, hi)))
    return scored


def _search(postings: DataFrame, weights: np.ndarray, rows: tuple[np.ndarray, ...], n_items: int, n_docs: int, n_words: int, top: int, block_docs: int, leaf: int) -> DataFrame:
    """(item, doc_id, score): the top of each item in each task."""

    def pack(held: list[pa.RecordBatch], weight: np.ndarray) -> Treaps | None:
        table = pa.Table.from_batches(held)
        ids, n = (table.column(i).to_numpy() for i in (0, 1))
        by = np.argsort(ids, kind="stable")
        place = np.empty(len(by), dtype=_I)
        place[by] = np.arange(len(by))
        lists, counts = (table.column(i).combine_chunks() for i in (2, 3))
        docs = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        term, tf = lists.flatten().to_numpy().astype(_I), counts.flatten().to_numpy().astype(_I)
        used = weight[term] > 0
        docs, term, tf = docs[used], term[used], tf[used]
        length = 100 - 25 + (25 * n * n_docs) // n_words
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[docs]))
        used = impact > 0
        return Treaps(ids[by], place[docs[used]], term[used], impact[used], len(weight)) if used.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, item, term, times = sent.value
        best = Best(n_items, top)
        # Items in runs of at most ITEM_TERMS terms, or one.
        edges, start = [0], 0
        for i in np.flatnonzero(np.diff(item, append=n_items)) + 1:
            if i - start > ITEM_TERMS and edges[-1] > start:
                start = edges[-1]
                edges.append(int(i))
            else:
                edges[-1] = int(i)
        runs = list(zip([0, *edges], edges))

        def close(held: list[pa.RecordBatch]) -> None:
            if block := pack(held, weight):
                for lo, hi in runs:
                    traverse(block, item[lo:hi], term[lo:hi], times[lo:hi], best, leaf)

        held, docs, postings_held = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                held.append(piece)
                docs, postings_held = docs + piece.num_rows, postings_held + len(piece.column(2).flatten())
                if docs >= block_docs or postings_held >= BLOCK_POSTINGS:
                    close(held)
                    held, docs, postings_held = [], 0, 0
        if held:
            close(held)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["item", "doc_id", "score"])

    sent = postings.sparkSession.sparkContext.broadcast((weights, *rows))
    return postings.mapInArrow(run, _FOUND)


def _groups(items: DataFrame, item_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """All items with text, as lists (item_id, text) of about ``item_bytes`` at most or of one item."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // item_bytes) * 2 if total > item_bytes else 1
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows, size = [], 0
        for row in part.toLocalIterator():
            if rows and size + len(row[1]) > item_bytes:
                yield rows
                rows, size = [], 0
            rows.append((row[0], row[1]))
            size += len(row[1])
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, block_docs: int = BLOCK_DOCS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    docs = require(docs, "doc_id", "text").filter("text is not null")
    items = require(items, "item_id", "text").filter("text is not null")
    kind = items.schema["item_id"].dataType
    out = []
    for group in _groups(items, item_bytes):
        wanted = [Counter(terms_of(text)) for _, text in group]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        if not vocabulary:
            continue
        postings = Scratch(spark, "search").keep("postings", count_terms(docs, vocabulary))
        n_docs, n_words = postings.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        # As many numbers as the group has terms.
        weights = np.zeros(len(vocabulary), dtype=_I)
        for term, df in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        rows = [(i, vocabulary[t], n) for i, held in enumerate(wanted) for t, n in held.items()]
        rows = tuple(np.array(x, dtype=_I) for x in zip(*rows, strict=True))
        found = _search(postings, weights, rows, len(group), n_docs, n_words, top, block_docs, leaf)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(group)], f"item int, item_id {kind.simpleString()}")
        # Parts of the tasks' lists first, so that no window holds those of all tasks.
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(32))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= top)
        out.append(found.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""with
asked as materialized (select row_number() over () i, item_id, {_TERMS} ts from benchmark where text is not null),
wanted as (select i, t, count(*) times from (select i, unnest(ts) t from asked) group by i, t),
held as materialized (select row_number() over () d, doc_id, {_TERMS} ts from documents where text is not null),
sized as (select d, doc_id, len(ts) n from held where len(ts) > 0),
corpus as (select count(*) nd, cast(sum(n) as bigint) nw from sized),
counts as (select d, t, count(*) tf from (select d, unnest(ts) t from held) semi join wanted using (t) group by d, t),
weights as (select t, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1)::double)) as bigint) w from counts, corpus group by t, nd),
parts as (select d, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nw))) part from counts join weights using (t) join sized using (d), corpus),
scores as (select i, d, cast(sum(times * part) as bigint) score from parts join wanted using (t) group by i, d),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls first, d) r from scores join sized using (d) where score > 0)
select item_id, cast(r as integer) as rank, doc_id, score from ranked join asked using (i) where r <= {TOP}"""
