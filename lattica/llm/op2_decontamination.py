"""Benchmark decontamination by template canonicalisation (operator 2).

Words are trimmed of punctuation and folded; numbers, units and names become
typed placeholders, so that a question with other numbers or names has the same
template.  Items are matched by windows of WINDOW words (items with fewer words
are one window of all their words), of three kinds:

* template windows hold placeholders and at least LITERALS other words;
* exact windows hold the words themselves.  Only items that have a window with
  fewer literals use them, so that questions made of numbers are found when
  they are copied as they stand;
* stretches run from a literal to the LITERALS-th literal from there, over
  however many slots lie between, and count when they are at least WINDOW words
  long.  Items in which at most half of the windows hold enough literals use
  them, so that questions full of numbers are found with other numbers, too.  An
  item with fewer literals takes all of them, but no fewer than FEWEST.

A template window or stretch must be consistent in its slots: along one alignment of item
and document, equal slot values of the item stand for equal values in the
document, and different ones for different ones.  A document is contaminated by
an item when its windows of one kind cover at least COVERAGE of the item's
windows of that kind, or at least PASSAGE of them (a passage of 13 words).
Windows of one item with the same hash count once, at their first place.

As tables: items with equal templates and equal patterns of slot values are one
*class*, since a document is consistent with all or none.  Windows of classes
and of documents are rows and meet in a hash join.  A document needs some number
of a class's windows; so it has one of those that are left when the ones that
most classes share are put aside, fewer than that number, and only such windows
make candidates.  All windows of a candidate are joined and its slots checked,
along each alignment in the order of the document.  Of the documents only
windows that pass a Bloom filter of the classes' hashes become rows; texts are
not shuffled.

Result: one row per document: doc_id, contaminated, item_ids (sorted), and over
these items the best coverage and the most windows (0 without any).  Edge cases:
null and empty texts are clean; null or empty items and null item_ids match
nothing; repeated rows each get a row; an item that occurs twice counts under
each of its ids; empty tables are fine; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vector as v
from .common import Scratch, columns, fresh, mark_needed, require, row_key

WINDOW = 8
LITERALS = 5
FEWEST = 3
COVERAGE = 0.4
PASSAGE = 6
#: Bits of the filter of window hashes for each hash, and the most in all (8 MB).
FILTER_RATIO, FILTER_BITS = 256, 1 << 26

_U = np.uint64
NUMBER, UNIT, NAME = (_U(x) for x in (0x1111, 0x2222, 0x3333))

# Words that count as numbers and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNIT_WORDS = "km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent mph kph kmh hz khz mhz ghz b kb mb gb tb w kw j kj cal kcal v a degree degrees".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    at = np.concatenate(([0], np.cumsum([len(w) for w in data]))).astype(np.int64)
    return np.sort(v.span_hash(v.prefix_sums(v.LOWER_CODE[np.frombuffer(b"".join(data), dtype=np.uint8)]), at[:-1], at[1:]))


_NUMBERS, _UNITS = _word_hashes(NUMBER_WORDS), _word_hashes(UNIT_WORDS)
_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _SOLID & ~_DIGIT
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def templates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template code, value hash, literal, first): the template words of each row of a block."""
    start, end, _, first = v.words(raw, offsets)
    if not len(start):
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=_U), np.zeros(0, dtype=bool), first
    # Trim to the first and last solid byte.
    n = len(raw)
    place = np.arange(n)
    solid = _SOLID[raw]
    after = np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    s, e = after[start], before[end - 1] + 1
    keep = (s < end) & (e > start)
    # A word begins a sentence after a stop, at a line break, or at the start of its row.
    opens = np.ones(len(start), dtype=bool)
    breaks = np.concatenate(([0], np.cumsum(raw == 10)))
    opens[1:] = _STOP[raw[end[:-1] - 1]] | (breaks[start[1:]] > breaks[end[:-1]])
    opens[first[:-1][first[:-1] < len(start)]] = True
    counts = {name: np.concatenate(([0], np.cumsum(table[raw]))) for name, table in (("digit", _DIGIT), ("upper", _UPPER), ("letter", _LETTER))}
    row = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    s, e, opens, row = s[keep], e[keep], opens[keep], row[keep]
    value = v.span_hash(v.prefix_sums(v.LOWER_CODE[raw]), s, e)
    digits, upper, letters = (c[e] - c[s] for c in counts.values())
    number = ((digits > 0) & (letters <= 3) & _DIGIT[raw[s]]) | _isin(value, _NUMBERS)
    unit = ~number & _isin(value, _UNITS)
    # A capital inside a sentence, in a word that is not all capitals.
    name = ~number & ~unit & _UPPER[raw[s]] & ~opens & (upper < letters)
    code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return code, value, ~(number | unit | name), np.searchsorted(row, np.arange(len(offsets)))


_SALT, _STRETCH = _U(0xA5A5A5A55A5A5A5A), _U(0x3C3C3C3CC3C3C3C3)


def windows(code: np.ndarray, value: np.ndarray, literal: np.ndarray, first: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, exact hash, index of the first word) of all windows of w words; the template hash is 0 without enough literals."""
    g, _, at = v.grams(code, first, w)
    exact, _, _ = v.grams(value, first, w)
    some = np.concatenate(([0], np.cumsum(literal)))
    return np.where(some[at + w] - some[at] >= min(LITERALS, w), g, _U(0)), v.mix(exact ^ _SALT), at


def stretches(code: np.ndarray, literal: np.ndarray, first: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, first word, word after the last) of every run of at least WINDOW words from a literal to the q-th literal from there."""
    at = np.flatnonzero(literal)
    start, end = at[: max(0, len(at) - q + 1)], at[q - 1 :] + 1
    row = np.searchsorted(first, start, side="right")
    good = (row == np.searchsorted(first, end - 1, side="right")) & (end - start >= WINDOW)
    start, end = start[good], end[good]
    return v.mix(v.span_hash(v.prefix_sums(v.mix(code)), start, end) ^ _STRETCH), start, end


def _slot_values(literal: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """For each span the values of its slots."""
    size = end - start
    ends = np.concatenate(([0], np.cumsum(size)))
    each = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    slot = ~literal[each]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(slot)))[ends].astype(np.int32)), pa.array(value[each[slot]].view(np.int64)))


_ITEM = "item_id long, c1 long, c2 long, kind int, size int, total long, need long, hs array<long>, places array<int>, slots array<array<long>>"


def _needed(total: int) -> int:
    return max(1, min(PASSAGE, int(np.ceil(COVERAGE * total - 1e-9))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """For each item and kind of window a row: the class it belongs to (c1, c2) and the class's windows.

    slots are numbers of the slot values in order of their first occurrence in the item; size is the words of a window, or
    the literals of a stretch below zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for lo, raw, offsets in v.blocks(batch.column(1)):
                code, value, literal, first = templates(raw, offsets)
                for i in range(len(offsets) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    w = min(WINDOW, b - a)
                    if not w:
                        continue
                    c, x, lit = code[a:b], value[a:b], literal[a:b]
                    seen: dict[int, int] = {}
                    slot = np.array([-1 if plain else seen.setdefault(s, len(seen)) for s, plain in zip(x.tolist(), lit.tolist(), strict=True)])
                    template, exact, at = windows(c, x, lit, np.array([0, b - a]), w)
                    by_slot, poor = [c, v.mix(slot.astype(np.int64).view(_U))], template == 0
                    kinds = [(0, w, template[~poor], at[~poor], at[~poor] + w, by_slot)]
                    if poor.any():
                        kinds.append((1, w, exact, at, at + w, [x]))
                    q = min(LITERALS, int(lit.sum()))
                    if 2 * poor.sum() >= len(poor) and q >= FEWEST:
                        kinds.append((2, -q, *stretches(c, lit, np.array([0, b - a]), q), by_slot))
                    for kind, size, h, starts, ends, parts in kinds:
                        hs, pos = np.unique(h, return_index=True)
                        if not len(hs):
                            continue
                        places = starts[pos]
                        whole = np.concatenate([np.array([len(c), kind], dtype=_U), *parts])
                        key = [v.span_hash(v.prefix_sums(v.mix(whole ^ salt)), np.array([0]), np.array([len(whole)]))[0].astype(np.int64) for salt in v.splitmix(2, 21)]
                        slots = [[int(s) for s in slot[p:e] if s >= 0] if kind != 1 else [] for p, e in zip(places.tolist(), ends[pos].tolist(), strict=True)]
                        out.append((ids[lo + i], int(key[0]), int(key[1]), kind, size, len(hs), _needed(len(hs)), hs.view(np.int64).tolist(), places.tolist(), slots))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _ITEM.split(", ")])

    items = require(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    return items.mapInArrow(run, _ITEM)


def _filter_bits(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter with one hash, of bounded size: the only thing that comes to the driver."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (FILTER_RATIO * hashes.count()).bit_length()))
    words = hashes.select(F.expr(f"h & {bits - 1}L").alias("i")).groupBy(F.expr("i div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(i % 64))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(_id, _th, h, at, vals): the windows of documents that pass the filter, with the values in their slots."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for lo, raw, offsets in v.blocks(batch.column(2)):
                code, value, literal, first = templates(raw, offsets)
                for w in sizes:
                    if w < 0:
                        h, start, end = stretches(code, literal, first, -w)
                        found = [(h, start, lambda i, s=start, e=end: _slot_values(literal, value, s[i], e[i]))]
                    else:
                        template, exact, at = windows(code, value, literal, first, w)
                        inside = lambda i, at=at, w=w: _slot_values(literal, value, at[i], at[i] + w)
                        bare = lambda i: pa.ListArray.from_arrays(pa.array(np.zeros(len(i) + 1, dtype=np.int32)), pa.array([], pa.int64()))
                        found = [(template, at, inside), (exact, at, bare)]
                    for h, at, values in found:
                        i = (h & _U(len(table) * 64 - 1)).astype(np.int64)
                        hit = np.flatnonzero(((table[i >> 6] >> (i & 63)) & 1).astype(bool) & (h != 0))
                        if not len(hit):
                            continue
                        place = at[hit]
                        row = np.searchsorted(first, place, side="right") - 1
                        of = pa.array(lo + row)
                        arrays = [batch.column(0).take(of), batch.column(1).take(of), pa.array(h[hit].view(np.int64)), pa.array((place - first[row]).astype(np.int32)), values(hit)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_th", "h", "at", "vals"])

    return require(docs, "doc_id", "text").select(*row_key(), "text").mapInArrow(run, "_id long, _th long, h long, at int, vals array<long>")


class _Alignment:
    """Slot values along one alignment."""

    def __init__(self) -> None:
        self.means: dict[int, int] = {}
        self.back: dict[int, int] = {}

    def takes(self, slots: list[int], vals: list[int]) -> bool:
        """Whether a window agrees with those before it; if so it counts."""
        new, back = dict(self.means), dict(self.back)
        for x, y in zip(slots, vals, strict=True):
            if new.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return False
        self.means, self.back = new, back
        return True


def _check_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, _th, cls, diagonal, place, slots, vals), in order of alignment and place, to (_id, _th, cls, windows)."""
    key, diagonal, covered, line = None, None, set(), _Alignment()
    out: list[tuple] = []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64()) for i in range(4)], names=["_id", "_th", "cls", "windows"])

    for batch in batches:
        a, b, c, d, place, slots, vals = (batch.column(i).to_pylist() for i in range(7))
        for i, now in enumerate(zip(a, b, c, strict=True)):
            if now != key:
                if covered:
                    out.append((*key, len(covered)))
                key, diagonal, covered = now, None, set()
            if d[i] != diagonal:
                diagonal, line = d[i], _Alignment()
            if line.takes(slots[i], vals[i]):
                covered.add(place[i])
        yield pack()
        out = []
    if covered:
        out.append((*key, len(covered)))
    yield pack()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_id, _th, items, coverage, windows): the rows of docs that hold benchmark items; a written table."""
    t = Scratch(docs.sparkSession, "decontamination")
    items = t.keep("items", item_windows(benchmark))
    one = [F.first(c).alias(c) for c in ("size", "total", "need", "hs", "places", "slots")]
    classes = t.keep("classes", items.groupBy("c1", "c2").agg(*one).withColumn("cls", F.monotonically_increasing_id()))
    zipped = F.explode(F.arrays_zip("hs", "places", "slots")).alias("z")
    wins = t.keep("windows", classes.select("cls", "total", "need", zipped).select("cls", "total", "need", F.col("z.hs").alias("h"), F.col("z.places").alias("place"), F.col("z.slots").alias("slots")))
    sizes = sorted(r[0] for r in classes.select("size").distinct().collect())  # WINDOW numbers at most, and one for each number of literals
    bits = _filter_bits(wins.select("h"))
    met = document_windows(docs, bits, sizes).dropDuplicates(["_id", "_th", "h", "at"])
    met = t.keep("met", met)
    # Windows that many classes share make no candidates as long as enough others are left.
    common = wins.groupBy("h").agg(F.count("*").alias("classes"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("classes"), "h"))
    keys = wins.select("cls", "need", "h").join(common, "h").withColumn("r", rank).filter("r >= need").select("cls", "h")
    candidates = t.keep("candidates", met.select("_id", "_th", "h").join(keys, "h").select("_id", "_th", "cls").distinct())
    rows = candidates.join(wins.select("cls", "h", "place", "slots"), "cls").join(met, ["_id", "_th", "h"])
    rows = rows.select("_id", "_th", "cls", F.expr("at - place").alias("diagonal"), "place", "slots", "vals")
    rows = rows.repartition("_id", "_th", "cls").sortWithinPartitions("_id", "_th", "cls", "diagonal", "place")
    counted = t.keep("counted", rows.mapInArrow(_check_slots, "_id long, _th long, cls long, windows long"))
    hits = counted.join(classes.select("cls", "c1", "c2", "total", "need"), "cls").filter("windows >= need")
    hits = hits.join(items.select("c1", "c2", "item_id"), ["c1", "c2"])
    found = hits.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("windows") / F.col("total")).alias("coverage"), F.max("windows").alias("windows"))
    found = t.keep("found", found)
    t.drop("items", "classes", "windows", "met", "candidates", "counted")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (all columns) with _items (array of item ids), _coverage and _windows; a name that docs has gets another underscore."""
    found = contaminated(docs, benchmark)
    names = [fresh(docs, n) for n in ("_items", "_coverage", "_windows")]
    marked = mark_needed(docs.select(F.struct(*columns(docs.columns)).alias("row"), *row_key()), found)
    hit = marked.filter("_needed").join(found, ["_id", "_th"], "left")
    none = (F.array().cast("array<long>"), F.lit(0.0), F.lit(0).cast("long"))
    rest = marked.filter("not _needed").select("row.*", *(x.alias(n) for x, n in zip(none, names, strict=True)))
    return rest.unionByName(hit.select("row.*", *(F.coalesce(F.col(c), x).alias(n) for c, x, n in zip(("items", "coverage", "windows"), none, names, strict=True))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_coverage").alias("coverage"), F.col("_windows").alias("n_windows"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, all others stay as they are."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("_id", "_th")
    marked = mark_needed(docs.select(F.struct(*columns(docs.columns)).alias("row"), *row_key()), found)
    clean = marked.filter("_needed").join(found, ["_id", "_th"], "left_anti")
    return marked.filter("not _needed").select("row.*").unionByName(clean.select("row.*"))
