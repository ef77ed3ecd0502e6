"""Components of near copies: candidates by signature bands, links confirmed on full sets.

Operators 3 and 5 share this; each brings its own signature (``Sketch``).

1. Texts with equal shingle sets are one *class* (a count, no pairs).  A class
   has one key for each band of its signature.  Classes with a key in common
   are candidates, each key has its *bucket* of them.
2. Hubs.  Every class tries, of the most central members of its buckets (for
   each range of sizes the one whose buckets hold most, and the first one), the
   TRIES it shares most buckets with.  A group of copies becomes one component
   at about TRIES comparisons a member.
3. What is left are buckets whose members are in several components.  Only a
   shingle that two components have can make a link between components.  Call
   these shared, f of them in a class of n shingles, and a class with
   f < t n is done: it cannot reach similarity t with any other component.
   Shared shingles are put in order, rare ones first.  By prefix filtering, two
   classes at t or more have a shingle in common among the first
   f - t n + 1 of each.
   a. A prefix shingle that at most RARE classes have lists these classes: all
      pairs are tried.
   b. A pair that no such list holds has common shingles only among those of
      more than RARE classes, h of them in a class.  So both have h >= t n:
      they are the *core* of a hot group.  Core classes try hubs as in 2, where
      the most central is the one with the largest share h / n.
   c. Core classes that are still apart from the main component of a bucket are
      dealt into blocks of about BLOCK shingles, and core classes of their
      buckets visit the blocks.  An index of the block's shingles gives exact
      intersections for all of it at once.
After that every candidate pair is inside one component or was decided.  Rows
are linear in the classes: TRIES, RARE and the bands bound them, and in c a class
visits blocks, not classes.

Every step writes its table to the shared folder and deletes those it has used up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vector as v
from .common import Scratch, cut, only_needed, require, row_key
from .components import roots

#: Hubs that a class tries in one round.
TRIES = 2
#: A shingle that so many of the classes that are left have is rare.
RARE = 16
#: Shingles in one block, and classes that meet a block in one task.
BLOCK = 1 << 18
SHARE = 512

_U = np.uint64


@dataclass(frozen=True)
class Sketch:
    """How sets are signed and compared."""

    #: Words in a shingle, and 100 * intersection >= percent * union links two sets.
    shingle: int
    percent: int
    #: (shingles, bounds) to uint16 [row, register].
    sign: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Registers to int64 [row, band].
    keys: Callable[[np.ndarray], np.ndarray]
    #: Registers of two lists of rows to estimates of their similarity.
    estimate: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: An estimate may be so far under the truth.
    margin: float
    registers: int


def _fixed(x: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _registers(column: pa.Array, sketch: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, sketch.registers)


def set_digests(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint64 [row, 2]: a 128-bit digest of each row's set of shingles; zeros for an empty set."""
    out = np.zeros((len(bounds) - 1, 2), dtype=_U)
    with np.errstate(over="ignore"):
        for j, salt in enumerate(v.splitmix(2, 34)):
            p = v.prefix_sums(v.mix(g ^ salt))
            out[:, j] = v.span_hash(p, bounds[:-1], bounds[1:])
    return out


def sets_of(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(_id, _th, n, node, sig): per row the set size, a 128-bit digest of the set, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, raw, offsets in v.blocks(batch.column(2)):
                n = len(offsets) - 1
                g, bounds = v.shingle_sets(raw, offsets, sketch.shingle)
                node = set_digests(g, bounds)
                sig = sketch.sign(g, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(bounds).astype(np.int64)), _fixed(node, 16), _fixed(sig, 2 * sketch.registers)], names=["_id", "_th", "n", "node", "sig"])

    return require(docs, "doc_id", "text").select(*row_key(), "text").mapInArrow(run, "_id long, _th long, n long, node binary, sig binary")


def _band_keys(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """(key, cid, n): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = sketch.keys(_registers(batch.column(2), sketch))
                i = pa.array(np.repeat(np.arange(batch.num_rows), key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(i), batch.column(1).take(i)], names=["key", "cid", "n"])

    return classes.select("cid", "n", "sig").mapInArrow(run, "key long, cid long, n long")


def _alike(a: str, b: str, percent: int):
    """Sizes a and b can be at the threshold."""
    return F.expr(f"{a} * 100 >= {b} * {percent} and {b} * 100 >= {a} * {percent}")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, label, ...) of keys with several labels."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class of rows (key, cid, n, label, score) the TRIES hubs of other labels that it shares most buckets with."""
    one = F.struct("score", "cid", "n", "label")
    ranged = rows.withColumn("range", F.floor(F.log(F.col("n")) / max(float(np.log(100 / percent)), 0.01)))
    by_range = ranged.groupBy("key", "range").agg(F.max(one).alias("top"), F.min(F.struct("cid", "n", "label", "score")).alias("first"))
    central = by_range.groupBy("key").agg(F.collect_list("top").alias("tops"), F.min("first").alias("first"))
    first = F.struct(*(F.col(f"first.{c}") for c in ("score", "cid", "n", "label")))
    asked = rows.join(central, "key").select(F.col("cid").alias("a"), "n", "label", F.explode(F.array_distinct(F.concat("tops", F.array(first)))).alias("hub"))
    asked = asked.filter(F.expr("a != hub.cid and label != hub.label") & _alike("n", "hub.n", percent))
    # Rows of one a come together once, for the count and for the rank.
    counted = asked.select("a", F.col("hub.cid").alias("b"), F.col("hub.score").alias("score")).repartition("a").groupBy("a", "b").agg(F.count("*").alias("c"), F.first("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), F.desc("score"), "b"))
    return counted.withColumn("r", rank).filter(F.col("r") <= TRIES).select("a", "b")


def _verified(pairs: DataFrame, live: DataFrame, sketch: Sketch, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union, written as ``name``."""
    threshold = sketch.percent / 100

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_registers(batch.column(i), sketch) for i in (2, 3))
                yield batch.filter(pa.array(sketch.estimate(x, y) >= threshold - sketch.margin)).select(["a", "b"])

    def side(which: str, column: str) -> DataFrame:
        return live.select(F.col("cid").alias(which), F.col(column).alias(f"{which}_{column}"))

    likely = pairs.join(side("a", "sig"), "a").join(side("b", "sig"), "b").select("a", "b", "a_sig", "b_sig")
    likely = scratch.keep("likely", likely.mapInArrow(estimate, "a long, b long"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype=_U))
        for batch in batches:
            same = []
            hubs = batch.column(1).to_pylist()
            for lo, raw, offsets in v.blocks(batch.column(2)):
                g, bounds = v.shingle_sets(raw, offsets, sketch.shingle)
                for i in range(len(offsets) - 1):
                    if hubs[lo + i] != last[0]:
                        _, r, o = next(v.blocks(batch.column(3).slice(lo + i, 1)))
                        last = (hubs[lo + i], v.shingle_sets(r, o, sketch.shingle)[0])
                    x, y = g[bounds[i] : bounds[i + 1]], last[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(100 * both >= sketch.percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(same, type=pa.bool_())).select(["a", "b"])

    # The side with few texts (hubs) is b: rows of one hub come together, its set is made once a run of rows.
    joined = likely.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "a_text", "b_text")
    links = scratch.keep(name, joined.mapInArrow(compare, "a long, b long"))
    scratch.drop("likely")
    return links


def _with_label(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (cid, ...) with the component they are in, by found (a, root)."""
    found = found.select(F.col("a").alias("cid"), "root")
    return rows.join(found, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")


def _left(rest: DataFrame, live: DataFrame, sketch: Sketch, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of the classes in rest (key, cid, n, label): (cid, n, label, ss) their sets, and
    (cid, n, label, h, rare) those that can have a link to another component; rare are their listed prefix shingles."""

    def list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, raw, offsets in v.blocks(batch.column(3)):
                g, bounds = v.shingle_sets(raw, offsets, sketch.shingle)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, len(sets)) for i in range(3)), sets], names=["cid", "n", "label", "ss"])

    nodes = rest.select("cid", "n", "label").distinct()
    sets = scratch.keep("sets", nodes.join(live.select("cid", "text"), "cid").select("cid", "n", "label", "text").mapInArrow(list_sets, "cid long, n long, label long, ss array<long>"))
    each = sets.select("cid", "n", "label", F.explode("ss").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("s", "c")
    shared = scratch.keep("shared", shared)
    own = only_needed(each, shared, "s").join(shared, "s").groupBy("cid", "n", "label").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("ts"))
    need = f"cast(ceil(n * {sketch.percent} / 100) as int)"
    able = own.withColumn("f", F.size("ts")).filter(f"f >= {need}")
    rare = F.expr(f"transform(filter(slice(ts, 1, f - {need} + 1), t -> t.c <= {RARE}), t -> t.s)")
    able = able.select("cid", "n", "label", F.expr(f"cast(size(filter(ts, t -> t.c > {RARE})) as long)").alias("h"), rare.alias("rare"))
    able = scratch.keep("able", able)
    scratch.drop("shared")
    return sets, able


def _listed(able: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different labels and like sizes that have a rare prefix shingle in common."""
    rows = able.select("cid", "n", "label", F.explode("rare").alias("s"))
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, F.expr("x.s = y.s and x.cid < y.cid and x.label != y.label") & _alike("x.n", "y.n", percent))
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _settle(core: DataFrame, sets: DataFrame, sketch: Sketch, scratch: Scratch) -> DataFrame:
    """(a, b): links between the labels of core (key, cid, n, label, h) that are still apart."""
    percent = sketch.percent
    # The main component of a bucket has most of its members.
    parts = core.groupBy("key", "label").agg(F.count("*").alias("members"), F.min("n").alias("least"))
    ends = parts.groupBy("key").agg(F.max(F.struct("members", "label")).alias("top"), F.min("least").alias("least"), F.sum("members").alias("members"))
    # At best, the other one is no smaller than h and has all of the h.
    can = F.expr(f"100 * h >= {percent} * (n + greatest(least - h, 0))")
    apart = core.join(ends, "key").filter((F.col("label") != F.col("top.label")) & can).select("key", "cid", "n", "members")
    homes = apart.groupBy("cid").agg(F.max(F.struct("members", "key")).alias("home"), F.first("n").alias("n")).select("cid", "home.key", "n")
    homes = scratch.keep("homes", homes.withColumnRenamed("key", "home"))
    total = homes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    # A family that fills several blocks is dealt over them; small ones share a block.
    chunks = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK).alias("chunks"))
    dealt = homes.join(chunks, "home").select("cid", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("cid"), "chunks")), F.lit(blocks)).alias("block"))
    dealt = scratch.keep("dealt", dealt)
    asked = core.select("key", "cid").join(dealt, "cid").select("key", "block").distinct()
    visits = scratch.keep("visits", core.select("key", "cid").join(asked, "key").select("cid", "block").distinct())
    shares = visits.groupBy("block").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    held = dealt.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), "cid")
    come = visits.join(shares, "block").select("block", F.pmod(F.xxhash64("cid"), "shares").alias("share"), F.lit(1).alias("side"), "cid")
    nodes = core.groupBy("cid").agg(F.first("label").alias("label"), F.first("h").alias("h")).join(sets.select("cid", "ss"), "cid")
    ready = held.unionByName(come).join(nodes, "cid").select("block", "share", "side", "cid", "label", "h", "ss").repartition("block", "share").sortWithinPartitions("block", "share", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(percent)
        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            side, cid, label, h = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            ss, a, b = batch.column(6), [], []
            for i in range(batch.num_rows):
                if where[i] != at:
                    at, block = where[i], _Block(percent)
                s = ss[i].values.to_numpy()
                if side[i] == 0:
                    block.hold(cid[i], label[i], h[i], s)
                    continue
                for other in block.links(label[i], h[i], s):
                    a.append(cid[i])
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    links = scratch.keep("settled", ready.mapInArrow(compare, "a long, b long"))
    scratch.drop("homes", "dealt", "visits")
    return links


class _Block:
    """The sets of one block, and an index of their shingles."""

    def __init__(self, percent: int) -> None:
        self.percent, self.rows, self.index = percent, [], None
        self.parent: dict[int, int] = {}

    def hold(self, cid: int, label: int, h: int, s: np.ndarray) -> None:
        self.rows.append((cid, label, h, s.copy()))

    def _root(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def links(self, label: int, h: int, s: np.ndarray) -> list[int]:
        """One class of the block for each label that this set joins to its own, for labels that no earlier set has joined."""
        if not self.rows:
            return []
        if self.index is None:
            tokens = np.concatenate([r[3] for r in self.rows])
            owner = np.repeat(np.arange(len(self.rows), dtype=np.int32), [len(r[3]) for r in self.rows])
            order = np.argsort(tokens, kind="stable")
            self.index = tokens[order], owner[order], np.array([r[1] for r in self.rows]), np.array([r[2] for r in self.rows]), np.array([len(r[3]) for r in self.rows])
        tokens, owner, labels, hs, n = self.index
        low = np.minimum(hs, h)
        able = (labels != label) & (100 * low >= self.percent * (n + len(s) - low))
        if not able.any():
            return []
        lo, hi = np.searchsorted(tokens, s, side="left"), np.searchsorted(tokens, s, side="right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        both = np.bincount(owner[at], minlength=len(n))
        out = []
        for i in np.flatnonzero(able & (100 * both >= self.percent * (n + len(s) - both))).tolist():
            x, y = self._root(label), self._root(int(labels[i]))
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                out.append(self.rows[i][0])
        return out


def _joined(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, root) of the components that links join those of found (a, root) to."""
    return found if links.isEmpty() else roots(found.select("a", F.col("root").alias("b")).unionByName(links), scratch, name)


def links_of(classes: DataFrame, docs: DataFrame, sketch: Sketch, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Tables (a, b) of confirmed links between classes (cid, _id, _th, n, sig), which together connect all that the bands
    and the threshold connect; and the components (a, root) that they make.  The written table of classes is deleted on the way."""
    percent = sketch.percent
    busy = scratch.keep("busy", _band_keys(classes, sketch).groupBy("key").agg(F.count("*").alias("k")).filter("k >= 2"))
    member = scratch.keep("member", only_needed(_band_keys(classes, sketch), busy, "key").join(busy, "key"))
    # Classes that stand in many crowded buckets are near the middle of their group.
    middle = scratch.keep("middle", member.groupBy("cid").agg(F.sum("k").alias("score")))
    live = scratch.keep("named", only_needed(classes.drop("node"), middle, "cid").join(middle, "cid"))
    # Of the texts only those of such classes are shuffled, once; rows that repeat whole are one class.
    texts = only_needed(require(docs, "doc_id", "text").select(*row_key(), "text"), live).dropDuplicates(["_id", "_th"])
    live = scratch.keep("live", live.join(texts, ["_id", "_th"]).select("cid", "n", "score", "sig", "text"))
    scratch.drop("busy", "named", "classes")
    member = member.select("key", "cid", "n")
    first = _verified(_hubs(member.join(middle, "cid").withColumn("label", F.col("cid")), percent), live, sketch, scratch, "first")
    found = roots(first, scratch, "first-roots")

    # What is left: buckets whose members are in several components.
    rest = scratch.keep("rest", _mixed(_with_label(member, found)))
    scratch.drop("member", "middle")
    sets, able = _left(rest, live, sketch, scratch)
    core = rest.join(able.filter(f"100 * h >= {percent} * n").select("cid", "h"), "cid")
    core = scratch.keep("core", core.withColumn("score", F.expr("h * 1000000 div n")))
    tried = _listed(able, percent).unionByName(_hubs(core, percent))
    second = _verified(tried, live, sketch, scratch, "second")
    scratch.drop("rest", "able", "live")
    found = _joined(found, second, scratch, "second-roots")
    still = scratch.keep("still", _mixed(_with_label(core.select("key", "cid", "n", "h"), found)))
    scratch.drop("core")
    third = _settle(still, sets, sketch, scratch)
    scratch.drop("sets", "still")
    return [first, second, third], _joined(found, third, scratch, "third-roots")


def classes_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, node, _id, _th, n, sig): one row for each set among rows (of ``sets_of``), with the least row that has it."""
    classes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("_id", "_th")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return scratch.keep("classes", classes.select(F.monotonically_increasing_id().alias("cid"), "node", "r._id", "r._th", "n", "sig"))


def near_links(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(a, b): confirmed links between the least _id of two different sets, a >= b.  They connect all near copies; copies of one set are not listed."""
    scratch = Scratch(docs.sparkSession, "near")
    classes = classes_of(sets_of(docs, sketch), scratch)
    named = scratch.keep("ids", classes.select("cid", "_id"))
    (first, second, third), _ = links_of(classes, docs, sketch, scratch)
    links = first.unionByName(second).unionByName(third).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    side = lambda c: named.select(F.col("cid").alias(c), F.col("_id").alias(f"{c}_id"))
    out = cut(links.join(side("a"), "a").join(side("b"), "b").select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).distinct())
    scratch.drop()
    return out


def components_of_sets(rows: DataFrame, docs: DataFrame, sketch: Sketch, scratch: Scratch) -> DataFrame:
    """(node, component) for each set among rows (_id, _th, n, node, sig) of docs; component is the least _id of the rows that links reach."""
    classes = classes_of(rows, scratch)
    # What is needed at the end, without the registers.
    named = scratch.keep("nodes", classes.select("cid", "node", "_id"))
    _, found = links_of(classes, docs, sketch, scratch)
    named = _with_label(named, found)
    least = named.groupBy("label").agg(F.min("_id").alias("component"))
    return named.join(least, "label").select("node", "component")


def near_components(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(_id, _th, n_shingles, component): one row per row of docs; component is the least _id of those that links reach, null without shingles."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.keep("rows", sets_of(docs, sketch))
    out = rows.select("_id", "_th", "n", "node").join(components_of_sets(rows, docs, sketch, scratch), "node", "left")
    out = cut(out.select("_id", "_th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).alias("component")))
    scratch.drop()
    return out
