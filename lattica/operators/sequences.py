"""Ordered sequences: returns, advantages, moving statistics, replay of actions.

A trajectory is the rows of one key in the order of a step number.  Windows
stream with spilling; reverse scans with a carried value stream too, over rows
sorted by key and step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _reverse_scan(df: DataFrame, keys: Sequence[str], step: str, add: Column, carry: Column, out: str) -> DataFrame:
    """df with out_t = add_t + carry_t * out_(t + 1) inside each key, linear in the rows.

    Rows come sorted by key and descending step; a scan holds one number and
    streams over batches, so a long trajectory is never a list in memory.
    """
    prepared = df.withColumns({"_a": add.cast("double"), "_k": carry.cast("double")})
    names = [*df.columns, out]
    nk, na = [prepared.columns.index(k) for k in keys], len(prepared.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = None, 0.0
        for batch in batches:
            key = list(zip(*[batch.column(i).to_pylist() for i in nk], strict=True))
            scanned = []
            for k, a, c in zip(key, batch.column(na).to_pylist(), batch.column(na + 1).to_pylist(), strict=True):
                value = a + c * value if k == last else a
                last = k
                scanned.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:na], pa.array(scanned, type=pa.float64())], names=names)

    ordered = prepared.repartition(*keys).sortWithinPartitions(*keys, F.desc(step))
    return ordered.mapInArrow(run, df.withColumn(out, F.lit(0.0)).schema)


def discounted_returns(df: DataFrame, key: str, step: str, reward: str, gamma: float, out: str = "ret") -> DataFrame:
    """R_t = r_t + gamma R_(t+1)."""
    return _reverse_scan(df, [key], step, F.col(reward), F.lit(gamma), out)


def gae(df: DataFrame, key: str, step: str, reward: str, value: str, done: str, gamma: float, lam: float, out: str = "adv") -> DataFrame:
    """Generalised advantage: delta_t + gamma lam (1 - done_t) A_(t+1); a done step cuts both value and carry."""
    nxt = F.coalesce(F.lead(value).over(Window.partitionBy(key).orderBy(step)), F.lit(0.0))
    live = 1.0 - F.col(done).cast("double")
    d = df.withColumns({"_d": F.col(reward) + gamma * nxt * live - F.col(value), "_l": gamma * lam * live})
    return _reverse_scan(d, [key], step, F.col("_d"), F.col("_l"), out).drop("_d", "_l")


def group_advantage(df: DataFrame, key: str, step: str, reward: str, size: int, eps: float = 1e-8) -> DataFrame:
    """z-score of the reward inside consecutive groups of ``size`` steps."""
    g = df.withColumn("group", F.floor((F.col(step) - 1) / size).cast("int"))
    w = Window.partitionBy(key, "group")
    return g.withColumn("adv", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + eps))


def moving_mean(df: DataFrame, key: str, step: str, value: str, width: int, out: str = "moving") -> DataFrame:
    """Mean of the last ``width`` values once there are that many."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(1 - width, 0)
    return df.withColumn(out, F.when(F.count(value).over(w) >= width, F.avg(value).over(w)))


def patience(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Best value so far and the steps since it was last improved."""
    w = Window.partitionBy(key).orderBy(step)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_b", F.max(value).over(before)).withColumn("improved", F.col("_b").isNull() | (F.col(value) > F.col("_b")))
    d = d.withColumn("best", F.greatest(F.coalesce("_b", value), F.col(value)))
    last = F.max(F.when(F.col("improved"), F.col(step))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("stale", F.col(step) - last).drop("_b")


def owner_at(actions: DataFrame, keys: Sequence[str], item: str, step: str, upto: Column | int, owner: str) -> DataFrame:
    """Owner of each item after all applied actions up to a step: the last write wins.  No state is carried; it is one aggregate."""
    return actions.filter(F.col(step) <= upto).groupBy(*keys, item).agg(F.max_by(owner, step).alias(owner), F.max(step).alias("since"))


def key_frames(actions: DataFrame, keys: Sequence[str], item: str, step: str, owner: str, every: int) -> DataFrame:
    """(keys, frame, item, owner, since): the whole state of each sequence after steps ``every``, 2 ``every``, .. to its end.

    An action counts from the first frame at or after it; a change fills the frames
    up to the next change of its item.
    """
    frame = F.ceil(F.col(step) / every).cast("long")
    changes = actions.groupBy(*keys, item, frame.alias("_from")).agg(F.max_by(owner, step).alias(owner), F.max(step).alias("since"))
    ends = actions.groupBy(*keys).agg(F.max(frame).alias("_end"))
    until = F.coalesce(F.lead("_from").over(Window.partitionBy(*keys, item).orderBy("_from")) - 1, F.col("_end"))
    filled = changes.join(ends, list(keys)).withColumn("_until", until).withColumn("frame", F.explode(F.sequence("_from", "_until")))
    return filled.select(*keys, "frame", item, owner, "since")


def seek(frames: DataFrame, actions: DataFrame, requests: DataFrame, keys: Sequence[str], item: str, step: str, owner: str, every: int) -> DataFrame:
    """(keys, at, item, owner, since): the state of a sequence after each asked step (keys, at): its last key frame and the few actions since.

    Both joins are on the frame's number, so no sequence is folded from its start;
    frames are made once, for any number of requests.  Beyond the last frame the
    last frame holds; steps start at 1.
    """
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"))
    asked = requests.select(*keys, "at").distinct().withColumn("_f", F.expr(f"at div {every}")).join(last, list(keys), "left")
    base = asked.withColumn("frame", F.least("_f", "_last")).join(frames, [*keys, "frame"]).select(*keys, "at", item, owner, "since")
    late = actions.select(*keys, item, F.col(step).alias("since"), owner, (F.ceil(F.col(step) / every).cast("long") - 1).alias("_f"))
    since = asked.select(*keys, "at", "_f").join(late, [*keys, "_f"]).filter("since <= at").select(*keys, "at", item, owner, "since")
    return base.unionByName(since).groupBy(*keys, "at", item).agg(F.max_by(owner, "since").alias(owner), F.max("since").alias("since"))


def on_grid(df: DataFrame, key: str, x: str, y: str, points: int) -> DataFrame:
    """(key, g, v): linear interpolation of each key's series at g / (points - 1) of its range of x (0..1)."""
    w = Window.partitionBy(key).orderBy(x)
    seg = df.select(key, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    top = points - 1
    lo = F.ceil(F.col("x0") * top - 1e-9).cast("int")
    hi = F.when(F.col("x1").isNull(), F.when(F.abs(F.col("x0") - 1) < 1e-9, F.lit(top)).otherwise(F.lit(-1))).otherwise((F.ceil(F.col("x1") * top - 1e-9) - 1).cast("int"))
    g = seg.withColumns({"lo": lo, "hi": hi}).filter("hi >= lo").withColumn("g", F.explode(F.sequence("lo", "hi")))
    at = F.col("g") / float(top)
    v = F.when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (at - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return g.select(key, "g", v.alias("v"))


def choice_rank(df: DataFrame, keys: Sequence[str], reward: str, chosen: str) -> DataFrame:
    """(keys, rank, best, regret) of the chosen action among the available ones: counts, no sort."""
    own = F.max(F.when(F.col(chosen), F.col(reward)))
    w = df.groupBy(*keys).agg(own.alias("_c"), F.max(reward).alias("best"))
    j = df.join(w, list(keys))
    return j.groupBy(*keys, "best", "_c").agg((F.count_if(F.col(reward) > F.col("_c")) + 1).alias("rank")).select(*keys, "rank", "best", (F.col("best") - F.col("_c")).alias("regret"))
