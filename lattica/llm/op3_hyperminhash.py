"""MinHash near-dedup with HyperMinHash registers (operator 3).

1. Each text becomes its set of distinct word shingles.  Texts with equal sets
   are one class (a count, no pairs); a class has REGISTERS registers, each the
   least hash of one bucket kept as leading-zero count (6 bits) and mantissa
   (10 bits), as a floating-point number keeps them.  Every bucket has a
   permutation of its own: of one hash that deals shingles over buckets, short
   texts would leave most empty.
2. Bands of four registers are one 64-bit key; classes with a key in common are
   candidates.  At similarity 0.8, 32 bands miss a pair with chance 5e-8.
3. ``near.py`` looks for links where they can still join two components.  Pairs
   with a collision-corrected Jaccard estimate under ``threshold - MARGIN`` fall
   out; the rest are verified on full sets.

Edge cases: null and empty texts have no shingles, link to nothing and stay; a
text with fewer words than a shingle is one shingle; repeated rows are one
class (rows of one doc_id stay or go together); a null doc_id sorts first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from . import vector as v
from .common import NULL_ID, Scratch, columns, mark_needed, row_key

REGISTERS = 128
BAND = 4
#: Five standard deviations of the estimate from 128 registers at 0.8.
MARGIN = 0.18
#: Chance that two different minima keep the same register: 0.17 of a mantissa step (published bound).
COLLISION = 0.1699 / (1 << 10)

_U = np.uint64
_A = v.splitmix(REGISTERS, 31) | _U(1)
_B = v.splitmix(REGISTERS, 32)
_BAND_SEED = v.splitmix(REGISTERS // BAND, 33)


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint16 [row, register]; a row without shingles has zeros."""
    size = np.diff(bounds)
    full = np.flatnonzero(size > 0)
    out = np.zeros((len(size), REGISTERS), dtype=np.uint16)
    if not len(full):
        return out
    at = bounds[:-1][full]
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            least = np.minimum.reduceat(shingles * _A[i] + _B[i], at)
            bits = least.astype(np.float64).view(_U) >> _U(42)
            out[full, i] = np.clip(bits.astype(np.int64) - (1023 << 10), 0, 65535)
    return out


def jaccard_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal registers, corrected for chance collisions, for register rows a and b."""
    same = (a == b).mean(axis=1)
    return np.clip((same - COLLISION) / (1 - COLLISION), 0, 1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 [row, band]: the four registers of a band are one 64-bit word."""
    with np.errstate(over="ignore"):
        return v.mix(np.ascontiguousarray(sig).view(_U) + _BAND_SEED).view(np.int64)


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(_id, _th, n_shingles, component): one row per row of docs; component is null without shingles."""
    return near.near_components(docs, near.Sketch(shingle, percent, registers, band_keys, jaccard_estimate, MARGIN, REGISTERS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_components(docs, shingle=2, percent=80)
    doc_id = F.when(F.col("_id") != NULL_ID, F.col("_id"))
    component = F.coalesce("component", "_id")
    return out.select(doc_id.alias("doc_id"), "n_shingles", F.when(component != NULL_ID, component).alias("component_id"), (F.col("_id") == component).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, the one with the least doc_id (and text hash).

    Five-word shingles at 0.8.  Of rows that repeat whole, one stays; texts without words stay.
    """
    found = near_components(docs)
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("_id", "_th")).alias("k")).select("k._id", "k._th").withColumn("_first", F.lit(True))
    decided = found.groupBy("_id", "_th").agg(F.count("*").alias("_rows"), F.max("component").isNull().alias("_empty")).join(first, ["_id", "_th"], "left")
    decided = decided.withColumn("_stays", F.col("_empty") | F.col("_first").isNotNull())
    touched = Scratch(spark, "touched").keep("rows", decided.filter("not _stays or _rows > 1").select("_id", "_th", "_stays"))
    # Documents that nothing is decided about are not shuffled.
    marked = mark_needed(docs.select(F.struct(*columns(docs.columns)).alias("row"), *row_key()), touched)
    asked = marked.filter("_needed").join(touched, ["_id", "_th"], "left")
    once = asked.filter("_stays").dropDuplicates(["_id", "_th"])
    rest = marked.filter("not _needed").select("row").unionByName(asked.filter("_stays is null").select("row"))
    return rest.unionByName(once.select("row")).select("row.*")
