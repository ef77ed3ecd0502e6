"""Grouping spelling variants by a rare-first bigram prefix filter (operator 12).

1. Words are runs of letters, lower-cased in A-Z, of which a keyed checksum
   makes some lose a letter; a task adds up its words before the shuffle.
2. The bigrams of all words are ordered by how many there are, rarest first,
   equal ones by bigram and then by place.
3. A word is joined on its three rarest bigrams only.  One edit destroys at most
   two bigrams of either word and keeps the order of the others, so the first
   bigram that survives is among the three of both words, at the same place, or
   one later in the longer word.  Position limits: same length, same place;
   lengths l and l + 1, the same place or one later.
4. One edit also leaves the first or the second half of the shorter word as it
   is.  The half is part of the join key, so that words which share a common
   rare bigram are not all compared with each other.
5. Candidates are verified by their edit distance and counted once.
6. A word's form is its near word of largest count, if that is five times its
   own; counts grow fivefold at each step, so roots are found by a few rounds in
   which links double their length.

Only the table of bigrams is broadcast: letters are 90, bigrams at most 8100.
All other joins are merged.  Spark takes the size of a written table from its
compressed file and does not count what an explode multiplies, so it would send
rows many times its broadcast limit through the driver.

Edge cases: a null text has no words; an empty table, or one whose words are all
short or rare, gives an empty result; a null doc_id counts as an empty string in
the checksum; rows that repeat count each; a word without near words has n_near
0, no form and itself as root; a run as long as a whole text is a word like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, require
from .op13_shards import CRC_TABLE, crc32_sql

LETTERS = 6
OCCURRENCES = 5
#: A form is this many times as frequent as its variant.
TIMES = 5
#: Checksums that this divides cost a word a letter.
DAMAGE = 199
#: Two bigrams are lost to one edit, so one of three survives.
PREFIX = 3
#: Words that a task adds up before it hands them on.
HELD = 400_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n): counts of the words of docs (doc_id, text) with enough letters, several rows for a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if len(word) < letters:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGE == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < letters:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return require(docs, "doc_id", "text").mapInArrow(run, "word string, n long")


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, gram, at): the PREFIX rarest bigrams of each word and their places, from 1."""
    grams = words.select("word", "n", F.posexplode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("at", "gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))  # at most 90 * 90 rows
    placed = grams.join(F.broadcast(often), "gram").groupBy("word", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, PREFIX).alias("rare"))
    return placed.select("word", "n", F.explode("rare").alias("r")).select("word", "n", "r.gram", (F.col("r.at") + 1).alias("at"))


def _halves(of: Column, left: Column, right: Column) -> Column:
    """Both halves of a word of which ``of`` letters take part, each with its side."""
    return F.explode(F.array(F.concat(F.lit("<"), left), F.concat(F.lit(">"), right)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words (word, n) one inserted, deleted or replaced letter apart, each pair once."""
    word, size = F.col("word"), F.length("word")
    rare = rare_bigrams(words).withColumn("size", size)

    def cut(at: Column) -> tuple[Column, Column]:
        return F.left(word, at), F.substring(word, at + 1, size)

    def keyed(rows: DataFrame, shift: int, half: Column, base: Column, at: Column) -> DataFrame:
        return rows.withColumn("half", half).select(F.xxhash64(F.lit(shift), base, "gram", at, "half").alias("key"), "word", "n")

    same = keyed(rare, 0, _halves(size, *cut(F.expr("size div 2"))), F.col("size"), F.col("at"))
    short = rare.withColumn("at", F.explode(F.array("at", F.col("at") + 1)))
    short = keyed(short, 1, _halves(size, *cut(F.expr("size div 2"))), F.col("size"), F.col("at"))
    # The longer word's parts that meet the halves of a word one letter shorter.
    middle = F.expr("(size - 1) div 2")
    long = keyed(rare, 1, _halves(size, F.left(word, middle), F.substring(word, middle + 2, size)), F.col("size") - 1, F.col("at"))
    one = same.unionByName(short).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = same.unionByName(long).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    found = one.join(other.hint("merge"), "key").filter("length(a) < length(b) or (length(a) = length(b) and a < b)").filter("levenshtein(a, b, 1) = 1")
    return found.select("a", "n_a", "b", "n_b").distinct()


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form): the end of each word's links.  Rounds double the length of links."""
    now, i = scratch.keep("links-0", links.select("word", F.col("form").alias("root"))), 0
    while now.join(now.select(F.col("word").alias("root")).hint("merge"), "root", "left_semi").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        i += 1
        now = scratch.keep(f"links-{i}", now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def spelling_groups(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep("words", count_words(docs, letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences))
    pairs = near_words(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("n_b").alias("on")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("n_a").alias("on")))).alias("p"))
    best = pairs.select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("on")).alias("m"), "o")).alias("best"))
    to = F.when(-F.col("best.m") >= F.col("n") * times, F.col("best"))
    known = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), to["o"].alias("form"), (-to["m"]).alias("form_n"))
    known = scratch.keep("forms", known)
    ends = roots(known.filter("form is not null"), scratch)
    return known.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("word", "n", "n_near", "form", "form_n", "root")


ORACLE = rf"""with recursive {CRC_TABLE},
runs as (select doc_id, w, count(*) c from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) w from documents where text is not null) where length(w) >= {LETTERS} group by doc_id, w),
spelt as (select w, c, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) hx from runs),
summed as (select w, c, {crc32_sql("hx")} h from spelt, crc_table),
words as materialized (select w, cast(sum(c) as bigint) n from
    (select case when h % {DAMAGE} = 0 then left(w, cast(h % length(w) as integer)) || substr(w, cast(h % length(w) + 2 as integer)) else w end w, c from summed)
  where length(w) >= {LETTERS} group by w having sum(c) >= {OCCURRENCES}),
cut as materialized (select w, n, i, left(w, cast(i as integer) - 1) || substr(w, cast(i as integer) + 1) d from (select w, n, unnest(range(1, length(w) + 1)) i from words)),
pairs as materialized (select x.w a, y.w b, y.n m from cut x join cut y on x.i = y.i and x.d = y.d and x.w <> y.w
  union select x.w, y.w, y.n from cut x join words y on x.d = y.w union select y.w, x.w, x.n from cut x join words y on x.d = y.w),
near as (select a, count(*) k, max(m) m from pairs group by a),
forms as materialized (select words.w, n, coalesce(k, 0) n_near, case when m >= {TIMES} * n then (select min(b) from pairs where pairs.a = words.w and pairs.m = near.m) end form, case when m >= {TIMES} * n then m end form_n from words left join near on words.w = near.a),
walk as (select w, w at_word, form from forms union all select walk.w, forms.w, forms.form from walk join forms on walk.form = forms.w),
ends as (select w, at_word root from walk where form is null)
select w as word, n, n_near, form, form_n, root from forms join ends using (w)"""
