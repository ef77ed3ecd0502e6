"""Ranked search, spelling groups and shards against SQL and plain rules, with all edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import op11_ranked_search as op11
from lattica.llm import op12_spelling as op12
from lattica.llm import op13_shards as op13

from ..compare import rows_of, rows_of_sql
from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("rank", "score", "n", "word", "size", "shard", "_h", "_s", "row")})


@pytest.mark.parametrize("op", [op11, op12, op13], ids=lambda m: m.__name__.rpartition(".")[2])
def test_query_equals_sql(spark, duck, op):
    df = op.query(spark, SMALL)
    names, expected = rows_of_sql(duck, op.ORACLE)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "naïve", "2024", "A", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 80))), f"s{i % 3}") for i in range(300)]
    rows += [(300, None, "s0"), (301, "", None), (302, " .,;", "s1"), (None, "w1 w2 w2", "s2"), (304, rows[3][1], "s0"), (304, rows[3][1], "s0"), (-5, rows[3][1], None), (305, "w1 " * 30000 + "w59", "s1")]
    return rows + [(400 + i, "w3 w4 w5 w6", "hot") for i in range(120)]


def brute_search(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(ts), len(ts)) for i, t, *_ in docs if (ts := terms(t))]
    n_docs, n_words = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, -(1 << 63) if i is None else i))
        out += [(item, r, None if i == -(1 << 63) else i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,leaf,item_bytes", [(op11.BLOCK_DOCS, op11.LEAF, op11.ITEM_BYTES), (64, 1, 150)])
def test_search_equals_brute_force(spark, texts, block, leaf, item_bytes):
    items = [(1, "w1 w50 W2 w2, naïve"), (2, "ünï Ünï w40 w41 w42"), (2, "w3"), (3, "nothing here"), (4, None), (5, ""), (6, "w59 A 2024 2024"), (None, "w7 w8"), (7, " ".join(f"w{i}" for i in range(60)))]
    got = op11.search(documents(spark, texts), spark.createDataFrame(items, ITEMS), 20, item_bytes, block, leaf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(texts, items, 20)


def test_search_of_empty_tables(spark, texts):
    docs, items = documents(spark, texts), spark.createDataFrame([(1, "w1")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text = ''"), items)):
        got = op11.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_treaps_keep_both_orders():
    rng = np.random.default_rng(2)
    docs, terms = np.nonzero(rng.random((500, 7)) < 0.3)
    block = op11.Treaps(np.arange(500), docs, terms, rng.integers(1, 6, len(docs)), 7)
    for t in range(7):
        a, b = int(block.start[t]), int(block.start[t + 1])
        seen, todo = [], [(int(block.root[t]), a, b, 0)]
        while todo:
            i, lo, hi, depth = todo.pop()
            assert lo <= i < hi and depth < 60
            seen.append(i)
            for child, x, y in ((int(block.left[i]), lo, i), (int(block.right[i]), i + 1, hi)):
                if child >= 0:
                    assert block.impact[child] <= block.impact[i]
                    todo.append((child, x, y, depth + 1))
        assert sorted(seen) == list(range(a, b))


def test_search_prunes():
    """Intervals that cannot enter the list are never scored."""
    rng = np.random.default_rng(3)
    n = 4000
    docs, terms = np.concatenate([np.flatnonzero(rng.random(n) < 0.5) for _ in range(2)]), None
    half = np.cumsum(np.diff(docs, prepend=-1) < 0)
    impact = np.where(rng.random(len(docs)) < 0.01, 10_000, rng.integers(1, 50, len(docs)))
    block, best = op11.Treaps(np.arange(n), docs, half, impact, 2), op11.Best(1, 20)
    scored = op11.traverse(block, np.array([0, 0]), np.array([0, 1]), np.array([1, 1]), best)
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, docs, impact)
    expected = sorted(zip((-total).tolist(), range(n)))[:20]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == expected
    assert scored < len(docs) / 2


def brute_spelling(docs, letters, occurrences, times):
    count = Counter()
    for i, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= letters and n >= occurrences}
    cuts = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for w in words:
        for v, i in cuts.get(w, ()):
            near[w].add(v)
            near[v].add(w)
    for group in cuts.values():
        for a, i in group:
            near[a] |= {b for b, j in group if i == j and a != b}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in form.items() if words[v] >= times * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()), key=repr)


def test_spelling_equals_brute_force(spark):
    rnd = random.Random(7)
    stems = ["banana", "bananana", "aaaaaa", "aaaaaaa", "éclair", "straßen", "network", "ananas"]
    tokens = []
    for s in stems:
        for _ in range(60):
            w, k = list(s), rnd.randrange(4)
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(w))
                w[i : i + (k != 0)] = {0: rnd.choice("abénx"), 1: "", 2: rnd.choice("aexß"), 3: w[i].upper()}[k]
            tokens += ["".join(w)] * rnd.choice((1, 2, 5, 30))
    rnd.shuffle(tokens)
    docs = [(i, " ".join(tokens[i::97]) + ".", "s") for i in range(97)] + [(97, None, "s"), (98, "", "s"), (None, "Banana banana2banana", "s"), (99, "x" * 2000, "s"), (3, "network", "s"), (3, "network", "s")]
    for letters, occurrences in ((6, 5), (4, 1)):
        got = op12.spelling_groups(documents(spark, docs), letters, occurrences).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(map(tuple, got.collect()), key=repr) == brute_spelling(docs, letters, occurrences, 5)


def test_roots_follow_long_chains(spark):
    from lattica.llm.common import Scratch

    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(23)] + [("v", "w20")], "word string, form string")
    got = {r.word: r.root for r in op12.roots(links, Scratch(spark, "test")).collect()}
    assert got == {f"w{i}": "w23" for i in range(23)} | {"v": "w23"}


def test_spelling_of_empty_tables(spark, texts):
    docs = documents(spark, texts)
    for d in (docs.limit(0), docs.filter("text is null")):
        assert op12.spelling_groups(d).count() == 0


def test_spelling_broadcasts_bigrams_only(spark, tmp_path, monkeypatch):
    """The planner takes a written table for its compressed size, so exploded words would go through the driver."""
    from lattica.llm.common import Scratch

    plans, keep = [], Scratch.keep
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Scratch, "keep", lambda self, name, df: (plan(df), keep(self, name, df))[1])
    spark.createDataFrame([(f"word{chr(97 + i)}s", 5 + 40 * i) for i in range(20)], "word string, n long").write.parquet(str(tmp_path / "words"))
    plan(op12.near_words(spark.read.parquet(str(tmp_path / "words"))))
    plan(op12.spelling_groups(documents(spark, [(i, f"letter{chr(97 + i % 3)} " * (1 + 9 * (i % 3)), "s") for i in range(30)])))
    op12.roots(spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "word string, form string"), Scratch(spark, "test"))
    joins = {j for p in plans for j in re.findall(r"(\w+Join) \[(\w+)#", p)}
    assert joins >= {("SortMergeJoin", "key"), ("SortMergeJoin", "word"), ("SortMergeJoin", "root")}
    assert {k for j, k in joins if j != "SortMergeJoin"} == {"gram"}


@pytest.mark.parametrize("shards", [24, 7])
def test_shards_hold_the_mixture(spark, texts, shards):
    docs = documents(spark, texts)
    rows = op13.plan(docs, shards).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    share = Counter((r._s, r._sn) for r in rows)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        for key, n in Counter((r._s, r._sn) for r in held).items():
            assert abs(n - share[key] * len(held) / len(rows)) <= 2.5
    sizes = sorted((r._size, r._crc) for r in rows)
    assert sizes == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in texts)


def test_shards_of_repeated_rows_and_other_columns(spark, texts, tmp_path):
    docs = documents(spark, [(1, "same", "a")] * 50 + [(1, "same", None)] * 3 + texts).withColumn("slot", F.rand(3))
    placed = op13.shard(docs, 5)
    assert placed.columns == [*docs.columns, "_shard", "_slot"]
    got = placed.select("doc_id", "text", "source", "_shard", "_slot").collect()
    assert sorted((r[:3] for r in got), key=repr) == sorted((tuple(r) for r in docs.select("doc_id", "text", "source").collect()), key=repr)
    assert len({(r._shard, r._slot) for r in got}) == len(got)
    op13.write(docs, str(tmp_path / "out"), 5, parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("_shard").count().count() == 5
    assert op13.plan(docs.limit(0)).count() == 0
    assert sorted(r.shard for r in op13.plan(docs.limit(3)).collect()) == [0, 8, 16]
