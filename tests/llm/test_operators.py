"""The corpus operators against brute force, round trips and held-out accuracy, with all edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import (
    op1_chat_format as op1,
    op2_decontamination as op2,
    op3_hyperminhash as op3,
    op4_license_scan as op4,
    op5_fingerprints as op5,
    op6_suffix_dedup as op6,
    op7_substring_dedup as op7,
    op8_main_text as op8,
    op9_toxicity as op9,
    op10_source_mix as op10,
)
from lattica.llm import vector as v
from lattica.llm.components import roots
from lattica.llm.levenshtein import LexiconAutomaton, allowed_errors, distance

from ..compare import rows_of, rows_of_sql
from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # Extra columns with names that operators use.
    return df.withColumns({"score": F.lit(1), "spans": F.lit("x"), "key": F.lit(2), "position": F.lit(0.5), "_c": F.lit(1)}) if extra else df


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    words = ["a", "bb", "ccc", "é", "x1", "yy", "zq", "the", "Öl"]
    passages = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    out = []
    for i in range(50):
        t = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(0, 40)))
        for _ in range(rnd.randint(0, 3)):
            p, a = rnd.choice(passages).split(), rnd.randint(0, 30)
            t += " " + " ".join(p[a : a + rnd.randint(3, 60)]) + f" {rnd.random()}"
        out.append((i, t))
    # Null, empty, blank, one word, periodic, a copy, a row that repeats whole, and a very long text.
    out += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "a " * 300), (55, "ab" * 200), (56, out[3][1]), (57, out[4][1]), (57, out[4][1]), (58, " ".join(rnd.choice(words) for _ in range(4000)))]
    return out


def brute_bytes(docs, length):
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        hit = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((d, len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~hit])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_op6_equals_brute_force(spark, corpus, hot):
    got = op6.remove_repeats(documents(spark, corpus), 40, hot, anchor=8).select("row.doc_id", "_n_bytes", "_n_removed", "_n_spans", F.sha2("_kept", 256))
    assert sorted(map(tuple, got.collect())) == brute_bytes(corpus, 40)


def test_op6_run_length_index():
    rnd = random.Random(2)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 60))) for _ in range(20)]
    index = op6.RunLengthIndex(strings)
    got = index.matching_statistics()
    assert index.runs < index.bounds[-1]
    where = [(s, i) for s in range(20) for i in range(len(strings[s]))]
    for s, i in where:
        best = 0
        for t, j in where:
            if (s, i) != (t, j):
                k = 0
                while i + k < len(strings[s]) and j + k < len(strings[t]) and strings[s][i + k] == strings[t][j + k]:
                    k += 1
                best = max(best, k)
        assert got[index.bounds[s] + i] == best


@pytest.mark.parametrize("hot", [4096, 2])
def test_op7_equals_brute_force(spark, corpus, hot):
    once = sorted(set(corpus), key=lambda r: r[0])  # rows that repeat whole are one document
    seen, want = set(), {}
    for d, t in once:
        w = WORD.findall(t or "")
        hit = [False] * len(w)
        for i in range(len(w) - 11):
            k = tuple(w[i : i + 12])
            if k in seen:
                hit[i : i + 12] = [True] * 12
            seen.add(k)
        want[d] = (d, len(w), sum(hit), hashlib.sha256(" ".join(x for x, y in zip(w, hit, strict=True) if not y).encode()).hexdigest())
    got = op7.remove_repeats(documents(spark, corpus), 12, 3, hot).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want[d] for d, _ in corpus)


def shingles(text, k):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_op3_equals_brute_force(spark):
    rnd = random.Random(8)
    base = [rnd.choice("abcdefgh") + str(rnd.randint(0, 400)) for _ in range(150)]
    texts = []
    for i in range(120):  # one large group of near copies, some beyond the threshold of all others
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 9, 12, 16])):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 50)}"
        texts.append((i, " ".join(w)))
    texts += [(200 + i, " ".join(rnd.choice("pqrs") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    texts += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (305, texts[0][1].upper()), (306, texts[7][1]), (306, texts[7][1])]
    sets = [(i, shingles(t, 2)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))
    got = op3.near_components(documents(spark, texts), 2, 80).select("_id", "n_shingles", F.coalesce("component", "_id"))
    assert sorted(map(tuple, got.collect())) == want


def test_op3_estimate_is_close():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.concatenate((common, rng.integers(0, 1 << 63, 500).astype(np.uint64))), np.concatenate((common, rng.integers(0, 1 << 63, 500).astype(np.uint64)))
    r = op3.registers(np.concatenate((a, b)), np.array([0, 4500, 9000]))
    assert abs(op3.jaccard_estimate(r[:1], r[1:])[0] - 0.8) < 0.15


def test_op4_equals_sql_and_normalises(spark, duck):
    assert rows_of(op4.query(spark, SMALL)) == rows_of_sql(duck, op4.ORACLE)[1]
    mit = op4.KNOWN[0][1]
    texts = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (2, mit.replace("sublicense", "sub-licence")), (3, mit + " but not"), (4, "text\nReleased under the MIT Licence!\nmore"), (5, None), (6, "")]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in op4.scan(documents(spark, texts)).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None and got[4] == (None, ["MIT"])
    assert got[5] == (None, []) and got[6] == (None, [])
    mine = spark.createDataFrame([("X", "Hello, World")], "license_id string, text string")
    assert op4.scan(documents(spark, [(1, "hello world!")]), mine).first()["license_id"] == "X"


def test_op5_edits_and_fingerprints(spark, corpus):
    texts = [r for r in corpus if r[0] != 57]
    got = {r["doc_id"]: r for r in op5.fingerprints(documents(spark, texts)).collect()}
    ordered = sorted(texts)
    for k, (d, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1
    assert got[3]["fingerprint"] == got[56]["fingerprint"] and got[50]["fingerprint"] == got[51]["fingerprint"] != got[53]["fingerprint"]
    alone = op5.fingerprints(documents(spark, [(9, "a b c d e f")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_op5_band_join_finds_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    docs = documents(spark, [(1, base), (2, base + " end"), (3, " ".join(f"z{i}" for i in range(200))), (4, None)])
    assert [(r["a"], r["b"]) for r in op5.near_pairs(docs).collect()] == [(2, 1)]


def test_op8_pages(spark):
    w = op8.learn(["<nav><ul><li><a href=x>m</a></li></ul></nav><article><h1>t</h1><p>one two three</p></article>"] * 3)
    page = "<!DOCTYPE html><title>no</title><script>var t='</p>';</script><nav><li><a>menu</a></li></nav><div class=\"ad\">buy now</div><article><h1>A &amp; B</h1><p><b>Lead.<br><p>one\n two&nbsp;three</p><form>field</form><aside>side</aside><div class='comments'><p>I say</p></div></article><footer>&copy; x</footer>"
    assert op8.extract(page, w) == "A & B\nLead.\none two three"
    assert op8.extract(None, w) == op8.extract("", w) == op8.extract("<script>x", w) == ""
    assert op8.extract("plain words only", w) == "plain words only"
    pages = spark.createDataFrame([(1, "u", page), (None, None, None), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in op8.main_text(pages).collect())
    assert got[0] == (0, 0) and got[2] == (2, 0) and got[1][1] > 10


def test_op8_equals_the_article_of_every_small_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in op8.query(spark, SMALL).collect():
        a = pages[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        a = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", a))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in a.split("\0")) if x)


def test_op9_automaton_equals_edit_distance():
    rnd = random.Random(1)
    terms = [b"idiot", b"moron", b"worthless", b"loser", b"scum"]
    automaton = LexiconAutomaton(terms, [b"lowei"])
    words = [bytes(rnd.choice(b"idotmrnlesxwh") for _ in range(rnd.randint(1, 10))) for _ in range(800)]
    for t in terms:
        for _ in range(150):
            w = bytearray(t)
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(w)) if w else 0
                kind = rnd.randint(0, 2)
                if kind == 0 and w:
                    w[i] = rnd.choice(b"abcxyz")
                elif kind == 1:
                    w.insert(i, rnd.choice(b"abc"))
                elif w:
                    del w[i]
            words.append(bytes(w) or b"a")
    raw, at = np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words])))

    def want(w):
        if w.startswith(b"lowei"):
            return 3
        hits = [d for d, k in ((distance(w, t), allowed_errors(t)) for t in terms) if d <= k]
        return 0 if not hits else 1 if min(hits) == 0 else 2

    assert automaton.match(raw, at[:-1], at[1:], op9.FOLD).tolist() == [want(w) for w in words]


def test_op9_learns_flags_and_tells_quotation(spark):
    rnd = random.Random(3)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        w = [rnd.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(["idiot", "worthless", "pathetic"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, labels = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op9.train(docs, labels)
    assert set(model.terms) == {"idiot", "worthless", "pathetic"}
    probe = [(1, "you w1 idiot w2 w3"), (2, "you w1 Idiiot!! w2 worthles w3"), (3, "they said “idiot” and went w1"), (4, None), (5, ""), (6, "w1 w2 w3")]
    got = {r["doc_id"]: r["_score"] for r in op9.score(documents(spark, probe), model).collect()}
    assert got[1] >= 0.3 and got[3] < 0.3 and got[4] == got[5] == got[6] < 0.3
    held = op9.score(docs, model).join(labels, "doc_id").filter(op9.held_out(F.col("doc_id")))
    assert held.filter((F.col("_score") >= 0.3) != (F.col("toxic") == 1)).count() == 0
    none = op9.train(docs, labels.limit(0))
    assert op9.score(documents(spark, probe), none).count() == 6


def test_op10_equals_sql(spark, duck):
    got, want = rows_of(op10.query(spark, SMALL)), rows_of_sql(duck, op10.ORACLE)[1]
    assert got == want


def test_op10_shares(spark, corpus):
    p = op10.plan(documents(spark, corpus)).collect()
    taken, target = Counter(), {}
    for r in p:
        taken[r["row"]["source"]] += r["_taken"]
        target[r["row"]["source"]] = r["_target"]
        assert 0 <= r["_taken"] <= 2 * r["_size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["_size"] for r in p)) < 1e-6
    mixed = op10.mix(documents(spark, corpus)).collect()
    assert sum(r["words"] for r in mixed) == sum(taken.values())
    assert [r["position"] for r in mixed] == sorted(r["position"] for r in mixed)


def test_op1_blocks_agree_and_markers_decide(spark):
    rng = np.random.default_rng(1)
    rows = [(c, t, ("user", "assistant")[t % 2], ("w " * int(rng.integers(3, 9)) + "?") if t % 2 == 0 else "w " * int(rng.integers(30, 80))) for c in range(60) for t in range(6)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    model = op1.train(conv)
    got = op1.format_chats(conv, model).collect()
    assert sum(r["role"] == r["parsed_role"] for r in got) >= 0.95 * len(got)
    long = spark.createDataFrame([(7, i, None, "x" * int(rng.integers(1, 300)) if i % 9 else "User: hi") for i in range(400)], "conv_id long, turn long, role string, text string")
    codes = [r[0] for r in long.select("turn", *op1._observed(F.col("text"))).select("turn", op1.Model.code().alias("c")).orderBy("turn").select("c").collect()]

    def path_score(block):
        states = [op1.ROLES.index(r["parsed_role"]) for r in sorted(op1.format_chats(long, model, block).collect(), key=lambda r: r["turn"])]
        return sum(model.emit[c, s] + model.step[p, s] for c, s, p in zip(codes, states, [len(op1.ROLES), *states], strict=False))

    # Ties may be broken otherwise, but the path is as good.
    assert path_score(5) == path_score(4000)
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, "user", ""), (1, 1, None, "Assistant: yes"), (1, 1, None, "Assistant: yes")], "conv_id long, turn long, role string, text string")
    out = op1.format_chats(odd, model).collect()
    assert len(out) == 4 and all(r["parsed_role"] for r in out)
    assert [r["rendered"] for r in out if r["parsed_role"] == "assistant"][0] == "<|assistant|>\nyes<|end|>"
    lines = op1.lines_of(spark.createDataFrame([(1, "User: hello?\n\n### Assistant: hi")], "conv_id long, text string"))
    assert [r["parsed_role"] for r in sorted(op1.format_chats(lines, model).collect(), key=lambda r: r["turn"])] == ["user", "assistant"]


def test_op2_templates_and_slots(spark):
    item = "If Alice has 3 apples and Bob has 5 apples then how many apples do Alice and Bob have together in the basket"
    bench = spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "")], "item_id long, text string")
    texts = [
        (1, "Intro. " + item + " End."),
        (2, "If Carol has 7 apples and Dave has 9 apples then how many apples do Carol and Dave have together in the basket"),
        (3, "Nothing of this kind stands in here at all, not even eight words in a row."),
        (4, "It is a short item here"),
        (5, None),
        (6, ""),
        (7, "If Carol has 7 apples and Dave has 9 apples then how many people do Erin and Frank know around the whole wide world"),
    ]
    long = " ".join(f"w{i}" for i in range(80))
    bench = bench.unionAll(spark.createDataFrame([(5, long)], "item_id long, text string"))
    texts += [(8, "so " + " ".join(long.split()[30:43]) + " yes"), (9, "so " + " ".join(long.split()[30:40]) + " yes")]
    got = {r["doc_id"]: r["_items"] for r in op2.decontaminate(documents(spark, texts), bench).collect()}
    assert got[8] == [5] and got[9] == []
    assert got[1] == [1] and got[2] == [1] and got[4] == [2]
    assert got[3] == got[5] == got[6] == got[7] == []


def test_op2_finds_every_planted_item(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {tuple(w[i : i + 8]): r["item_id"] for r in items for w in [words(r["text"])] for i in range(len(w) - 7)}
    want = {d for d, t in docs.items() if any(tuple(w[i : i + 8]) in grams for w in [words(t)] for i in range(len(w) - 7))}
    got = {r["doc_id"] for r in op2.query(spark, SMALL).collect() if r["contaminated"]}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"\x64", b"\x65")], "a binary, b binary")
    got = {bytes(r["a"]): bytes(r["root"]) for r in roots(links).collect()}
    assert all(got[bytes([i])] == b"\x00" for i in range(1, 21)) and got[b"\x65"] == b"\x64"


def test_kernels():
    texts = ["", None, "one", " two  words\n", "é ü", "a b c d e f"]
    lo, raw, offsets = next(v.blocks(pa.array(texts)))
    start, end, h, first = v.words(raw, offsets)
    assert np.diff(first).tolist() == [0, 0, 1, 2, 2, 6] and len(set(h.tolist())) == len(h)
    again = list(v.blocks(pa.array(texts), 1))
    assert [h for _, r, o in again for h in v.words(r, o)[2].tolist()] == h.tolist()
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    assert v.sliding_minimum(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10"])
def test_empty_tables(spark, name):
    docs = documents(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    run = {
        "op2": lambda: op2.decontaminate(docs, bench),
        "op3": lambda: op3.near_components(docs),
        "op4": lambda: op4.scan(docs),
        "op5": lambda: op5.fingerprints(docs),
        "op6": lambda: op6.remove_repeats(docs),
        "op7": lambda: op7.remove_repeats(docs),
        "op9": lambda: op9.score(docs, op9.train(docs, labels)),
        "op10": lambda: op10.mix(docs),
    }[name]
    assert run().count() == 0


def test_op8_attributes_classes_and_regions():
    w = op8.learn(())
    article = lambda inner: op8.extract(f"<nav><a href=x>menu</a></nav><article>{inner}</article><footer>end</footer>", w)
    assert article("<p title=it's>Hello world don't go there</p><p>More.</p>") == "Hello world don't go there\nMore."
    assert article("<p class=\"a>b\">One two</p><img alt='x > y'><p data-x=\"'\">three</p>") == "One two\nthree"
    assert article('<p>Text</p><div class="share-price">Shares cost 5</div><section id="related-work">Others did this</section>') == "Text\nShares cost 5\nOthers did this"
    for mark in ("comments", "comments-section", "post-comments", "shareButtons", "ad-slot", "ad-300x250", "cookie-notice", "site_footer", "related-posts", "side-bar", "sr-only"):
        assert article(f'<p>Text</p><div class="x {mark}"><p>gone</p></div>') == "Text", mark
    for mark in ("search-results", "notice-period", "header-image", "commentary", "addition", "navigator-biography", "legal-history"):
        assert article(f'<p>Text</p><div class="{mark}"><p>stays</p></div>') == "Text\nstays", mark
    many = " ".join(["word"] * 40)
    parted = f'<body><div class="menu"><a href=1>a</a></div><div>{many} one.</div><div class="ad">{many} buy</div><div>{many} two.</div><div class="footer">{many}</div></body>'
    assert op8.extract(parted, w) == f"{many} one.\n{many} two."
    assert op8.extract("<SCRIPT>İİİ</script ><p>after</p>", w) == "after"
    assert article("<p>R&amp;D &am<b>p;</b> caf&eacute;&#33;</p>") == "R&D &amp; café!"
    assert article('<p>a "quoted <b class="x>y</b> end</p>').startswith('a "quoted')


def test_op8_learns_class_names():
    page = '<div class="teaser"><p>x y z</p></div><article><div class="story"><p>a b c</p></div></article>'
    w = op8.learn([page] * 20)
    assert w[".teaser"] < -1 and w[".story"] == 0


def test_op4_knows_licence_files(spark):
    known = dict(reversed(op4.KNOWN))
    body = {name: text for name, text in reversed(op4.KNOWN) if len(text) > 200}
    wrapped = lambda t: re.sub(r"(.{60,75}) ", r"\1\n", t)
    texts = [
        (1, "MIT License\n\nCopyright (c) 2019 Jane Doe\n\n" + body["MIT"], "MIT"),
        (2, "The MIT License (MIT)\n\nCopyright Jane Doe 2020\n\n" + wrapped(body["MIT"]), "MIT"),
        (3, "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\n" + body["ISC"], "ISC"),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2017, Author\nAll rights reserved.\n\n" + wrapped(body["BSD-3-Clause"]), "BSD-3-Clause"),
        (5, "# BSD 2-Clause License\n" + body["BSD-2-Clause"], "BSD-2-Clause"),
        (6, "Boost Software License - Version 1.0\n\n" + body["BSL-1.0"], "BSL-1.0"),
        (7, "zlib License\n\n(C) 1995 Someone\n\n" + body["Zlib"], "Zlib"),
        (8, wrapped(body["GPL-3.0-or-later"]), "GPL-3.0-or-later"),
        (9, wrapped(body["Unlicense"]), "Unlicense"),
        (10, "MIT License", None),
        (11, "Our MIT license story\n\n" + body["MIT"], None),
        (12, body["MIT-0"], "MIT-0"),
    ]
    got = {r["doc_id"]: r["license_id"] for r in op4.scan(documents(spark, [t[:2] for t in texts])).collect()}
    assert got == {i: want for i, _, want in texts}
    lines = op4.scan(spark.createDataFrame([(1, "x\nSPDX-License-Identifier: MPL-2.0\n"), (1, "other"), (None, "// SPDX-License-Identifier: LGPL-3.0-only"), (2, known["MPL-2.0"])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["notices"]) for r in lines) == [(0, ["LGPL-3.0-only"]), (1, []), (1, ["MPL-2.0"]), (2, ["MPL-2.0"])]


def plain_viterbi(model, codes):
    """Scores of the best path, step by step."""
    k = len(op1.ROLES)
    score = {k: 0.0}
    for c in codes:
        score = {t: max(s + model.step[p, t] for p, s in score.items()) + model.emit[c, t] for t in range(k)}
    return max(score.values())


@pytest.mark.parametrize("block", [3, 256])
def test_op1_equals_plain_viterbi(spark, block):
    rnd = random.Random(8)
    texts = ["User: hi there?", "Assistant: fine.", "why?", "because\nof\nthis", "Tool: 42", "", None, "ok", "System: be kind", "long " * 90]
    rows = [(c, t, None, rnd.choice(texts)) for c in range(4) for t in range(rnd.randint(1, 30))]
    # Null, negative and very negative turns, many texts of one turn, and rows that repeat.
    rows += [(9, None, None, f"{rnd.choice(texts)} {i}") for i in range(40)] + [(9, t, None, rnd.choice(texts)) for t in (-100000, -70000, -9, -2, -1, 0, 1, 5)] + [(9, 3, None, f"{rnd.choice(texts)} {i}") for i in range(25)]
    rows += [(None, 1, None, "User: x"), (None, 1, None, "User: x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = op1.train(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    got = op1.roles(df, model, block)
    seen = df.select(*op1._keys(), *op1._observed(F.col("text"))).select("_conv", "_turn", "_th", op1.Model.code().alias("m")).distinct().join(got, ["_conv", "_turn", "_th"]).collect()
    assert len(seen) == len({(r[0], r[1], r[3]) for r in rows}) == got.count()
    for conv in {r["_conv"] for r in seen}:
        path = sorted((r["_turn"], r["_th"], r["m"], r["_state"]) for r in seen if r["_conv"] == conv)
        states = [len(op1.ROLES), *(x[3] for x in path)]
        have = sum(model.step[p, s] + model.emit[x[2], s] for p, s, x in zip(states, states[1:], path, strict=False))
        assert have == plain_viterbi(model, [x[2] for x in path])


def test_op6_stage_keeps_cut_characters(spark):
    rnd = random.Random(4)
    shared = "".join(rnd.choice("éÖxyz ü€😀") for _ in range(150))
    texts = [(1, "€1" + shared + "😀 a"), (2, "é2" + shared[1:] + "😂 b"), (3, "alone"), (4, None)]
    out = {r["doc_id"]: r for r in op6.stage(spark, documents(spark, texts), "").collect()}
    b = {i: (t or "").encode() for i, t in texts}
    for i, t in texts:
        if i > 2:
            assert out[i]["text"] == t
            continue
        other, covered, n = b[3 - i], [False] * len(b[i]), 200
        for k in range(len(b[i]) - n + 1):
            if b[i][k : k + n] in other:
                covered[k : k + n] = [True] * n
        assert any(covered)
        want, at = "", 0
        for c in t:
            size = len(c.encode())
            want += "" if all(covered[at : at + size]) else c
            at += size
        assert out[i]["text"] == want and out[i]["n_chars"] == len(want)
