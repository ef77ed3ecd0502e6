"""Decontamination, fingerprints and the stages of the pipeline against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import op2_decontamination as op2
from lattica.llm import op3_hyperminhash as op3
from lattica.llm import op5_fingerprints as op5

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOLID = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF](?:.*[0-9A-Za-z\x80-\U0010FFFF])?", re.S)


def fold(w):
    return re.sub("[A-Z]", lambda m: m[0].lower(), w)


def template(text):
    """[(kind or word, word)] of a text, word by word."""
    out, opens = [], True
    place = 0
    for m in WORD.finditer(text or ""):
        if place and "\n" in text[place : m.start()]:
            opens = True
        core = SOLID.search(m[0])
        if core:
            w = core[0]
            digits, letters, upper = (sum(bool(re.match(p, c)) for c in w) for p in ("[0-9]", r"[A-Za-z\x80-\U0010FFFF]", "[A-Z]"))
            size = sum(len(c.encode()) for c in w if not re.match("[0-9]", c) and re.match(r"[A-Za-z\x80-\U0010FFFF]", c))
            v = fold(w)
            if (digits and size <= 3 and re.match("[0-9]", w)) or v in op2.NUMBER_WORDS:
                kind = "#"
            elif v in op2.UNIT_WORDS:
                kind = "unit"
            elif re.match("[A-Z]", w) and not opens and upper < size:
                kind = "name"
            else:
                kind = None
            out.append((kind, v))
        opens = m[0][-1] in ".!?:"
        place = m.end()
    return out


def contaminated(doc, item):
    d, t = template(doc), template(item)
    w = min(8, len(t))
    if not w:
        return False

    def keys(words):
        out = []
        for i in range(len(words) - w + 1):
            part = words[i : i + w]
            rich = sum(k is None for k, _ in part) >= min(5, w)
            out.append((tuple(k or v for k, v in part) if rich else None, tuple(v for _, v in part)))
        return out

    have, want = keys(d), keys(t)
    # Template windows.
    first = {}
    for p, (key, _) in enumerate(want):
        if key is not None:
            first.setdefault(key, p)
    if first:
        found, lines = set(), {}
        for a, (key, _) in enumerate(have):
            if key in first:
                lines.setdefault(a - first[key], []).append((first[key], a))
        for rows in lines.values():
            means, back = {}, {}
            for p, a in sorted(rows):
                new, old = dict(means), dict(back)
                if all(new.setdefault(t[p + j][1], d[a + j][1]) == d[a + j][1] and old.setdefault(d[a + j][1], t[p + j][1]) == t[p + j][1] for j in range(w) if t[p + j][0]):
                    means, back = new, old
                    found.add(p)
        if len(found) >= min(6, int(np.ceil(0.4 * len(first) - 1e-9))) and found:
            return True
    # Stretches, where at most half of the windows have enough literals.
    plain = [i for i, (k, _) in enumerate(t) if k is None]
    q = min(5, len(plain))
    if 2 * sum(k is None for k, _ in want) >= len(want) and q >= 3:

        def runs(words):
            lits = [i for i, (k, _) in enumerate(words) if k is None]
            return [(a, z + 1, tuple(k or v for k, v in words[a : z + 1])) for a, z in zip(lits, lits[q - 1 :]) if z + 1 - a >= 8]

        first = {}
        for a, z, key in runs(t):
            first.setdefault(key, (a, z))
        found, lines = set(), {}
        for a, _, key in runs(d):
            if key in first:
                lines.setdefault(a - first[key][0], []).append((*first[key], a))
        for rows in lines.values():
            means, back = {}, {}
            for p, e, a in sorted(rows):
                new, old = dict(means), dict(back)
                if all(new.setdefault(t[p + j][1], d[a + j][1]) == d[a + j][1] and old.setdefault(d[a + j][1], t[p + j][1]) == t[p + j][1] for j in range(e - p) if t[p + j][0]):
                    means, back = new, old
                    found.add(p)
        if found and len(found) >= min(6, int(np.ceil(0.4 * len(first) - 1e-9))):
            return True
    if any(k is None for k, _ in want):
        exact = {e for _, e in want}
        if len(exact & {e for _, e in have}) >= max(1, min(6, int(np.ceil(0.4 * len(exact) - 1e-9)))):
            return True
    return False


def test_op2_equals_brute_force(spark):
    rnd = random.Random(6)
    plain = "the a of in how many apples does if has then buys more than each total what is left sold bag box and to per".split()
    names, units = ["Alice", "Bob", "Carol", "Dave"], ["km", "kg", "dollars"]

    def word():
        x = rnd.random()
        return rnd.choice(plain) if x < 0.6 else rnd.choice(names) if x < 0.72 else str(rnd.randint(1, 30)) if x < 0.9 else rnd.choice(units)

    items = [" ".join(word() for _ in range(rnd.randint(4, 30))) for _ in range(25)]
    items += ["12 7 9 30 4 4 8 21 5 6", "1 2 3", items[0], "", None, "Bob 3 km 4 kg and 5 dollars 6 7 8 Carol 9 per 1 2"]
    docs = []
    for i in range(120):
        item = rnd.choice([x for x in items if x])
        words = item.split()
        lo = rnd.randint(0, max(0, len(words) - 9))
        part = words[lo : lo + rnd.randint(6, 30)]
        if i % 3 == 1:  # other numbers and names, the same for the same
            change = {}
            part = [change.setdefault(w, str(rnd.randint(100, 999))) if w.isdigit() else change.setdefault(w, rnd.choice(["Erin", "Frank", "Grace"]) + "xy"[len(change) % 2]) if w in names else w for w in part]
        if i % 3 == 2:  # at odds
            part = [str(rnd.randint(100, 999)) if w.isdigit() else w for w in part]
        docs.append((i, " ".join([word() for _ in range(5)] + part + [word() for _ in range(5)])))
    docs += [(200, None), (201, ""), (202, "7"), (3, docs[3][1])]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(items)] + [(None, "a b c d e f g h i j")], "item_id long, text string").repartition(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("_items", F.lit("clash"))
    got = sorted((r["doc_id"], tuple(r["__items"])) for r in op2.decontaminate(frame, bench).collect())
    want = sorted((i, tuple(k for k, x in enumerate(items) if contaminated(t, x))) for i, t in docs)
    assert got == want and sum(bool(x) for _, x in want) > 30


def test_op2_finds_questions_made_of_numbers(spark):
    """Recall on items with few literals: copied as they stand all are found, with other numbers those with a window of five literals."""
    rnd = random.Random(2)
    heavy = [" ".join(str(rnd.randint(1, 999)) if rnd.random() < 0.7 else rnd.choice("plus minus times over equals find".split()) for _ in range(20)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(heavy)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"see the task {t} and solve it") for i, t in enumerate(heavy)], "doc_id long, text string")
    got = {r["doc_id"]: r["_items"] for r in op2.decontaminate(docs, bench).collect()}
    assert all(i in got[i] for i in range(40))


def test_op2_finds_slot_rich_questions_with_other_values(spark):
    """The two questions of the review, and generated ones of which over half are slots; other templates stay clean."""
    rnd = random.Random(8)
    asked = ["A train moves 60 km in 2 hours, how far in 5 hours?", "Was Alice 12 or 13 years old in 1999?"]
    changed = ["A train moves 80 km in 3 hours, how far in 7 hours?", "Was Bob 14 or 15 years old in 2001?"]
    odd = ["A train moves 80 km in 3 hours, how near in 7 hours?", "Was Bob 14 and 15 years old in 2001?"]
    verbs = "buys sells packs lends finds weighs ships paints counts stacks trades mixes".split()
    things = "apples boxes stones lamps cards coins books bricks ropes jars seeds bolts".split()

    def question():
        parts = [f"how {rnd.choice(verbs)}"]
        for _ in range(rnd.randint(3, 6)):
            parts.append(f"{rnd.choice(['Alice', 'Bob', 'Carol'])} {rnd.randint(2, 99)} or {rnd.randint(100, 999)} {rnd.choice(['km', 'kg', 'dollars'])} {rnd.choice(things)}")
        return " ".join(parts)

    def other(text):
        means = {}
        fresh = iter(rnd.sample(range(1000, 9000), 60))
        for w in text.split():
            if w.isdigit() or w in ("Alice", "Bob", "Carol"):
                means.setdefault(w, str(next(fresh)) if w.isdigit() else {"Alice": "Erin", "Bob": "Frank", "Carol": "Grace"}[w])
        return " ".join(means.get(w, w) for w in text.split())

    made = [question() for _ in range(60)]
    items = asked + made
    docs = [(i, f"some words before it. {t} and some words after") for i, t in enumerate(changed + [other(t) for t in made])]
    docs += [(1000 + i, f"some words before it. {t} and some words after") for i, t in enumerate(odd)]
    docs += [(2000 + i, question()) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["_items"] for r in op2.decontaminate(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert 0 in got[0] and 1 in got[1] and not got[1000] and not got[1001]
    recall = sum(i in got[i] for i in range(2, 62)) / 60
    assert recall >= 0.9, recall
    assert sum(bool(got[2000 + i]) for i in range(200)) <= 4


def test_op5_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = [(i * 3, " ".join(rnd.choice("ab cd éf gh ij".split()) for _ in range(rnd.randint(0, 40)))) for i in range(40)]
    texts += [(7, None), (8, ""), (9, "one"), (None, "no id here at all"), (None, "another without id"), (50, "x y z " * 9), (50, "x y z " * 9), (50, "x y z " * 9), (None, "no id here at all")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in op5.fingerprints(frame).collect())
    th = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    rows = sorted(((-1 << 63) if i is None else i, th[t], t or "") for i, t in texts)
    sig = lambda t: op5.signatures([t.encode()])[0]
    want = []
    for (i, _, t), (_, _, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = op5.edited(t, after)
        want.append((-1 if i < 0 else i, len(t), hashlib.sha256(e.encode()).hexdigest(), sig(t).tobytes().hex(), sig(e).tobytes().hex(), round(float((sig(t) == sig(e)).mean()), 6), round(float((sig(t) == sig(after)).mean()), 6)))
    assert got == sorted(want)


def shingles(t, k=5):
    w = [fold(x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = some(70)
    item = "what is the sum of all prime numbers below the square of the largest known answer here"
    rows = [(i, some(rnd.randint(20, 60))) for i in range(300)]
    toxic = set(range(0, 120, 4))
    rows = [(i, t + " idiot " + some(3) + " worthless scum" if i in toxic else t) for i, t in rows]
    near = rows[130][1].split()
    rows += [(400 + k, " ".join(near[:k] + ["changed"] + near[k + 1 :])) for k in (0, len(near) - 1)] + [(500, rows[131][1]), (501, rows[132][1]), (501, rows[132][1])]
    rows += [(600, some(10) + " " + passage + " " + some(12)), (601, some(14) + " é " + passage + " " + some(9)), (700, some(20) + " " + item + " " + some(20))]
    rows += [(800, None), (801, ""), (802, " \n"), (803, "word"), (None, some(25)), (900, some(3000))]
    folder = tmp_path_factory.mktemp("corpus")
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 803 else None, None if t is None else len(t), "kept", 1.0) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _score string, position double").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic


def test_stages_equal_brute_force(spark, corpus):
    folder, rows, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "mix":
            assert docs.columns == names
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    left = [(i, t) for i, t in rows if i not in toxic]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out["toxicity"]) == sorted((i is None, i or 0, t or "") for i, t in left)
    # Near copies: of each component the least (id, text hash) stays; texts without words stay.
    once = sorted({(-1 if i is None else i, t) for i, t in left}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingles(t) for _, t in once]
    root = list(range(len(once)))
    for a in range(len(once)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    stay = {once[root[a]][0] if sets[a] else once[a][0] for a in range(len(once))}
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out["near_dedup"]) == sorted(stay)
    assert not stay & {400, 500} and 501 not in stay and 130 in stay
    # Repeated strings of 200 bytes.
    before = {r["doc_id"]: r["text"] for r in out["near_dedup"]}
    after = {r["doc_id"]: r for r in out["suffix_dedup"]}
    count: dict = {}
    for t in before.values():
        b = (t or "").encode()
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    for i, t in before.items():
        b, hit = (t or "").encode(), set()
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit.update(range(k, k + 200))
        want = bytes(x for k, x in enumerate(b) if k not in hit).decode()
        assert (after[i]["text"] or "") == want and (t is None or after[i]["n_chars"] == len(want))
    assert len(after[600]["text"]) < len(before[600]) - 200
    assert sorted(str(r["doc_id"]) for r in out["decontamination"]) == sorted(str(i) for i in after if i != 700)
    mixed = out["mix"]
    assert {"position", "_position", "words"} <= set(mixed[0].asDict())
    assert [r["_position"] for r in mixed] == sorted(r["_position"] for r in mixed)
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in out["decontamination"]}
    taken: dict = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["words"]
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 5


def test_run_is_the_stages(spark, corpus):
    folder, rows, toxic = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in out}
    assert out and not ids & toxic and 700 not in ids and 400 not in ids


def test_stages_take_empty_tables(spark, corpus, tmp_path):
    folder, *_ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_op3_production_parameters(spark, corpus):
    folder, *_ = corpus
    rows = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is not null").select("doc_id", "text").collect()
    sets = {i: set() for i in {r["doc_id"] for r in rows}}
    texts = sorted({(r["doc_id"], r["text"] or "") for r in rows})
    keyed = [(i, shingles(t, 2)) for i, t in texts]
    root = {i: i for i in sets}
    for a in range(len(keyed)):
        for b in range(a):
            x, y = keyed[a][1], keyed[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root[keyed[a][0]], root[keyed[b][0]]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op3.query(spark, folder).collect() if r["doc_id"] is not None}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in keyed}
