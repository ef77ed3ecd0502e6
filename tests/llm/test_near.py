"""Near copies against brute force."""

from __future__ import annotations


def test_near_pairs_connect_what_brute_force_connects(spark):
    import random
    from itertools import combinations

    from lattica.llm import op5_fingerprints as op5

    rnd = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def changed(words, places):
        return [f"x{rnd.random()}" if i in places else w for i, w in enumerate(words)]

    docs = []
    for g in range(2):
        own = [f"g{g}{w}" for w in base]
        # Forty least ids that are under the threshold of the two near copies, and stand in every band of theirs.
        docs += [(g * 100 + k, " ".join(changed(own, set(rnd.sample(range(300), 9))))) for k in range(40)]
        docs += [(g * 100 + 50 + k, " ".join(changed(own, {100 * k + 50}))) for k in range(2)]
    # One id with two near texts, and equal rows.
    docs += [(1, docs[1][1] + " end"), docs[3], docs[3]]
    nodes = sorted(set(docs))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in nodes]
    sig = op5.signatures([t.encode() for _, t in nodes]).reshape(len(nodes), -1, op5.BAND)
    near = {(j, i): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in combinations(range(len(nodes)), 2) if (sig[i] == sig[j]).all(axis=1).any()}

    def groups(links):
        root = {i: i for i, _ in nodes}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {i: top(i) for i in root}

    wanted = {(nodes[i][0], nodes[j][0]) for (i, j), s in near.items() if s >= 0.8}
    star = set()
    for band in range(sig.shape[1]):
        first = {}
        for i in range(len(nodes)):
            j = first.setdefault(sig[i, band].tobytes(), i)
            if j != i and near[i, j] >= 0.8:
                star.add((nodes[i][0], nodes[j][0]))
    assert groups(star) != groups(wanted)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = op5.near_pairs(frame).collect()
    assert groups([(r["a"], r["b"]) for r in got]) == groups(wanted)
    assert {(r["a"], r["b"]) for r in got} <= wanted and (1, 1) in {(r["a"], r["b"]) for r in got}
    assert len(got) == len(set(got))
