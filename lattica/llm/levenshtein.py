"""Levenshtein automata intersected with a lexicon trie, compiled to one table.

A state is the set of (trie node, errors so far) pairs reachable by the bytes
read; subset construction over the bytes that occur in the lexicon (all others
are one class) makes it deterministic.  All words of a block step through the
table together, one byte at a time; words whose set gets empty drop out.
"""

from __future__ import annotations

import numpy as np

#: What a word is: nothing, a term, a term misspelled, a word that begins with a stem.
NONE, EXACT, MISSPELLED, STEM = 0, 1, 2, 3


def allowed_errors(term: bytes) -> int:
    """Short terms must be exact; long ones may have one error, very long ones two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    def __init__(self, terms: list[bytes], stems: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        budget, ends, stem_end = [0], [False], [False]

        def insert(word: bytes) -> int:
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    budget.append(0)
                    ends.append(False)
                    stem_end.append(False)
                node = children[node][b]
            return node

        for t in terms:
            ends[insert(t)] = True
            node = 0
            budget[0] = max(budget[0], allowed_errors(t))
            for b in t:  # a node allows as many errors as some term below it
                node = children[node][b]
                budget[node] = max(budget[node], allowed_errors(t))
        # A term's own allowance is checked at its end.
        own = {insert(t): allowed_errors(t) for t in terms}
        for t in stems:
            stem_end[insert(t)] = True

        symbols = sorted({b for node in children for b in node})
        self.classes = np.full(256, len(symbols), dtype=np.uint8)
        for i, b in enumerate(symbols):
            self.classes[b] = i

        def close(pairs: set[tuple[int, int]]) -> frozenset:
            """Deletions of lexicon bytes; of one node only the fewest errors count."""
            best: dict[int, int] = {}
            stack = list(pairs)
            while stack:
                node, e = stack.pop()
                if e > budget[node] or best.get(node, 99) <= e:
                    continue
                best[node] = e
                stack += [(n, e + 1) for n in children[node].values()]
            return frozenset(best.items())

        start = close({(0, 0)})
        ids, todo, table = {frozenset(): 0, start: 1}, [start], {}
        absorbing = -1
        while todo:
            state = todo.pop()
            row = []
            for c in range(len(symbols) + 1):
                b = symbols[c] if c < len(symbols) else -1
                after: set[tuple[int, int]] = set()
                stem = False
                for node, e in state:
                    hit = children[node].get(b)
                    if hit is not None:
                        after.add((hit, e))
                        stem |= e == 0 and stem_end[hit]
                    after.add((node, e + 1))  # an inserted byte
                    after |= {(n, e + 1) for n in children[node].values() if n != hit}  # a substituted byte
                if stem:
                    row.append(absorbing)
                    continue
                nxt = close(after)
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            table[ids[state]] = row
        n = len(ids)
        # The table goes to every worker: two bytes a state where they are enough.
        self.next = np.zeros((n + 1, len(symbols) + 1), dtype=np.uint16 if n < 1 << 16 else np.int32)
        self.verdict = np.zeros(n + 1, dtype=np.uint8)
        for i, row in table.items():
            self.next[i] = [n if r == absorbing else r for r in row]
        self.next[n] = n
        self.verdict[n] = STEM
        for state, i in ids.items():
            errors = [e for node, e in state if ends[node] and e <= own[node]]
            if errors:
                self.verdict[i] = EXACT if min(errors) == 0 else MISSPELLED
        self.stem_state = n

    def match(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The verdict on each word raw[start:end], its bytes taken through the table ``fold``."""
        state = np.ones(len(start), dtype=np.int32)
        live, j = np.arange(len(start)), 0
        while len(live):
            live = live[(start[live] + j < end[live])]
            symbol = self.classes[fold[raw[start[live] + j]]]
            now = self.next[state[live], symbol]
            state[live] = now
            live = live[(now != 0) & (now != self.stem_state)]
            j += 1
        return self.verdict[state]


def distance(a: bytes, b: bytes) -> int:
    """Plain edit distance, for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]
