"""Plain versions of the operators, quadratic where that is simplest."""

import re
from collections import Counter


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1)))


def near_classes(rows, w, percent):
    """{doc_id: (n_shingles, component)} for rows of (doc_id, text)."""
    sets = [(i, shingles(t, w)) for i, t in rows]
    c = Sets()
    for a, (i, s) in enumerate(sets):
        c.root(i)
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= percent * len(s | o):
                c.join(i, j)
    return {i: (len(s), c.root(i)) for i, s in sets}


def leaks(docs, items, similarity=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = set()
    for d, text in docs:
        w = words(text)
        for i, t in items:
            b = words(t)
            if len(b) < 5:
                continue
            for s in range(max(1, len(w) - len(b) + 1)):
                x, y = bag(w[s : s + len(b)]), bag(b)
                common = sum((x & y).values())
                if common and common / (sum(x.values()) + sum(y.values()) - common) >= similarity:
                    out.add((d, i))
                    break
    return out
