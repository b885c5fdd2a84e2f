"""Small fixtures and brute-force versions."""

from __future__ import annotations

import collections
import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, odd white space, empty and null texts, a long one."""
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    shared = prose(2, 40)
    docs = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, prose(3, 150) + "\n" + shared + "\n" + prose(4, 30)),
        (5, prose(5, 120) + " " + shared.replace(" ", "\t") + " " + prose(6, 20)),
        (6, ""),
        (7, None),
        (8, " \n\t "),
        (9, "one two"),
        (10, "ONE two"),
        (11, "x " * 80),
        (12, prose(7, 5000)),
        (13, "naïve 日本 \U0001f600 " + prose(8, 50)),
    ]
    return docs


def jaccard_classes(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_words(docs, size):
    words = {i: (t or "").encode().split() for i, t in docs}
    seen = collections.Counter(tuple(w[a : a + size]) for w in words.values() for a in range(len(w) - size + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - size + 1):
            if seen[tuple(w[a : a + size])] > 1:
                gone.update(range(a, a + size))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
