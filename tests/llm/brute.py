"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text, width=5):
    found = words(text)
    if len(found) < width:
        return Counter([tuple(found)]) if found else Counter()
    return Counter(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def near_classes(rows, threshold=0.8):
    """Class of each row (the least id) by comparing all pairs that share a shingle."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        if text is not None:
            by[("bytes", text)].append(i) if not bags[i] else None
        for s in bags[i]:
            by[s].append(i)
    pairs = {(i, j) for g in by.values() for k, i in enumerate(g) for j in g[k + 1 :]}
    for i, j in pairs:
        if (not bags[i] and not bags[j]) or similarity(bags[i], bags[j]) >= threshold:
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(key, least.get(root(i))) for i, (key, _) in enumerate(rows)]
