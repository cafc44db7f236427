"""Plain one-machine versions that the operators are held against."""

from __future__ import annotations

import itertools
import re


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k=5):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def classes(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_classes(rows, percent=75):
    """(doc_id, text) rows to {doc_id: component}, by every pair that shares a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    at = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(n)
    pairs = {p for ns in at.values() if len(ns) > 1 for p in itertools.combinations(ns, 2)}
    links = []
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= percent * len(x | y):
            links.append((sets[a][0], sets[b][0]))
    return classes({i for i, _ in sets}, links)
