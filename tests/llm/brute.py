"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(ASCII_LOWER)


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def secrets(docs):
    """doc_id -> (n_assign, n_access, n_hex, base_sha256)"""
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), k, name, m.end()) for k, (name, rx, ok) in enumerate(kinds) for m in rx.finditer(text or "") if ok(m)]
        joined = ",".join(f"{name}:{b}:{e}" for b, _, name, e in sorted(spans))
        out.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    return out


def contamination(docs, items, window=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    found = defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            found[tuple(words[i : i + n])].add(str(item))
    lengths = {len(k) for k in found}
    out = []
    for doc_id, text in docs:
        words, hit, ids = alnum_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (own := found.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= own
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, n=3):
    words = space_words(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_components(docs, p=90, q=100, n=3):
    """(doc_id, n_shingles, component_id)"""
    sets = [(d, shingle_set(t, n)) for d, t in docs]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    edges = []
    for k, (d, s) in enumerate(sets):
        for other, both in Counter(j for g in s for j in where[g] if j < k).items():
            if q * both >= p * (len(s) + len(sets[other][1]) - both):
                edges.append((d, sets[other][0]))
    group = union_find({d for d, _ in sets if d is not None}, [e for e in edges if None not in e])
    return [(d, len(s), group.get(d)) for d, s in sets]
