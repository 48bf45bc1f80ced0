"""Brute-force versions of the operators for small inputs: plain Python over all rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def substring_dedup(rows, window=20):
    """rows: (doc_id, text), ids distinct.  {doc_id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            if k in seen:
                gone[s:s + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def suffix_dedup(rows, window=400):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[s:s + window] for s in range(len(b) - window + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if count[b[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def jaccard_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for k, (_, s) in enumerate(sets):
        both = Counter(j for x in s for j in by[x] if j < k)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def pieces(rows, tokenizer, capacity=2048):
    """{(doc_id, piece): (start, length, crc)} with the tokenizer run on whole texts."""
    import struct
    import zlib

    out = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out[i, p] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    return out


def katz(rows, depth=5, keep=0.05):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)} by dictionaries over all rows."""
    import math
    import zlib

    docs = [(i, zlib.crc32(str(i).encode()) % 10 == 0, (t or "").encode().lower().split() + [b" end"]) for i, t in rows]
    uni, big, ctx = Counter(), Counter(), defaultdict(set)
    first = Counter()
    for _, held, w in docs:
        if not held:
            uni.update(w)
            for h, x in zip([b" start"] + w, w):
                big[h, x] += 1
                ctx[h].add(x)
                first[h] += 1
    total, vocab = sum(uni.values()), len(uni)

    def disc(counts):
        nr = Counter(counts)
        d = {r: (r - 0.5) / r for r in range(1, depth + 1)}
        if nr[1]:
            cut = (depth + 1) * nr[depth + 1] / nr[1]
            for r in d:
                if nr[r] and cut < 1:
                    x = ((r + 1) * nr[r + 1] / (r * nr[r]) - cut) / (1 - cut)
                    if 0 < x < 1:
                        d[r] = x
        return lambda c: d[c] * c if c <= depth else c - keep
    du, db = disc(uni.values()), disc(big.values())
    left = 1 - sum(du(c) for c in uni.values()) / total if total else 1.0

    def p1(x):
        return du(uni[x]) / total if uni[x] else left

    alpha = {}

    def p2(h, x):
        if big[h, x]:
            return db(big[h, x]) / first[h]
        if h not in first:
            return p1(x)
        if h not in alpha:
            alpha[h] = (1 - sum(db(big[h, y]) for y in ctx[h]) / first[h]) / (1 - sum(p1(y) for y in ctx[h]))
        return alpha[h] * p1(x)
    out = {}
    for i, held, w in docs:
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (vocab + 1))) for x in w)
        out[i] = (held, len(w), sum(uni[x] > 0 for x in w), total, base, sum(math.log10(p2(h, x)) for h, x in zip([b" start"] + w, w)))
    return out, p2, uni
