"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_dedup(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple]:
    least: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, t in texts:
        for p in range(len(t) - window + 1):
            k = t[p : p + window]
            least[k] = min(i, least.get(k, i))
    out = {}
    for i, t in texts:
        m = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if least[t[p : p + window]] < i:
                m[p : p + window] = True
        kept = bytes(b for b, g in zip(t, m) if not g)
        spans = sum(1 for p in range(len(t)) if m[p] and (p == 0 or not m[p - 1]))
        out[i] = (len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(docs: list[tuple[int, str | None]], window: int = 35) -> dict[int, tuple]:
    seen: dict[tuple, int] = defaultdict(int)
    texts = [(i, WORD.findall(t or "")) for i, t in docs]
    for _, w in texts:
        for p in range(len(w) - window + 1):
            seen[tuple(w[p : p + window])] += 1
    out = {}
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fingerprint(text: str | None, words: int = 4) -> int:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near_duplicates(docs: list[tuple[int, str | None]], radius: int = 4) -> dict[int, tuple]:
    fp = {i: fingerprint(t) for i, t in docs}
    up = {i: i for i in fp}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    distinct = defaultdict(list)
    for i, f in fp.items():
        distinct[f].append(i)
    for ids in distinct.values():
        for i in ids:
            a, b = sorted((root(i), root(ids[0])))
            up[b] = a
    fs = list(distinct)
    arr = np.array(fs, np.uint64)
    for k, f in enumerate(fs):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1 :] ^ np.uint64(f)) <= radius):
            a, b = sorted((root(distinct[f][0]), root(distinct[fs[k + 1 + int(j)]][0])))
            up[b] = a
    return {i: (f"{fp[i]:016x}", root(i)) for i in fp}


def top_k(rows: list[tuple[int, list[float] | None]], k: int = 5) -> list[tuple]:
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 50:
            continue
        best = sorted(((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in good if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def near_copies(docs: list[tuple[int, str | None]], words: int = 5, least: float = 0.8) -> dict[int, int]:
    """The smallest id reachable by links of texts whose word shingles have a Jaccard similarity of ``least`` or more."""
    sets, up = {}, {i: i for i, _ in docs}
    for i, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i]) < least * len(sets[j]) - 1e-9:
                break
            n = len(sets[i] & sets[j])
            if n / (len(sets[i]) + len(sets[j]) - n) >= least:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}
