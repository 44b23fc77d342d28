"""Suffix-array dedup of byte strings across documents.

Candidate stretches come from ``winnow``. Where several different contents share a gram, their suffixes are sorted: a bottom-up
mergesort whose merges rank each suffix in the sibling run by binary search; a comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes, in a logarithmic number of steps. Neighbours in the sorted array with a
common extension of at least the window are equal windows, verified byte by byte, and take the least document id of their run.

A byte goes if a window that covers it also starts in a document with a smaller id; windows are judged on the input.

A stretch that is the only content around its gram has no equal windows inside (of equal windows the leftmost least gram differs in
place), so its suffixes aren't sorted: its windows' least id is that of its copies.

Defined cases: null texts are empty; texts shorter than a window stay whole; rows that repeat an id don't delete each other (no
id is smaller); ties can't arise; a null id counts as the least; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from questlake.llm.winnow import Met, Part, Rule, Spec, dedup, in_runs, powers, prefix_hashes

WINDOW = 50


def _extension(h: np.ndarray, inv: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The common extension of suffixes a and b, up to ``most``, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most)
    ha, hb, ia, ib = h[a], h[b], inv[a], inv[b]
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi + 1) // 2, lo)
        same = (h[a + mid] - ha) * ia == (h[b + mid] - hb) * ib
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def sorted_suffixes(text: np.ndarray, suffix: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix starts sorted by their first ``window`` bytes within each group (``group`` ascending), and whether each equals its
    predecessor. All suffixes have a whole window in ``text``. The first eight bytes deal them out; mergesort does the rest.

    Raises ValueError if the verification finds a hash collision.
    """
    h, n = prefix_hashes(text.astype(np.uint64) + np.uint64(1)), len(suffix)
    inv = powers(len(text) + 1)[1]
    head = np.zeros(n, np.uint64)
    for i in range(min(8, window)):
        head = head << np.uint64(8) | text[suffix + i]
    order = np.lexsort((head, group))
    suffix, group, head = suffix[order], group[order], head[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (head[1:] != head[:-1])])
    size = np.diff(np.r_[first, n])
    start, stop = np.repeat(first, size), np.repeat(first + size, size)
    order, run = suffix.copy(), 1
    while (live := np.flatnonzero(stop - start > run)).size:
        inside = live - start[live]
        block = inside // run
        base = start[live] + (block & ~1) * run
        lo = start[live] + (block ^ 1) * run
        hi = np.minimum(lo + run, stop[live])
        lo = np.minimum(lo, stop[live])
        sib = lo.copy()
        odd = (block & 1).astype(bool)
        mine = order[live]
        while (at := np.flatnonzero(lo < hi)).size:
            mid = (lo[at] + hi[at]) // 2
            a, b = order[mid], mine[at]
            ext = _extension(h, inv, a, b, window)
            e = np.minimum(ext, window - 1)
            less = (ext < window) & (text[a + e] < text[b + e])
            right = less | (odd[at] & (ext >= window))  # equal suffixes keep their order
            lo[at] = np.where(right, mid + 1, lo[at])
            hi[at] = np.where(right, hi[at], mid)
        placed = order.copy()
        placed[base + inside % run + (lo - sib)] = mine
        order, run = placed, 2 * run
    same = np.zeros(n, bool)
    if n > 1:
        near = np.flatnonzero(start[1:] == start[:-1]) + 1
        a, b = order[near - 1], order[near]
        same[near] = _extension(h, inv, a, b, window) >= window
        views = np.lib.stride_tricks.sliding_window_view(text, window)
        for at in range(0, len(near), 1 << 16):
            k = near[at : at + (1 << 16)]
            x, y = views[order[k - 1]], views[order[k]]
            equal = (x == y).all(axis=1)
            differ = (x != y).argmax(axis=1)[:, None]
            falls = ~equal & (np.take_along_axis(x, differ, 1) > np.take_along_axis(y, differ, 1))[:, 0]
            if (equal != same[k]).any() or falls.any():
                raise ValueError("a hash collision")
    return order, same


def by_suffix_sort(met: Met, window: int = WINDOW) -> list[bytes]:
    """The least id of each window's occurrences, or b"" for rows none of whose documents has a greater id than any of its windows."""
    least: dict[bytes, int] = {}
    groups: dict[int, dict[bytes, None]] = {}
    for c, h, v in zip(met.contents, met.anchors.tolist(), met.values.tolist()):
        if (was := least.get(c)) is None or v < was:
            least[c] = v
        groups.setdefault(h, {})[c] = None
    found: dict[bytes, tuple[int, bytes]] = {}  # the least of all, and the answer
    batch: list[list[bytes]] = []
    held = 0

    def flush() -> None:
        if not batch:
            return
        flat = [c for g in batch for c in g]
        text = np.frombuffer(b"".join(flat), np.uint8)
        sizes = np.array([len(c) for c in flat])
        at = np.cumsum(sizes) - sizes
        n = sizes - window + 1
        first = np.cumsum(n) - n
        suffix = np.repeat(at - first, n) + np.arange(n.sum())
        group = np.repeat(np.repeat(np.arange(len(batch)), [len(g) for g in batch]), n)
        value = np.repeat(np.array([least[c] for c in flat]), n)
        out = np.empty(len(text), np.int64)
        try:
            order, same = sorted_suffixes(text, suffix, group, window)
            of = np.empty(len(text), np.int64)
            of[suffix] = value
            runs = np.flatnonzero(~same)
            out[order] = np.repeat(np.minimum.reduceat(of[order], runs), np.diff(np.r_[runs, len(order)]))
        except ValueError:  # sort by bytes where hashes collide
            best: dict[bytes, int] = {}
            raw = text.tobytes()
            for s, v in zip(suffix.tolist(), value.tolist()):
                k = raw[s : s + window]
                best[k] = min(v, best.get(k, v))
            for s in suffix.tolist():
                out[s] = best[raw[s : s + window]]
        each = out[suffix]
        low, high = np.minimum.reduceat(each, first), np.maximum.reduceat(each, first)
        one = low.astype("<i8").tobytes()
        for i, (c, k, m, lo, hi) in enumerate(zip(flat, first.tolist(), n.tolist(), low.tolist(), high.tolist())):
            found[c] = lo, one[8 * i : 8 * i + 8] if lo == hi else in_runs(each[k : k + m])
        batch.clear()

    for g in groups.values():
        if len(g) > 1:  # one content has no equal windows inside: its suffixes need no order
            batch.append(sorted(g))
            held += sum(map(len, g))
            if held > 1 << 20:
                flush()
                held = 0
    flush()
    alone = lambda c: (least[c], least[c].to_bytes(8, "little", signed=True))
    return [a if low < last else b"" for c, last in zip(met.contents, met.lasts.tolist()) for low, a in (found.get(c) or alone(c),)]


def _rows(part: Part, mask: np.ndarray) -> list[tuple]:
    out = []
    for doc, a, b in zip(part.ids.tolist(), part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
        m = mask[a:b]
        gone = int(m.sum())
        spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if gone else 0
        kept = part.data[a:b][~m].tobytes() if gone else part.data[a:b].tobytes()
        out.append((None if doc == np.iinfo(np.int64).min else doc, b - a, gone, spans, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 20, hot: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) a document."""
    fields = [("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    rule = Rule(lambda met: by_suffix_sort(met, window), False, np.iinfo(np.int64).max, lambda v, doc: v < doc, _rows, fields)
    return dedup(docs, Spec(window, gram, False, hot), rule, id_col, text_col)
