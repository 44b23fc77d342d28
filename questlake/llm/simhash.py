"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits). Of two fingerprints that differ in at most four bits, some
segment differs in at most one (4 // 3). Two segments differ in at most one bit exactly if, for some position, they agree once
that bit is deleted; so each fingerprint is indexed under its 64 one-wildcard variants, equal variants meet, and Hamming
distance verifies them.

Only distinct fingerprints enter the index, so groups of copies of any size count once. Fingerprints are dealt by the equal half of
a segment, and its variants are made where they meet; each task checks its equal-key runs and gives a spanning forest of the links,
never all pairs. Components come from alternating large-star and small-star rounds over tables in the shared folder.

Defined cases: null or blank texts have fingerprint zero and link like any other; repeated rows and ties keep one row each in the
output; a null doc_id is never the smallest id, so only a component without any id has none; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.llm.common import add_columns, kept_only, parallelism, utf8_rows, written
from questlake.llm.graph import components, joined
from questlake.session import importable

SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(w: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles; a shorter text is one, a text without words none."""
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, max(1, len(w) - words + 1))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(h):
        return 0
    by_byte = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint_of(text: bytes, words: int = 4) -> int:
    """The fingerprint of a text: A-Z lower-cased, ASCII white space splits."""
    return majority(shingle_hashes(text.lower().split(), words))


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a long ``fp``; whole texts."""

    def start():
        return lambda batch: [[fingerprint_of(x, words) for x in utf8_rows(batch.column(batch.schema.get_field_index(text_col)))]]

    return add_columns(docs, [text_col], [("fp", pa.int64(), T.LongType())], start, keep)


def _halves() -> list[tuple[int, int, int, int]]:
    """(first bit, bits, first bit of the other half, its bits) for both halves of each segment."""
    out = []
    for at, width in SEGMENTS:
        low = width // 2
        out += [(at, low, at + low, width - low), (at + low, width - low, at, low)]
    return out


def _bits(fps: np.ndarray, at: int, width: int) -> np.ndarray:
    return (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)


def _wildcards(part: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The segment halves without one bit, for each bit in turn."""
    for bit in range(width):
        low = np.uint64((1 << bit) - 1)
        yield ((part >> np.uint64(1)) & ~low) | (part & low)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, over links a-b."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if not (m := x != y).any():
            break
        a, b, x, y = a[m], b[m], x[m], y[m]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    m = label != np.arange(len(nodes))
    return nodes[m], nodes[label[m]]


def _links_in(keys: np.ndarray, fps: np.ndarray, radius: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints of equal key; pairs are checked in blocks of bounded size."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])] if len(keys) else np.zeros(0, bool)
    keys, fps = keys[fresh], fps[fresh]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    a, b, held, step = [], [], 0, 1
    while len(at := at[at + step < end[at]]):
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        a.append(fps[at[near]])
        b.append(fps[at[near] + step])
        held += int(near.sum())
        if held > most:
            x, y = _forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
            most = max(most, 2 * len(x))
        step += 1
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(distinct: DataFrame, partitions: int, radius: int = RADIUS) -> DataFrame:
    """Spanning links (u, v), u > v, among the distinct ``fp`` of ``distinct``; connectivity is that of all links.

    Of two segments that differ in at most one bit, one half is equal. So a fingerprint is dealt by the six halves of its segments, a
    row each, and the one-wildcard variants of a segment are made and joined where its half is.
    """
    if radius >= 2 * len(SEGMENTS):
        raise ValueError("one-wildcard variants of three segments find up to five bits")
    halves = _halves()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            key = np.concatenate([_bits(fps, at, width) | np.uint64(k << 16) for k, (at, width, _, _) in enumerate(halves)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.tile(fps.view(np.int64), len(halves)))], names=["half", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, fp = np.concatenate(keys), np.concatenate(fps).view(np.uint64)
            a, b = [], []
            for k in np.unique(key >> 16).tolist():  # one half of one segment, all its values
                m = key >> 16 == k
                _, _, at, width = halves[k]
                for variant in _wildcards(_bits(fp[m], at, width), width):
                    x, y = _links_in(key[m].view(np.uint64) << np.uint64(width) | variant, fp[m], radius)
                    a.append(x)
                    b.append(y)
            hi, lo = (x.view(np.int64) for x in _forest(np.concatenate(a), np.concatenate(b)))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(hi, lo)), pa.array(np.minimum(hi, lo))], names=["u", "v"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held > 1 << 19 and (cut := int(np.searchsorted(key, keys[-1][-1], side="right"))) < len(key):
                keys.append(key[:cut])
                fps.append(fp[:cut])
                yield out()
                keys, fps, held, key, fp = [], [], 0, key[cut:], fp[cut:]
            if len(key):
                keys.append(key)
                fps.append(fp)
                held += len(key)
        if held:
            yield out()

    rows = distinct.select("fp").mapInArrow(deal, "half long, fp long").repartition(partitions, "half").sortWithinPartitions("half")
    return rows.mapInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row a document: its id, ``fp`` and ``component_id`` (the smallest id reachable by links)."""
    importable(docs.sparkSession)
    with kept_only(docs.sparkSession, "components") as path:
        prints = written(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", words, ["id"]), "fp")
        classes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
        roots = components(links(classes, parallelism(docs, 2), radius))
        linked = written(classes.join(roots, classes.fp == roots.node).select("fp", "least", "root"), "linked")
        lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("n"))
        named = joined(linked, lowest, "root", linked.count()).select("fp", "lowest")
        final = written(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("lowest", "least").alias("component_id")), "named")
        rows = final.agg(F.sum("n")).first()[0] or 0
        return written(joined(prints, final, "fp", rows).select(F.col("id").alias(id_col), "fp", "component_id"), "components", path)
