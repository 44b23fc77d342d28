"""SimHash near-dedup verified by the Jaccard similarity of word shingles: operator 9 for groups of similar texts.

Distinct texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come from two
indexes:

- the SimHash operator's deletion variants over five-word fingerprints (``simhash.links``). Texts of similarity 0.8 differ in about
  a seventh of the bits, far beyond any radius that few one-wildcard segments can promise, so this index alone loses most of the
  links between different texts;
- least hashes: 200 of each set in 40 bands of five; texts that share a band are candidates. A pair of similarity 0.8 shares none with
  probability (1 - 0.8**5)**40, about one in eight million; more similar pairs are likelier still.

All candidates are verified on the whole shingle sets. Exact copies (of the words) count once. A text is first compared with the
least one of each of its candidate groups, which connects a group of near copies with as many comparisons as it has texts. Only
groups that hang together by candidates and aren't connected by then are compared all with all, in blocks of bounded size; each
pair of blocks gives a spanning forest of its links, so no group ends up in one task.

Defined cases: null or blank texts are copies of each other; a text of fewer than five words is one shingle; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.llm import simhash
from questlake.llm.common import add_columns, kept_only, parallelism, utf8_rows, written
from questlake.llm.graph import components, joined
from questlake.session import importable

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
#: Texts a block; a task holds two blocks.
BLOCK = 256
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, ASCII white space splits."""
    return text.lower().split()


def shingles_of(w: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(simhash.shingle_hashes(w, words))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of sets that aren't empty, one row a set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sets), b + 1, np.uint64)
        for a in _FACTORS[b * ROWS : (b + 1) * ROWS]:
            k = (k ^ np.minimum.reduceat(flat * a, starts)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        out[:, b] = k
    return out


def keys(docs: DataFrame) -> DataFrame:
    """(id, key): a 128-bit hash of a text's words."""

    def made(batch: pa.RecordBatch) -> list:
        return [[xxhash.xxh3_128_digest(b" ".join(words_of(x))) for x in utf8_rows(batch.column(batch.schema.get_field_index("text")))]]

    return add_columns(docs, ["text"], [("key", pa.binary(), T.BinaryType())], lambda: made, ["id"])


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, bands, fp): the packed band keys (empty for blank texts) and the SimHash fingerprint."""

    def made(batch: pa.RecordBatch) -> list:
        sets, fps = [], []
        for x in utf8_rows(batch.column(batch.schema.get_field_index("text"))):
            h = simhash.shingle_hashes(words_of(x), words)
            fps.append(simhash.majority(h))
            sets.append(np.unique(h))
        some = [i for i, s in enumerate(sets) if len(s)]
        bands = [b""] * len(sets)
        for i, row in zip(some, bands_of([sets[i] for i in some]) if some else []):
            bands[i] = row.tobytes()
        return [bands, fps]

    return add_columns(docs, ["text"], [("bands", pa.binary(), T.BinaryType()), ("fp", pa.int64(), T.LongType())], lambda: made, ["id"]).withColumnRenamed("id", "node")


def band_stars(reps: DataFrame, partitions: int) -> DataFrame:
    """Star links (u, v), u > v, from each node to the least node that shares one of its bands."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, b) for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if b]
            if rows:
                node = np.repeat(np.array([n for n, _ in rows], np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b for _, b in rows), np.int64)), pa.array(node)], names=["band", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, node = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(node[starts], np.diff(np.r_[starts, len(key)]))
        pairs = np.unique(np.stack([node, least], 1)[node != least], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return reps.select("node", "bands").mapInArrow(deal, "band long, node long").repartition(partitions, "band").mapInArrow(meet, "u long, v long").distinct()


def fingerprint_stars(reps: DataFrame, partitions: int) -> DataFrame:
    """Links (u, v), u > v, of the SimHash operator among ``reps`` (node, fp): equal fingerprints, and those within its radius."""
    named = written(reps.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = reps.join(named, "fp").where("node > first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = simhash.links(named, partitions)
    for c in ("u", "v"):
        near = near.join(named.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")), c)
    return same.unionByName(near.select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v")))


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``others`` shares with ``one``."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def forest(nodes: list[int], sets: list[np.ndarray], least: float = SIMILARITY, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Spanning links among ``nodes`` whose sets have a similarity of ``least`` or more; pairs already connected (nodes of one ``known``
    group are) are skipped."""
    n = np.array([len(s) for s in sets])
    label = np.arange(len(nodes)) if known is None else np.unique(known, return_inverse=True)[1]
    out = []
    for a in range(len(nodes) - 1):
        rest = np.arange(a + 1, len(nodes))
        rest = rest[(label[rest] != label[a]) & (np.minimum(n[rest], n[a]) >= (least - 1e-9) * np.maximum(n[rest], n[a]))]
        if not len(rest):
            continue
        both = np.concatenate([_shared(sets[a], [sets[b] for b in part.tolist()]) for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(n[rest]) >> 18)) + 1)])
        for b in rest[both / (n[rest] + n[a] - both) >= least].tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((max(nodes[a], nodes[b]), min(nodes[a], nodes[b])))
    return out


def _as_links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])


def _sets(table: pa.Table, words: int) -> list[np.ndarray]:
    return [shingles_of(words_of(x), words) for x in utf8_rows(table.column("text"))]


def similar_pairs(stars: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Those of ``stars`` (u, v) whose shingle sets have a similarity of ``least`` or more; ``texts`` has (id, text). Texts travel rather
    than their sets, which are larger. A node with very many links is dealt to several tasks."""

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _as_links([])
        one, others, v = _sets(left, words)[0], _sets(right, words), left.column("v")[0].as_py()
        n, both = np.array([len(s) for s in others]), _shared(one, others)
        return _as_links([(u, v) for u, ok in zip(right.column("u").to_pylist(), both / (n + len(one) - both) >= least) if ok])

    per = written(stars.groupBy("v").agg(F.count("*").alias("n")), "degrees").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part")
    members = joined(stars, per, "v", stars.count()).select("v", part, F.col("u").alias("id")).join(texts, "id").select("v", "part", F.col("id").alias("u"), F.col("text"))
    centres = per.select(F.col("v").alias("id"), "parts").join(texts, "id").select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text"))
    return centres.groupBy("v", "part").cogroup(members.groupBy("v", "part")).applyInArrow(check, "u long, v long")


def similar_in_groups(groups: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Spanning links (u, v) among the nodes of each group that has unconnected ones; ``groups`` has (node, root, known), ``known`` naming
    nodes that are connected already. A group is split into blocks of bounded size, and each pair of blocks is a task's row group."""

    def check(table: pa.Table) -> pa.Table:
        return _as_links(forest(table.column("id").to_pylist(), _sets(table, words), least, table.column("known").to_pylist()))

    per = groups.groupBy("root").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    per = written(per.where("a < b").select("root", "n", "blocks"), "open")
    held = joined(groups, per, "root", groups.count()).select(F.col("node").alias("id"), "root", "known", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"))
    dealt = held.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("id", "text", "root", "known", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).groupBy("root", "i", "j").applyInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, component_id), the smallest id reachable by links; ids must be unique longs. Texts of a table that is bucketed by the id
    aren't shuffled to find candidates' texts; they then only go to the tasks that compare them."""
    importable(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with kept_only(docs.sparkSession, "components") as path:
        prints = written(keys(docs), "keys")
        classes = written(prints.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("n")), "classes")
        reps = docs.join(classes.select(F.col("node").alias("id")), "id", "left_semi")
        signed, tasks = written(signatures(reps, words), "signatures"), parallelism(docs, 2)
        stars = written(fingerprint_stars(signed.where("length(bands) > 0"), tasks).unionByName(band_stars(signed, tasks)).distinct(), "stars")
        first = written(similar_pairs(stars, docs, words, least, block), "similar")
        # nodes that hang together by candidates without being connected yet are compared all with all
        groups, known = components(stars, "candidates"), components(first).withColumnRenamed("root", "known")
        marked = written(groups.join(known, "node", "left").withColumn("known", F.coalesce("known", "node")), "groups")
        second = similar_in_groups(marked, docs, words, least, block)
        roots = components(first.unionByName(second))
        final = written(classes.join(roots, "node", "left").select("key", "n", F.coalesce("root", "node").alias("component_id")), "named")
        rows = final.agg(F.sum("n")).first()[0] or 0
        return written(joined(prints, final, "key", rows).select(F.col("id").alias(id_col), "component_id"), "components", path)
