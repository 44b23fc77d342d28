"""Ranked lexical search over document shards of postings with integer impacts.

The index has one row a shard: its documents, its terms in byte order, and their postings as compressed sparse rows (where a term's
postings begin, each posting's document and impact), made from the documents of one scan task, so that building it shuffles no
postings. Impacts are computed once, when the index is built, from the number of documents and terms of the whole corpus. A search
meets each block of queries with each shard: term after term adds weight x impact to a dense array of the shard's documents, the best
``k`` are cut off where no tie is torn apart, and the shards' best are merged.

Blocks of queries are broadcast where their packed size, which is measured, is at most ``BROADCAST`` bytes; beyond it they are dealt to
the shards by a shuffle.

Defined cases: null texts and texts without a term are no document and no query; repeated rows count as rows, each query row with a
ranking of its own; a null id ranks before others of its score; texts of any length are indexed whole; other columns are ignored; an
empty table of either kind gives no rows; scores of 0 are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from questlake.llm.common import importable, parallelism, pieces, utf8_rows, written

#: Bytes of text that a shard holds before it is closed; a longer document has a shard of its own.
SHARD = 4 << 20
#: Terms and queries a block.
BLOCK_TERMS, BLOCK_QUERIES = 1 << 17, 1 << 12
#: Packed queries up to this size are broadcast.
BROADCAST = 16 << 20

# Bytes that belong to terms are digits, letters (upper-case ones read as lower-case) and all of non-ASCII characters.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SHARDS = "doc_ids array<bigint>, terms binary, starts binary, docs binary, impacts binary"
STATS = "n bigint, length bigint"
ITEM = pa.struct([("row", pa.int64()), ("item", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64()), ("df", pa.int64())])))])


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


@dataclass
class Index:
    """shards (one row each), dictionary (term, df), and the number of documents with terms."""

    shards: DataFrame
    dictionary: DataFrame
    n: int


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m) for postings in documents of ``n`` terms, m = 100 - 75 + (75 n N) div L."""
    if 75 * int(n.max(initial=0)) * docs < 1 << 63:
        m = 25 + 75 * n * docs // max(length, 1)
    else:  # beyond 64 bits: by whole and rest
        m = np.array([25 + 75 * int(x) * docs // length for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> Index:
    """Two passes over the texts: one for the corpus statistics, one that writes the shards to the shared folder."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            for part in pieces(batch):
                sizes = [len(terms(t)) for t in utf8_rows(part.column(0))]
                n, length = n + sum(map(bool, sizes)), length + sum(sizes)
        yield pa.RecordBatch.from_pydict({"n": [n], "length": [length]})

    total = rows.select("text").mapInArrow(counted, STATS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    everything, length = total.n, total.length

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, vocabulary, keys, counts, held = [], [], {}, [], [], 0
        for batch in batches:
            for part in pieces(batch):
                for i, text in zip(part.column(0).to_pylist(), utf8_rows(part.column(1))):
                    words = terms(text)
                    if not words:
                        continue
                    if held and held + len(text) > shard:
                        yield packed(ids, lengths, vocabulary, keys, counts, everything, length)
                        ids, lengths, vocabulary, keys, counts, held = [], [], {}, [], [], 0
                    found = Counter(words)
                    keys.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64))
                    counts.append(np.array(list(found.values()), np.int64))
                    ids.append(i)
                    lengths.append(len(words))
                    held += len(text)
        if ids:
            yield packed(ids, lengths, vocabulary, keys, counts, everything, length)

    spark = docs.sparkSession
    shards = written(rows.mapInArrow(sharded, SHARDS), "lexical-shards")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df = np.diff(np.frombuffer(starts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(words.split(b" ")[: len(df)], pa.binary()), pa.array(df)], names=["term", "df"])

    found = shards.select("terms", "starts").mapInArrow(known, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(shards, written(found, "lexical-terms") if everything else spark.createDataFrame([], "term binary, df bigint"), everything)


def packed(ids: list, lengths: list[int], vocabulary: dict[bytes, int], keys: list[np.ndarray], counts: list[np.ndarray], everything: int, length: int) -> pa.RecordBatch:
    """One shard: postings by term in byte order, then by document."""
    order = sorted(vocabulary)
    place = np.empty(len(order), np.int64)
    place[[vocabulary[w] for w in order]] = np.arange(len(order))
    term, doc = place[np.concatenate(keys)], np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    by = np.lexsort((doc, term))
    value = impacts(np.concatenate(counts), np.array(lengths, np.int64)[doc], everything, length)
    starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(order)))].astype(np.int64)
    row = {"doc_ids": pa.array([ids], pa.list_(pa.int64()))} | {
        n: pa.array([v], pa.binary())
        for n, v in (("terms", b" ".join(order)), ("starts", starts.tobytes()), ("docs", doc[by].astype(np.int32).tobytes()), ("impacts", value[by].astype(np.int32).tobytes()))
    }
    return pa.RecordBatch.from_pydict(row)


def best(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores above 0 (null ids, then lesser ids first among equals), in order."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]  # the whole tie at the cut
    return some[np.lexsort((ids[some], ~null[some], -scores[some]))][:k]


class Shard:
    def __init__(self, row: dict):
        listed = row["doc_ids"]
        self.null = np.array([i is None for i in listed])
        self.ids = np.array([0 if i is None else i for i in listed], np.int64)
        self.starts, self.docs, self.impacts = (np.frombuffer(row[c], t) for c, t in (("starts", np.int64), ("docs", np.int32), ("impacts", np.int32)))
        self.at = {w: k for k, w in enumerate(row["terms"].split(b" "))}

    def scores(self, query: list[tuple[bytes, int]]) -> np.ndarray:
        """Term after term, of (term, weight) pairs."""
        acc = np.zeros(len(self.ids), np.int64)
        for word, weight in query:
            k = self.at.get(word)
            if k is not None and weight:
                span = slice(self.starts[k], self.starts[k + 1])
                acc[self.docs[span]] += weight * self.impacts[span].astype(np.int64)  # a document stands once in a term's postings
        return acc


def query_blocks(index: Index, queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """(block, items): bounded lists of (row, item, terms with repeats and document frequencies); terms that no document has are left out."""
    spark = queries.sparkSession
    importable(spark)
    asked = written(queries.select(F.col(query_id).cast("bigint").alias("item"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "lexical-queries")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                rows = [(r, w, c) for r, t in zip(part.column(0).to_pylist(), utf8_rows(part.column(1))) for w, c in Counter(terms(t)).items()]
                if rows:
                    r, w, c = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(w, pa.binary()), pa.array(c, pa.int64())], names=["row", "term", "times"])

    words = asked.select("row", "text").mapInArrow(cut, "row bigint, term binary, times bigint").join(index.dictionary, "term")
    grouped = words.groupBy("row").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms"))
    whole = written(grouped.join(asked.select("row", "item"), "row").select("row", "item", "terms"), "lexical-terms-of-queries")
    size = whole.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    parts = max(1, -(-size.queries // BLOCK_QUERIES), -(-size.terms // BLOCK_TERMS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By running size: no query is split, none is left out."""
        held, size = [], 0
        schema = pa.schema([("items", pa.list_(ITEM))])
        for batch in batches:
            for q in batch.to_pylist():
                if held and (size + len(q["terms"]) > BLOCK_TERMS or len(held) >= BLOCK_QUERIES):
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(ITEM))], schema=schema)
                    held, size = [], 0
                held.append(q)
                size += len(q["terms"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(ITEM))], schema=schema)

    return written(whole.coalesce(parts).mapInArrow(blocks, "items array<struct<row: bigint, item: bigint, terms: array<struct<term: binary, times: bigint, df: bigint>>>>"), "lexical-blocks")


def search(index: Index, queries: DataFrame, k: int = 10, query_id: str = "item_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(query id, rank, doc_id, score) of the ``k`` best documents of each query row. Weights are floor(1000 ln((2N + 2) / (2 df + 1)))."""
    if k < 1:
        raise ValueError("k must be at least 1")
    blocks = query_blocks(index, queries, query_id, text_col)
    size = blocks.agg(F.coalesce(F.sum(F.expr("aggregate(items, 0L, (a, q) -> a + 24 + aggregate(q.terms, 0L, (b, t) -> b + 32 + length(t.term)))")), F.lit(0)).alias("size")).first().size
    n = index.n
    shards = index.shards
    if size <= broadcast:
        met = shards.join(F.broadcast(blocks), F.lit(True))  # blocks of the stated queries, of a size just measured
    else:
        lanes = parallelism(shards, 1)
        dealt = shards.withColumn("lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes)))
        met = dealt.join(blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))), "lane").drop("lane")
    met = met.select("doc_ids", "terms", "starts", "docs", "impacts", "items")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a shard and a block
                pair = batch.slice(at, 1).to_pylist()[0]
                shard, out = Shard(pair), []
                for q in pair["items"]:
                    weighed = [(t["term"], t["times"] * math.floor(1000 * math.log((2 * n + 2) / (2 * t["df"] + 1)))) for t in q["terms"]]
                    scores = shard.scores(weighed)
                    out += [(q["row"], q["item"], None if shard.null[d] else int(shard.ids[d]), int(scores[d])) for d in best(scores, shard.ids, shard.null, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "item", "doc_id", "score"])

    hits = met.mapInArrow(ranked, "row bigint, item bigint, doc_id bigint, score bigint")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("item").alias(query_id), "rank", "doc_id", "score")
