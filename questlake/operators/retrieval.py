"""BM25 over an inverted index of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from questlake.functions.text import observation, once, split_title, strip, truncated
from questlake.operators.guards import checked
from questlake.session import cut, importable


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Documents a part: no task gets more postings of a term.
PART = 1 << 18
#: Documents of rare terms that are looked at for a query's floor, and how many of them are scored in full.
RARE, SEEDS = 400, 24
#: What part of the floor the lists that are left out may add up to. With more of it fewer postings are read and more documents completed.
SKIPPED = 0.75
#: Scores are rounded to six decimals; what could round to the floor still counts.
MARGIN = 2e-6


#: Tokens that are sorted at once where lists are packed.
TOKENS = 1 << 22


@dataclass
class Index:
    """packed lists, a row for each term and block of documents (term, n documents, and doc_ids, tfs, dls, the shortest documents first),
    and corpus statistics (n, avgdl, parts, k1, b; one row). tfs and dls, and doc_ids if they are longs, are little-endian bytes: what
    isn't wanted is passed over as one value.

    ``analyzer`` is the function from a text column to its terms; the same one cuts the documents and the queries. Bands, postings and
    statistics are views of the packed lists."""

    packed: DataFrame
    corpus: DataFrame
    analyzer: Callable[[Column], Column] = terms

    @cached_property
    def total(self) -> Row:
        return self.corpus.first()

    def impact(self, tf, dl):
        """Of columns or of arrays."""
        t = self.total
        return tf / (tf + t.k1 * (1.0 - t.b + t.b * dl / (t.avgdl or 1.0)))

    def unpacked(self, lists: DataFrame) -> DataFrame:
        """A row for each document of packed lists: doc_id, impact and the other columns, also those that were joined to them."""
        kept = [c for c in lists.columns if c not in PACKED]
        ids = lists.schema["doc_ids"].dataType
        schema = StructType([lists.schema[c] for c in kept] + [StructField("doc_id", ids.elementType if isinstance(ids, ArrayType) else LongType()), StructField("impact", DoubleType())])
        total = self.total
        return lists.select(*kept, "doc_ids", "tfs", "dls").mapInArrow(lambda batches: _unpack(batches, Index(None, _Known(total))), schema)

    @cached_property
    def banded(self) -> DataFrame:
        """Lists cut into bands, documents of similar length, in which impacts are alike: (term, band, n, tf: the greatest, dl: the least,
        doc_ids, tfs, dls)."""
        if "band" in self.packed.columns:
            return self.packed
        kind = self.packed.schema["doc_ids"].dataType.simpleString()
        schema = f"term string, band int, n long, tf int, dl int, doc_ids {kind}, tfs binary, dls binary"
        return self.packed.select("term", "doc_ids", "tfs", "dls").mapInArrow(_bands, schema)

    @property
    def postings(self) -> DataFrame:
        """(term, band, doc_id, impact)"""
        return self.unpacked(self.banded)

    @property
    def stats(self) -> DataFrame:
        """(term, df)"""
        return self.packed.groupBy("term").agg(F.sum("n").alias("df"))

    @property
    def lists(self) -> DataFrame:
        """(term, band, df, top: no impact is greater)"""
        return self.banded.groupBy("term", "band").agg(F.sum("n").alias("df"), F.max(self.impact(F.col("tf"), F.col("dl"))).alias("top"))

    def of_terms(self, wanted: DataFrame) -> Index:
        """The lists of some terms (term, distinct), read out of the whole index once and cut into bands; the corpus stays what it is."""
        few = Index(self.packed.join(wanted, "term", "left_semi"), self.corpus, self.analyzer)
        return Index(cut(few.banded, "lists"), self.corpus, self.analyzer)


def counted(terms: Column) -> Column:
    """array<struct(term, tf)> of sorted terms: runs of equal ones."""
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w: once(starts(w), lambda s: F.transform(s, lambda at, j: F.struct(F.get(w, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(w)) - at).alias("tf"))))
    return F.when(F.size(terms) > 0, runs(terms))


PACKED = ("n", "tf", "dl", "doc_ids", "tfs", "dls")


@dataclass
class _Known:
    """A corpus whose row is at hand."""

    row: Row

    def first(self) -> Row:
        return self.row


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value for each run of numbers."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _packed(ids: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Packed lists of some documents, and a row without a term that has their number and their terms'."""
    if ids.null_count:
        raise ValueError("a document lacks its id")
    size = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    by_size = np.argsort(size, kind="stable")
    place = np.empty_like(by_size)
    place[by_size] = np.arange(len(size))
    found = words.flatten().dictionary_encode()
    code, doc = found.indices, np.repeat(place, size)
    if code.null_count:  # counts as length only
        doc = doc[code.is_valid().to_numpy(zero_copy_only=False)]
        code = code.drop_null()
    bits = len(size).bit_length()
    key = np.sort(code.to_numpy().astype(np.int64) << bits | doc)
    at = _starts(key)
    tf = np.diff(np.r_[at, len(key)]).astype("<i4")
    code, doc = key[at] >> bits, by_size[key[at] & ((1 << bits) - 1)]
    dl, at = size[doc].astype("<i4"), _starts(code)
    ends = np.r_[at, len(code)]
    listed = _bytes(ids.to_numpy()[doc].astype("<i8"), ends) if pa.types.is_int64(ids.type) else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.take(pa.array(doc)))
    rows = [found.dictionary.take(pa.array(code[at])), pa.array(np.diff(ends)), listed, _bytes(tf, ends), _bytes(dl, ends), pa.nulls(len(at), pa.int64())]
    names = ["term", "n", "doc_ids", "tfs", "dls", "length"]
    yield pa.RecordBatch.from_arrays(rows, names)
    total = {"n": len(size), "length": int(size.sum())}
    yield pa.RecordBatch.from_arrays([pa.array([total.get(name)], c.type) for name, c in zip(names, rows)], names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (n, tf), (_, dl), ids = _numbers(batch.column("tfs"), "<i4"), _numbers(batch.column("dls"), "<i4"), batch.column("doc_ids")
        row, band = np.repeat(np.arange(len(n)), n), np.floor(2 * np.log2(dl)).astype(np.int32)
        at = _starts(row * 128 + band)
        ends = np.r_[at, len(row)]
        listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.flatten()) if pa.types.is_list(ids.type) else _bytes(_numbers(ids, "<i8")[1], ends)
        most, least = (np.maximum.reduceat(tf, at), np.minimum.reduceat(dl, at)) if len(at) else (tf, dl)
        rows = [batch.column("term").take(pa.array(row[at])), pa.array(band[at]), pa.array(np.diff(ends)), pa.array(most), pa.array(least), listed, _bytes(tf, ends), _bytes(dl, ends)]
        yield pa.RecordBatch.from_arrays(rows, ["term", "band", *PACKED])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each value of a binary column has, and all of them."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    return np.diff(at), np.frombuffer(data, kind)[at[0] : at[-1]] if data is not None and len(at) and at[-1] else np.empty(0, kind)


def _unpack(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(_numbers(batch.column("tfs"), "<i4")[0])
        at = 0
        while at < len(ends):  # lists of at most a million documents together, one list at least
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            part = batch.slice(at, upto - at)
            (n, tf), (_, dl), ids = _numbers(part.column("tfs"), "<i4"), _numbers(part.column("dls"), "<i4"), part.column("doc_ids")
            row = pa.array(np.repeat(np.arange(len(n)), n))
            kept = [c for c in batch.schema.names if c not in PACKED]
            ids = ids.flatten() if pa.types.is_list(ids.type) else pa.array(_numbers(ids, "<i8")[1])
            yield pa.RecordBatch.from_arrays([part.column(c).take(row) for c in kept] + [ids, pa.array(index.impact(tf, dl))], [*kept, "doc_id", "impact"])
            at = upto


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):  # as many documents as have TOKENS terms, one at least
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            part = batch.slice(at, upto - at)
            yield from _packed(part.column(0), part.column(1))
            at = upto


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, k1: float = 0.9, b: float = 0.4, analyzer: Callable[[Column], Column] = terms, path: str | None = None) -> Index:
    """Texts are read and cut into terms once. The documents of an Arrow batch are a block: their terms are counted and packed into lists
    where they are read, which are written without a shuffle. Ids must be unique.

    Blocks are dealt to parts, so that no task gets all documents of a common term. With a ``path`` the index is made there, where
    ``open_index`` finds it: nothing is written twice.
    """
    importable(docs.sparkSession)
    words = docs.select(F.col(id_col).alias("doc_id"), analyzer(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    kind = words.schema["doc_id"].dataType
    ids = "binary" if isinstance(kind, LongType) else f"array<{kind.simpleString()}>"
    schema = f"term string, n long, doc_ids {ids}, tfs binary, dls binary, length long"
    packed, corpus = (path and f"{path}/{name}" for name in INDEX_TABLES)
    found = cut(words.mapInArrow(_pack, schema), "postings", packed)
    sums = found.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    made = sums.select("n", (F.col("length") / F.greatest("n", F.lit(1))).alias("avgdl"), F.greatest(F.lit(1), F.ceil(F.col("n") / part)).cast("int").alias("parts"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
    return Index(_lists(found), cut(made, "corpus", corpus), analyzer)


INDEX_TABLES = ("packed", "corpus")


def _lists(packed: DataFrame) -> DataFrame:
    return packed.where("term IS NOT NULL").drop("length")


def save_index(index: Index, path: str) -> None:
    for name in INDEX_TABLES:
        getattr(index, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def open_index(spark: SparkSession, path: str, analyzer: Callable[[Column], Column] = terms) -> Index:
    """A saved index; a part that is missing is an error now, not when the index is searched. ``analyzer`` must be the one that it was
    built with."""
    for name in INDEX_TABLES:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(f"{path}/{name}")
    importable(spark)
    packed, corpus = (spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES)
    return Index(_lists(packed), corpus, analyzer)


def _ranked(scored: DataFrame, query_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _met(index: Index, wanted: DataFrame, *keys: str) -> DataFrame:
    """Postings of wanted lists; every part of a list is wanted."""
    parts = index.total.parts
    if parts == 1:
        return index.unpacked(index.banded.join(wanted, list(keys)))
    dealt = index.banded.withColumn("part", F.pmod(F.xxhash64("doc_ids"), F.lit(parts)).cast("int"))
    return index.unpacked(dealt.join(wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "part"]).drop("part"))


def _of_documents(index: Index, wanted: DataFrame, *keys: str) -> DataFrame:
    """(*wanted, impact) of wanted documents' terms; only lists with one of the wanted ``keys`` are unpacked."""
    lists = index.banded.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return index.unpacked(lists).select("doc_id", "term", "impact").join(wanted, ["doc_id", "term"])


def query_terms(index: Index, queries: DataFrame, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query id, term, qf)"""
    words = require_queries(queries, text_col).select(query_id, F.explode(index.analyzer(F.col(text_col))).alias("term"))
    return words.groupBy(query_id, "term").agg(F.count("*").alias("qf"))


def query_weights(index: Index, queries: DataFrame, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query id, term, df, w) of terms that the corpus has."""
    asked = query_terms(index, queries, query_id, text_col)
    idf = F.log(1.0 + (F.lit(index.total.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.stats, "term").select(query_id, "term", "df", (F.col("qf") * idf).alias("w"))


def floors(index: Index, weights: DataFrame, k: int, query_id: str = "item_id", rare: int = RARE, seeds: int = SEEDS) -> DataFrame:
    """(query id, floor): a score that ``k`` documents reach. The documents of a query's rarest terms (one at least, then as many as have
    ``rare`` postings together) are ranked by these, and the best are scored in full. Queries with fewer documents have no row."""
    by_df = Window.partitionBy(query_id).orderBy("df", "term")
    few = weights.withColumn("_upto", F.sum("df").over(by_df)).withColumn("_n", F.row_number().over(by_df)).where((F.col("_upto") <= rare) | (F.col("_n") == 1)).select(query_id, "term", "w")
    near = _met(index, few, "term").groupBy(query_id, "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    best = _ranked(near, query_id, max(seeds, 4 * k)).select(query_id, "doc_id")
    asked = cut(best.join(weights, query_id).select(query_id, "doc_id", "term", "w"), "seeds")
    whole = _of_documents(index, asked, "term")
    scored = whole.groupBy(query_id, "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    return _ranked(scored, query_id, k).where(F.col("rank") == k).select(query_id, F.col("score").alias("floor"))


def planned_lists(index: Index, weights: DataFrame, floor: DataFrame, query_id: str = "item_id", skipped: float = SKIPPED) -> DataFrame:
    """(query id, term, band, w, floor, skip, rest): the lists of each query's terms. Those with the least bound for their length are left
    out (``skip``) as long as their bounds add up to less than a part of the floor: no document in these alone can reach it. ``rest`` is
    what they could add to a document of the band; bands whose lists together can't reach the floor are gone."""
    rows = weights.select(query_id, "term", "w").join(index.lists, "term").join(floor, query_id, "left")
    least = F.col("floor") - MARGIN
    bounds = rows.withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("ub", F.col("w") * F.col("top"))
    band = Window.partitionBy(query_id, "band")
    upto = F.sum("ub").over(band.orderBy(F.col("ub") / F.col("df"), "term"))
    marked = bounds.withColumn("all", F.sum("ub").over(band)).withColumn("skip", upto < skipped * least).where(F.col("all") >= least)
    return marked.withColumn("rest", F.sum(F.when(F.col("skip"), F.col("ub")).otherwise(0.0)).over(band)).select(query_id, "term", "band", "w", "floor", "skip", "rest")


def candidates(index: Index, lists: DataFrame, query_id: str = "item_id") -> DataFrame:
    """(query id, doc_id, band, part_score) of documents that may still reach their query's floor, from the lists that aren't left out."""
    hits = _met(index, lists.where("NOT skip").select(query_id, "term", "band", "w", "floor", "rest"), "term", "band")
    partial = hits.groupBy(query_id, "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("part_score"), F.first("band").alias("band"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    return partial.where(F.col("part_score") + F.col("rest") >= F.col("floor") - MARGIN).select(query_id, "doc_id", "band", "part_score")


def search(index: Index, queries: DataFrame, k: int = 3, query_id: str = "item_id", text_col: str = "text", rare: int = RARE, seeds: int = SEEDS, skipped: float = SKIPPED) -> DataFrame:
    """(query id, rank, doc_id, score) of the ``k`` best documents of each query; ties go to the smaller id. A blank query is an error.

    Exact, but most postings of common terms aren't read: rare terms give each query a floor, by upper bounds the lists that can't lift
    a document above it are left out, and only documents that may reach it are completed from these. Which joins are used follows the
    sizes. The whole index is read once, for the lists of the queries' terms.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    index = index.of_terms(cut(query_terms(index, queries, query_id, text_col).select("term").distinct(), "asked"))
    weights = cut(query_weights(index, queries, query_id, text_col), "weights")
    lists = cut(planned_lists(index, weights, floors(index, weights, k, query_id, rare, seeds), query_id, skipped), "planned")
    open_ = cut(candidates(index, lists, query_id), "candidates")
    missing = cut(open_.join(lists.where("skip").select(query_id, "band", "term", "w"), [query_id, "band"]).select(query_id, "doc_id", "band", "term", "w"), "missing")
    found = _of_documents(index, missing, "term", "band").select(query_id, "doc_id", (F.col("w") * F.col("impact")).alias("score"))
    scored = open_.select(query_id, "doc_id", F.col("part_score").alias("score")).unionByName(found).groupBy(query_id, "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return _ranked(scored, query_id, k).select(query_id, "rank", "doc_id", "score")


def with_passages(hits: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    title, body = split_title(F.col("passage"))
    return hits.join(docs.select("doc_id", F.col(text_col).alias("passage")), "doc_id").select(*hits.columns, title.alias("title"), body.alias("text"))


def observations(passages: DataFrame, query_id: str = "item_id", most: int | None = None) -> DataFrame:
    """One observation text a query, hits by rank."""
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))), lambda h: h)
    return passages.groupBy(query_id).agg(observation(hits, most).alias("observation"))


def require_queries(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """The queries, or an error for a blank one when it is read."""
    return checked(queries, F.coalesce(strip(F.col(text_col)), F.lit("")) != "", "a query is blank")


def passages_of(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Only the passages that are hits: what is joined to them afterwards doesn't grow with the corpus."""
    return docs.join(hits.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a corpus of JSON lines (id, contents); bad lines, missing fields and an empty corpus are errors."""
    df = spark.read.schema("id string, contents string").option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError("the corpus is empty")
    good = checked(df, F.col("id").isNotNull() & F.col("contents").isNotNull(), "a passage lacks its id or contents")
    return good.select(F.col("id").alias("doc_id"), F.col("contents").alias("text"))


def search_tool(index: Index, docs: DataFrame, k: int = 3, most: int | None = None):
    """A function from queries (question_id, query) to (question_id, hits) for the agent loop; texts cut to ``most`` characters if set."""
    if most is not None and most < 1:
        raise ValueError("most must be at least 1")

    def find(queries: DataFrame) -> DataFrame:
        hits = cut(search(index, queries, k, "question_id", "query"), "hits")
        rows = with_passages(hits, passages_of(docs, hits)).withColumn("text", truncated("text", most))
        return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("hits"))

    return find
