"""A corpus pipeline: filter, deduplicate and pack ``documents``.

Each stage takes all rows its predecessor kept, its decisions take effect, and its result is written to the shared folder and read
again as the next one's input:

1. toxicity: documents that score at or above the threshold go;
2. language ID: documents without letters (``und``) go, and those whose score is one at which held-out predictions are more often
   wrong than right; a null ``lang`` is filled with the language found;
3. SimHash near-dedup (five-word shingles, Jaccard similarity of 0.8 or more): of each group of linked documents the one with the least
   (doc_id, text hash) stays;
4. substring dedup: windows of 35 words that repeat anywhere are taken out of the texts; ``n_chars`` follows;
5. best-fit packing: the remaining texts as pieces in sequences of at most 2048 tokens.

Rows may have null or repeated ids, null texts and further columns of any name, which the first four stages keep as they are; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.llm import langid, nearcopies, packing, substringdedup, toxicity
from questlake.llm.common import boxed, parallelism, scratch_path, table, unboxed
from questlake.llm.registry import tokenizer_path
from questlake.llm.winnow import bucketed


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    got = toxicity.scored(boxed(docs, "text"), model, keep=["doc"])
    return unboxed(got.where(F.col("tox_score") < toxicity.THRESHOLD), docs.columns)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without any labelled row there is no language to find: every document with a letter stays."""
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    got = langid.predicted(boxed(docs, "text"), model, keep=["doc"])
    kept = got.where((F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= langid.threshold(docs, model)))
    return kept.select(*[(F.coalesce(F.col("doc").getField(c), "lang_pred") if c == "lang" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the least (doc_id, text) stays, null ids first. Only rows of one group compete, so
    unrelated texts that share an id, or have none, all stay."""
    # dealt by row once, so that neither candidates' texts nor the rows that stay are shuffled to find them
    rows = bucketed(boxed(docs).withColumn("row", F.monotonically_increasing_id()), scratch_path(spark, "rows"), "row", parallelism(docs, 2))
    groups = nearcopies.near_duplicates(rows.select("row", "doc.text"), "row").select("row", F.col("component_id").alias("group"))
    order = rows.select("row", "doc.doc_id", F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("hash"))
    kept = order.join(groups, "row").groupBy("group").agg(F.min(F.struct("doc_id", "hash", "row")).alias("least")).select("least.row")
    return unboxed(rows.join(kept, "row", "left_semi"), docs.columns)


def substring_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substringdedup.cleaned(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("language_id", language_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_filter),
    ("best_fit_packing", pack),
]

#: SQL can't express the stages; the result is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
