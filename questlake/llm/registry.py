"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.llm import bpe, langid, lexical, media, mtree, packing, pairbpe, sharding, simhash, substringdedup, suffixdedup, toxicity, whitening
from questlake.llm.common import scratch_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.predicted(docs, langid.fit(docs), keep=["doc_id"])
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, appended and compacted, then read back from the last version."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), docs.schema, target=32 << 20)
    store.append_many(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substringdedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return got.select("doc_id", toxicity.held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairbpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that doesn't fit 64 bits is null."""
    got = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return got.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_sharding, op4_sentencepiece, op5_substring_dedup, op6_best_fit_packing, op7_media_columns, op8_exact_top_k, op9_simhash, op10_toxicity, op11_pair_bpe, op12_lexical_search, op13_whitening)}

ORACLE: dict[str, str] = {
    "op3_sharding": "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents",
    "op8_exact_top_k": """
        WITH e AS (
            SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        b AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
        c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n),
        q AS (SELECT r, term, count(*) AS times FROM (SELECT r, unnest(t) AS term FROM b) GROUP BY ALL),
        s AS (
            SELECT q.r AS qr, d.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(t) * n) // l))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.r = p.r CROSS JOIN c GROUP BY q.r, d.r, d.doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
        FROM s JOIN b ON b.r = qr WHERE score > 0 QUALIFY rank <= 10
    """,
}
