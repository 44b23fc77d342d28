"""Leakage isolation, deduplication and assertions over keys."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlake.functions.text import normalize_answer
from questlake.operators.components import components
from questlake.session import cut, importable


def isolated(df: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, each on its own, are none of the protected ones. Catalyst broadcasts the protected side only if it is small."""
    for k in keys:
        df = df.join(protected.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return df


def leaks(df: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Rows whose key is protected: the report to ``isolated``."""
    return df.join(protected.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def first_by(df: DataFrame, key: str | Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_occurrences(df: DataFrame, key: str, id_col: str, *order: Column) -> DataFrame:
    """All rows with ``kept_id``, the id of the first row with their key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("kept_id", F.first(id_col).over(w))


#: Rows of a component that one task walks through.
WALK = 200_000


def _walked(table: pa.Table) -> pa.Table:
    """Of one component's rows, taken in order, those whose id and key no taken row has."""
    order = pc.sort_indices(table["_pos"]).to_pylist()
    ids, keys, seen_ids, seen_keys, kept = table["_id"].to_pylist(), table["_key"].to_pylist(), set(), set(), []
    for at in order:
        if ids[at] not in seen_ids and keys[at] not in seen_keys:
            seen_ids.add(ids[at])
            seen_keys.add(keys[at])
            kept.append(at)
    return table.take(pa.array(kept, pa.int64())).drop_columns(["_pos", "_id", "_key", "_component"])


def skip_reasons(candidates: DataFrame, protected: DataFrame, id_col: str, key: str, order: list[Column], walk: int = WALK) -> DataFrame:
    """``candidates`` with ``reason``: protected_id, protected_question, duplicate_id, duplicate_question or null, in that order.

    Rows are taken one after another in ``order`` (ascending columns that no two rows share); an id or key counts as used from the
    first row on that isn't skipped itself. Only rows that ids and keys connect depend on one another: each component of up to
    ``walk`` rows is walked through in a task. Greater ones go by rounds, in each of which all rows that come first in both their id
    and their key are taken, and the rows that they rule out go; these end when no row is open.
    """
    importable(candidates.sparkSession)
    marks = protected.select(F.col(id_col).alias("_pid")).distinct()
    texts = protected.select(F.col(key).alias("_pkey")).distinct()
    marked = candidates.join(marks, F.col(id_col) == F.col("_pid"), "left").join(texts, F.col(key) == F.col("_pkey"), "left")
    outside = F.when(F.col("_pid").isNotNull(), "protected_id").when(F.col("_pkey").isNotNull(), "protected_question")
    marked = cut(marked.withColumn("reason", outside).drop("_pid", "_pkey").withColumn("_at", F.struct(*order)))
    open_ = marked.where("reason IS NULL").select(id_col, key, "_at")

    def first(rows: DataFrame, c: str, name: str) -> DataFrame:
        return rows.groupBy(F.col(c).alias(f"_{name}")).agg(F.min("_at").alias(f"_{name}_at"))

    def with_first(rows: DataFrame, firsts: DataFrame, c: str, name: str, how: str) -> DataFrame:
        return rows.join(firsts, rows[c].eqNullSafe(firsts[f"_{name}"]), how).drop(f"_{name}")

    # ids and keys are nodes, rows are edges; equal hashes of different values only make a component greater
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c).cast("string"), F.col(c).isNull())
    nodes = open_.withColumns({"_a": node("id", id_col), "_b": node("key", key)})
    placed = nodes.join(components(nodes, "_a", "_b").select(F.col("node").alias("_a"), F.col("component").alias("_component")), "_a").drop("_a", "_b")
    sizes = placed.groupBy("_component").agg(F.count("*").alias("_size"))
    placed = cut(placed.join(sizes, "_component"))
    small = placed.where(F.col("_size") <= walk).withColumn("_pos", F.row_number().over(Window.partitionBy("_component").orderBy("_at")))
    small = small.select(id_col, key, "_at", "_component", "_pos", F.col(id_col).cast("string").alias("_id"), F.col(key).cast("string").alias("_key"))
    taken = cut(small.groupBy("_component").applyInArrow(_walked, open_.schema))
    open_ = cut(placed.where(F.col("_size") > walk).select(id_col, key, "_at"))
    while not open_.isEmpty():
        both = with_first(with_first(open_, first(open_, id_col, "id"), id_col, "id", "inner"), first(open_, key, "key"), key, "key", "inner")
        now = cut(both.where((F.col("_at") == F.col("_id_at")) & (F.col("_at") == F.col("_key_at"))).select(id_col, key, "_at"))
        taken = taken.unionByName(now)
        left = with_first(with_first(open_, first(now, id_col, "id"), id_col, "id", "left"), first(now, key, "key"), key, "key", "left")
        open_ = cut(left.where("_id_at IS NULL AND _key_at IS NULL").select(id_col, key, "_at"))
    seen = with_first(with_first(marked, first(taken, id_col, "id"), id_col, "id", "left"), first(taken, key, "key"), key, "key", "left")
    inside = F.when(F.col("_id_at") < F.col("_at"), "duplicate_id").when(F.col("_key_at") < F.col("_at"), "duplicate_question")
    return seen.withColumn("reason", F.coalesce("reason", inside)).drop("_at", "_id_at", "_key_at")


def training_overlap(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(id, overlap): evaluation rows (id, question) whose id, or whose question as a normalised answer text, is in ``training``."""
    by_id = evaluation.select("id", F.col("id").cast("string").alias("_k")).join(training.select(F.col("id").cast("string").alias("_k")).distinct(), "_k", "left_semi")
    asked = evaluation.select("id", normalize_answer("question").alias("_k")).join(training.select(normalize_answer("question").alias("_k")).distinct(), "_k", "left_semi")
    return by_id.select("id", F.lit("id").alias("overlap")).unionByName(asked.select("id", F.lit("question").alias("overlap")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; empty for equal tables."""
    cols = a.columns
    left = a.exceptAll(b.select(cols)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(cols).exceptAll(a).withColumn("side", F.lit("right")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def require_empty(df: DataFrame, what: str) -> None:
    """Fail with some of the offending rows."""
    if bad := df.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")
