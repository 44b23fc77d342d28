"""Resuming: what is left to do, and whether what is done is a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.operators.isolation import duplicates, require_empty


def remaining(candidates: DataFrame, completed: DataFrame, skipped: DataFrame, key: str = "uid") -> DataFrame:
    """Candidates neither completed nor skipped; an id may not be both."""
    require_empty(completed.select(key).intersect(skipped.select(key)), "completed and skipped")
    return candidates.join(completed.select(key).unionByName(skipped.select(key)).distinct(), key, "left_anti")


def completed_ids(df: DataFrame, key: str = "uid") -> DataFrame:
    require_empty(duplicates(df, key), "ids occur twice")
    return df.select(key)


def prefix_errors(results: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, error): results that aren't the first rows of the expected table, one after another from 0: other values, ordinals
    that the table lacks, ordinals that occur twice, and those that the results skip."""
    n = results.agg(F.count("*").alias("n"))
    a = results.groupBy("ordinal").agg(F.count("*").alias("times"), F.min(F.struct(*columns)).alias("got"))
    b = expected.select("ordinal", F.struct(*columns).alias("want"), F.lit(True).alias("known"))
    both = a.join(b, "ordinal", "full").join(F.broadcast(n), F.lit(True))  # one row
    error = (
        F.when(F.col("times") > 1, "twice")
        .when(F.col("times").isNull() & (F.col("ordinal") < F.col("n")), "missing")
        .when(F.col("times").isNotNull() & F.col("known").isNull(), "unknown")
        .when(F.col("times").isNotNull() & ~F.col("got").eqNullSafe(F.col("want")), "different")
    )
    return both.withColumn("error", error).where("error IS NOT NULL").select("ordinal", "error")


def prefix_mismatches(results: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Ordinals at which the results aren't the first rows of the expected table."""
    a, b = results.select("ordinal", F.struct(*columns).alias("got")), expected.select("ordinal", F.struct(*columns).alias("want"))
    return a.join(b, "ordinal", "left").where(~F.col("got").eqNullSafe(F.col("want"))).select("ordinal")
