"""Connected components over tables in the shared folder, and joins that hot keys don't pile up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.llm.common import clear_scratch, scratch_path, written

#: A key is hot if it has more than this part of all rows; so fewer than this many are broadcast.
HOT_SHARES = 256


def joined(rows: DataFrame, keyed: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """``rows`` with the columns of ``keyed`` (one row a key, with its number of rows among ``total``), inner. Rows of hot keys stay
    where they lie and meet a broadcast that is bounded by their share; the others are shuffled."""
    hot = F.col(count) * HOT_SHARES > total
    few = F.broadcast(keyed.where(hot).drop(count))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot).drop(count), key)
    return rows.join(few, key).unionByName(rest)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    ``edges`` are links (u, v), u > v. Large-star and small-star rounds alternate until the links are stars around least nodes: each
    u has one v, and no v is a u.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, name)
    e = written(edges, name, path)
    while True:
        per = e.groupBy("u").agg(F.count("*").alias("n"))
        if per.where("n > 1").isEmpty() and e.join(per.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), name, at := scratch_path(spark, name))
        large = joined(both, least, "u", 2 * e.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name, large_at := scratch_path(spark, name))
        down = large.groupBy("u").agg(F.min("v").alias("m"))  # a node has one link for each neighbour that was a least one
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(small, name, now := scratch_path(spark, name))
        clear_scratch([path, at, large_at])
        path = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
