"""Connected components by large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes of ``edges`` (two columns of long): the least node that edges connect it with.

    Each round hangs every node's greater neighbours, then its lesser ones, on the least of them; the number of rounds grows with the
    logarithm of the longest path, and each round's edges, which never are more than before, are written. A node of very many edges
    costs one row of a join's smaller side.
    """
    ends = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*ends).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        kept = cut(large.union(now.where("lo = hi")).where("lo <= hi").distinct(), "large")
        down = kept.groupBy("hi").agg(F.min("lo").alias("m"))
        small = kept.join(down, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        now = cut(small.distinct(), "small")
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
