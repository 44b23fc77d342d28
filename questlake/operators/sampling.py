"""Seeded splits, quotas and orders that don't depend on partitioning."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlake.operators.isolation import duplicates, require_empty
from questlake.session import cut


def seeded(seed: int, id_col: str) -> list[Column]:
    """A reproducible pseudo-random order: MD5 of seed and id, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]


def ranked(df: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


#: Rows of a group beyond those wanted that one task may rank.
SLACK = 10_000


def group_limit(df: DataFrame) -> int:
    """Up to so many rows of a group Spark's windows keep no more than they need."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def first_of_groups(df: DataFrame, by: str, n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in any order, with their rank. Beyond what Spark's windows limit by themselves, groups are dealt
    to lanes by a hash of their order, ranked there, and only the first ``n`` of each lane are ranked again."""
    if n > group_limit(df):
        lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lane = df.withColumn("_lane", F.pmod(F.xxhash64(*order), F.lit(lanes)))
        df = lane.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_lane").orderBy(*order))).where(F.col("_rank") <= n).drop("_lane", "_rank")
    return ranked(df, by, *order, name=name).where(F.col(name) <= n)


def seeded_first(df: DataFrame, by: str, id_col: str, wanted: DataFrame | int, seed: int = 123, name: str = "rank", slack: int = SLACK) -> DataFrame:
    """The first rows of each group in seeded order, with their rank: ``wanted`` of each, or as many as the table (``by``, n) says.

    Small numbers are left to the window. Else a histogram of each group's leading digits of the seeded hash finds a cut below which the
    wanted rows lie, refined by further digits while more than ``slack`` rows share the cut; only rows up to it are ranked. Rows aren't
    shuffled for the histograms, and no window sees a whole group.
    """
    if isinstance(wanted, int) and wanted <= group_limit(df):
        return ranked(df, by, *seeded(seed, id_col), name=name).where(F.col(name) <= wanted)
    key, as_group = seeded(seed, id_col)[0], lambda t, other: t[by].eqNullSafe(other["_by"])
    rows = df.withColumn("_key", key)
    if isinstance(wanted, int):
        cuts = df.select(F.col(by).alias("_by")).distinct().withColumn("_n", F.lit(wanted).cast("long"))
    else:
        cuts = wanted.select(F.col(by).alias("_by"), F.col("n").cast("long").alias("_n"))
    cuts, digits = cuts.withColumns({"_cut": F.lit(""), "_below": F.lit(0).cast("long")}), 0
    while digits < 30:
        digits += 3
        at_cut = rows.select(by, "_key").join(cuts, as_group(rows, cuts)).where(F.startswith("_key", F.col("_cut")))
        bins = at_cut.groupBy("_by", "_n", "_below", F.substring("_key", 1, digits).alias("_cut")).agg(F.count("*").alias("_size"))
        w = Window.partitionBy("_by").orderBy("_cut")
        upto = bins.withColumn("_upto", F.col("_below") + F.sum("_size").over(w)).withColumn("_last", F.lead("_cut").over(w).isNull())
        hit = upto.where(((F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("_size") < F.col("_n"))) | (F.col("_last") & (F.col("_upto") < F.col("_n"))))
        cuts = cut(hit.where("_n > 0").select("_by", "_n", "_cut", (F.col("_upto") - F.col("_size")).alias("_below"), "_size"), "cuts")
        most = cuts.agg(F.max("_size").alias("most")).first().most
        cuts = cuts.drop("_size")
        if (most or 0) <= slack:
            break
    near = rows.join(cuts, as_group(rows, cuts)).where(F.substring("_key", 1, digits) <= F.col("_cut"))
    first = near.withColumn(name, F.row_number().over(Window.partitionBy("_by").orderBy("_key", id_col))).where(F.col(name) <= F.col("_n"))
    return first.drop("_key", "_by", "_n", "_cut", "_below")


def quota_sample(df: DataFrame, by: str, id_col: str, total: int, seed: int = 123) -> DataFrame:
    """Rows of each group up to its share of ``total``, in seeded order."""
    return seeded_first(df, by, id_col, quotas(df, by, total).select(by, F.col("quota").alias("n")), seed).drop("rank")


def exact_sample(df: DataFrame, by: str, id_col: str, wanted: dict[str, int], seed: int = 123) -> DataFrame:
    """Rows that ``random.Random(seed).sample`` draws from the sorted ids of one group after another, in the order of ``wanted``.

    The draws are made on places (``range``), of which Python keeps as many as are drawn; ids are sorted and numbered by Spark, each
    range of them on its own. Ids must be unique; a group with fewer rows than wanted is an error.
    """
    spark = df.sparkSession
    listed = cut(df.where(F.col(by).isin(list(wanted))).select(by, id_col).repartitionByRange(by, id_col).sortWithinPartitions(by, id_col).withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ids")
    runs = listed.groupBy(by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    begins = runs.withColumn("_before", F.coalesce(before, F.lit(0)))
    sizes = {r[by]: r.n for r in listed.groupBy(by).agg(F.count("*").alias("n")).collect()}  # a row a wanted group
    rng, drawn = random.Random(seed), []
    for group, n in wanted.items():
        if n > sizes.get(group, 0):
            raise ValueError(f"{group} has fewer than {n} rows")
        drawn += [(group, at) for at in rng.sample(range(sizes.get(group, 0)), n)]
    places = spark.createDataFrame(drawn, f"{by} string, _place long")
    numbered = listed.join(begins, [by, "_task"]).withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first"))
    return df.join(numbered.join(places, [by, "_place"]).select(by, id_col), [by, id_col], "left_semi")


def taken(df: DataFrame, by: str, quota: int, *order: Column) -> DataFrame:
    """The first ``quota`` rows of each group; a group that has fewer is an error, at once."""
    short = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < quota)
    require_empty(short, f"fewer than {quota} rows")
    return first_of_groups(df, by, quota, *order)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """A total order, by ordinal or uid, for sinks whose readers rely on it."""
    return df.orderBy(*columns)


def train_validation(df: DataFrame, train: int, validation: int, id_col: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The first rows of two tables' seeded orders, as trainers load them: ``split`` tells the tables apart."""
    part = lambda name, n: df.where(F.col("split") == name).orderBy(*seeded(seed, id_col)).limit(n)
    return part("train", train), part("validation", validation)


def split_by_source(df: DataFrame, by: str, id_col: str, train: int, validation: int, seed: int = 123) -> DataFrame:
    """``split``: the first ``train`` of each source in seeded order are train, the next ``validation`` are validation."""
    r = seeded_first(df, by, id_col, train + validation, seed)
    return r.withColumn("split", F.when(F.col("rank") <= train, "train").otherwise("validation"))


def round_robin(df: DataFrame, by: str, id_col: str, n: int, seed: int = 123, sources: int | None = None) -> DataFrame:
    """Sources take turns, each in its seeded order; the first ``n`` rows get their ``position``. Fewer than ``n`` rows, an id that occurs
    twice, or another number of sources than ``sources`` are errors, at once."""
    require_empty(duplicates(df, id_col), "ids occur twice")
    found = df.groupBy(by).agg(F.count("*").alias("n")).agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if sources is not None and found.sources != sources:
        raise ValueError(f"expected {sources} sources, found {found.sources}")
    if found.rows < n:
        raise ValueError(f"fewer than {n} rows")
    first = seeded_first(df, by, id_col, n, seed, name="turn").orderBy("turn", by).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy("turn", by)))


def quotas(df: DataFrame, by: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total``: whole parts, then one more by remainder, then by name. One row a group."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    everything = df.agg(F.count("*").alias("all"))
    parts = n.join(everything, F.lit(True)).select(by, "n", F.expr(f"{total} * n div all").alias("whole"), F.expr(f"{total} * n % all").alias("rest"))
    order = Window.orderBy(F.desc("rest"), by)
    left = F.lit(total) - F.sum("whole").over(Window.partitionBy())
    return parts.withColumn("quota", F.col("whole") + (F.row_number().over(order) <= left).cast("long")).select(by, "n", "quota")


def exact_random_ranks(ids_by_source: dict[str, list[str]], seed: int, shared: bool) -> dict[str, list[str]]:
    """Orders of Python's own generator, for parity with small published splits: one generator a source, or one for all."""
    rng, out = random.Random(seed), {}
    for source in sorted(ids_by_source):
        ids = sorted(ids_by_source[source])
        (rng if shared else random.Random(seed)).shuffle(ids)
        out[source] = ids
    return out
