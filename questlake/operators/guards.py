"""Checks that stay in the plan: a filter whose other branch raises, so that no pruning of columns takes it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlake.operators.isolation import duplicates, require_empty


def checked(df: DataFrame, ok: Column, message: str | Column) -> DataFrame:
    """The rows, or an error for the first one read for which ``ok`` doesn't hold, whatever columns are used later."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def from_source(df: DataFrame, expected: str, by: str = "source") -> DataFrame:
    """Rows of the expected source; any other is an error."""
    return checked(df, F.col(by) == expected, F.concat(F.lit(f"{by} is not {expected}: "), F.coalesce(by, F.lit("null"))))


def training_only(df: DataFrame, split: str = "extra_info.split") -> DataFrame:
    """Rows of the training split; any other is an error."""
    return checked(df, F.col(split) == "train", "a row isn't of the training split")


def require_quotas(df: DataFrame, quotas: dict[str, int], by: str = "source") -> DataFrame:
    """``df`` if it has exactly so many rows of each group and no others; else an error, at once."""
    got = df.groupBy(by).agg(F.count("*").alias("n")).orderBy(by).limit(len(quotas) + 1).collect()
    if {r[by]: r.n for r in got} != {k: n for k, n in quotas.items() if n}:
        raise ValueError(f"expected {quotas} rows by {by}, found {[tuple(r) for r in got]}")
    return df


def require_balance(read: DataFrame, excluded: DataFrame, written: DataFrame, by: str = "source_split") -> DataFrame:
    """(split, read, excluded, written) if written = read - excluded in every split; else an error, at once."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    all_ = n(read, "read").join(n(excluded, "excluded"), by, "full").join(n(written, "written"), by, "full")
    out = all_.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("read", "excluded", "written")])
    require_empty(out.where("written != read - excluded"), "rows got lost or were added")
    return out


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` if no key occurs twice; else an error, at once."""
    require_empty(duplicates(df, *keys), f"{', '.join(keys)} occurs twice")
    return df
