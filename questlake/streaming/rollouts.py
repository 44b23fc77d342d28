"""Extension: rollout records that arrive as a stream. The batch operators are the reference's; this only feeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_rollouts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def termination_counts(stream: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Terminations in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), "termination_reason").agg(F.count("*").alias("n"))
