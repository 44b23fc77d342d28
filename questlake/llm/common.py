"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.session import clear_scratch, importable, recorded, scratch_path, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any store Spark can read works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scan_partitions(df: DataFrame) -> int:
    """Follows the input's size: Spark cuts files by spark.sql.files.maxPartitionBytes."""
    return df.rdd.getNumPartitions()


def parallelism(df: DataFrame, factor: int) -> int:
    """Partitions for data that grows with ``df``."""
    importable(df.sparkSession)
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, factor * scan_partitions(df))


def utf8_arrays(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets, without a copy; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("", col.type))
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    base = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return base[off[0] : off[-1]], off - off[0]


def utf8_rows(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Row texts as UTF-8 bytes; null reads as empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


@contextlib.contextmanager
def kept_only(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for a result; the other intermediate folders that this thread makes meanwhile are removed at the end."""
    path = scratch_path(spark, name)
    with recorded() as made:
        try:
            yield path
        finally:
            clear_scratch(made)


ArrowFields = list[tuple[str, pa.DataType, T.DataType]]


def add_columns(df: DataFrame, needed: list[str], fields: ArrowFields, start: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None) -> DataFrame:
    """Append columns made from Arrow batches.

    ``start`` runs once a task and gives the function from a batch to one array (or list) per field. Columns kept that have the
    name of a new one are replaced. ``needed`` are the inputs of that function.
    """
    importable(df.sparkSession)
    names = [n for n, _, _ in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    cols = list(dict.fromkeys([*keep, *needed]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, _, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or start()
            for part in pieces(batch):
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, (_, t, _) in zip(fn(part), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], names=[*keep, *names])

    return df.select(*[f"`{c}`" for c in cols]).mapInArrow(run, schema)


def boxed(df: DataFrame, *inputs: str) -> DataFrame:
    """All columns in one struct ``doc``, beside copies of ``inputs``: what operators add can't clash with them."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    return df.select(whole, *[F.col(f"`{c}`") for c in inputs])


def unboxed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes, so that working arrays stay small; a single row may be longer."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= most:
        if n:
            yield batch
        return
    step = max(1, n * most // batch.nbytes)
    for at in range(0, n, step):
        yield batch.slice(at, step)


def ids_array(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; null becomes the least long."""
    return pc.fill_null(col.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
