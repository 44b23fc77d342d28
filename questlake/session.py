"""What operators need of the session: workers that find this package where it lies (on clusters --py-files ships it), and a folder
that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="questlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_SCRATCH: list[str] = []
_MADE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate rows; ``clear_scratch`` removes it, at the latest when Python ends."""
    path = f"{shared_folder(spark)}/questlake-{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clear_scratch)
    _SCRATCH.append(path)
    for run in getattr(_MADE, "runs", [])[-1:]:
        run.append(path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The intermediate folders that this thread makes meanwhile; other threads' operators have lists of their own."""
    runs = _MADE.__dict__.setdefault("runs", [])
    runs.append([])
    try:
        yield runs[-1]
    finally:
        runs.pop()


def scratch_paths() -> list[str]:
    """The intermediate folders that this process made and that are still there, oldest first."""
    return list(_SCRATCH)


def clear_scratch(paths: list[str] | None = None) -> None:
    """Remove intermediate folders, by default all that this process made; results that still read them are no longer valid."""
    sc, jvm = SparkContext._active_spark_context, SparkContext._jvm
    for path in list(_SCRATCH if paths is None else paths):
        with contextlib.suppress(Exception):  # the session may be gone
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        with contextlib.suppress(ValueError):  # another thread may have been first
            _SCRATCH.remove(path)


def cut(df: DataFrame, name: str = "rows", path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back, so that lineage stays short and a lost executor costs no recomputation."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed. Spark removes them once the driver has collected what planned them, which a driver
    with little to do may not do until the session ends."""
    gc.collect()
    spark.sql("SELECT 1").collect()  # the listeners hold the last query until another one ends
    with contextlib.suppress(Exception):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()
