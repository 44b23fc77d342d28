"""Several outputs that appear together, and batches that are appended once."""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from questlake.sources.io import hadoop, table_digest, write_text


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole and in one step; FileExistsError if there is one. Local disks link it to its name, HDFS renames without
    overwriting; object stores need conditional writes for that, elsewhere let one writer at a time publish."""
    fs, final = hadoop(spark, path)
    temp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    write_text(spark, temp, text)
    _, made = hadoop(spark, temp)
    try:
        if fs.getUri().getScheme() == "file":
            os.link(made.toUri().getPath(), final.toUri().getPath())
        else:
            names = spark.sparkContext._jvm.org.apache.hadoop.fs
            how = spark.sparkContext._gateway.new_array(names.Options.Rename, 1)
            how[0] = names.Options.Rename.NONE
            names.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, final, how)
    except Py4JJavaError as e:
        if fs.exists(final):
            raise FileExistsError(path) from e
        raise
    finally:
        with contextlib.suppress(Py4JJavaError):
            fs.delete(made, False)


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = hadoop(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a version, by default the newest, holds: its outputs with path, schema, rows and digest, and the note given with it."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing is published in {root}")
    path = f"{root}/manifests/{known[-1] if version is None else version:012d}.json"
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def publish(spark: SparkSession, root: str, outputs: dict[str, DataFrame], form: str = "json", note: dict | None = None) -> int:
    """Write all ``outputs``, read them back for their rows and digests, and make them the next version in one step; its number.

    Each output is a folder of its own below a folder that nobody knows until the manifest names it, so whatever stops a run half-way
    leaves the version before as the newest. Formats that change a value (JSON drops null fields) show in the digest of the rows as
    they are read back, which must be that of the rows written; else it is an error and nothing is published.
    """
    folder, found = f"{root}/data/{uuid.uuid4().hex}", {}
    for name, df in outputs.items():
        df.write.format(form).save(f"{folder}/{name}")
        back = spark.read.schema(df.schema).format(form).load(f"{folder}/{name}")
        told, seen = (table_digest(x).first() for x in (df, back))
        if told != seen:
            raise ValueError(f"{name} isn't read back as it was written: {told.rows} and {seen.rows} rows")
        found[name] = {"path": f"{folder}/{name}", "form": form, "schema": df.schema.jsonValue(), "rows": seen.rows, "digest": str(seen.digest)}
    fs, p = hadoop(spark, f"{root}/manifests")
    fs.mkdirs(p)
    n = max(versions(spark, root), default=0) + 1
    create_once(spark, f"{root}/manifests/{n:012d}.json", json.dumps({"version": n, "outputs": found, "note": note or {}}))
    return n


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    of = manifest(spark, root, version)["outputs"][name]
    return spark.read.schema(StructType.fromJson(of["schema"])).format(of["form"]).load(of["path"])


def append_once(df: DataFrame, path: str, batch: int | str) -> bool:
    """Append a batch unless it is there: False if it was. A batch is a folder that counts from its success marker on, so one that was cut
    off is written again, and a batch that is repeated (by a run that resumes, or by a stream's ``foreachBatch``) isn't."""
    part = f"{path}/batch={batch}"
    if _finished(df.sparkSession, part):
        return False
    df.write.mode("overwrite").json(part)
    return True


def _finished(spark: SparkSession, part: str) -> bool:
    fs, p = hadoop(spark, f"{part}/_SUCCESS")
    return fs.exists(p)


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all finished batches, with ``batch``."""
    fs, p = hadoop(spark, path)
    parts = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("batch=")] if fs.exists(p) else []
    done = [x for x in parts if _finished(spark, x)]
    shape = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not done:
        return spark.createDataFrame([], shape).withColumn("batch", F.lit(None).cast("string"))
    rows = spark.read.schema(shape).json(done)
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]*)/", 1))
