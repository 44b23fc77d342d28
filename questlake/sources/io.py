"""Sources and sinks. Schemas are explicit; writes go through Spark's committer, which publishes whole outputs only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from questlake.functions.text import strip
from questlake.operators.guards import checked
from questlake.operators.isolation import duplicates, require_empty
from questlake.session import cut


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, ordinal: bool = False) -> DataFrame:
    """Bad lines raise; blank ones are skipped. With ``ordinal`` rows are numbered from 0 in the order of the files' names and lines."""
    if not ordinal:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    row = F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"})
    return numbered_lines(spark, path).select(row.alias("row"), "ordinal").select("row.*", "ordinal")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal): the lines that aren't blank, numbered from 0 by file name and place in the file.

    Files are read in splits, many tasks to a file. A first pass counts each split's lines; the sums of the splits before it are where
    a split's numbers begin, so only one row a split, not the lines, goes through a window. Files that change between the passes are
    an error.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    placed = lines.where(strip("value") != "").withColumn("_at", F.monotonically_increasing_id())  # rises within a split
    counts = cut(placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last")), "splits")
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    found = placed.join(begins, ["_file", "_start"], "left")
    same = F.col("_at").between(F.col("_first"), F.col("_last"))
    return checked(found, same, "a file changed while it was read").select("value", (F.col("_before") + F.col("_at") - F.col("_first")).alias("ordinal"))


def read_splits(spark: SparkSession, paths: dict[str, str], schema: StructType | str, form: str = "json") -> DataFrame:
    """One table of several splits, with ``source_split``."""
    out = None
    for split, path in paths.items():
        df = spark.read.schema(schema).format(form).load(path).withColumn("source_split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def read_eval(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """Evaluation rows with ``ordinal``, of the first ``limit`` lines; empty tables and repeated ids are errors. Rows that have an ordinal
    of their own keep it, others get the file's order."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    known = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = read_jsonl(spark, path, schema, ordinal="ordinal" not in known.names)
    df = df if limit is None else df.where(F.col("ordinal") < limit)
    require_empty(duplicates(df, "id"), "ids occur twice")
    if df.isEmpty():
        raise ValueError("no evaluation rows")
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_messages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.to_json(F.struct("messages")).alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    """Resumable output: batches are appended whole."""
    df.write.mode("append").json(path)


def open_output(spark: SparkSession, path: str, resume: bool) -> None:
    """A folder for ``append``: a run that doesn't resume needs an empty one, a run that does needs one that is there."""
    fs, p = hadoop(spark, path)
    there = fs.exists(p)
    if resume and not there:
        raise FileNotFoundError(path)
    if not resume and there and fs.listStatus(p):
        raise FileExistsError(f"{path} isn't empty")
    fs.mkdirs(p)


def read_ids(spark: SparkSession, path: str, name: str = "uid") -> DataFrame:
    """An id a line, without white space around it; blank lines are skipped, repeated ids are errors."""
    ids = spark.read.text(path).select(strip("value").alias(name)).where(F.col(name) != "")
    require_empty(duplicates(ids, name), "ids occur twice")
    return ids


def write_ids(df: DataFrame, path: str, name: str = "uid") -> None:
    df.select(F.col(name).cast("string").alias("value")).write.mode("append").text(path)


#: Files up to this size are hashed by executors, each in one row.
WHOLE = 256 << 20


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(path, sha256) of a file or of the files in a folder. Executors read and hash files of up to ``whole`` bytes; longer ones, which
    don't fit a row, are read as streams by the driver."""
    fs, p = hadoop(spark, path)
    jvm, rows = spark.sparkContext._jvm, []
    for found in fs.globStatus(p) or []:
        for f in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if f.isFile() and (f.getLen() == 0 or f.getLen() > whole):  # Spark leaves empty files out
                stream = fs.open(f.getPath())
                try:
                    rows.append((f.getPath().toString(), jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
                finally:
                    stream.close()
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))
    return small.unionByName(spark.createDataFrame(rows, "path string, sha256 string"))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest: rows and the sum of their hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).alias("digest"))


#: Rows that a report may have.
REPORT_ROWS = 10_000


def write_report(rows: DataFrame, path: str, title: str, most: int = REPORT_ROWS) -> None:
    """A small result as JSON and Markdown beside each other, in any store that Spark writes; more than ``most`` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    got = [r.asDict(recursive=True) for r in found]
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = "\n".join("| " + " | ".join(str(r[c]) for c in rows.columns) + " |" for r in got)
    write_text(rows.sparkSession, f"{path}/report.json", json.dumps(got, indent=2, ensure_ascii=False, default=str))
    write_text(rows.sparkSession, f"{path}/report.md", f"# {title}\n\n{head}\n{body}\n")


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
