"""Size-tiered sharded store.

Arrivals are appended as small immutable Parquet shards; a version is a manifest (JSON) that lists the live shards with their rows,
bytes and tier. Compaction takes each tier (by powers of ``fan_in`` of the bytes) that has at least ``fan_in`` shards of similar size,
merges them into files of about the target size and commits a version without the merged ones. Old versions stay readable until
``vacuum``.

A commit makes the whole manifest of the next number appear in one step that only one writer can do: local disks link a finished file
to the name, file systems such as HDFS rename without overwriting, object stores put it by a create that doesn't overwrite. The last
is one step only where the store has conditional writes (ABFS; S3 with ``fs.s3a.create.conditional.enabled``); elsewhere in object
stores let one writer at a time commit.

Before it writes, an append puts a note of its folder into ``open``; ``vacuum`` spares the folders of open writes until they are
``patience`` old, and data files younger than that, so it can't take files of a commit under way.

The manifest grows with the number of files, not of rows, and is the only thing the driver holds.

Defined cases: an empty arrival commits a version without new shards; null values and repeated rows are kept as they are; columns
that the schema doesn't have are left out; an empty store reads as no rows of its schema; two writers of one version: the later
one fails and may retry (``append`` retries by itself); texts of any length are kept whole.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from questlake.llm.common import hadoop_fs

TARGET = 128 << 20
FAN_IN = 4
#: Seconds after which a write that hasn't committed counts as given up.
PATIENCE = 24 * 3600
#: Stores whose create puts a whole object in one step when it is closed.
OBJECT_STORES = ("s3a", "s3", "abfs", "abfss", "gs", "oss", "obs")


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, target: int = TARGET, fan_in: int = FAN_IN, codec: str = "zstd", patience: float = PATIENCE):
        self.spark, self.path, self.schema, self.target, self.fan_in, self.codec, self.patience = spark, path.rstrip("/"), schema, target, fan_in, codec, patience
        fs, p = hadoop_fs(spark, f"{self.path}/manifests")
        fs.mkdirs(p)

    def _list(self, folder: str) -> list[tuple[str, int, float]]:
        """(path, bytes, age in seconds) of a folder's files."""
        fs, p = hadoop_fs(self.spark, folder)
        return [(s.getPath().toString(), s.getLen(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []

    def _read(self, path: str) -> str:
        fs, p = hadoop_fs(self.spark, path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = hadoop_fs(self.spark, path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _create(self, path: str, text: str) -> None:
        """A new whole file in one step; FileExistsError if it is there."""
        fs, final = hadoop_fs(self.spark, path)
        scheme = fs.getUri().getScheme()
        temp = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        try:
            if scheme in OBJECT_STORES:
                self._put(path, text)
                return
            self._put(temp, text)
            _, p = hadoop_fs(self.spark, temp)
            if scheme == "file":
                os.link(p.toUri().getPath(), final.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
                rule = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
                rule[0] = jvm.Options.Rename.NONE
                jvm.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(p, final, rule)
        except Py4JJavaError as e:
            if fs.exists(final):
                raise FileExistsError(path) from e
            raise
        finally:
            if scheme not in OBJECT_STORES:
                fs.delete(hadoop_fs(self.spark, temp)[1], False)

    def create(self, version: int, text: str) -> None:
        """The manifest of a version in one step; FileExistsError if it is there."""
        self._create(f"{self.path}/manifests/v{version:012d}.json", text)

    def versions(self) -> list[int]:
        names = [f.rpartition("/")[2] for f, _, _ in self._list(f"{self.path}/manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version, by default the newest: (version, shards of file, rows, bytes, tier)."""
        version = max(self.versions(), default=0) if version is None else version
        return json.loads(self._read(f"{self.path}/manifests/v{version:012d}.json")) if version else {"version": 0, "shards": []}

    def _commit(self, base: int, shards: list[dict]) -> int:
        """Version base + 1, or FileExistsError if another writer made it first."""
        self.create(base + 1, json.dumps({"version": base + 1, "shards": shards}))
        return base + 1

    def _added(self, shards: list[dict]) -> int:
        """Commit shards on top of the newest version, again if another writer was first."""
        while True:
            now = self.manifest()
            try:
                return self._commit(now["version"], [*now["shards"], *shards])
            except FileExistsError:
                continue

    def _folder(self) -> str:
        """A new data folder, noted as open."""
        name = uuid.uuid4().hex
        fs, p = hadoop_fs(self.spark, f"{self.path}/open")
        fs.mkdirs(p)
        self._put(f"{self.path}/open/{name}", "")
        return f"{self.path}/data/{name}"

    def _close(self, folder: str) -> None:
        fs, p = hadoop_fs(self.spark, f"{self.path}/open/{folder.rpartition('/')[2]}")
        fs.delete(p, False)

    def _tier(self, size: int) -> int:
        """0 for shards up to target / fan_in^3, one more for each factor of fan_in."""
        return max(0, 3 + math.floor(math.log(max(1, size) / self.target, self.fan_in) + 1e-9)) if size < self.target * 0.75 else 99

    def _written(self, folders: list[str]) -> list[dict]:
        """What lies in the folders, with the rows of each file by its own footer."""
        found = sorted((f, n) for folder in folders for f, n, _ in self._list(folder) if f.endswith(".parquet"))
        if not found:
            return []
        schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in self.schema.fields[:1])
        rows = self.spark.read.schema(schema).parquet(*[f for f, _ in found]).groupBy(F.col("_metadata.file_name").alias("name")).count()
        counts = {r.name: r["count"] for r in rows.collect()}  # a row a file; only footers and one column are read
        return [{"file": f, "rows": counts.get(f.rpartition("/")[2], 0), "bytes": n, "tier": self._tier(n)} for f, n in found]

    def append(self, arrival: DataFrame) -> int:
        """One arrival: its partitions become small shards, committed at once."""
        folder = self._folder()
        arrival.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.option("compression", self.codec).parquet(folder)
        version = self._added(self._written([folder]))
        self._close(folder)
        return version

    def append_many(self, arrivals: DataFrame, by: Column) -> list[int]:
        """Several arrivals, told apart by a condition on their columns, written in one pass over the input (one folder a value of ``by``) and
        committed one after another, or none of them if the write fails; their versions."""
        folder, name = self._folder(), f"arrival_{uuid.uuid4().hex}"
        rows = arrivals.select(*[F.col(f"`{c}`") for c in self.schema.names], by.alias(name))
        rows.write.option("compression", self.codec).partitionBy(name).parquet(folder)
        fs, p = hadoop_fs(self.spark, folder)
        subs = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())
        made = self._written(subs)
        versions = [self._added([s for s in made if s["file"].startswith(f"{sub}/")]) for sub in subs]
        self._close(folder)
        return versions

    def compact(self) -> int:
        """Merge tiers, lowest first, until none has ``fan_in`` shards; a version for each merge."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                tiers.setdefault(s["tier"], []).append(s)
            ready = [t for t in sorted(tiers) if t != 99 and len(tiers[t]) >= self.fan_in]
            if not ready:
                return now["version"]
            merge = tiers[ready[0]]
            total = sum(s["bytes"] for s in merge)
            files = max(1, round(total / self.target))
            if files >= len(merge):
                files = max(1, len(merge) // self.fan_in)
            folder = self._folder()
            rows = self.spark.read.schema(self.schema).parquet(*[s["file"] for s in merge])
            rows.coalesce(files).write.option("compression", self.codec).parquet(folder)
            gone = {s["file"] for s in merge}
            made = [s | {"tier": max(s["tier"], ready[0] + 1)} for s in self._written([folder])]
            while True:  # appends in between stay; only another compaction of the same shards makes this one void
                now = self.manifest()
                if not gone <= {s["file"] for s in now["shards"]}:
                    raise FileExistsError("another writer has merged these shards")
                try:
                    self._commit(now["version"], [*(s for s in now["shards"] if s["file"] not in gone), *made])
                    break
                except FileExistsError:
                    continue
            self._close(folder)

    def read(self, version: int | None = None) -> DataFrame:
        files = [s["file"] for s in self.manifest(version)["shards"]]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read_with_shard(self, version: int | None = None, name: str = "shard") -> DataFrame:
        """The rows with their file as ``name``; an error if the schema has such a column."""
        if name in self.schema.names:
            raise ValueError(f"the rows have a column {name}; choose another name")
        return self.read(version).withColumn(name, F.input_file_name())

    def vacuum(self) -> int:
        """Delete data files that the newest version doesn't list, and older manifests; the number of files deleted. Files of open writes
        stay, as do files younger than ``patience`` that no version lists."""
        newest = self.manifest()
        live, n = {s["file"] for s in newest["shards"]}, 0
        once = {s["file"] for v in self.versions() if v < newest["version"] for s in self.manifest(v)["shards"]}
        notes = self._list(f"{self.path}/open")
        open_ = {f.rpartition("/")[2] for f, _, age in notes if age < self.patience}
        fs, root = hadoop_fs(self.spark, f"{self.path}/data")
        if fs.exists(root):
            files = fs.listFiles(root, True)
            while files.hasNext():
                s = files.next()
                p, age = s.getPath(), time.time() - s.getModificationTime() / 1000
                path = p.toString()
                if not p.getName().endswith(".parquet") or path in live or any(f"/data/{o}/" in path for o in open_):
                    continue
                if path in once or age >= self.patience:
                    fs.delete(p, False)
                    n += 1
        for v in self.versions():
            if v < newest["version"]:
                fs.delete(hadoop_fs(self.spark, f"{self.path}/manifests/v{v:012d}.json")[1], False)
        for f, _, age in notes:
            if age >= self.patience:
                fs.delete(hadoop_fs(self.spark, f)[1], False)
        return n
