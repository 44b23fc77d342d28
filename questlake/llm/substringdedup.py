"""Substring dedup of word windows with a log-structured fingerprint index.

A window's fingerprint is the hash of its least gram (see ``winnow``). ``FingerprintLog`` keeps the fingerprints of all batches in
sorted immutable runs in the shared folder; each new batch is merge-joined with the runs and becomes a run itself, and runs of
similar size are merged. What the joins find is verified on the words: contents that share a fingerprint meet, and equal windows are
counted.

A word goes if a window of 35 words that covers it also starts anywhere else, in the same document included; windows are judged on
the input. ``substring_dedup`` judges all documents of its input, which it takes in as several batches; ``incremental`` judges a new
batch against the history.

Defined cases: null texts have no words; texts shorter than a window stay whole; repeated rows are occurrences, so both lose their
windows; null ids are kept; an empty table gives no rows; extra columns are ignored, or kept by ``cleaned`` whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from questlake.llm.common import hadoop_fs, kept_only, parallelism, scratch_path, written
from questlake.llm.sharding import ShardStore
from questlake.llm.winnow import GRAMS, Met, Part, Rule, Spec, applied, bucketed, cut, gram_rows, in_runs, known_buckets, own_tables, resolved, shard_count, shard_table, stretch_rows
from questlake.session import importable

WINDOW = 35
#: Arrivals that a one-off run deals its input into.
BATCHES = 3


RUN = "gram long, n int, kinds long"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gram").agg(F.sum("n").cast("int").alias("n"), F.sum("kinds").alias("kinds"))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row a fingerprint, of two that have a row each. Not by grouping their union: Spark 4.1 takes a union of bucketed scans for
    dealt by the key, but puts its partitions one after the other, so that the rows of a key don't meet."""
    other = b.select("gram", F.col("n").alias("n_b"), F.col("kinds").alias("kinds_b"))
    both = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_b", F.lit(0))
    return a.join(other.hint("merge"), "gram", "full").select("gram", both("n").cast("int").alias("n"), both("kinds").cast("long").alias("kinds"))


class FingerprintLog:
    """The index of the fingerprints of all batches so far: sorted immutable runs in a folder that all executors share.

    ``append`` takes a batch of arrivals: its fingerprints become a sorted run. Runs that are not much larger than what comes after them
    are merged with it and written once, together, so there are few runs and each entry is rewritten a logarithmic number of times.
    ``deduplicated`` merge-joins the batches' fingerprints with what repeats in the runs and verifies what it finds on the words themselves.

    Each file written starts processes for its permissions where Hadoop has no native library, so nothing is written that a join or
    a scan of the runs gives as well.

    Runs are bucketed and sorted by fingerprint, so joins shuffle nothing. Each batch ends in a manifest of the next number, which appears
    whole and in one step (as the sharded store's do) and lists what is valid: a driver that dies leaves the log as it was before the
    batch, and of two writers the later one fails. ``FingerprintLog`` on the same folder goes on from the newest manifest; a folder that
    holds runs but no manifest is an error. Runs that were merged away are removed one batch later.

    The number of buckets is fixed when the log is made; choose it for the history that is expected.
    """

    def __init__(self, spark: SparkSession, path: str, spec: Spec, buckets: int = 64, ratio: int = 3):
        self.spark, self.path, self.spec, self.ratio = spark, path.rstrip("/"), spec, ratio
        importable(spark)
        self.state = {"buckets": buckets, "window": spec.window, "gram": spec.gram, "batches": [], "runs": []}
        self.manifests = ShardStore(spark, self.path, StructType())
        fs, p = hadoop_fs(spark, self.path)
        known = max(self.manifests.versions(), default=0)
        if known:
            self.state = self.manifests.manifest(known)
        elif any(s.isDirectory() and s.getPath().getName().partition("-")[0] in ("run", "grams", "shards") for s in fs.listStatus(p)):
            raise ValueError(f"{path} holds runs but no manifest")
        if known:
            if (self.state["window"], self.state["gram"]) != (spec.window, spec.gram):
                raise ValueError("the log holds fingerprints of other windows")
        self.tables: dict[str, DataFrame] = {}

    def _commit(self, state: dict) -> None:
        """``state`` as the next version; FileExistsError, and nothing changed, if another writer made it first."""
        old = self.state.get("merged", [])
        state = {**state, "version": self.state.get("version", 0) + 1}
        self.manifests.create(state["version"], json.dumps(state))
        self.state = state
        for path in old:  # no reader of the version before needs them any more
            fs, p = hadoop_fs(self.spark, path)
            fs.delete(p, True)

    def _put(self, df: DataFrame, kind: str, by: str, buckets: int) -> tuple[str, DataFrame]:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        self.tables[path] = bucketed(df, path, by, buckets, ordered=True)
        return path, self.tables[path]

    def _get(self, path: str, schema: str, by: str, buckets: int) -> DataFrame:
        """A table of this folder, with its buckets, in this session or a later one."""
        if path not in self.tables:
            self.tables[path] = known_buckets(self.spark, path, schema, by, buckets)
        return self.tables[path]

    def _run(self, run: dict) -> DataFrame:
        rows = self._get(run["path"], RUN, "gram", self.state["buckets"])
        return rows

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> int:
        """Take a batch in; its number. Its documents are dealt to ``shards`` (by default some for each partition of its scan, none of much more than ``winnow.SHARD`` bytes)."""
        s, n = self.state, shards or shard_count(docs, text_col, 6)
        first, buckets = sum(b["shards"] for b in s["batches"]), s["buckets"]
        path = f"{self.path}/shards-{uuid.uuid4().hex}"
        self.tables[path] = shard_table(docs, id_col, text_col, path, n, first)
        grams, table = self._put(gram_rows(self.tables[path], self.spec, False), "grams", "gram", buckets)
        runs, mine, rows, gone = list(s["runs"]), _summed(table), table.count(), []
        while runs and runs[-1]["rows"] < self.ratio * rows:
            rows += runs[-1]["rows"]
            gone.append(runs.pop())
            mine = _merged(mine, self._run(gone[-1]))
        made, run = self._put(mine, "run", "gram", buckets)
        batches = [*s["batches"], {"path": path, "grams": grams, "first": first, "shards": n}]
        self._commit({**s, "runs": [*runs, {"path": made, "rows": run.count()}], "batches": batches, "merged": [r["path"] for r in gone]})
        return len(batches) - 1

    def deduplicated(self, rule: Rule, batch: int | None = None) -> DataFrame:
        """What ``rule`` makes of all documents, or of one batch's, judged against everything in the log. For one batch, only those shards
        of the history are read that share a fingerprint with it; their numbers pass through the driver."""
        s, buckets, n = self.state, self.state["buckets"], max((b["shards"] for b in self.state["batches"]), default=1)
        each = [(b, self._get(b["path"], "id long, text string, shard long", "shard", b["shards"]), self._get(b["grams"], GRAMS, "gram", buckets)) for b in s["batches"]]
        runs = [self._run(r) for r in s["runs"]]
        known = reduce(_merged, runs).where("n > 1").select("gram", (F.col("kinds") > self.spec.hot).alias("hot"))
        if batch is not None:
            known = known.join(each[batch][2].select("gram"), "gram", "left_semi")
        if batch is not None or len(runs) > 1:  # else a scan of the run, which needs no shuffle
            known = bucketed(known, scratch_path(self.spark, "known"), "gram", buckets, ordered=True)
        flagged = F.when(F.col("hot"), F.col("gram").bitwiseOR(F.lit(1 << 62))).otherwise(F.col("gram")).alias("gram")
        sides = [g.join(known.hint("merge"), "gram").select("shard", flagged) for _, _, g in each]
        texts = [self._hit(t, side) if batch not in (None, k) else t for k, ((_, t, _), side) in enumerate(zip(each, sides))]
        contents = reduce(DataFrame.unionByName, [stretch_rows(t, side, self.spec, b["shards"], rule.count) for (b, _, _), t, side in zip(each, texts, sides) if t is not None])
        answers = written(resolved(contents, sum(b["shards"] for b in s["batches"]), rule.resolver), "answers")
        out = []
        for k, ((b, t, _), side) in enumerate(zip(each, sides)):
            if batch in (None, k):
                here = answers.where(F.col("shard").between(b["first"], b["first"] + b["shards"] - 1))
                out.append(applied(t, side, here, self.spec, rule, b["shards"]))
        return reduce(DataFrame.unionByName, out)


    def _hit(self, texts: DataFrame, side: DataFrame) -> DataFrame | None:
        """The shards that ``side`` names, by their buckets, or None if there are none."""
        wanted = [r.shard for r in side.select("shard").distinct().collect()]  # one row a shard, each of some megabytes of text
        return texts.where(F.col("shard").isin(wanted)) if wanted else None


def by_words(met: Met, window: int = WINDOW) -> list[bytes]:
    """Verification: which windows of the contents occur more than once, by their words; b"" where none does.

    A window is compared with those of the contents that share its fingerprint; no others can be equal.
    """
    out: list[bytes] = []
    for a, b in cut(met.anchors):
        seen: dict[bytes, int] = {}
        mine, distinct = [], {}
        for c, v in zip(met.contents[a:b], met.values[a:b].tolist()):
            if c not in distinct:
                ends = [i for i, x in enumerate(c) if x == 32] + [len(c)]
                starts = [0, *(e + 1 for e in ends[:-1])]
                distinct[c] = [c[i:j] for i, j in zip(starts, ends[window - 1 :])]
            for x in distinct[c]:
                seen[x] = seen.get(x, 0) + v
            mine.append(c)
        told = {c: np.array([seen[x] > 1 for x in w], np.int64) for c, w in distinct.items()}
        packed = {c: in_runs(v) if v.any() else b"" for c, v in told.items()}
        out += [packed[c] for c in mine]
    return out


def _rows(part: Part, mask: np.ndarray) -> list[tuple]:
    out = []
    for doc, a, b in zip(part.ids.tolist(), part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
        m = mask[a:b]
        gone = int(m.sum())
        words = part.words[a:b]
        kept = b" ".join([w for w, g in zip(words, m.tolist()) if not g]) if gone else b" ".join(words)
        out.append((None if doc == np.iinfo(np.int64).min else doc, b - a, gone, hashlib.sha256(kept).hexdigest()))
    return out


def _texts(part: Part, mask: np.ndarray) -> list[tuple]:
    """Only documents that lose words: a digest of their words and the remaining text."""
    out = []
    for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()):
        m = mask[a:b]
        if m.any():
            words = part.words[a:b]
            out.append((hashlib.sha256(b" ".join(words)).hexdigest(), b" ".join([w for w, g in zip(words, m.tolist()) if not g]).decode()))
    return out


def _run(docs, finish, fields, id_col, text_col, window, gram, hot=4096, batches=BATCHES):
    spark, spec = docs.sparkSession, Spec(window, gram, True, hot)
    # by value: a row belongs to the same arrival in each job, however its input is partitioned then
    arrival = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(batches))
    with kept_only(spark, "deduplicated") as path, own_tables(spark):
        log, shards = FingerprintLog(spark, scratch_path(spark, "fingerprints"), spec, parallelism(docs, 1)), -(-shard_count(docs, text_col, 4) // batches)
        for k in range(batches):
            log.append(docs.where(arrival == k) if batches > 1 else docs, id_col, text_col, shards)
        return written(log.deduplicated(Rule(lambda met: by_words(met, window), True, 0, lambda v, doc: v > 0, finish, fields)), "deduplicated", path)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 8, hot: int = 4096, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) a document; the input arrives in ``batches``, dealt by a hash of its rows."""
    fields = [("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    return _run(docs, _rows, fields, id_col, text_col, window, gram, hot, batches)


def incremental(log: FingerprintLog, arrivals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``substring_dedup`` for a batch that is taken into ``log``, judged against its history and itself."""
    fields = [("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    k = log.append(arrivals, id_col, text_col)
    window = log.spec.window
    return log.deduplicated(Rule(lambda met: by_words(met, window), True, 0, lambda v, doc: v > 0, _rows, fields), k)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 8) -> DataFrame:
    """``docs`` with repeated windows taken out of the text; documents that lose no word keep theirs as it is. The words alone decide
    what goes, so rows are matched by a digest of their words: ids may repeat or be null, and other columns may have any name."""
    fields = [("words", pa.string(), "string"), ("kept", pa.string(), "string")]
    less = _run(docs, _texts, fields, id_col, text_col, window, gram).dropDuplicates(["words"])
    # the document's columns travel as one struct, so that none of them can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc").getField(text_col)
    words = F.sha2(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), 256)
    joined = whole.withColumn("words", words).join(less, "words", "left")
    return joined.select(*[F.coalesce("kept", F.col("doc").getField(c)).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
