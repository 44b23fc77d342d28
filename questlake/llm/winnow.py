"""Repeated windows of symbols over whole corpora, without shuffling every window.

A window of W symbols is represented by its least hashed gram (winnowing), the fingerprint: equal windows have equal least grams, so
windows that repeat are found among the stretches whose gram repeats. The passes are:

1. documents are dealt to shards in a bucketed table, so that later passes shuffle no text;
2. each shard gives its distinct gram hashes, a row each (pre-aggregated: a gram of a hot passage counts once a shard); those that
   repeat go back to the shards that have them;
3. each shard gives the distinct stretches (runs of windows with one repeated gram) with what it knows of them, a row each; a gram with
   very many distinct stretches (the edges of a common passage) gives single windows instead, spread by their own hash, so that no
   task gets them all;
4. rows meet sorted by gram, and a resolver compares the contents (see suffixdedup and substringdedup) and answers for each window;
5. each shard applies the answers to its documents.

Rows grow with the grams, whatever the number of shards. Equality is always decided on contents; hashes only bring candidates
together.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questlake.llm.common import ids_array, kept_only, parallelism, pieces, scratch_path, utf8_arrays, utf8_rows, written
from questlake.session import free_shuffles

CHUNK = 1 << 20
SLAB = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 1024)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW.append(np.cumprod(x))
        _POW[:] = _POW[-2:]
    return _POW[0][:n], _POW[1][:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass(frozen=True)
class Spec:
    """hot: distinct stretches of a gram, summed over shards, beyond which its windows are spread."""

    window: int
    gram: int
    words: bool
    hot: int = 4096

    def runs(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches (first window start, last + 1, 48-bit hash of the one least gram, hash of the content); none crosses a document."""
        n = len(symbols) - self.window + 1
        if n < 1:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        valid = np.zeros(n, bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            valid[a : max(a, b - self.window + 1)] = True
        slabs = [(at, *self._slab(symbols[at : at + SLAB + self.window - 1], valid[at : at + SLAB])) for at in range(0, n, SLAB)]
        return np.concatenate([at + x for at, x, *_ in slabs]), np.concatenate([at + x for at, _, x, *_ in slabs]), *(np.concatenate([s[k] for s in slabs]) for k in (3, 4))

    def _slab(self, symbols: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of at most SLAB windows. Of equal least grams the leftmost counts, by a place of 16 bits that a slab can't exceed."""
        n, k = len(symbols), self.gram
        h = prefix_hashes(symbols)
        low = mixed((h[k:] - h[:-k]) * powers(n - k + 1)[1])
        low = (low & ~np.uint64(0xFFFF)) | np.arange(len(low), dtype=np.uint64)
        size, want = 1, self.window - k + 1
        while size < want:
            step = min(size, want - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        edge = low[1:] != low[:-1]
        starts = np.flatnonzero(valid & np.r_[True, ~valid[:-1] | edge])
        stops = np.flatnonzero(valid & np.r_[~valid[1:] | edge, True]) + 1
        whole = mixed((h[stops + self.window - 1] - h[starts]) * powers(n)[1][starts])
        # least hashes crowd near zero; mixed again, they spread over all ranges
        return starts, stops, mixed(low[starts] & ~np.uint64(0xFFFF)) >> np.uint64(16), whole


class Part:
    """Documents of a shard, about a chunk of symbols at once."""

    def __init__(self, spec: Spec, ids: np.ndarray, data: np.ndarray, words: list[bytes], offsets: np.ndarray):
        self.spec, self.ids, self.data, self.words, self.offsets = spec, ids, data, words, offsets
        symbols = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) if spec.words else data.astype(np.uint64) + np.uint64(1)
        self.starts, self.stops, self.grams, self.whole = spec.runs(symbols, offsets)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1

    def content(self, a: int, b: int) -> bytes:
        return b" ".join(self.words[a:b]) if self.spec.words else self.data[a:b].tobytes()


def parts(spec: Spec, table: pa.Table) -> Iterator[Part]:
    """The shard's documents in a fixed order: by id, then text."""
    table = table.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")])
    ids = ids_array(table.column("id"))
    if spec.words:
        words, offsets, first = [], [0], 0
        for i, text in enumerate(utf8_rows(table.column("text"))):
            words += text.split()
            offsets.append(len(words))
            if len(words) >= CHUNK // 4 or i + 1 == len(ids):
                yield Part(spec, ids[first : i + 1], np.zeros(0, np.uint8), words, np.array(offsets))
                words, offsets, first = [], [0], i + 1
        return
    data, offsets = utf8_arrays(table.column("text"))
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK)))
        last = min(last, len(ids))
        yield Part(spec, ids[first:last], data[offsets[first] : offsets[last]], [], offsets[first : last + 1] - offsets[first])
        first = last


def cut(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal keys start and end."""
    at = _first(keys).tolist()
    return zip(at, [*at[1:], len(keys)])


def _first(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)


def bucketed(df: DataFrame, path: str, by: str, buckets: int, ordered: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, dealt (and sorted) by ``by`` so that grouping by it needs no shuffle.

    Its catalog entry is temporary: ``forget`` drops it, the files stay where ``path`` says.
    """
    name = f"questlake_{uuid.uuid4().hex}"
    out = df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").format("parquet")
    (out.sortBy(by) if ordered else out).saveAsTable(name)
    if not _TABLES:
        atexit.register(_forget_all)
    return df.sparkSession.table(_noted(name))


def _forget_all() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        with contextlib.suppress(Exception):  # the session may be gone
            forget(spark)


_TABLES: list[str] = []
_OWN = threading.local()


def _noted(name: str) -> str:
    _TABLES.append(name)
    for run in getattr(_OWN, "runs", [])[-1:]:
        run.append(name)
    return name


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """The catalog entries that this thread makes meanwhile are dropped at the end."""
    runs = _OWN.__dict__.setdefault("runs", [])
    runs.append([])
    try:
        yield
    finally:
        _drop(spark, runs.pop())


def _drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        with contextlib.suppress(ValueError):  # another thread may have been first
            _TABLES.remove(name)


def known_buckets(spark: SparkSession, path: str, schema: str, by: str, buckets: int) -> DataFrame:
    """A table that ``bucketed`` wrote, sorted, maybe in an earlier session."""
    name = f"questlake_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(_noted(name))


def forget(spark: SparkSession) -> None:
    """Drop all catalog entries that this process made; files are removed with the scratch folders."""
    _drop(spark, list(_TABLES))


#: Bytes of text a shard, on average. A task holds its shard's text, stretches and contents, some tens of times as much.
SHARD = 8 << 20


def shard_count(docs: DataFrame, text_col: str, factor: int) -> int:
    """Shards for ``docs``: some for each partition of the scan, and as many as keep each to ``SHARD`` bytes, however large the scan's
    partitions are."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return max(parallelism(docs, factor), -(-size // SHARD))


def shard_table(docs: DataFrame, id_col: str, text_col: str, path: str, shards: int, first: int = 0) -> DataFrame:
    """(id, text, shard): rows are dealt to shards whatever their ids, so that null or repeated ids don't meet in one of them."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return bucketed(rows.withColumn("shard", first + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))), path, "shard", shards)


GRAMS = "gram long, shard long, n int, kinds int"


PACKED_GRAMS = "gram long, packed long"


def gram_rows(shards: DataFrame, spec: Spec, other_document: bool, packed: bool = False) -> DataFrame:
    """A shard's distinct gram hashes. n is 2 for those that repeat inside the shard (in another document), else 1; kinds is the number of
    distinct contents around them. ``packed`` puts shard, kinds (up to 2^23 - 1) and n - 1 into one long."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        grams, docs, whole = [], [], []
        for part in parts(spec, table):
            grams.append(part.grams)
            docs.append(part.ids[part.doc])
            whole.append(part.whole)
        h, d, c = np.concatenate(grams), np.concatenate(docs), np.concatenate(whole)
        order = np.lexsort((d, h)) if other_document else np.argsort(h, kind="stable")
        h, d, c = h[order], d[order], c[order]
        first = _first(h)
        last = np.r_[first[1:], len(h)][: len(first)] - 1
        again = d[last] != d[first] if other_document else last > first
        # distinct contents of the grams that repeat here; only those of several stretches can have more than one
        sizes = last - first + 1
        rows = np.repeat(sizes > 1, sizes)
        g, c = np.repeat(np.arange(len(first)), sizes)[rows], c[rows]
        order = np.lexsort((c, g))
        g, c = g[order], c[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])] if len(g) else np.zeros(0, bool)
        kinds = np.maximum(np.bincount(g[fresh], minlength=len(first)), 1).astype(np.int32)
        if packed:
            meta = np.int64(shard) << 24 | np.minimum(kinds, (1 << 23) - 1).astype(np.int64) << 1 | again.astype(np.int64)
            return pa.table([pa.array(h[first].astype(np.int64)), pa.array(meta)], names=["gram", "packed"])
        cols = h[first].astype(np.int64), np.full(len(first), shard, np.int64), again.astype(np.int32) + np.int32(1), kinds
        return pa.table([pa.array(x) for x in cols], names=["gram", "shard", "n", "kinds"])

    return shards.groupBy("shard").applyInArrow(run, PACKED_GRAMS if packed else GRAMS)


def repeated_grams(rows: DataFrame, partitions: int, hot: int) -> DataFrame:
    """(shard, grams): each shard's gram hashes that repeat anywhere, of packed ``rows``; bit 62 marks those with very many contents.

    A task packs what it has for one shard, so there are never more rows than grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], []]
        for batch in batches:
            for c, x in zip(cols, batch.columns):
                c.append(x.to_numpy())
        if not cols[0]:
            return
        gram, packed = map(np.concatenate, cols)
        order = np.argsort(gram, kind="stable")
        gram, packed = gram[order], packed[order]
        first = _first(gram)
        sizes = np.diff(np.r_[first, len(gram)])
        again = np.repeat(sizes + np.add.reduceat(packed & 1, first) > 1, sizes)
        flag = np.repeat(np.add.reduceat(packed >> 1 & ((1 << 23) - 1), first) > hot, sizes)
        shard, marked = packed[again] >> 24, gram[again] | flag[again].astype(np.int64) << 62
        order = np.argsort(shard, kind="stable")
        shard, marked = shard[order], marked[order]
        some = list(cut(shard))
        yield pa.RecordBatch.from_arrays([pa.array(shard[_first(shard)]), pa.array([marked[a:b].tobytes() for a, b in some], pa.binary())], names=["shard", "grams"])

    return rows.repartition(partitions, "gram").mapInArrow(run, "shard long, grams binary")


def _grams(table: pa.Table) -> np.ndarray:
    """The gram hashes of a shard, packed or a row each."""
    if "grams" in table.schema.names:
        return np.frombuffer(b"".join(table.column("grams").to_pylist()), np.int64)
    return table.column("gram").to_numpy()


class Stretches:
    """A shard's distinct contents, in a fixed order, and where each of its stretches found them.

    value: least id (or the number of occurrences) of each content; last: the greatest id. uses: (part, run, content number, or numbers
    of single windows).
    """

    def __init__(self, spec: Spec, table: pa.Table, grams: np.ndarray, count: bool):
        known = np.sort(grams & ((1 << 48) - 1)).astype(np.uint64)
        hot = set((grams[grams >> 62 != 0] & ((1 << 48) - 1)).tolist())
        self.parts, self.contents, self.anchor, self.value, self.last, self.uses = [], {}, [], [], [], []
        at, anchor, value, last, w = self.contents, self.anchor, self.value, self.last, spec.window

        def seen(content: bytes, h: int, doc: int) -> int:
            i = at.setdefault(content, len(anchor))
            if i == len(anchor):
                anchor.append(h)
                value.append(1 if count else doc)
                last.append(doc)
                return i
            if count:
                value[i] += 1
            elif doc < value[i]:
                value[i] = doc
            if doc > last[i]:
                last[i] = doc
            return i

        for k, part in enumerate(parts(spec, table)):
            self.parts.append(part)
            if not len(known):
                continue
            found = np.flatnonzero(known[np.minimum(np.searchsorted(known, part.grams), len(known) - 1)] == part.grams)
            owner = part.ids[part.doc[found]].tolist()
            for r, a, b, h, doc in zip(found.tolist(), part.starts[found].tolist(), part.stops[found].tolist(), part.grams[found].tolist(), owner):
                if h in hot:
                    places = []
                    for p in range(a, b):
                        c = part.content(p, p + w)
                        places.append(seen(c, xxhash.xxh64_intdigest(c) >> 16, doc))
                    self.uses.append((k, r, places))
                else:
                    self.uses.append((k, r, seen(part.content(a, b + w - 1), h, doc)))


# place: the shard, and the content's number in it, in one long; more: the greatest id less the value, or 0
CONTENTS = "anchor long, place long, content binary, value long, more long"


def stretch_rows(shards: DataFrame, grams: DataFrame, spec: Spec, partitions: int, count: bool) -> DataFrame:
    """The distinct contents of each shard around its repeated grams, a row each; ``anchor`` brings those together that may share windows."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in CONTENTS.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        s = Stretches(spec, left, _grams(right), count)
        n, shard = len(s.anchor), left.column("shard")[0].as_py()
        value = np.array(s.value, np.int64)
        more = np.zeros(n, np.int64) if count else np.array(s.last, np.int64) - value
        cols = (s.anchor, np.int64(shard) << 32 | np.arange(n), list(s.contents), value, more)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return shards.groupBy("shard").cogroup(grams.repartition(partitions, "shard").groupBy("shard")).applyInArrow(run, CONTENTS)


@dataclass
class Met:
    """Contents that met, those of one anchor next to each other."""

    anchors: np.ndarray
    contents: list[bytes]
    values: np.ndarray
    lasts: np.ndarray


def in_runs(values: np.ndarray) -> bytes:
    """An answer: one figure, or figures and how many windows in turn have them."""
    first = _first(values)
    if len(first) == 1:
        return values[:1].astype("<i8").tobytes()
    return values[first].astype("<i8").tobytes() + np.diff(np.r_[first, len(values)]).astype("<i4").tobytes()


def resolved(rows: DataFrame, partitions: int, resolver: Callable[[Met], list[bytes]], batch_bytes: int = 1 << 20) -> DataFrame:
    """(shard, numbers, sizes, answers): ``resolver`` gives ``in_runs`` of an answer a window, or b"" where nothing goes.

    Rows come sorted by anchor, so a task holds the contents of few anchors at once, and packs the answers that it then has for one shard;
    there are never more rows than answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            value = t.column(3).to_numpy()
            answers = resolver(Met(t.column(0).to_numpy(), t.column(2).to_pylist(), value, value + t.column(4).to_numpy()))
            sizes = np.fromiter(map(len, answers), np.int32, len(answers))
            some = np.flatnonzero(sizes)
            place = t.column(1).to_numpy()[some]
            order = np.argsort(place, kind="stable")
            some, shard, number = some[order], place[order] >> 32, (place[order] & 0xFFFFFFFF).astype(np.int32)
            packed = [(number[a:b].tobytes(), sizes[some[a:b]].tobytes(), b"".join([answers[i] for i in some[a:b].tolist()])) for a, b in cut(shard)]
            cols = zip(*packed) if packed else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(shard[_first(shard)]), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "numbers", "sizes", "answers"])

        size = 0
        for whole in batches:
            for batch in pieces(whole, batch_bytes):
                anchors = batch.column(0).to_numpy()
                if held and size > batch_bytes:
                    # close what is held where a new anchor starts
                    stop = int(np.searchsorted(anchors, held[-1].column(0)[-1].as_py(), side="right"))
                    if stop < len(anchors):
                        held.append(batch.slice(0, stop))
                        yield out()
                        held.clear()
                        size, batch = 0, batch.slice(stop)
                held.append(batch)
                size += batch.nbytes
        if held:
            yield out()

    return rows.repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "shard long, numbers binary, sizes binary, answers binary")


def removed_spans(stretches: Stretches, told: Iterator[tuple[bytes, bytes, bytes]], spec: Spec, neutral: int, gone: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[Part, np.ndarray]]:
    """Each part with a mask of the symbols that windows cover for which ``gone(answers, ids)`` holds."""
    one, many = np.full(len(stretches.anchor), neutral, np.int64), {}
    for numbers, sizes, answers in told:
        number, size = np.frombuffer(numbers, np.int32), np.frombuffer(sizes, np.int32)
        end = np.cumsum(size)
        data, plain = np.frombuffer(answers, np.uint8), size == 8
        at = (end - size)[plain]
        if len(at):
            one[number[plain]] = data[at[:, None] + np.arange(8)].reshape(-1).view("<i8")
        for i, b, m in zip(number[~plain].tolist(), end[~plain].tolist(), size[~plain].tolist()):
            k = m // 12
            many[i] = np.repeat(np.frombuffer(answers, "<i8", k, b - m), np.frombuffer(answers, "<i4", k, b - m + 8 * k))
    several = np.zeros(len(one), bool)
    several[list(many)] = True
    w = spec.window
    of_part = np.array([k for k, _, _ in stretches.uses], np.int64)
    for k, part in enumerate(stretches.parts):
        uses = stretches.uses[np.searchsorted(of_part, k) : np.searchsorted(of_part, k, side="right")]
        cover = np.zeros(int(part.offsets[-1]) + 1, np.int32)
        ids = part.ids[part.doc]
        rest = []
        if plain := [(r, i) for _, r, i in uses if not isinstance(i, list)]:
            r, i = np.array(plain).T
            flagged = ~several[i] & gone(one[i], ids[r])
            np.add.at(cover, part.starts[r[flagged]], 1)
            np.add.at(cover, part.stops[r[flagged]] + w - 1, -1)
            some = np.flatnonzero(several[i])
            rest = [(x, many[y]) for x, y in zip(r[some].tolist(), i[some].tolist())]
        rest += [(r, one[i]) for _, r, i in uses if isinstance(i, list)]
        if rest:
            m = np.array([len(v) for _, v in rest])
            r = np.array([r for r, _ in rest])
            at = np.repeat(part.starts[r], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at = at[gone(np.concatenate([v for _, v in rest]), np.repeat(ids[r], m))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + w, -1)
        yield part, np.cumsum(cover[:-1]) > 0


@dataclass(frozen=True)
class Rule:
    """How contents are judged. count: values are numbers of occurrences, not least ids. neutral: the answer of contents that get none.
    gone: whether a window goes, of answers and document ids. finish: the rows of a part, from the mask of its removed symbols."""

    resolver: Callable[[Met], list[bytes]]
    count: bool
    neutral: int
    gone: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[Part, np.ndarray], list[tuple]]
    fields: list[tuple[str, pa.DataType, str]]


def applied(shards: DataFrame, grams: DataFrame, answers: DataFrame, spec: Spec, rule: Rule, partitions: int) -> DataFrame:
    """The rows that ``rule.finish`` makes of each shard's documents."""
    name, kind = grams.columns[1], grams.schema[1].dataType
    side = grams.select("shard", name, *[F.lit(None).cast("binary").alias(c) for c in ("numbers", "sizes", "answers")])
    side = side.unionByName(answers.select("shard", F.lit(None).cast(kind).alias(name), "numbers", "sizes", "answers")).repartition(partitions, "shard")
    schema, finish, count, neutral, gone = pa.schema([(f, t) for f, t, _ in rule.fields]), rule.finish, rule.count, rule.neutral, rule.gone

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            known, told = right.filter(pc.field(name).is_valid()), right.filter(pc.field("numbers").is_valid())
            s = Stretches(spec, left, _grams(known), count)
            for part, mask in removed_spans(s, zip(*(told.column(c).to_pylist() for c in ("numbers", "sizes", "answers"))), spec, neutral, gone):
                rows += finish(part, mask)
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema) if rows else schema.empty_table()

    return shards.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(run, ", ".join(f"{f} {t}" for f, _, t in rule.fields))


def dedup(docs: DataFrame, spec: Spec, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """Run the passes. The result is written, and the tables that led to it are dropped. Each pass ends in a table, and what it shuffled
    goes before the next one writes: on disk are the tables and one pass's shuffle, not all passes'."""
    spark, n = docs.sparkSession, shard_count(docs, text_col, 6)
    with kept_only(spark, "deduplicated") as path, own_tables(spark):
        shards = shard_table(docs, id_col, text_col, scratch_path(spark, "shards"), n)
        free_shuffles(spark)
        grams = written(repeated_grams(gram_rows(shards, spec, not rule.count, packed=True), n, spec.hot), "grams")
        free_shuffles(spark)
        answers = written(resolved(stretch_rows(shards, grams, spec, n, rule.count), n, rule.resolver), "answers")
        free_shuffles(spark)
        return written(applied(shards, grams, answers, spec, rule, n), "deduplicated", path)
