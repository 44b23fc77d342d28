"""Best-fit packing of documents into sequences.

Tokenizing gives pieces of at most ``size`` tokens. Pieces are range-sorted by length and ranked within it (each range partition
counts its lengths; the counts, at most one row per partition and length, give every partition its base rank). A piece then is
an interval member: (length, rank). Gaps are kept the same way, as intervals of sequences per gap size.

The best-fit supersteps run over these two sorted lists, from the longest length down: all documents of a length are matched at
once with the successor gaps (the smallest that hold them), conflicts go by rank (the interval's first documents take the first
sequences), gaps shrink, and the next length follows; documents that no gap holds open new sequences. The state has at most
``size`` lengths and ``size`` gap sizes, however many documents there are. The plan is a list of intervals, and every piece
finds its sequence in it by its rank.

Defined cases: a null or empty text is one piece, the separator; texts longer than ``size`` are cut, in order; repeated rows are
packed as often as they occur; ties in length go by id and piece; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.llm.common import ids_array, parallelism, pieces, written
from questlake.session import importable

SIZE = 2048
#: Words that a worker remembers (some 100 MB).
MOST_CACHED = 500_000
#: Characters for which white-space words can be tokenized apart: printable ASCII, Latin letters that NFC and lower-casing keep apart.
#: Their lower case in Python is that of the tokenizer.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-įĲ-ɏ]")


#: A sign before a full stop or comma; the rarer character is looked for first.
_SIGNS = re.compile(r"[.,](?<=(?:[^\w\s]|_).)")


class WordCached:
    """Token ids of whole texts; for plain texts each distinct white-space word is tokenized once a worker."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same merges for words that are one lower-cased run of letters each: nothing to normalize, white space cuts
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.letters = Tokenizer.from_str(json.dumps(spec))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0x80, 0x250) if chr(i).isalpha()}
        self.cache: dict[str, bytes] = {}

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words; those of letters alone go through the merges together and are cut at word-end tokens."""
        odd = [w for w in words if not w.isalpha()]
        rest = [w for w in words if w.isalpha()]
        out = dict(zip(odd, self._all(odd)))
        for at in range(0, len(rest), 2048):
            some = rest[at : at + 2048]
            (got,) = self.letters.encode_batch_fast([" ".join(some).translate(self.shown)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out.update(zip(some, [raw[i:j] for i, j in zip([0, *stops], stops)], strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        plain = [not _PLAIN.search(x) and "<|" not in x for x in texts]
        odd = iter(self._all([x for x, p in zip(texts, plain) if not p]))
        get, out, open_ = cache.get, [], []
        for x, p in zip(texts, plain):
            words = self._split(x) if p else None
            found = [next(odd)] if words is None else list(map(get, words))
            if None in found:
                open_.append((found, [(k, words[k]) for k, y in enumerate(found) if y is None]))
            out.append(found)
        extra = self._words(list({w for _, rest in open_ for _, w in rest}))
        for found, rest in open_:
            for k, w in rest:
                found[k] = extra[w]
        if len(cache) < MOST_CACHED:
            cache.update(islice(extra.items(), MOST_CACHED - len(cache)))
        return list(map(b"".join, out))

    @staticmethod
    def _split(text: str) -> list[str]:
        """White-space words; a full stop or comma that ends one is a word of its own unless it ends a run of signs."""
        text = text.lower()
        if not _SIGNS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return text.split()


_LOADED: dict[str, WordCached] = {}


def loaded(path: str) -> WordCached:
    if path not in _LOADED:
        _LOADED[path] = WordCached(path)
    return _LOADED[path]


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; ``separator`` ends each."""
    sep = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                ids, out = ids_array(batch.column(0)), []
                got = loaded(tokenizer).encode([x or "" for x in batch.column(1).to_pylist()])
                for doc, packed in zip(ids.tolist(), got):
                    packed += sep
                    for k in range(0, len(packed), 4 * size):
                        part = packed[k : k + 4 * size]
                        out.append((doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """``rows`` with ``part`` (range partition) and ``local`` (rank among the partition's rows of equal length); lengths stay whole in order."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    at = rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            n = len(lengths)
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            sizes = np.diff(np.r_[starts, n])
            local = np.arange(n) - np.repeat(starts, sizes)
            if lengths[0] == last:
                local[: sizes[0]] += seen
            last, seen = lengths[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))], names=schema.names)

    return rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over intervals: (length, first rank, number of documents, first sequence, documents per sequence, offset).

    The documents of such a row fill its sequences in turn; the last one may get fewer.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size: intervals (first sequence, number)
    order: list[int] = []
    opened, out = 0, []

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def fill(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Put up to ``left`` documents into ``n`` sequences that have ``gap`` left; the number that found room."""
        per = gap // length
        put = min(left, n * per)
        out.append((length, rank, put, first, per, size - gap))
        full, rest = divmod(put, per)
        add(gap - per * length, first, full)
        if rest:
            add(gap - rest * length, first + full, 1)
        add(gap, first + full + bool(rest), n - full - bool(rest))
        return put

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(order, length)  # the successor
            if k == len(order):
                n = -(-left // (size // length))
                fill(length, rank, left, size, opened, n)
                opened += n
                break
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            put = fill(length, rank, left, gap, first, n)
            rank, left = rank + put, left - put
    return out


def pack(rows: DataFrame, partitions: int, size: int = SIZE) -> DataFrame:
    """``rows`` (with a long ``length`` of 1 to ``size``) with ``sequence_id`` and ``offset``."""
    keys = ["length", *[c for c in ("doc_id", "piece", "start") if c in rows.columns]]
    placed = written(ranked(rows, keys, partitions), "ranked")
    spark = rows.sparkSession
    # at most a row for each partition and length, as lengths are sorted over the partitions: so many as partitions + lengths
    found = placed.groupBy("length", "part").agg(F.count("*").alias("n")).toArrow().sort_by([("length", "ascending"), ("part", "ascending")])
    length, part, n = (found.column(c).to_numpy() for c in ("length", "part", "n"))
    before = np.cumsum(n) - n
    first = np.flatnonzero(np.r_[True, length[1:] != length[:-1]]) if len(length) else np.zeros(0, int)
    before -= np.repeat(before[first], np.diff(np.r_[first, len(length)]))  # documents of the length in earlier partitions
    counts = dict(zip(length[first].tolist(), np.add.reduceat(n, first).tolist())) if len(first) else {}
    # only the least length of a partition can have begun before it
    some = np.flatnonzero(before)
    opened, base = np.full(partitions, -1, np.int64), np.zeros(partitions, np.int64)
    opened[part[some]], base[part[some]] = length[some], before[some]
    table = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast((opened, base, table))  # 16 bytes a partition, and some thousand intervals
    names = rows.columns
    at = {c: placed.columns.index(c) for c in placed.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_, base_, steps_ = sent.value
        key = steps_[:, 0] << 44 | steps_[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, part, local = (batch.column(at[c]).to_numpy() for c in ("length", "part", "local"))
            rank = local + np.where(opened_[part] == length, base_[part], 0)
            step = steps_[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            inside = rank - step[:, 1]
            sequence, offset = step[:, 3] + inside // step[:, 4], step[:, 5] + inside % step[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    rows = written(tokenized_pieces(docs, tokenizer, size, id_col, text_col), "pieces")  # a range sort reads its input twice
    return pack(rows, parallelism(docs, 1), size)
