"""Exact encoding and decoding for merge-type (BPE) sentencepiece models by a prefix table.

A text is cut where no piece of the vocabulary can reach over (before runs of the space mark, around unknown characters); each
distinct unit is encoded once a worker. For a unit, the last token of every prefix's encoding is unique: of the pieces that an
Aho-Corasick automaton finds to end there, it is the one that is compatible with the last token of the prefix before it. Two
tokens are compatible if merging their joined characters by rank gives just them. The ids are then read backwards through the
table. Characters outside the vocabulary become byte pieces.

Defined cases: null and empty texts give only the begin and end ids; repeated rows repeat their result; texts of any length are
encoded whole; ties in merging go to the leftmost pair, as in the library; an empty table gives no rows; columns named like the
results are replaced by them, other extra columns are kept (or only those named in ``keep``).
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from questlake.llm.common import add_columns, utf8_rows

MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Stands before a unit that has no space mark, on the quick way only: texts that hold the character themselves take the general way,
#: whose units are pairs.
_BARE = "\x01"
#: A sign after something other than a letter, or what the quick way doesn't cut exactly.
_GENERAL = re.compile(f"^ |  | $|[{MARK}{_BARE}]")
_SIGNS = re.compile(r"[\W\d_][.,]")
MOST_CACHED = 800_000
Unit = str | tuple[bool, str]


class PrefixBPE:
    """pieces: id to string. first: the id of byte piece 0. normal: ids that merges can make, in rank order of their scores."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, n = sp.bos_id(), sp.eos_id(), sp.get_piece_size()
        self.byte_at = sp.piece_to_id("<0x00>")
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.shown: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.shown[i] = bytes([i - self.byte_at])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id[piece], self.rank[piece] = i, -sp.get_score(i)
                self.shown[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece reaches over a word's start")
        self.chars = {c for p in self.id for c in p}
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        #: No piece joins a letter to a full stop or comma, or holds a line end, so units end there.
        self.signs = not any(b in ".," and re.fullmatch(r"[^\W\d_]", a) for a, b in pairs)
        self.lines = "\n" not in self.chars
        self.machine = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.machine.add_word(p, (i, len(p)))
        self.machine.make_automaton()
        self.text = {i: p for p, i in self.id.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[Unit, tuple[bytes, bytes]] = {}

    def merged(self, s: str) -> list[str]:
        """Merging by rank, leftmost first, as the definition says; used for pairs of tokens only."""
        parts: list[str | None] = list(s)
        nxt, prev = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = [(self.rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], nxt[i] = whole, None, nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
                if (w := whole + parts[nxt[i]]) in self.rank:
                    heapq.heappush(heap, (self.rank[w], i, w))
            if prev[i] >= 0 and (w := parts[prev[i]] + whole) in self.rank:
                heapq.heappush(heap, (self.rank[w], prev[i], w))
        return [x for x in parts if x is not None]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) > 4 * MOST_CACHED:
            self.fits.clear()
        x, y = self.text.get(a, ""), self.text[b]
        got = self.fits[(a, b)] = self.merged(x + y) == ([x, y] if x else [y])
        return got

    def known(self, s: str) -> list[int]:
        """Ids of a string of known characters."""
        last = [-1] * (len(s) + 1)
        size = [0] * (len(s) + 1)
        fits, compatible = self.fits, self.compatible
        for at, (i, n) in self.machine.iter(s):  # by end; the longest first
            if size[at + 1]:
                continue
            start = at + 1 - n
            before = last[start]
            if start and before < 0:
                continue
            ok = fits.get((before, i))
            if ok is None:
                ok = compatible(before, i)
            if ok:
                last[at + 1], size[at + 1] = i, n
        if s and not size[-1]:
            raise AssertionError(f"no token ends {s!r}")
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def ids(self, unit: str) -> list[int]:
        if self.chars.issuperset(unit):
            return self.known(unit)
        out, run = [], ""
        for c in unit:
            if c in self.chars:
                run += c
                continue
            out += self.known(run) if run else []
            run = ""
            out += [self.byte_at + b for b in c.encode()]
        return out + (self.known(run) if run else [])

    def unit(self, unit: Unit) -> tuple[bytes, bytes]:
        """A unit's ids as little-endian 32-bit integers, and what they decode to. A string starts with a space unless it is bare; a pair
        says whether its text does."""
        bare, rest = unit if isinstance(unit, tuple) else (True, unit[1:]) if unit[:1] == _BARE else (False, unit)
        ids = self.ids(rest if bare else MARK + rest)
        return np.array(ids, "<u4").tobytes(), b"".join([self.shown[i] for i in ids])

    def units(self, text: str) -> list[Unit]:
        """The text's units, the first with the space that encoding puts before a text."""
        if _GENERAL.search(text):
            marked = MARK + text.replace(" ", MARK)
            return [(False, u[1:]) if u[0] == MARK else (True, u) for u in _UNITS.findall(marked)]
        if self.signs and not _SIGNS.search(text):
            text = text.replace(", ", f" {_BARE}, ").replace(". ", f" {_BARE}. ").replace(".\n", f" {_BARE}.\n")
        if self.lines:
            text = text.replace("\n", f" {_BARE}\n {_BARE}")
        return text.split(" ")

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, packed, and the decoded text as UTF-8."""
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        if not text:
            return begin + end, b""
        units, cache = self.units(text), self.cache
        extra = {u: self.unit(u) for u in set(units).difference(cache)}
        if len(cache) < MOST_CACHED:
            cache.update((u, x) for u, x in extra.items() if len(x[0]) < 800)
        get = cache.get
        got = [get(u) or extra[u] for u in units]
        shown = b"".join([b for _, b in got]).decode(errors="replace")
        return begin + b"".join([a for a, _ in got]) + end, shown.removeprefix(" ").encode()


_LOADED: dict[str, PrefixBPE] = {}


def loaded(path: str) -> PrefixBPE:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded``."""

    def start():
        enc = loaded(model_file)

        def fn(batch):
            got = [enc.encode(x.decode()) for x in utf8_rows(batch.column(batch.schema.get_field_index(text_col)))]
            flat = np.frombuffer(b"".join(a for a, _ in got), "<i4")
            offsets = np.r_[0, np.cumsum([len(a) // 4 for a, _ in got])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([b for _, b in got], pa.binary()).cast(pa.string())]

        return fn

    return add_columns(docs, [text_col], [("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("decoded", pa.string(), T.StringType())], start, keep)


def digests(docs: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of ids and SHA-256 digests of the ids and of the decoded text; the ids never leave the worker."""

    def start():
        enc = loaded(model_file)

        def fn(batch):
            got = [enc.encode(x.decode()) for x in utf8_rows(batch.column(batch.schema.get_field_index(text_col)))]
            return [[len(a) // 4 for a, _ in got], [hashlib.sha256(a).hexdigest() for a, _ in got], [hashlib.sha256(b).hexdigest() for _, b in got]]

        return fn

    return add_columns(docs, [text_col], [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())], start, keep)
