"""Exact encoding and decoding for byte-level BPE tokenizers by an index of pair occurrences.

Texts are cut at special tokens and, by the tokenizer's pattern, into words; each distinct word that a worker hasn't met is laid into one
row of symbols. An index maps every pair of neighbours that the vocabulary can merge to all its positions. The ranks that have
positions are applied in ascending order, each at all its positions from left to right, and what a merge makes new is added to the
lists of the pairs that it touches; positions that a merge has overtaken are known by their symbols. A merge makes tokens that only
later ranks use (checked when the file is read), so applying a rank everywhere at once is what merging each word by itself does.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows repeat their result; texts and words of any
length are encoded whole; overlapping pairs go to the leftmost, as in the library; a text with characters newer than Python's
tables is cut by the library's own pre-tokenizer; invalid UTF-8 reads as U+FFFD; an empty table gives no rows; columns named like the
results are replaced by them, other extra columns are kept (or only those named in ``keep``). Tokenizers of another kind are an error.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from questlake.llm.common import add_columns, utf8_rows

# The pattern of byte-level pre-tokenizers, and what it says of ASCII texts.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Runs of white space are cut by what stands around them; texts without any are cut at each space and line end.
_RUNS = re.compile(r"\s\s|\0")
#: Stands before a unit without a space.
_BARE = "\0"
#: Units and words that a worker remembers.
MOST_CACHED = 400_000
#: Bytes of words that share one index; a longer word has its own.
ROW = 1 << 21
#: Positions of one rank that are merged by array operations.
MANY = 150


def shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairBPE:
    """merges: (left, right, made) ids by rank. decimal: ids are packed as decimals after commas, else as little-endian 32-bit integers."""

    def __init__(self, path: str, decimal: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, dec = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or dec.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        ids, byte_of = model["vocab"], shown_bytes()
        special = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError("special tokens that take in what is around them")
        self.special = {t["content"]: t["id"] for t in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.shown = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.shown[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.shown[i] = token.encode()
        self.first = np.array([ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)
        self.size = len(self.shown)
        self.merges, born = [], {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((ids[a], ids[b], ids[a + b]))
            born[ids[a + b]] = rank
            if born.get(ids[a], -1) >= rank or born.get(ids[b], -1) >= rank:
                raise ValueError("a merge uses a token that a later one makes")
        self.rank = {a * self.size + b: r for r, (a, b, _) in enumerate(self.merges)}
        codes = np.array(list(self.rank), np.int64)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.form = [b",%d" % i if decimal else i.to_bytes(4, "little") for i in range(self.size)]
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.units: dict[str, tuple[bytes, bytes]] = {}
        self.known = {chr(c) for c in range(128)}

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of non-empty words that share one row of symbols."""
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        row = self.first[text]
        row[ends] = -1
        starts = np.r_[0, ends[:-1] + 1]
        code = row[:-1] * self.size + row[1:]
        code[(row[:-1] < 0) | (row[1:] < 0)] = -1
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1) if len(self.codes) else np.zeros(len(code), int)
        hit = np.flatnonzero(self.codes[at] == code) if len(self.codes) else np.zeros(0, int)
        ranks = self.order[at[hit]] if len(hit) else hit
        by = np.argsort(ranks, kind="stable")
        cuts = np.flatnonzero(np.diff(ranks[by])) + 1
        places = {int(ranks[g[0]]): hit[g].tolist() for g in np.split(by, cuts)} if len(hit) else {}
        n = len(row)
        sym = array("i", row.astype(np.int32).tobytes())
        nxt = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        prv = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        views = [np.frombuffer(x, np.int32) for x in (sym, nxt, prv)]  # the same memory
        active = list(places)
        heapq.heapify(active)
        size, rank_of = self.size, self.rank.get
        while active:
            r = heapq.heappop(active)
            a, b, made = self.merges[r]
            spots = places.pop(r)
            if len(spots) >= MANY and a != b:
                for k, more in self.merge_many(np.array(spots), a, b, made, *views):
                    if k in places:
                        places[k] += more
                    else:
                        places[k] = more
                        heapq.heappush(active, k)
                continue
            spots.sort()
            for p in spots:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = made, -2
                nxt[p] = after = nxt[q]
                prv[after] = p  # each word ends in a mark, so there is a symbol after it
                before = prv[p]
                if before >= 0 and (c := sym[before]) >= 0 and (k := rank_of(c * size + made)) is not None:
                    if k in places:
                        places[k].append(before)
                    else:
                        places[k] = [before]
                        heapq.heappush(active, k)
                if (c := sym[after]) >= 0 and (k := rank_of(made * size + c)) is not None:
                    if k in places:
                        places[k].append(p)
                    else:
                        places[k] = [p]
                        heapq.heappush(active, k)
        left = np.frombuffer(sym, np.int32)
        alive = left >= 0
        upto = np.r_[0, np.cumsum(alive)]
        ids, cut = left[alive].tolist(), upto[np.r_[starts, n]]
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def merge_many(self, p: np.ndarray, a: int, b: int, made: int, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """One rank at many positions at once (of different tokens, so none overlap), and the positions that it adds by rank."""
        p = p[sym[p] == a]
        p = p[sym[nxt[p]] == b]
        q = nxt[p]
        sym[p], sym[q] = made, -2
        nxt[p] = after = nxt[q]
        prv[after] = p
        before = prv[p]
        left = before[before >= 0]
        left = left[sym[left] >= 0]
        right = p[sym[after] >= 0]
        code = np.r_[sym[left].astype(np.int64) * self.size + made, made * self.size + sym[nxt[right]].astype(np.int64)]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == code)
        if len(hit):
            rank = self.order[at[hit]]
            by = np.argsort(rank)
            rank, spots = rank[by], np.r_[left, right][hit[by]].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(rank)) + 1).tolist(), len(rank)]
            for i, j in zip(cuts, cuts[1:]):
                yield int(rank[i]), spots[i:j]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that aren't remembered, as many together as fit in a row."""
        if len(self.words) > MOST_CACHED:
            self.words.clear()
        row, length = [], 0
        for w in [*words, None]:
            if row and (w is None or length + len(w) > ROW):
                form, shown = self.form, self.shown
                for x, ids in zip(row, self.merged([x.encode() for x in row])):
                    self.words[x] = (form[ids[0]], shown[ids[0]]) if len(ids) == 1 else (b"".join([form[i] for i in ids]), b"".join([shown[i] for i in ids]))
                row, length = [], 0
            if w is not None:
                row.append(w)
                length += len(w)

    def cut_words(self, text: str) -> list[str]:
        if text.isascii():
            return [text] if text.isalpha() or text[:1] == " " and text[1:].isalpha() else ASCII.findall(text)
        if not self.known.issuperset(text):
            new = set(text) - self.known
            if any(unicodedata.category(c) == "Cn" for c in new):
                return [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]
            self.known |= new
        return PATTERN.findall(text)

    def keys(self, text: str) -> list[str] | None:
        """Units of a text without runs of white space: cut before each space, which the unit takes in, and around line ends."""
        if _RUNS.search(text):
            return None
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(_BARE + "\n")
            if line:
                out += (line[1:] if line[0] == " " else _BARE + line).split(" ")
        return out

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and decoded bytes of each text. What is made here has no cycles, so their collector needn't look at it."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode_many(texts)
        finally:
            if on:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.units) > MOST_CACHED:
            self.units.clear()
        parts = [[(x, self.special.get(x)) for x in (self.cut.split(t) if self.cut else [t]) if x] for t in texts]
        keyed, plain, units = {}, {}, set()
        for x in {x for p in parts for x, s in p if s is None}:
            keys = self.keys(x)
            if keys is None:
                plain[x] = self.cut_words(x)
            else:
                keyed[x] = keys
                units.update(keys)
        new = {u: self.cut_words(u[1:] if u[:1] == _BARE else " " + u) for u in units.difference(self.units)}
        needed = {w for ws in new.values() for w in ws} | {w for ws in plain.values() for w in ws}
        self.learn(needed.difference(self.words))
        if lost := needed.difference(self.words):  # the cache was cleared
            self.learn(lost)
        words, known = self.words, self.units
        for u, ws in new.items():
            known[u] = words[ws[0]] if len(ws) == 1 else (b"".join([words[w][0] for w in ws]), b"".join([words[w][1] for w in ws]))
        done = {x: [known[u] for u in keys] for x, keys in keyed.items()} | {x: [words[w] for w in ws] for x, ws in plain.items()}
        out = []
        for p in parts:
            got = done[p[0][0]] if len(p) == 1 and p[0][1] is None else [e for x, s in p for e in (done[x] if s is None else [(self.form[s], self.shown[s])])]
            out.append((b"".join([e[0] for e in got]), b"".join([e[1] for e in got])))
        return out


_LOADED: dict[tuple[str, bool], PairBPE] = {}


def loaded(path: str, decimal: bool = False) -> PairBPE:
    """One encoder a worker process."""
    if (path, decimal) not in _LOADED:
        _LOADED[(path, decimal)] = PairBPE(path, decimal)
    return _LOADED[(path, decimal)]


def _texts(batch: pa.RecordBatch, text_col: str) -> list[str]:
    return [x.decode(errors="replace") for x in utf8_rows(batch.column(batch.schema.get_field_index(text_col)))]


def encoded(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded``."""

    def start():
        enc = loaded(tokenizer_file)

        def fn(batch):
            got = enc.encode_many(_texts(batch, text_col))
            flat = np.frombuffer(b"".join([a for a, _ in got]), "<i4")
            offsets = np.r_[0, np.cumsum([len(a) // 4 for a, _ in got])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), [b.decode(errors="replace") for _, b in got]]

        return fn

    return add_columns(docs, [text_col], [("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("decoded", pa.string(), T.StringType())], start, keep)


def digests(docs: DataFrame, tokenizer_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of ids and SHA-256 digests of the ids (decimals joined by commas) and of the decoded text."""

    def start():
        enc = loaded(tokenizer_file, decimal=True)

        def fn(batch):
            got = enc.encode_many(_texts(batch, text_col))
            shown = [hashlib.sha256(b.decode(errors="replace").encode()).hexdigest() for _, b in got]
            return [[a.count(b",") for a, _ in got], [hashlib.sha256(a[1:]).hexdigest() for a, _ in got], shown]

        return fn

    return add_columns(docs, [text_col], [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())], start, keep)
