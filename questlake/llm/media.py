"""Media columns: ISO base media containers.

``container`` stores bytes losslessly as 8-bit PCM samples ('raw ', one access unit of 64 samples) in an ISO file with the usual
boxes; ``probe`` walks nested boxes of any such file, decodes the sample tables (stts, stsc, stsz, stco or co64, stss) and gives
codec, duration and the byte ranges of key frames without touching the payload; ``payload`` reads the stored samples back.

Defined cases: null and empty texts store 64 zero bytes; equal texts give equal files; long texts are stored whole; a broken or
foreign file gives None from ``probe`` instead of an error: tables that are longer than their boxes, counts beyond what the file can
hold, chunks and samples outside it, key frames that are no samples and boxes nested too deep are refused before memory is taken for them;
files with compact sample sizes (stz2) or without sample tables of their own (fragments: moof, traf, trun) give None too. Repeated rows repeat their result; an
empty table gives no rows; columns named like the results are replaced, other extra columns are kept (or only those in ``keep``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from questlake.llm.common import add_columns, utf8_rows

UNIT = 64
RATE = 8000
CHUNK_UNITS = 64
KEY_EVERY = 16
#: Boxes nested deeper than this make a file foreign; real ones need about eight levels.
DEEPEST = 32
#: Boxes that hold boxes (fixed values of the format).
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def container(data: bytes) -> bytes:
    """``data`` (a multiple of 64 bytes) as an ISO file with one audio track of access units."""
    units = len(data) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    head = len(ftyp) + 8
    span = struct.pack(">I", units * UNIT)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS, 1)] * (chunks > 1) + [(chunks, last, 1)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    offsets = [head + i * CHUNK_UNITS * UNIT for i in range(chunks)]
    keys = range(1, units + 1, KEY_EVERY)
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, units, UNIT)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, units)),
        _full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
    )
    info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
    media = _box(b"mdia", _full(b"mdhd", bytes(8), struct.pack(">I", RATE), span, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), info)
    track = _box(b"trak", _full(b"tkhd", bytes(8), struct.pack(">II", 1, 0), span, bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7), media)
    movie = _box(b"moov", _full(b"mvhd", bytes(8), struct.pack(">I", RATE), span, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _UNITY, bytes(24), struct.pack(">I", 2)), track)
    return ftyp + _box(b"mdat", data) + movie


def boxes(view: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, end) of each box, nested ones too, in order; bodies aren't read. 64-bit and to-the-end sizes are known."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(view))]
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", view, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", view, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} ends outside its parent")
        if len(path) >= DEEPEST:
            raise ValueError("boxes are nested too deep")
        here = (*path, kind)
        yield here, body, stop
        open_.append((path, stop, end))
        if kind in _NESTED:
            open_.append((here, body, stop))


def _table(view: memoryview, at: int, end: int, kind: str, width: int = 1, skip: int = 4) -> np.ndarray:
    """A box's rows; their number is checked against the box before anything is read."""
    (n,) = struct.unpack_from(">I", view, at + skip)
    if at + skip + 4 + n * width * np.dtype(kind).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(view, kind, n * width, at + skip + 4).reshape(n, width).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, and sample offsets, sizes, decode times, key flags, all from the tables."""
    view, found = memoryview(data), []
    for path, at, end in boxes(view):
        kind = path[-1]
        if kind == b"trak":
            found.append({"stss": None})
        if not found or b"trak" not in path:
            continue
        t = found[-1]
        if kind == b"mdhd":
            wide = view[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))
        elif kind == b"stsd":
            t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(view, at, end, ">u4", 2)
        elif kind == b"stsc":
            t["stsc"] = _table(view, at, end, ">u4", 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", view, at + 4)
            if same * n > len(view):
                raise ValueError("more samples than the file can hold")
            t["sizes"] = np.full(n, same, np.int64) if same else _table(view, at, end, ">u4", skip=8)[:, 0]
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(view, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            t["stss"] = _table(view, at, end, ">u4")[:, 0]
    for t in found:
        runs, chunks, sizes = t["stsc"], t["chunks"], t["sizes"]
        if len(chunks) and (chunks.min() < 0 or chunks.max() > len(view)):
            raise ValueError("a chunk lies outside the file")
        if t["stss"] is not None and len(t["stss"]) and (t["stss"].min() < 1 or t["stss"].max() > len(sizes)):
            raise ValueError("a key frame that isn't a sample")
        n, first = len(sizes), runs[:, 0] - 1
        per = np.repeat(runs[:, 1], np.diff(np.r_[first, len(chunks)]))
        ends = np.cumsum(per)  # forged counts cost no memory: tables are looked up, not expanded
        steps = np.cumsum(t["stts"][:, 0])
        if n and (not len(ends) or ends[-1] < n or not len(steps) or steps[-1] < n):
            raise ValueError("the tables cover fewer samples than there are")
        chunk = np.searchsorted(ends, np.arange(n), side="right")
        before = np.r_[0, np.cumsum(sizes)]
        t["offsets"] = chunks[chunk] + before[:n] - before[np.minimum(ends[chunk] - per[chunk], n)]
        if n and int((t["offsets"] + sizes).max()) > len(view):
            raise ValueError("a sample lies outside the file")
        each = t["stts"][np.searchsorted(steps, np.arange(n), side="right"), 1] if n else sizes
        t["times"] = np.cumsum(each) - each
        key = np.full(len(sizes), t["stss"] is None)
        if t["stss"] is not None:
            key[t["stss"] - 1] = True
        t["key"] = key
    return found


def probe(data: bytes) -> dict | None:
    """Codec, duration in seconds and key-frame byte ranges of the first track; None for what isn't such a file."""
    try:
        t = tracks(data)[0]
        at = np.flatnonzero(t["key"])
        return {"codec": t["codec"], "duration": t["duration"] / t["timescale"], "samples": len(t["sizes"]), "ranges": np.stack([t["offsets"][at], t["offsets"][at] + t["sizes"][at]], axis=1)}
    except (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError):
        return None


def payload(data: bytes) -> bytes:
    """The stored samples of the first track, in order; neighbouring samples are read at once."""
    t = tracks(data)[0]
    off, sizes = t["offsets"], t["sizes"]
    if not len(off):
        return b""
    cut = np.flatnonzero(np.r_[True, off[1:] != off[:-1] + sizes[:-1]])
    stop = np.r_[cut[1:] - 1, len(off) - 1]
    return b"".join([data[off[a] : off[b] + sizes[b]] for a, b in zip(cut, stop)])


def feature(data: bytes) -> str:
    """Codec, duration, samples, number of key frames, and a digest with the first and the last of their byte ranges."""
    p = probe(data)
    r = p["ranges"]
    return f"codec={p['codec'].strip()};duration={p['duration']:.6f};samples={p['samples']};keyframes={len(r)};first={r[0, 0]}-{r[0, 1]};last={r[-1, 0]}-{r[-1, 1]};ranges_crc32={zlib.crc32(r.astype('<i8').tobytes())}"


def media_column(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``media`` (the container) for each text."""

    def start():
        return lambda batch: [[container(padded(x)) for x in utf8_rows(batch.column(batch.schema.get_field_index(text_col)))]]

    return add_columns(docs, [text_col], [("media", pa.binary(), T.BinaryType())], start, keep)


def probed(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``codec``, ``duration`` and ``keyframes`` (array of byte ranges) of a binary column; null for other data."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def start():
        def fn(batch):
            got = [None if x is None else probe(x) for x in batch.column(batch.schema.get_field_index(media_col)).to_pylist()]
            return [[p and p["codec"] for p in got], [p and p["duration"] for p in got], pa.array([p and [{"start": int(a), "stop": int(b)} for a, b in p["ranges"]] for p in got], span)]

        return fn

    kind = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    return add_columns(df, [media_col], [("codec", pa.string(), T.StringType()), ("duration", pa.float64(), T.DoubleType()), ("keyframes", span, kind)], start, keep)


def digests(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with digests of each container and of the samples read back from it; the files never leave the worker."""
    fields = [("n_bytes", pa.int64(), T.LongType()), ("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType())]

    def one(text: bytes) -> tuple:
        file = container(padded(text))
        back = payload(file)
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(file)

    def start():
        return lambda batch: [list(c) for c in zip(*map(one, utf8_rows(batch.column(batch.schema.get_field_index(text_col)))))]

    return add_columns(docs, [text_col], fields, start, keep)
