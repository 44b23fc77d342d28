"""Odd inputs of the training-data operators: forged files, repeated and missing ids, mixed lengths, clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import struct
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from questlake.llm import bpe, langid, media, mtree, toxicity
from questlake.llm.registry import tokenizer_path


def test_bpe_of_control_characters_is_the_library_s():
    import sentencepiece

    path, rnd = tokenizer_path("piece_bpe_32k.model"), random.Random(1)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), bpe.PrefixBPE(path)
    odd = "".join(map(chr, range(32))) + "\x7f\x80\x85▁​　﻿ �"
    texts = ["\x01", "a \x01b", "\x02 \x01", " \x01", "\x01 "]
    texts += ["".join(rnd.choice(odd if rnd.random() < 0.35 else "abcde  the\n.,éß日▁😀ing's1_-\"|") for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    for t in texts:
        ids, shown = own.encode(t)
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert (np.frombuffer(ids, "<u4").tolist(), shown.decode()) == (want, sp.decode(want))


def test_bpe_keeps_repeated_rows_and_replaces_columns_of_its_names(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, decoded string")
    got = bpe.encoded(docs, path).collect()
    assert sorted(r.decoded for r in got) == ["", "a b", "a b"] and bpe.encoded(docs.limit(0), path).count() == 0


def forged(file: bytes, kind: bytes, at: int, value: int) -> bytes:
    i = file.index(kind) + at
    return file[:i] + struct.pack(">I", value) + file[i + 4 :]


def test_forged_files_give_none_without_taking_memory():
    deep = b""
    for _ in range(1500):
        deep = media._box(b"moov", deep)
    assert media.probe(deep) is None
    file = media.container(media.padded(b"hello" * 1000))
    for kind, at in ((b"stsz", 12), (b"stsc", 8), (b"stts", 8), (b"stco", 8), (b"stss", 8), (b"stco", 12)):
        assert media.probe(forged(file, kind, at, 0xFFFFFFFF)) is None
    assert media.probe(forged(file, b"stts", 12, 1)) is None  # fewer samples than there are
    rnd = random.Random(4)
    for _ in range(3000):
        b = bytearray(file)
        for _ in range(rnd.randint(1, 6)):
            b[rnd.randrange(len(b) - 700, len(b))] = rnd.choice([0, 255, rnd.randrange(256)])
        media.probe(bytes(b))


def test_forged_offsets_and_key_frames_are_refused():
    file = media.container(media.padded(b"hello" * 1000))
    i = file.index(b"stco")
    chunks = struct.unpack(">I", file[i + 8 : i + 12])[0]
    head, tail = file[: i - 4], file[i + 12 + 4 * chunks :]

    def wide(first: int) -> bytes:
        """The same file with 64-bit offsets, the first of which is forged; the boxes around it grow by what it needs."""
        offsets = [first, *struct.unpack(f">{chunks}I", file[i + 12 : i + 12 + 4 * chunks])[1:]]
        body = struct.pack(">I4sII", 16 + 8 * chunks, b"co64", 0, chunks) + struct.pack(f">{chunks}Q", *offsets)
        out = bytearray(head + body + tail)
        for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
            at = out.index(kind) - 4
            out[at : at + 4] = struct.pack(">I", struct.unpack(">I", out[at : at + 4])[0] + 4 * chunks)
        return bytes(out)

    right = struct.unpack(">I", file[i + 12 : i + 16])[0]
    assert media.payload(wide(right)) == media.payload(file) and media.probe(wide(right)) is not None
    for first in (2**64 - 100, 2**63, 2**63 - 1, len(file) + 1, 2**40):
        assert media.probe(wide(first)) is None
    assert media.probe(forged(file, b"stss", 12, 0)) is None and media.probe(forged(file, b"stss", 12, 10**6)) is None
    assert media.probe(file.replace(b"stsz", b"stz2")) is None


@pytest.mark.parametrize("size", [1e4, 1e6, 1.3e6])
def test_top_k_of_large_components_is_exact(spark, size):
    rng = np.random.default_rng(int(size))
    near = rng.normal(0, size, 24)
    rows = [(i, [float(np.float32(x)) for x in near + rng.normal(0, size * 1e-6, 24)]) for i in range(300)]  # scores differ in their last digits
    assert ranks(vectors(spark, rows), block=32) == sorted(brute.top_k(rows), key=repr)


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(ValueError, match="64 bits"):
        ranks(vectors(spark, [(0, [1e10, 1.0]), (1, [1.0, 1.0])]))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, row string, block int")


def ranks(df, **k):
    return sorted((tuple(r) for r in mtree.top_k(df, F.col("id") % 50 == 0, **k).collect()), key=repr)


def test_top_k_of_mixed_lengths_and_empty_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0]), (50, [2.0]), (100, []), (3, []), (4, None), (150, [])]
    got = ranks(vectors(spark, rows))
    assert got == sorted([(0, 1, 1, 196608), (50, 1, 2, 393216), (100, 1, 3, 0), (100, 2, 150, 0), (150, 1, 3, 0), (150, 2, 100, 0)], key=repr)
    assert ranks(vectors(spark, []).limit(0)) == []


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0]), (0, [2.0]), (7, [3.0]), (None, [9.0])]
    assert ranks(vectors(spark, rows)) == sorted([(0, 1, 7, 196608), (0, 2, 0, 131072), (0, 1, 7, 393216), (0, 2, 0, 131072)], key=repr)


@pytest.mark.parametrize("block, cells, chunk", [(32, 1024, 3), (16, 4, 1 << 15)])
def test_top_k_over_many_cells_and_blocks(spark, block, cells, chunk):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, 0.05, 6)).tolist()) for i in range(500)]
    rows += [(500 + i, [0.5] * 6) for i in range(250)]  # a third are equal
    want = brute.top_k([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert ranks(vectors(spark, rows), block=block, cells=cells, chunk=chunk) == sorted(want, key=repr)


def test_tree_reads_few_pages_of_clusters_and_all_of_an_even_sphere():
    rng = np.random.default_rng(2)
    near = np.floor(np.repeat(rng.normal(0, 400, (20, 6)), 100, 0) + rng.normal(0, 3, (2000, 6)))
    sphere = rng.normal(0, 1, (2000, 64))
    sphere = np.floor(256 * sphere / np.linalg.norm(sphere, axis=1)[:, None])
    read = []
    for v in (near, sphere):
        top, ids, seen = float((v * v).sum(1).max()), np.arange(2000), Counter()
        tree = mtree.build(ids, v, top, page=32)
        for q in range(0, 2000, 97):
            mtree.search(tree, ids, v[q], q, 5, top, seen=seen)
        read.append(seen["entries"] / (2000 * 21))
    assert read[0] < 0.35 and read[1] > 0.9


# what the registered queries return, by plainer means

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def rows_of(spark, name, key="doc_id"):
    got = entry.queries()[name](spark, SF).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def plain_network(net: langid.ByteCNN, text: bytes) -> np.ndarray:
    """The mean class probabilities of a text, one filter at one place after another."""
    width = net.kernels.shape[0]
    total = np.zeros(len(net.langs))
    for at in range(0, len(text), 256):
        part = text[at : at + 256]
        win = part.ljust(256, b"\0")
        places = [sum(net.emb[win[p + k]].astype(float) @ net.kernels[k] for k in range(width)) for p in range(256 - width + 1)]
        z = np.maximum(np.max(places, axis=0) + net.bias, 0) @ net.out + net.out_bias
        z = np.exp(z - z.max())
        total += z / z.sum() * len(part)
    return total / len(text)


@here
def test_op1_is_the_plain_network(spark, documents):
    got = rows_of(spark, "op1_language_id")
    net = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.keys() == documents.keys()
    short = sorted((i for i, t in documents.items() if t and any(c.isalpha() for c in t)), key=lambda i: len(documents[i]))
    for i in [*short[:15], *(j for j in short if 600 < len(documents[j]) < 1500)][:25]:
        p = plain_network(net, documents[i].encode())
        assert got[i].score == pytest.approx(p.max(), abs=1e-4) and (got[i].lang_pred == net.langs[p.argmax()] or sorted(p)[-1] - sorted(p)[-2] < 1e-4)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_language_of_repeated_rows_ties_and_long_texts(spark):
    net = langid.train(np.zeros((0, 256), np.uint8), np.zeros(0, int), ["a", "b"])
    net.out[:], net.out_bias[:] = 0, 0  # all classes tie
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y" * 300_000), (3, "1" * 5000 + "z"), (4, "\0\0")], "doc_id long, text string")
    got = sorted(tuple(r) for r in langid.predicted(docs, net, keep=["doc_id"]).collect())
    assert [(i, p) for i, p, _ in got] == [(1, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "und")] and got[0][2] == pytest.approx(0.5)


def plain_file(data: bytes) -> bytes:
    """The container's layout, written down box by box from the format's description."""

    def box(kind, body):
        return (8 + len(body)).to_bytes(4, "big") + kind.encode() + body

    def u32(*xs):
        return b"".join(x.to_bytes(4, "big") for x in xs)

    units = len(data) // 64
    chunks = (units + 63) // 64
    head = box("ftyp", b"isom" + u32(512) + b"isomqt  ")
    keys = list(range(1, units + 1, 16))
    runs = ([(1, 64, 1)] if chunks > 1 else []) + [(chunks, units - 64 * (chunks - 1), 1)]
    sound = box("raw ", bytes(6) + b"\0\1" + bytes(8) + b"\0\1\0\x08\0\0\0\0" + u32(8000 << 16))
    stbl = box("stbl", box("stsd", u32(0, 1) + sound) + box("stts", u32(0, 1, units, 64)) + box("stsc", u32(0, len(runs), *(x for r in runs for x in r))) + box("stsz", u32(0, 64, units)) + box("stco", u32(0, chunks, *(len(head) + 8 + 4096 * i for i in range(chunks)))) + box("stss", u32(0, len(keys), *keys)))
    unity = u32(65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    minf = box("minf", box("smhd", u32(0, 0)) + box("dinf", box("dref", u32(0, 1) + box("url ", u32(1)))) + stbl)
    mdia = box("mdia", box("mdhd", u32(0, 0, 0, 8000, units * 64) + b"\x55\xc4\0\0") + box("hdlr", u32(0, 0) + b"soun" + bytes(12) + b"\0") + minf)
    trak = box("trak", box("tkhd", u32(7, 0, 0, 1, 0, units * 64) + bytes(8) + b"\0\0\0\0\1\0\0\0" + unity + bytes(8)) + mdia)
    mvhd = box("mvhd", u32(0, 0, 0, 8000, units * 64, 65536) + b"\1\0\0\0" + bytes(8) + unity + bytes(24) + u32(2))
    return head + box("mdat", data) + box("moov", mvhd + trak)


@here
def test_op7_digests_by_other_means(spark, documents):
    got = rows_of(spark, "op7_media_columns")
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        data = (text or "").encode()
        stored = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        file, r, n = plain_file(stored), got[i], len(stored) // 64
        spans = [(32 + 1024 * k, 32 + 1024 * k + 64) for k in range(-(-n // 16))]
        crc = zlib.crc32(b"".join(x.to_bytes(8, "little") for s in spans for x in s))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert r.feature == f"codec=raw;duration={n * 64 / 8000:.6f};samples={n};keyframes={len(spans)};first=32-96;last={spans[-1][0]}-{spans[-1][1]};ranges_crc32={crc}"


def plain_toxicity(model: toxicity.Model, text: bytes) -> float:
    """The score from all segments of all tokens, found by the definition."""
    scores = [model.scores.get(w, 0.0) - model.drift for w in toxicity.tokens(text)]

    def maximal(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > best + 1e-12:
                    best, at = s, (i, j + 1)
        return [] if at is None else [*maximal(a, at[0]), best, *maximal(at[1], b)]

    found = [model.lam * s - model.ln_k - np.log(len(scores)) for s in maximal(0, len(scores))]
    a = np.log1p(max(0.0, max(found))) if found else 0.0
    b = np.log1p(sum(x > 2.97 for x in found)) if found else 0.0
    return 1 / (1 + np.exp(-np.clip(model.weights[0] * a + model.weights[1] * b + model.weights[2], -50, 50)))


@here
def test_op10_scores_by_definition(spark, documents):
    got = rows_of(spark, "op10_toxicity")
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert got.keys() == documents.keys()
    tried = 0
    for i, text in documents.items():
        data = (text or "").encode()
        if len(toxicity.tokens(data)) <= 120:
            tried += 1
            assert got[i].score == pytest.approx(plain_toxicity(model, data), rel=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.3)
    assert tried > 20


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "calm words here", "a"), (1, "calm words here", "b"), (1, "vile scum", "c"), (2, "vile scum " * 50_000, "d"), (None, "x", "e"), (3, None, "f")], "doc_id long, text string, tox_score string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_bytes=1000)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.tox_score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), model).count() == 0 and toxicity.passages(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).scores == {}


def test_whole_sample_calibrates():
    """Clean texts beyond the first few hundred change the extreme-value parameters."""
    rnd = random.Random(1)
    clean = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(30)).encode() for _ in range(1500)]
    late = [x + b" slur" * (k % 2) for k, x in enumerate(clean)]
    toxic = [(" ".join(rnd.choice("abcdefghij") * 3 for _ in range(10)) + " slur slur vile vile").encode() for _ in range(300)]
    a = toxicity.fit([(x, 0) for x in clean[:1200]] + [(x, 1) for x in toxic])
    b = toxicity.fit([(x, 0) for x in clean[:600] + late[600:1200]] + [(x, 1) for x in toxic])
    assert (a.lam, a.ln_k) != (b.lam, b.ln_k)


@here
@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op5_substring_dedup", "op9_simhash"])
def test_dedup_queries_by_brute_force(spark, documents, name):
    docs = list(documents.items())
    want = {"op2_suffix_dedup": brute.suffix_dedup, "op5_substring_dedup": brute.substring_dedup, "op9_simhash": brute.near_duplicates}[name](docs)
    assert {i: tuple(r)[1:] for i, r in rows_of(spark, name).items()} == want


@here
def test_op4_is_the_library_s(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for i, r in rows_of(spark, "op4_sentencepiece").items():
        ids = sp.encode(documents[i] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@here
def test_op6_packs_every_token(spark, documents):
    from tokenizers import Tokenizer

    tok, end = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    rows = entry.queries()["op6_best_fit_packing"](spark, SF).collect()
    pieces = {i: sorted(r for r in rows if r.doc_id == i) for i in documents}
    for i, text in documents.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert [tuple(r)[:5] for r in pieces[i]] == want
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048 and len(end) >= sum(end.values()) / 2048


@here
@pytest.mark.parametrize("name", ["op3_sharding", "op8_exact_top_k"])
def test_queries_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
