"""Language ID, toxicity, tokenizers, packing, media, top-k and the shard store."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from questlake.llm import bpe, langid, media, mtree, packing, sharding, toxicity
from questlake.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, lang_pred int, tox_score string, ids string"
ODD = ["", None, " ", "  a  b ", "\n", "a\nb\n\n", "▁ x ▁▁y", "aaaaaaaaaaaaaaaa", "日本語 😀", "<s> </s> <0x41>", "é ﬁ ½ İ ΣΑΣ", "It's 's, x''s., |b| \"q\", (a). c...", "<|endoftext|> x", "one, two. three.\nFour", "12,3. _a_.", "word " * 3000]


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else "en", 1, "s", "x") for i, t in enumerate(texts)], SCHEMA)


def speech(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def test_language_id_learns_and_marks_texts_without_letters(spark):
    rnd = random.Random(2)
    own = {"x": ["ouble", "thing", "anded", "wher"], "y": ["ßach", "keit", "lich", "über"], "z": ["ción", "ado", "llama", "que"]}
    rows = [(speech(rnd, own[k], rnd.randint(4, 200)), k) for k in rnd.choices(list(own), k=300)]
    odd = [(None, "x"), ("", None), ("123 ...", "y"), ("ouble thing", None)]
    docs = frame(spark, [t for t, _ in rows + odd], [k for _, k in rows + odd])
    model = langid.fit(docs, per_lang=80)
    assert model.langs == ["x", "y", "z"]
    got = {r.doc_id: r for r in langid.predicted(docs, model).withColumn("h", langid.held_out()).collect()}
    hits = [got[i].lang_pred == k for i, (_, k) in enumerate(rows) if got[i].h]
    assert sum(hits) / len(hits) > 0.95
    assert [got[300 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[303].lang_pred in "xyz"
    assert all(0 <= r.lang_score <= 1 for r in got.values()) and got[300].lang_score == 0
    assert {i for i, r in got.items() if r.h} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}


def test_languages_beyond_the_bound_are_the_rarer_ones(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 5} " * 4, f"l{i % 10}") for i in range(400)] + [(1000 + i, "zzz zzz", f"free text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df, most_langs=10)
    assert net.langs == [f"l{k}" for k in range(10)]
    got = langid.predicted(df, net, keep=["doc_id"]).collect()
    assert len(got) == 700 and {r.lang_pred for r in got} <= set(net.langs)


def test_language_id_without_labels(spark):
    docs = frame(spark, ["abc"], [None])
    assert [r.lang_pred for r in langid.predicted(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.predicted(frame(spark, ["a"]).limit(0), langid.fit(docs)).count() == 0


def test_windows_cover_whole_texts():
    texts = [b"a" * 600, b"", b"b" * 256, b"c"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    wins, owner, length = langid.windows_of(data, offsets)
    assert owner.tolist() == [0, 0, 0, 2, 3] and length.tolist() == [256, 256, 88, 256, 1]
    assert wins[2].tolist() == [97] * 88 + [0] * 168


def test_maximal_segments_match_brute_force():
    rnd = random.Random(7)

    def recursive(x, a, b):
        best = max(((sum(x[i:j]), -i, j) for i, j in itertools.combinations(range(a, b + 1), 2)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        # of equal sums the shortest: no prefix or suffix of it sums to zero
        i, j = min(((i, j) for i, j in itertools.combinations(range(a, b + 1), 2) if sum(x[i:j]) == best[0]), key=lambda p: (p[1] - p[0], p[0]))
        return [*recursive(x, a, i), (i, j, best[0]), *recursive(x, j, b)]

    for _ in range(300):
        x = [rnd.choice([-3, -2, -1, 1, 2, 4]) + rnd.random() / 1000 for _ in range(rnd.randint(0, 12))]
        assert [(a, b, pytest.approx(s)) for a, b, s in toxicity.segments(x)] == recursive(x, 0, len(x))


def test_toxicity_learns_words(spark):
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        if bad:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Idiot,", "scum", "trash!"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    docs = frame(spark, [*texts, None, ""])
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(3, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.tox_score for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, y in enumerate(labels))
    assert got[600] == got[601] < toxicity.THRESHOLD
    found = toxicity.passages(docs, model).select("id").distinct().collect()
    assert {r.id for r in found} == {i for i, y in enumerate(labels) if y}


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a"])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.tox_score < 0.01 for r in toxicity.scored(docs, model).collect()] == [True]


def odd_texts(n=1500):
    rnd = random.Random(9)
    return [t or "" for t in ODD] + ["".join(rnd.choice("abcde  the\n.,éß日▁😀ing's1_-\"|") for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_bpe_is_the_library_s(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), bpe.PrefixBPE(path)
    for t in odd_texts():
        ids, shown = own.encode(t)
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert shown.decode() == sp.decode(want)
    got = bpe.encoded(frame(spark, ["a b", None]), path).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [sp.encode("a b", add_bos=True, add_eos=True), [1, 2]] and got[1].decoded == ""
    d = bpe.digests(frame(spark, ["a b"]), path).first()
    assert d.decoded_sha256 == hashlib.sha256(b"a b").hexdigest() and d.n_tokens == len(got[0].ids)


def test_word_cache_is_the_tokenizer_s():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own, tok = packing.WordCached(path), Tokenizer.from_file(path)
    texts = odd_texts()
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def sequential_best_fit(lengths, size):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            n += 1
            gaps.append(size - length)
    return n


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(200):
        size = rnd.randint(3, 60)
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 200))]
        counts = {v: lengths.count(v) for v in set(lengths)}
        fill: dict[int, int] = {}
        placed = 0
        for length, _, n, first, per, offset in packing.plan(counts, size):
            for k in range(n):
                assert fill.get(first + k // per, 0) == offset + k % per * length
                fill[first + k // per] = offset + k % per * length + length
            placed += n
        assert placed == len(lengths) and max(fill.values(), default=0) <= size
        assert len(fill) == sequential_best_fit(lengths, size)


def test_packing_keeps_every_piece(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, "same text", "same text"]
    rows = packing.packed_documents(frame(spark, texts), path, size=64).collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert mine == [(k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    end: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 64 and len(end) == sequential_best_fit([r.length for r in rows], 64)
    assert packing.packed_documents(frame(spark, ["a"]).limit(0), path).count() == 0


@pytest.mark.parametrize("data", [b"", b"x", b"y" * 64, "é\0日".encode() * 5000])
def test_media_round_trip(data):
    file = media.container(media.padded(data))
    assert media.payload(file) == media.padded(data) and len(media.padded(data)) % 64 == 0 and media.padded(data).rstrip(b"\0") == data.rstrip(b"\0")
    p = media.probe(file)
    units = len(media.padded(data)) // 64
    assert (p["codec"], p["samples"], p["duration"]) == ("raw ", units, units * 64 / 8000)
    for k, (a, b) in enumerate(p["ranges"]):
        assert file[a:b] == media.padded(data)[k * 16 * 64 : k * 16 * 64 + 64]
    kinds = [path[-1] for path, _, _ in media.boxes(memoryview(file))]
    assert kinds[:3] == [b"ftyp", b"mdat", b"moov"] and {b"stts", b"stsc", b"stsz", b"stco", b"stss"} <= set(kinds)


def test_media_column_and_foreign_bytes(spark):
    docs = media.media_column(frame(spark, ["abc", "abc", None]))
    got = media.probed(docs).orderBy("doc_id").collect()
    assert got[0].media == got[1].media and [r.codec for r in got] == ["raw "] * 3 and got[0].keyframes[0].stop - got[0].keyframes[0].start == 64
    for junk in (b"", b"short", bytes(100), b"\xff" * 64, media.container(bytes(64))[:-40]):
        assert media.probe(junk) is None
    assert media.digests(frame(spark, ["a"]).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(100)]  # ties
    rows += [(500, None), (550, [float("nan")] * 8), (600, [1.0, None] * 4), (650, [float("inf")] * 8), (700, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    want = brute.top_k([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for block in (64, 8192):
        got = mtree.top_k(df, F.col("id") % 50 == 0, block=block).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == want
    few = df.where("vec_id in (0, 1, 500)")
    assert [tuple(r)[:3] for r in mtree.top_k(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert mtree.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_tree_skips_pages():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (20, 6))
    v = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 3, (2000, 6)))
    top = float((v * v).sum(1).max())
    ids = np.arange(2000)
    tree = mtree.build(ids, v, top, page=32)
    for q in range(0, 2000, 97):
        want = sorted(((-int(v[q] @ v[i]), i) for i in range(2000) if i != q))[:5]
        assert [(-s, i) for s, i in mtree.search(tree, ids, v[q], q, 5, top)] == want


def test_shard_store(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(200)] + [None])
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, target=1 << 20)
    assert store.read().count() == 0
    for k in range(5):
        store.append(docs.where(F.col("doc_id") % 5 == k))
    before = store.manifest()
    assert sum(x["rows"] for x in before["shards"]) == 201
    version = store.compact()
    after = store.manifest()
    assert version > before["version"] and len(after["shards"]) < len(before["shards"]) and sum(x["rows"] for x in after["shards"]) == 201
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, docs.collect()))
    assert store.read(1).count() == docs.where("doc_id % 5 = 0").count()
    with pytest.raises(FileExistsError):
        store._commit(before["version"], [])
    assert store.vacuum() > 0 and store.versions() == [version] and store.read().count() == 201
    assert store.append(docs.limit(0)) == version + 1


def test_vacuum_spares_writes_in_progress(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(40)])
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema)
    store.append(docs.where("doc_id < 20"))
    folder = store._folder()  # an append that has written and not yet committed
    docs.where("doc_id >= 20").write.parquet(folder)
    assert store.vacuum() == 0
    store._added(store._written([folder]))
    store._close(folder)
    assert store.read().count() == 40 and store.vacuum() == 0
    lost = store._folder()
    docs.write.parquet(lost)
    assert store.vacuum() == 0
    store.patience = 0  # now it counts as given up
    assert store.vacuum() > 0 and store.read().count() == 40 and not list((tmp_path / "s" / "open").glob("[0-9a-f]*"))


def test_manifests_appear_whole_or_not_at_all(spark, tmp_path):
    docs = frame(spark, ["a", "b"])
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema)
    assert store.append(docs) == 1
    (tmp_path / "s" / "manifests" / ".left-behind").write_text('{"version": 2, "sha')  # of a writer that died
    assert store.manifest()["version"] == 1 and store.append(docs) == 2 and store.read().count() == 4
    with pytest.raises(FileExistsError):
        store._create(f"{store.path}/manifests/v000000000002.json", "{}")
    assert len(store.manifest()["shards"]) > 0
    assert [p.name for p in (tmp_path / "s" / "manifests").iterdir() if not p.name.endswith(".crc")].count(".left-behind") == 1


def test_several_arrivals_in_one_pass(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}", "x", 1) for i in range(50)], "doc_id long, text string, shard string, arrival int")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, target=1 << 20)
    assert store.append_many(docs.withColumn("more", F.lit(1)), F.col("doc_id") % 3) == [1, 2, 3]
    assert [store.read(v).count() for v in (1, 2, 3)] == [17, 34, 50]
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, docs.collect()))
    with pytest.raises(ValueError, match="column shard"):
        store.read_with_shard()
    assert store.read_with_shard(name="file").select("file").distinct().count() >= 3


def test_two_writers(spark, tmp_path):
    docs = frame(spark, [f"text {i}" for i in range(40)])
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s"), docs.schema, target=1 << 20) for _ in range(2))
    for k in range(5):
        (a, b)[k % 2].append(docs.where(F.col("doc_id") % 5 == k))
    seen = []
    commit = a._commit

    def late(base, shards):  # the other writer appends just before this one commits
        if not seen:
            seen.append(b.append(docs.limit(3)))
        return commit(base, shards)

    a._commit = late
    a.compact()
    assert seen and a.read().count() == 43 and b.manifest() == a.manifest()
