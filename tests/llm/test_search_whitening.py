"""Pair-index BPE against the library, lexical search against its definition, whitening against a plain eigendecomposition."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from questlake.llm import lexical, pairbpe, whitening
from questlake.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


# 11


def test_pair_bpe_of_odd_texts_is_the_library_s():
    tok, own, rnd = library(), pairbpe.PairBPE(tokenizer_path("byte_bpe_50k.json")), random.Random(3)
    odd = "".join(map(chr, range(32))) + "\x7f\x80\x85\xa0 　՘Ᲊ\U00010d40é日😀'"
    texts = ["<|endoftext|>", "a<|endoftext|> b", "<|endo<|endoftext|>text|>", "", "\0a \0a", " \0a", "a" * 5000, "ab" * 3000, "  \n x", "x  ", "a \n"]
    texts += ["".join(rnd.choice(odd if rnd.random() < 0.35 else "abcde  the\n.,éß日's're'll1_-\"|<>") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    for t, (ids, shown) in zip(texts, own.encode_many(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert (np.frombuffer(ids, "<u4").tolist(), shown.decode(errors="replace")) == (want, tok.decode(want, skip_special_tokens=False))


def test_pair_bpe_cuts_every_character_like_the_library():
    tok, own = library(), pairbpe.PairBPE(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [f"a{chr(c)}!" for c in range(0x3000, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(a, "<u4").tolist() for a, _ in own.encode_many(texts)] == want


def test_pair_index_applies_ranks_everywhere_once(monkeypatch):
    own = pairbpe.PairBPE(tokenizer_path("byte_bpe_50k.json"))
    words = [b"lower", b"lowest", b"newer", b"aaaaaaa", b"\xff\xfe"]
    alone = [own.merged([w])[0] for w in words]
    assert own.merged(words) == alone and all(b"".join(own.shown[i] for i in ids) == w for ids, w in zip(alone, words))
    monkeypatch.setattr(pairbpe, "MOST_CACHED", 3)  # caches that are cleared all the time
    monkeypatch.setattr(pairbpe, "ROW", 8)
    texts = ["one two three four five six", "one  two", "seven one", ""]
    tok = library()
    for _ in range(3):
        assert [np.frombuffer(a, "<u4").tolist() for a, _ in own.encode_many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@here
def test_op11_is_the_library_s(spark):
    tok = library()
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: r for r in entry.queries()["op11_pair_bpe"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids
        shown = tok.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_pair_bpe_columns_and_empty_tables(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None), (2, "word " * 100_000, "y", 2)], "doc_id long, text string, decoded string, n int")
    got = pairbpe.encoded(docs, path)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "n", "text"] and pairbpe.encoded(docs.limit(0), path).count() == 0
    assert sorted(len(r.decoded) for r in got.collect()) == [0, 3, 3, 500_000]
    none = [r for r in pairbpe.digests(docs, path).collect() if r.doc_id is None][0]
    assert (none.n_tokens, none.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_other_tokenizers_are_errors():
    with pytest.raises(ValueError):
        pairbpe.PairBPE(tokenizer_path("word_bpe_49k.json"))


# 12


def plain_search(docs: list[tuple[int | None, str | None]], items: list[tuple[int, str | None]], k: int = 10) -> list[tuple]:
    def terms(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    tf = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, length = sum(x[2] > 0 for x in tf), sum(x[2] for x in tf)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in tf:
            m = 25 + 75 * size * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, term string, row int")
    return d, spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")


@pytest.mark.parametrize("broadcast", [lexical.BROADCAST, 0])
def test_lexical_search_by_definition(spark, broadcast, monkeypatch):
    rnd = random.Random(12)
    words = ["the", "Cat", "dog", "été", "X9", "日本", "zebra", "a"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice([4, 8, 68])]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "the cat the dog") for i in range(150)]  # a third are equal, so whole shards tie
    docs += [(None, "the cat the dog"), (7, "cat cat"), (7, "cat cat"), (2000, None), (2001, " .,;"), (2002, "long " * 50_000 + "zebra")]
    items = [(1, "The CAT, the zebra?"), (1, "The CAT, the zebra?"), (2, None), (3, "..."), (4, "unknown"), (5, "dog " * 50 + "w1 w2"), (6, "日本 été")]
    d, q = tables(spark, docs, items)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    index = lexical.build(d.repartition(5), shard=1500)
    assert index.shards.count() > 5
    got = lexical.search(index, q, broadcast=broadcast).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(docs, items)
    assert sorted(map(tuple, lexical.search(index, q, k=3).collect()), key=repr) == plain_search(docs, items, 3)


def test_lexical_search_of_empty_tables(spark):
    d, q = tables(spark, [(1, "a b")], [(1, "a")])
    assert lexical.search(lexical.build(d.limit(0)), q).count() == 0
    assert lexical.search(lexical.build(d), q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lexical.search(lexical.build(d), q, k=0)


def test_ties_at_the_cut_stay_whole():
    scores = np.array([5, 7, 5, 5, 0, 5])
    ids, null = np.array([9, 1, 3, 4, 0, 0]), np.array([False] * 5 + [True])
    assert lexical.best(scores, ids, null, 3).tolist() == [1, 5, 2]


def test_impacts_beyond_64_bits():
    n = np.array([10, 10**7])
    got = lexical.impacts(np.array([1, 3]), n, 10**12, 10**14)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * int(x) * 10**12 // 10**14)) for t, x in zip([1, 3], n)]


@here
def test_op12_by_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["op12_lexical_search"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, entry.queries()["op12_lexical_search"](spark, SF).select(names).collect())) == sorted(want.fetchall())


# 13


def plain_whitening(vectors: dict, most: int = 16):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, p = np.linalg.eigh(c.T @ c / n)
    e, p = e[::-1], p[:, ::-1]
    return n, e, {i: (int(((n * v - s) ** 2).sum()), (v - s / n) @ p[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300))) for i, v in x.items()}


def check_whitening(got, vectors, kept):
    n, e, want = plain_whitening(vectors)
    signs = np.zeros(kept)
    assert len(got) == kept * len(vectors) and {r.vec_id for r in got} == vectors.keys()
    for r in got:
        deviation, white = want[r.vec_id]
        w = white[r.component - 1]
        if abs(w) > 1e-3 and not signs[r.component - 1]:
            signs[r.component - 1] = np.sign(w * r.whitened)
        assert (r.n, int(r.deviation)) == (n, deviation) and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert abs(abs(w) - abs(r.whitened)) < 1e-7 and r.identity_error < 1e-9
        assert abs(w) < 1e-3 or w * r.whitened * signs[r.component - 1] > 0


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string").repartition(3)


@here
def test_op13_is_a_plain_eigendecomposition(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist() if r["embedding"]}
    check_whitening(entry.queries()["op13_whitening"](spark, SF).collect(), vectors, 16)


def test_falling_spectrum_needs_no_full_basis(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(400, 60)) * 40 * 0.6 ** np.arange(60)) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x * 50)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third are copies, which count once
    df = vectors_table(spark, rows)
    model = whitening.fit(whitening.fit_list(whitening.usable(df, "vec_id", "embedding")), 60, most=8)
    assert not model.full and 1 < model.passes < 7
    assert whitening.fit(whitening.fit_list(whitening.usable(df, "vec_id", "embedding")), 60, most=8, passes=1).full
    n, e, _ = plain_whitening(dict(rows))
    assert model.n == n and model.values == pytest.approx(e[:8], rel=1e-12)
    check_whitening(whitening.whitened(df).collect(), dict(rows), 16)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [inf, 0.0, 0.0]), (104, [])]
    got = whitening.whitened(vectors_table(spark, good + odd)).collect()
    check_whitening(got, {i: [float(np.float32(c)) for c in v] for i, v in good}, 3)
    both = whitening.whitened(vectors_table(spark, [*good, (200, [1.0]), (201, [5.0]), (201, [5.0]), (None, [2.0])])).collect()
    assert len(both) == 90 + 4 and {r.n for r in both if r.vec_id in (200, 201, None)} == {3}
    assert whitening.whitened(vectors_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # nothing varies
    assert whitening.whitened(vectors_table(spark, good).limit(0)).count() == 0
    line = whitening.whitened(vectors_table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5
    with pytest.raises(ValueError):
        whitening.whitened(vectors_table(spark, [(1, [1.0]), (2, [1.0, 2.0])]), most_lengths=1)


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [2.0**40 * i, 1.0]) for i in range(4)]
    got = whitening.whitened(vectors_table(spark, rows)).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == {i: (4 * 2**46 * i - 6 * 2**46) ** 2 for i in range(4)}
