"""Dedup operators against brute force, edge cases included."""

from __future__ import annotations

import os
import random
import time
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from questlake.llm import graph, mtree, nearcopies, simhash, substringdedup, suffixdedup, winnow

SCHEMA = "doc_id long, text string, lang string, shard string, fp string"


def corpus(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = rnd.randrange(8)
        if kind == 0 and out:
            t = rnd.choice(out)[1]
        elif kind == 1 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[rnd.randrange(len(w))] = "Changed"
            t = " ".join(w)
        elif kind in (2, 3):
            t = text(rnd.randint(0, 20)) + " " + passage + "\n" + text(rnd.randint(0, 20))
        else:
            t = text(rnd.randint(0, 120))
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, "x"), (n + 3, "a " * 90), (n + 4, "a" * 130), (n + 5, "ab" * 500), (n + 6, "a b c " * 300), (n + 7, text(3000))]
    rnd.shuffle(out)
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", "f") for i, t in docs], SCHEMA)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, hot):
    docs = corpus(1)
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.suffix_dedup(frame(spark, docs), hot=hot).collect()}
    assert got == brute.suffix_dedup(docs)


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, hot):
    docs = corpus(2)
    got = {r[0]: tuple(r)[1:] for r in substringdedup.substring_dedup(frame(spark, docs), hot=hot).collect()}
    assert got == brute.substring_dedup(docs)


def test_shards_follow_the_bytes_of_the_texts(spark, monkeypatch):
    docs, dealt, deal = corpus(4), [], winnow.shard_table

    def noted(rows, id_col, text_col, path, shards, first=0):
        dealt.append(shards)
        return deal(rows, id_col, text_col, path, shards, first)

    monkeypatch.setattr(winnow, "SHARD", 2000, raising=False)
    monkeypatch.setattr(winnow, "shard_table", noted)
    monkeypatch.setattr(substringdedup, "shard_table", noted)
    rows = frame(spark, docs).coalesce(1)
    size = sum(len((t or "").encode()) for _, t in docs)
    assert {r[0]: tuple(r)[1:] for r in suffixdedup.suffix_dedup(rows).collect()} == brute.suffix_dedup(docs)
    assert size > 40_000 and dealt == [-(-size // 2000)]
    assert {r[0]: tuple(r)[1:] for r in substringdedup.substring_dedup(rows, batches=1).collect()} == brute.substring_dedup(docs)
    assert dealt[1:] == dealt[:1]


def test_substring_cleaned_keeps_columns_and_untouched_texts(spark):
    w = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, "x  y"), (2, f"a {w} b"), (3, f"c {w}"), (4, None)])
    got = {r.doc_id: r.text for r in substringdedup.cleaned(docs).select(docs.columns).collect()}
    assert got == {1: "x  y", 2: "a b", 3: "c", 4: None}


def test_near_duplicates(spark):
    docs = corpus(3) + [(100 + i, "one two three four five") for i in range(30)]
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_duplicates(docs)


def test_links_find_every_pair_within_four_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b)
        for bit in rng.choice(63, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    linked = {f for f in fps if any(f != g and root(f) == root(g) for g in fps)}
    assert {f: root(f) for f in linked} == roots


def test_long_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    assert {r.root for r in graph.components(edges).collect()} == {0}


def test_empty_tables_and_repeated_rows(spark):
    none = frame(spark, [])
    assert suffixdedup.suffix_dedup(none).count() == 0
    assert substringdedup.substring_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    same = frame(spark, [(7, "z" * 60), (7, "z" * 60), (None, "q" * 5)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixdedup.suffix_dedup(same).collect()) == [(0, 0), (7, 0), (7, 0)]
    assert simhash.near_duplicates(same).count() == 3


def test_hash_collisions_fall_back_to_bytes():
    text = np.frombuffer(b"abcabdabc", np.uint8)
    order, same = suffixdedup.sorted_suffixes(text, np.array([0, 3, 6]), np.zeros(3, int), 3)
    assert order.tolist() == [0, 6, 3] and same.tolist() == [False, True, False]


def test_fingerprint_log_goes_on_from_its_folder_and_compacts(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, old = text(50), [(i, text(60)) for i in range(12)]
    old[3] = (3, f"{text(5)} {passage} {text(5)}")
    spec, path, seen = substringdedup.Spec(35, 8, True), str(tmp_path / "log"), []
    sizes = []
    for k in range(6):
        log = substringdedup.FingerprintLog(spark, path, spec, buckets=4)  # opened anew for each batch
        batch = old if k == 0 else [(100 * k + i, text(60)) for i in range(2)] + [(100 * k + 9, f"{text(3)} {passage if k in (2, 5) else text(50)}")]
        seen += batch
        got = {r[0]: tuple(r)[1:] for r in substringdedup.incremental(log, frame(spark, batch)).collect()}
        want = brute.substring_dedup(seen)
        assert got == {i: want[i] for i, _ in batch}  # judged against the history and itself
        sizes.append([r["rows"] for r in log.state["runs"]])
    assert max(map(len, sizes)) in (2, 3) and all(a >= log.ratio * b for x in sizes for a, b in zip(x, x[1:]))
    with pytest.raises(ValueError):
        substringdedup.FingerprintLog(spark, path, substringdedup.Spec(30, 8, True))


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_of_arrival_don_t_matter(spark, batches):
    docs = corpus(4)
    got = {r[0]: tuple(r)[1:] for r in substringdedup.substring_dedup(frame(spark, docs).repartition(5), batches=batches).collect()}
    assert got == brute.substring_dedup(docs)


def test_repeats_inside_one_stretch_of_a_long_text(spark):
    """A run of one word around a place that is a multiple of 65536, in a text without other repeats."""
    w = [f"u{i}" for i in range(65_516)] + ["same"] * 40 + [f"v{i}" for i in range(300)]
    docs = [(1, " ".join(w))]
    assert {r[0]: tuple(r)[1:] for r in substringdedup.substring_dedup(frame(spark, docs)).collect()} == brute.substring_dedup(docs)


def test_rows_that_are_shuffled_don_t_grow_with_the_shards(spark):
    spec, rows = winnow.Spec(35, 8, True), []
    text = " ".join(f"w{i % 977}" for i in range(4000))
    docs = spark.createDataFrame([(None, f"{text} d{i}") for i in range(12)], "doc_id long, text string")
    for n in (4, 32):
        shards = docs.selectExpr("doc_id AS id", "text", f"pmod(xxhash64(text), {n}) AS shard")
        grams = winnow.gram_rows(shards, spec, False, packed=True)
        known = winnow.repeated_grams(grams, n, spec.hot)
        contents = winnow.stretch_rows(shards, known, spec, n, True)
        answers = winnow.resolved(contents, n, substringdedup.by_words)
        rows.append((grams.count(), known.count(), contents.count(), answers.count()))
        assert known.count() <= grams.count() and answers.count() <= contents.count()
    # documents have the same grams, so each row is a gram of a shard that holds some
    assert rows[1][0] <= 4 * rows[0][0] and rows[1][2] <= 4 * rows[0][2]


def test_rows_without_id_are_spread_over_shards(spark, tmp_path):
    docs = spark.range(400).selectExpr("CAST(NULL AS long) AS doc_id", "'same text' AS text")
    sizes = [r["count"] for r in winnow.shard_table(docs, "doc_id", "text", str(tmp_path / "s"), 8).groupBy("shard").count().collect()]
    winnow.forget(spark)
    assert len(sizes) == 8 and max(sizes) < 100


def test_tables_and_folders_of_a_run_go(spark):
    from questlake import session

    folder = session.shared_folder(spark).removeprefix("file:")
    before = {t.name for t in spark.catalog.listTables()}
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    runs = (lambda: substringdedup.substring_dedup(frame(spark, corpus(1, 10))), lambda: suffixdedup.suffix_dedup(frame(spark, corpus(1, 10))), lambda: simhash.near_duplicates(frame(spark, corpus(1, 10))), lambda: nearcopies.near_duplicates(frame(spark, corpus(1, 10)), "doc_id"), lambda: mtree.top_k(vectors, F.col("id") == 0))
    for f in runs:
        session.clear_scratch()
        there = set(os.listdir(folder))
        assert f().collect()
        assert {t.name for t in spark.catalog.listTables()} == before
        assert len(set(os.listdir(folder)) - there) == 1  # the result
        session.clear_scratch()
        assert set(os.listdir(folder)) == there


def test_cleaned_with_clashing_columns(spark):
    w = " ".join(f"w{i}" for i in range(40))
    names = ["doc_id", "text", "_id", "_kept", "_words", "words", "kept", "doc", "text b"]
    docs = spark.createDataFrame([(1, f"a {w}", *"123456", None), (1, f"b {w}", *"abcdef", "z")], ", ".join(f"`{n}` string" if i else "doc_id long" for i, n in enumerate(names)))
    got = sorted((tuple(r) for r in substringdedup.cleaned(docs).collect()), key=repr)
    assert got == [(1, "a", *"123456", None), (1, "b", *"abcdef", "z")]


def test_suffix_dedup_frees_what_a_pass_shuffled(spark, monkeypatch):
    """When the last pass starts, the shuffle files of the earlier ones are gone."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, seen, applied = held(), [], winnow.applied

    def last(*args):
        until = time.time() + 20
        while held() > before and time.time() < until:
            time.sleep(0.2)
        seen.append(held())
        return applied(*args)

    monkeypatch.setattr(winnow, "applied", last)
    docs = corpus(7)
    got = suffixdedup.suffix_dedup(frame(spark, docs)).count()
    assert got == len(docs) and len(seen) == 1 and seen[0] <= before


def test_fingerprint_log_writes_nothing_that_its_runs_give(spark, tmp_path):
    """Like batches end in one run: each is merged before it is written, and what repeats is read off the run."""
    from questlake import session

    docs, path = corpus(8, 90), tmp_path / "log"
    log = substringdedup.FingerprintLog(spark, str(path), substringdedup.Spec(35, 8, True), buckets=4)
    for k in range(3):
        log.append(frame(spark, docs[k::3]), shards=3)
    there = session.scratch_paths()
    fields = [("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    rule = substringdedup.Rule(substringdedup.by_words, True, 0, lambda v, doc: v > 0, substringdedup._rows, fields)
    assert {r[0]: tuple(r)[1:] for r in log.deduplicated(rule).collect()} == brute.substring_dedup(docs)
    # the run that the second batch merged went with the third; the one that the third merged is still there for readers of the version before
    assert sorted(p.name.split("-")[0] for p in path.iterdir() if p.is_dir()) == ["grams"] * 3 + ["manifests"] + ["run"] * 2 + ["shards"] * 3
    assert [p.rsplit("/questlake-", 1)[1].split("-")[0] for p in session.scratch_paths() if p not in there] == ["answers"]
    assert len(log.state["runs"]) == 1
    whole, sums = Counter(), Counter()
    for b in log.state["batches"]:
        for r in spark.read.parquet(b["grams"]).collect():
            whole[r.gram] += r.n
            sums[r.gram] += r.kinds
    assert sorted(tuple(r) for r in log._run(log.state["runs"][0]).collect()) == sorted((g, whole[g], sums[g]) for g in whole)


def log_of(spark, path, buckets=4):
    return substringdedup.FingerprintLog(spark, str(path), substringdedup.Spec(35, 8, True), buckets=buckets)


def judged(log, spark, batch, **options):
    return {r[0]: tuple(r)[1:] for r in substringdedup.incremental(log, frame(spark, batch), **options).collect()}


def test_a_crash_in_a_commit_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    docs = corpus(11, 40)
    first, second = docs[::2], docs[1::2]
    log = log_of(spark, tmp_path / "log")
    log.append(frame(spark, first))

    def dies(*a):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(type(log.manifests), "create", dies)
        with pytest.raises(RuntimeError):
            log.append(frame(spark, second))
    again = log_of(spark, tmp_path / "log")
    assert len(again.state["batches"]) == 1
    want = brute.substring_dedup(docs)
    assert judged(again, spark, second) == {i: want[i] for i, _ in second}  # the history is still there


def test_a_log_without_its_manifest_and_a_second_writer_are_errors(spark, tmp_path):
    docs = corpus(12, 20)
    one = log_of(spark, tmp_path / "log")
    one.append(frame(spark, docs[:10]))
    other = log_of(spark, tmp_path / "log")
    one.append(frame(spark, docs[10:15]))
    with pytest.raises(FileExistsError):
        other.append(frame(spark, docs[15:]))
    assert len(log_of(spark, tmp_path / "log").state["batches"]) == 2
    for f in (tmp_path / "log" / "manifests").iterdir():
        f.unlink()
    with pytest.raises(ValueError, match="no manifest"):
        log_of(spark, tmp_path / "log")


def test_a_new_batch_reads_only_the_shards_that_it_hits(spark, tmp_path):
    """The texts read for a batch of the same kind don't grow with the history."""
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, log, seen, read = text(50), log_of(spark, tmp_path / "log"), [], []
    hit = substringdedup.FingerprintLog._hit

    def counted(self, texts, side):
        got = hit(self, texts, side)
        read[-1] += 0 if got is None else got.count()
        return got

    substringdedup.FingerprintLog._hit = counted
    try:
        for k in range(5):
            old = [(1000 * k + i, text(60)) for i in range(100)] + [(1000 * k + 500, text(3) + " " + passage)] * (k == 0)
            log.append(frame(spark, old), shards=25)
            new = [(1000 * k + 900 + i, text(40)) for i in range(19)] + [(1000 * k + 950, passage)]
            read.append(0)
            seen += [*old, *new]
            want = brute.substring_dedup(seen)
            assert judged(log, spark, new) == {i: want[i] for i, _ in new}
    finally:
        substringdedup.FingerprintLog._hit = hit
    assert 0 < max(read) <= 60 and read[-1] <= read[1] + 60  # of some 500 documents


def test_arrivals_are_dealt_by_value(spark):
    """Every arrival has rows, whatever the partitions are, also of an input that isn't a scan."""
    docs = corpus(14)
    made = frame(spark, docs).repartition(6).groupBy("doc_id").agg(F.first("text").alias("text")).coalesce(1)
    sizes = []
    append = substringdedup.FingerprintLog.append

    def noted(self, batch, *a, **k):
        sizes.append(batch.count())
        return append(self, batch, *a, **k)

    substringdedup.FingerprintLog.append = noted
    try:
        got = {r[0]: tuple(r)[1:] for r in substringdedup.substring_dedup(made).collect()}
    finally:
        substringdedup.FingerprintLog.append = append
    assert got == brute.substring_dedup(docs) and sum(sizes) == len(docs) and min(sizes) > 0


def test_operators_in_two_threads_keep_to_their_own_folders(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = [corpus(15), corpus(16)]
    runs = [lambda d=d, f=f: {r[0]: tuple(r)[1:] for r in f(frame(spark, d)).collect()} for d in docs for f in (substringdedup.substring_dedup, suffixdedup.suffix_dedup)]
    want = [f(d) for d in docs for f in (brute.substring_dedup, brute.suffix_dedup)]
    before = {t.name for t in spark.catalog.listTables()}
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda f: f(), runs)) == want
    assert {t.name for t in spark.catalog.listTables()} == before
