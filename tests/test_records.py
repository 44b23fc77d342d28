"""Outputs that appear together, batches once, digests, one-pass checks, models loaded once, strict turns by places of tags."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from questlake.functions import text as tx
from questlake.operators import metrics, protocol, qa, retrieval, rollout
from questlake.sources import io, publish


def test_a_version_appears_with_all_its_outputs_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "set")
    one, two = (spark.createDataFrame([(k, f"t{k}", None)], "id long, t string, n int") for k in (1, 2))
    assert publish.publish(spark, root, {"train": one, "messages": one.select("t")}, note={"seed": 1}) == 1
    broken = two.withColumn("t", F.when(F.col("id") == 2, F.raise_error(F.lit("stopped here")).cast("string")))
    with pytest.raises(Exception, match="stopped here"):
        publish.publish(spark, root, {"train": two, "messages": broken})
    assert publish.versions(spark, root) == [1]
    assert [tuple(r) for r in publish.read_published(spark, root, "train").collect()] == [(1, "t1", None)]
    assert publish.publish(spark, root, {"train": two, "messages": two.select("t")}, "parquet") == 2
    assert publish.read_published(spark, root, "train").first().id == 2 and publish.read_published(spark, root, "train", 1).first().id == 1
    m = publish.manifest(spark, root, 1)
    assert m["note"] == {"seed": 1} and m["outputs"]["messages"]["rows"] == 1
    with pytest.raises(FileExistsError):
        publish.create_once(spark, f"{root}/manifests/{2:012d}.json", "{}")
    with pytest.raises(FileNotFoundError):
        publish.manifest(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="read back"):  # lines of CSV end where the text's do
        publish.publish(spark, root, {"x": spark.createDataFrame([(1, "a\nb")], "id long, t string")}, "csv")
    assert publish.versions(spark, root) == [1, 2]


def test_batches_are_appended_once_also_after_a_crash(spark, tmp_path):
    path, rows = str(tmp_path / "out"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert publish.read_appended(spark, path, "id long").count() == 0
    assert publish.append_once(rows(1, 2), path, 0) and not publish.append_once(rows(1, 2), path, 0)
    with pytest.raises(Exception, match="killed"):
        publish.append_once(rows(3).select(F.when(F.lit(True), F.raise_error(F.lit("killed")).cast("long")).alias("id")), path, 1)
    (tmp_path / "out" / "batch=1").mkdir(exist_ok=True)
    (tmp_path / "out" / "batch=1" / "part-0.json").write_text('{"id":3}\n')  # what a killed run may leave
    assert sorted(r.id for r in publish.read_appended(spark, path, "id long").collect()) == [1, 2]
    assert publish.append_once(rows(3, 4), path, 1)
    assert sorted((r.id, r.batch) for r in publish.read_appended(spark, path, "id long").collect()) == [(1, "0"), (2, "0"), (3, "1"), (4, "1")]


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1}\n{"id":2}\n')
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda df, n: publish.append_once(df, out, n) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    run()
    (tmp_path / "c" / "commits" / "0").unlink()  # the query died after its output: the batch comes again
    for f in (tmp_path / "c" / "commits").glob(".0*"):
        f.unlink()
    (tmp_path / "in" / "b.json").write_text('{"id":3}\n')
    run()
    assert sorted(r.id for r in publish.read_appended(spark, out, "id long").collect()) == [1, 2, 3]


def test_executors_hash_files(spark, tmp_path):
    want = {}
    for k in range(300):
        data = os.urandom(k * 7)
        (tmp_path / f"f{k}").write_bytes(data)
        want[f"f{k}"] = hashlib.sha256(data).hexdigest()
    for whole in (io.WHOLE, 1500):  # the second has long files, which the driver streams
        got = {r.path.rpartition("/")[2]: r.sha256 for r in io.file_digests(spark, str(tmp_path), whole).collect()}
        assert got == want


def test_one_pass_sorts_rows_out(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", " ", ["x"]), ("a", "q", ["x"]), ("b", "q", []), ("b", "q", ["\n"]), ("b", "r", ["y"])], "source_split string, question string, golden_answers array<string>")
    rows = rows.mapInArrow(counted, rows.schema)
    good, bad, counts = qa.quarantined(rows, qa.row_error(F.col("question"), F.col("golden_answers")), str(tmp_path / "q"))
    assert good.columns == rows.columns and good.count() == 2
    assert sorted(r.error for r in bad.collect()) == ["blank answers", "blank question", "no answers"]
    assert sorted(map(tuple, counts.collect())) == [("a", 2, 1, 1), ("b", 3, 2, 1)]
    assert read.value == 5  # once


def test_quantiles_stay_within_their_rank_error(spark):
    rnd = random.Random(3)
    values = sorted(int(rnd.paretovariate(1.2) * 10) for _ in range(30_000))
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5), ("b", None)], "source string, n long").repartition(7)
    got = {r.source: r for r in metrics.length_audit(df, F.col("n"), accuracy=200).collect()}
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        lo, hi = (values[min(len(values) - 1, max(0, int((q + e) * len(values))))] for e in (-1.5 / 200, 1.5 / 200))
        assert lo <= got["a"][name] <= hi
    assert got["a"].max == values[-1] and tuple(got["b"])[1:] == (1, 5.0, 5, 5, 5, 5, 5)


def test_lists_are_cleaned_in_slices_and_without_regular_expressions(spark):
    seen, make = [], lambda x: seen.append(x) or x
    lists = pa.array([["ab" * 1000] * 4] * 1000 + [None, [], [None, ""]])
    assert tx.sliced(lists, make, lists.type).equals(lists) and len(seen) == len(lists)
    assert tx.sliced(lists.slice(0, 0), make, lists.type).equals(lists.slice(0, 0))
    df = spark.createDataFrame([("s", ["A  b", "a B", None, " ", "ß", "SS", "x"]), ("t", None), (None, [])], "source_split string, golden_answers array<string>")
    assert [r.v for r in df.select(qa.clean_list(F.col("golden_answers")).alias("v")).collect()] == [["A b", "ß", "x"], None, []]
    counts = qa.counters(df)
    assert {tuple(r) for r in counts.collect()} == {("s", 1, 2, 2), ("t", 1, None, None), ("overall", 1, 0, 0), ("overall", 3, 2, 2)}
    plan = counts._jdf.queryExecution().toString() + df.select(qa.clean_list(F.col("golden_answers"))).withColumn("x", F.lit(1))._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan


def test_latin_questions_need_no_python(spark, monkeypatch):
    def fold(texts):
        if texts.null_count < len(texts):
            raise ValueError("a text went to Python")
        return texts.cast(pa.string())

    said = ["The SAME\u0000", "Straße", "ÀÉÎ ¿qué? «Œuvre»", "\t", "", None]
    monkeypatch.setattr(tx, "_fold", fold)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").repartition(2)
    got = dict(map(tuple, df.select("i", tx.normalize_question("t")).collect()))
    assert [got[i] for i in range(len(said))] == [None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in said]


def test_articles_cost_little_more_than_white_space(spark):
    words = "banana tea atlas others than athena plan and theatre Anna café Straße".split() + ["the", "a", "An"]
    rnd = random.Random(6)
    df = spark.createDataFrame([(" ".join(rnd.choice(words) for _ in range(4000)),) for _ in range(40)], "t string").coalesce(1).cache()

    def seconds(c):
        took = []
        for _ in range(4):
            began = time.time()
            df.select(F.sum(F.length(c))).collect()
            took.append(time.time() - began)
        return min(took)

    assert seconds(tx.normalize_answer("t")) < 12 * seconds(tx.normalize_whitespace("t"))


def test_quantiles_of_large_groups_are_exact(spark):
    rnd = random.Random(4)
    values = sorted(int(rnd.paretovariate(0.9) * 100) for _ in range(40_000))
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 7)], "source string, n long").repartition(7)
    got = {r.source: tuple(r)[1:] for r in metrics.length_audit(df, F.col("n")).collect()}
    at = [values[-(-m * len(values) // 100) - 1] for m in (50, 90, 95, 99)]
    assert got["a"] == (len(values), pytest.approx(sum(values) / len(values), abs=1e-6), *at, values[-1])
    assert got["b"] == (0, *[None] * 6) and got[None] == (1, 7.0, *[7] * 5)


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import json
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(histories):
            asked = [json.loads(h)[1]["content"] for h in histories]
            if any(q == "bad" for q in asked):
                raise RuntimeError("out of memory")
            return [f"<think>t</think><answer>{q}</answer><|im_end|>" for q in asked]

        return model

    rows = [(i, "bad" if i == 7 else f"q{i}") for i in range(200)]
    asked = spark.createDataFrame(rows, "question_id long, question string").repartition(12)
    nothing = lambda q: q.select("question_id", F.array().cast("array<struct<rank:int,title:string,text:string>>").alias("hits"))
    got = {r.question_id: r for r in rollout.run_agent(asked, rollout.model_function(load, batch=16), nothing, "S").collect()}
    assert got[7].termination_reason == "runtime_error" and all(got[i].termination_reason == "answer" and got[i].steps[-1].content == q for i, q in rows if i != 7)
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 8  # twelve partitions and more, one load a process


STRICT = re.compile(r"(?s)\A<think>(.*?)</think>\s*<(search|answer)>(.*?)</\2><\|im_end\|>\Z")


def test_strict_turns_by_places_are_those_of_the_pattern(spark):
    rnd = random.Random(5)
    parts = ["<think>", "</think>", "<search>", "</search>", "<answer>", "</answer>", "<|im_end|>", " ", "\n", "x", "é😀"]
    raws = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    raws += [f"<think>{a}</think>{b}<{k}>{c}</{m}><|im_end|>{d}" for a in ("", "t", "a😀") for b in ("", " \n ", "x") for k in ("search", "answer") for m in ("search", "answer") for c in ("", "q", "</search>", "<answer>") for d in ("", "\n")]
    df = spark.createDataFrame(list(enumerate(raws)), "i long, raw string")
    fits, thought, kind, body = protocol.strict_parts(F.col("raw"))
    for r in df.select("raw", fits.alias("fits"), thought.alias("t"), kind.alias("k"), body.alias("b")).collect():
        if r.raw.count("<think>") == r.raw.count("</think>") == 1:
            m = STRICT.match(r.raw)
            assert r.fits == bool(m) and (not m or (r.t, r.k, r.b) == m.groups()), r.raw


def test_blanks_and_counts_of_answers(spark):
    rows = [(["a", " a", "A", "b\t", ""],), ([None, "x"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "a array<string>")
    got = [tuple(r.n) if r.n is not None else None for r in df.select(qa.answer_counts(F.col("a")).alias("n")).collect()]
    assert got[0] == (2, 2) and got[2] == (0, 0)
    texts = ["", " ", "\n　\x1c", "x", " é", None, "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.b for r in df.select(tx.is_blank("t").alias("b")).collect()] == [not (t or "").strip() for t in texts]


def test_terms_are_counted_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None), (4, "z")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    assert index.total.n == 4 and index.total.avgdl == pytest.approx(7 / 4)
    got = {(r.doc_id, r.term) for r in index.postings.collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (4, "z")}
    counts = docs.select("doc_id", retrieval.counted(F.sort_array(retrieval.terms(F.col("text")))).alias("t")).collect()
    assert [(t.term, t.tf) for t in counts[0].t] == [("a", 2), ("b", 3), ("c", 1)] and counts[1].t is None
    assert "Exchange" not in docs.select(F.explode_outer(retrieval.counted(F.sort_array(retrieval.terms(F.col("text")))))) ._jdf.queryExecution().executedPlan().toString()
