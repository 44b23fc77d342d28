"""The pipeline against brute-force versions of its stages."""

from __future__ import annotations

import os
import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from questlake.llm import langid, nearcopies, simhash, substringdedup

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        made = f(spark, out[-1], SF)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    clean, toxic = ({r.doc_id for r in marks.where(f"toxic = {y}").collect()} for y in (0, 1))
    assert stages[1].columns == stages[0].columns
    assert len(clean & kept) >= 0.98 * len(clean) and len(toxic & kept) < 0.5 * len(toxic)


def test_documents_with_letters_stay(stages):
    assert stages[2].count() == stages[1].where(F.col("text").rlike(r"\p{L}")).count()


def test_groups_of_op9_on_the_stage_s_input(stages):
    """op9's own contract (four words, four bits); what the stage keeps is held to five words and 0.8 below."""
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i for i, (_, root) in brute.near_duplicates(docs).items() if i == root}
    assert {r.doc_id for r in simhash.near_duplicates(stages[2]).where("doc_id = component_id").collect()} == want


def test_repeated_passages_go(stages):
    docs = [(r.doc_id, r.text) for r in stages[3].collect()]
    want = brute.substring_dedup(docs)
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(after) == set(want)
    for i, text in docs:
        gone = want[i][1]
        assert len(brute.WORD.findall(after[i].text)) == want[i][0] - gone
        assert after[i].n_chars == len(after[i].text) and (gone or after[i].text == text)


def test_every_remaining_document_is_packed(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_rows_that_repeat_an_id_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(None, "g h i j k", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, SF)
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1]
    assert substringdedup.cleaned(got).count() == 2


def test_unrelated_texts_under_one_id_or_none_stay(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    a, b, z = text("a"), text("b"), text("z")
    rows = [(None, a), (None, b), (None, b), (None, text("c")), (7, z), (7, text("d")), (5, text("d")), (9, z)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (None, text("c")), (7, z), (5, text("d"))], key=repr)


def test_rows_without_id_lose_repeated_windows(spark):
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(None, f"a {w}"), (None, f"b {w}"), (7, f"c {w}"), (7, f"d {w}"), (7, "e")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.substring_filter(spark, df, SF).collect()]
    assert sorted(got, key=repr) == sorted([(None, "a", 1), (None, "b", 1), (7, "c", 1), (7, "d", 1), (7, "e", 1)], key=repr)


def test_near_copies_of_five_word_similarity_leave_one(spark, stages):
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {i for i, root in brute.near_copies(docs).items() if i == root}


@pytest.mark.parametrize("block", [256, 3])
def test_near_copies_in_blocks(spark, block):
    rnd = random.Random(3)
    base, docs = [[f"{k}_{i}" for i in range(80)] for k in range(6)], [(900, None), (901, " "), (902, "A b"), (903, "a  B"), (904, "b a")]
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(9)}"
        docs.append((i, " ".join(w)))
    got = nearcopies.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", block=block)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute.near_copies(docs)


def odd_documents(spark, rows):
    """Documents with columns named like what operators add."""
    extra = ["tox_score", "lang_pred", "lang_score", "_first", "kept_id", "_id", "_kept", "doc", "row", "group", "words", "kept", "_row", "_group", "fp", "key"]
    made = [(i, t, lang, "s", len(t or ""), *[f"{c}{n}" for c in extra]) for n, (i, t, lang) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))


def test_other_columns_stay_as_they_are(spark):
    rnd = random.Random(5)
    text = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eins", "zwei"]) + str(rnd.randrange(99)) for _ in range(30))
    rows = [(i, text(), "en") for i in range(20)] + [(None, None, None), (None, "", "en"), (3, text(), None), (3, text(), "en")]
    docs = odd_documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        before = {tuple(r)[5:] for r in docs.collect()}
        assert all(tuple(r)[5:] in before for r in got.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_language_stage_without_labels_keeps_documents_with_letters(spark):
    docs = odd_documents(spark, [(1, "abc", None), (2, "123", None), (3, None, None), (4, "é", None)])
    assert {r.doc_id for r in corpus_pipeline.language_filter(spark, docs, SF).collect()} == {1, 4}


def test_language_stage_fills_missing_languages(stages):
    before, after = ({r.doc_id: r.lang for r in s.collect()} for s in (stages[1], stages[2]))
    assert all(after[i] == before[i] for i in after if before[i] is not None) and None not in after.values()


def test_threshold_rejects_where_predictions_are_mostly_wrong(spark):
    """A model that knows one of two languages only: what it is unsure of is mostly wrong."""
    rnd = random.Random(2)
    own = {"x": "abcdef", "y": "mnopqr"}
    rows = [(i, " ".join("".join(rnd.choice(own[k]) for _ in range(4)) for _ in range(30)), k) for i, k in enumerate(rnd.choices("xy", k=400))]
    docs = odd_documents(spark, rows)
    model = langid.fit(docs)
    assert langid.threshold(docs, model) == 0.0
    swapped = docs.withColumn("lang", F.when(F.col("lang") == "x", "y").otherwise("x"))
    assert langid.threshold(swapped, model) > 0.5
