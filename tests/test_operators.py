"""Behaviours that the oracle can't show: protocol cases, the renderer's errors, budgets, guards, sources and sinks."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from questlake import session
from questlake.functions import scoring
from questlake.functions import text as tx
from questlake.operators import assembly, guards, isolation, metrics, protocol, qa, resume, retrieval, rollout, sampling, trajectory
from questlake.sources import io
from questlake.streaming import rollouts


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {schema}")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def random_texts(n: int, seed: int = 4) -> list[str]:
    rnd = random.Random(seed)
    alphabet = string.ascii_letters + string.punctuation + "  \t\n\r\x1c\x85\xa0　ßéΣﬁ½Å" + "the an a "
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["The An a", "a.an,the", ""]


def test_whitespace_and_question_keys_match_python(spark):
    texts = random_texts(300)
    assert column(spark, texts, tx.normalize_whitespace) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert column(spark, texts, tx.normalize_question) == [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip() for t in texts]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]


def plain_answer(t: str) -> str:
    t = t.lower().translate(str.maketrans("", "", string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


def plain_f1(a: str, b: str) -> float:
    p, g = plain_answer(a).split(), plain_answer(b).split()
    if not p or not g:
        return float(p == g)
    same = sum((collections.Counter(p) & collections.Counter(g)).values())
    return 2 * same / (len(p) + len(g))


def test_answer_scores_match_python(spark):
    rnd = random.Random(1)
    words = ["the", "a", "cat", "Cat!", "dog", "", "x-y", "an"]
    pairs = [(" ".join(rnd.choices(words, k=rnd.randint(0, 5))), " ".join(rnd.choices(words, k=rnd.randint(0, 5)))) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = df.select("i", scoring.token_f1(F.col("a"), F.col("b")), scoring.exact_match(F.col("a"), F.col("b"))).orderBy("i").collect()
    for (_, f1, em), (a, b) in zip(got, pairs):
        assert f1 == pytest.approx(plain_f1(a, b))
        assert em == float(plain_answer(a) == plain_answer(b))


@pytest.mark.parametrize(
    ("prediction", "golds", "termination", "strict", "want"),
    [
        ("Mount Kenya", ["mount kenya."], "answer", True, 1.0),
        ("1912", ["1911", "the 1912"], "answer", True, 1.0),
        ("1912", ["1911"], "answer", True, 0.0),
        ("1912", ["1912"], "max_turns", True, 0.0),
        ("1912", ["1912"], "answer", False, 0.0),
        ("", ["1912"], "answer", True, 0.0),
        ("1912", [], "answer", True, 0.0),
        (None, ["1912"], "answer", True, 0.0),
    ],
)
def test_reward(spark, prediction, golds, termination, strict, want):
    df = spark.createDataFrame([(prediction, golds, termination, strict)], "p string, g array<string>, t string, s boolean")
    assert df.select(scoring.reward(F.col("p"), F.col("g"), F.col("t"), F.col("s"))).first()[0] == want


def turn(thought="which river", *acts, end="<|im_end|>"):
    return f"<think>{thought}</think>" + "".join(f"<{k}>{c}</{k}>" for k, c in acts) + end


RIVER, NILE = ("search", "longest river"), ("answer", "the Nile")


@pytest.mark.parametrize(
    ("raw", "ended", "error", "valid"),
    [
        (turn("which river", RIVER), True, None, True),
        ("<think>done</think>\n \t<answer>  the Nile\n</answer><|im_end|>", True, None, True),
        (turn("which river", RIVER), False, "missing_im_end", True),
        (turn("which \ufffd river", RIVER), True, "decode_error", True),
        ("<answer>the Nile</answer><|im_end|>", True, "invalid_think_count", True),
        (turn("which river", RIVER, ("information", "made up")), True, "forged_information", False),
        (turn("which river", RIVER, end="\n<|im_end|>"), True, "raw_protocol_mismatch", True),
        (turn("which river", NILE, RIVER), True, "raw_protocol_mismatch", False),
        (turn("\t", NILE), True, "empty_think", True),
        (turn("which river", ("answer", "\n \n")), True, "empty_action", False),
        (turn("no </answer> yet", NILE), True, "reserved_tag_in_think", True),
        (turn("which river", NILE, NILE), True, "reserved_tag_in_action", False),
    ],
)
def test_raw_protocol(spark, raw, ended, error, valid):
    p = spark.createDataFrame([(raw, ended)], "r string, e boolean").select(protocol.parse_raw(F.col("r"), F.col("e")).alias("p")).first().p
    assert (p.error, p.valid_action, p.strict_valid) == (error, valid, error is None)
    assert (p.type == "invalid") == (error is not None)


EVENTS = "q string, e array<struct<type:string,content:string>>"


@pytest.mark.parametrize(
    ("kinds", "error"),
    [
        ("think search information think answer", None),
        ("think think", "think is out of order"),
        ("search", "search lacks preceding think or is out of order"),
        ("think answer answer", "answer lacks preceding think or is out of order"),
        ("information", "information lacks preceding search"),
        ("think other", "unsupported event type: other"),
        ("think search information", "trajectory does not end with think and answer"),
        ("", "trajectory does not end with think and answer"),
    ],
)
def test_renderer(spark, kinds, error):
    events = [(k, f"c{i}") for i, k in enumerate(kinds.split())]
    r = spark.createDataFrame([("Q", events)], EVENTS).select(trajectory.render(F.col("e"), F.col("q"), "S").alias("r")).first().r
    assert r.error == error
    if error is None:
        assert [m.role for m in r.messages] == ["system", "user", "assistant", "user", "assistant"]
        assert r.messages[2].content == "<search>c1</search>" and r.messages[2].reasoning_content == "c0"


def test_events_come_from_turns_and_steps(spark):
    row = ([("<think>old</think><search>s</search>", "r1"), ("<think>a</think><think>b</think>bad", None)], [("search", "s", "\n\n<information>i</information>\n\n"), ("invalid", "", "")])
    df = spark.createDataFrame([row], "t array<struct<content:string,reasoning_content:string>>, s array<struct<type:string,content:string,observation:string>>")
    got = df.select(trajectory.extract_events(F.col("t"), F.col("s")).alias("e")).first().e
    assert [tuple(x) for x in got] == [("think", "r1"), ("search", "s"), ("information", "i"), ("think", "b")]


def budget(spark, turns, prompt=10, response=20, total=100, **k):
    rows = [(*t, None) if len(t) == 4 else t for t in turns]
    df = spark.createDataFrame([(rows, prompt)], f"t array<{rollout.TURN}>, p int")
    return df.select(rollout.budgeted(F.col("t"), F.col("p"), response, total, **k).alias("b")).first().b


def test_budgets(spark):
    b = budget(spark, [("search", 2, 4, True), ("search", 1, 2, True), ("answer", 3, 0, True)])
    assert (b.mask, b.reason, b.searches, b.turns, b.n) == ([1, 1, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1], "answer", 2, 3, 12)
    b = budget(spark, [("search", 5, 16, True), ("answer", 3, 0, True)])
    assert (b.n, b.searches, b.reason) == (5, 1, "length_limit")
    assert budget(spark, [("invalid", 20, 0, False)]).reason == "length_limit"
    assert budget(spark, [("invalid", 20, 0, True)]).reason == "invalid_action"
    assert budget(spark, [("invalid", 5, 0, False)]).strict_valid is False
    b = budget(spark, [("answer", 5, 0, True)], prompt=100)
    assert (b.n, b.turns, b.reason) == (0, 0, "length_limit")
    assert budget(spark, [("search", 10, 10, True)]).reason == "length_limit"  # nothing is left for the next turn


def test_budgets_stop_after_five_turns(spark):
    b = budget(spark, [("search", 1, 1, True)] * 7)
    assert (b.turns, b.searches, b.n, b.reason) == (5, 5, 10, "max_turns")


def test_log_probabilities_follow_the_mask(spark):
    b = budget(spark, [("search", 2, 2, True, [-0.5, -0.25]), ("answer", 1, 0, True, [-1.0])])
    assert b.log_probs == [-0.5, -0.25, 0.0, 0.0, -1.0] and len(b.log_probs) == len(b.mask)
    with pytest.raises(Exception, match="log-probabilities"):
        budget(spark, [("search", 2, 2, True, [-0.5])])


def test_budgets_are_errors_when_exceeded(spark):
    with pytest.raises(Exception, match="more tokens than were asked for"):
        budget(spark, [("invalid", 30, 0, False)])
    with pytest.raises(Exception, match="more tokens than were asked for"):
        budget(spark, [("search", 600, 1, True)], response=6144, total=8192)
    with pytest.raises(Exception, match="prompt is beyond"):
        budget(spark, [("answer", 1, 0, True)], prompt=101)
    with pytest.raises(Exception, match="prompt is beyond"):
        budget(spark, [("answer", 1, 0, True)], prompt=2049, response=6144, total=8192)


def plain_budget(turns, prompt, response, total):
    mask, searches, n = [], 0, 0
    for kind, tokens, seen, ended in turns:
        if n == 5:
            break
        if min(response - len(mask), total - prompt - len(mask)) <= 0:
            return mask, searches, n, "length_limit"
        n += 1
        mask += [1] * tokens
        if kind == "answer":
            return mask, searches, n, "answer"
        if kind == "invalid":
            full = len(mask) >= response or prompt + len(mask) >= total
            return mask, searches, n, "length_limit" if full and not ended else "invalid_action"
        searches += 1
        if len(mask) + seen > response or prompt + len(mask) + seen > total:
            return mask, searches, n, "length_limit"
        mask += [0] * seen
    full = len(mask) >= response or prompt + len(mask) >= total
    return mask, searches, n, "length_limit" if n < 5 and full else "max_turns"


def test_budgets_match_a_plain_loop(spark):
    rnd, cases = random.Random(3), []
    while len(cases) < 300:
        prompt, response, total, turns, used = rnd.randint(1, 30), 40, 60, [], 0
        for _ in range(rnd.randint(0, 7)):
            left = min(response - used, total - prompt - used)
            tokens, seen = rnd.randint(0, max(0, left)), rnd.randint(0, 25)
            turns.append((rnd.choice(["search"] * 6 + ["answer", "invalid"]), tokens, seen, rnd.random() < 0.5))
            used += tokens + seen
        cases.append((turns, prompt))
    df = spark.createDataFrame([(i, [(*t, None) for t in turns], p) for i, (turns, p) in enumerate(cases)], f"i int, t array<{rollout.TURN}>, p int")
    got = df.select("i", rollout.budgeted(F.col("t"), F.col("p"), 40, 60).alias("b")).orderBy("i").collect()
    for r, (turns, prompt) in zip(got, cases):
        assert (r.b.mask, r.b.searches, r.b.turns, r.b.reason) == plain_budget(turns, prompt, 40, 60)


def test_agent_loop_stops_for_each_reason(spark):
    q = spark.createDataFrame([(1, "answer"), (2, "loop"), (3, "bad")], "question_id long, question string")

    def generate(messages, turn):
        ask = F.element_at(messages, 2)["content"]
        act = F.when(ask == "loop", "<search>x</search>").when(ask == "bad", "nothing").otherwise("<answer>ok</answer>")
        return F.concat(F.lit("<think>t</think>"), act, F.lit("<|im_end|>"))

    find = lambda asked: asked.select("question_id", F.array(F.struct(F.lit(1).alias("rank"), F.lit("T").alias("title"), F.lit("B").alias("text"))).alias("hits"))
    got = {r.question_id: r for r in rollout.run_agent(q, generate, find, "S", max_turns=2).collect()}
    assert {k: (r.termination_reason, len(r.steps)) for k, r in got.items()} == {1: ("answer", 1), 2: ("max_turns", 2), 3: ("invalid_action", 1)}
    assert got[2].messages[-1].content == "<information>[1] Title: T\nContent: B</information>"


def test_rollout_guards(spark):
    schema = "question_id long, rollout_id long, status string, reward double"
    rows = [(1, k, "ok", 1.0) for k in range(4)] + [(2, k, "ok", float(k % 2)) for k in range(4)] + [(3, 0, "error", None)]
    got = {r.question_id: (r.category, r.rewards) for r in metrics.rollout_groups(spark.createDataFrame(rows, schema), 4, spark.createDataFrame([(9,)], "question_id long")).collect()}
    assert got == {1: ("all_one", "[1.0,1.0,1.0,1.0]"), 2: ("mixed", "[0.0,1.0,0.0,1.0]"), 3: ("incomplete", "[]"), 9: ("incomplete", "[]")}
    for columns in (["*"], ["question_id"], ["record_count"]):
        with pytest.raises(Exception, match="neither 0 nor 1"):
            metrics.rollout_groups(spark.createDataFrame([(1, 0, "ok", 0.5)], schema), 4).select(*columns).collect()
        with pytest.raises(Exception, match="a rollout occurs twice: 1"):
            metrics.rollout_groups(spark.createDataFrame([(1, 0, "ok", 1.0)] * 2, schema), 4).select(*columns).collect()
    with pytest.raises(Exception, match="out of range"):
        metrics.depth_crosstab(spark.createDataFrame([("nq", 5)], "source string, search_count int")).collect()


def test_empty_groups_have_zeros(spark):
    schema = "source string, em double, f1 double, total_turns long, valid_action_count long, strict_protocol_count long, eos_count long, search_count long, termination_reason string"
    got = {r.source: r for r in metrics.agent_metrics(spark.createDataFrame([("nq", 1.0, 1.0, 2, 1, 2, 2, 1, "answer")], schema), ["nq", "hotpotqa"]).collect()}
    assert got["nq"].valid_action_rate == 0.5 and got["hotpotqa"].samples == 0 and got["hotpotqa"].answer_em == 0.0
    assert got["overall"].samples == 1


def test_skip_reasons_ignore_skipped_rows(spark):
    c = spark.createDataFrame([(1, "a", 0), (2, "p", 1), (3, "p", 2), (4, "a", 3), (1, "z", 4), (5, "z", 5)], "id long, k string, o long")
    got = isolation.skip_reasons(c, spark.createDataFrame([(9, "p")], "id long, k string"), "id", "k", [F.col("o")])
    assert [r.reason for r in got.orderBy("o").collect()] == [None, "protected_question", "protected_question", "duplicate_question", "duplicate_id", None]


def test_skip_reasons_match_a_plain_walk(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), o) for o in range(150)]
    protected, ids, keys, want = {(3, "c"), (9, "d")}, set(), set(), []
    for i, k, _ in rows:
        reason = "protected_id" if i in {p for p, _ in protected} else "protected_question" if k in {p for _, p in protected} else "duplicate_id" if i in ids else "duplicate_question" if k in keys else None
        want.append(reason)
        if reason is None:
            ids.add(i)
            keys.add(k)
    got = isolation.skip_reasons(spark.createDataFrame(rows, "id long, k string, o long"), spark.createDataFrame(list(protected), "id long, k string"), "id", "k", [F.col("o")])
    assert [r.reason for r in got.orderBy("o").collect()] == want
    chain = [(1, "a", 0), (2, "a", 1), (2, "b", 2)]  # the second is skipped, so its id isn't used
    got = isolation.skip_reasons(spark.createDataFrame(chain, "id long, k string, o long"), spark.createDataFrame([], "id long, k string"), "id", "k", [F.col("o")])
    assert [r.reason for r in got.orderBy("o").collect()] == [None, "duplicate_question", None]


RESULT = "id long, question string, source string, gold_answers array<string>, prediction string, em double, f1 double, search_count int, termination_reason string"


@pytest.mark.parametrize("columns", [["em_delta"], ["source"], ["id"]])
def test_pairs_must_agree_whatever_is_read(spark, columns):
    row = lambda i, q="q", g=("g",), s="nq": (i, q, s, list(g), "p", 1.0, 1.0, 1, "answer")
    side = lambda *rows: spark.createDataFrame(list(rows), RESULT)
    assert metrics.paired(side(row(1), row(2)), side(row(2), row(1))).select(*columns).count() == 2
    for left, right, error in (
        ([row(1), row(1)], [row(1)], "an id occurs twice: 1"),
        ([row(1)], [row(1), row(1)], "an id occurs twice: 1"),
        ([row(1), row(2)], [row(1)], "don't have the same ids: 2"),
        ([row(1)], [row(1, q="other")], "disagree on question: 1"),
        ([row(1)], [row(1, g=("g", "h"))], "disagree on gold_answers: 1"),
        ([row(1)], [row(1, s="hotpotqa")], "disagree on source: 1"),
    ):
        with pytest.raises(Exception, match=error):
            metrics.paired(side(*left), side(*right)).select(*columns).collect()
        with pytest.raises(Exception, match=error):
            metrics.contingency(metrics.paired(side(*left), side(*right))).collect()


def test_guards(spark):
    df = spark.createDataFrame([("nq", "train", 1), ("nq", "dev", 2)], "source string, split string, n int")
    assert guards.from_source(df, "nq").select("n").count() == 2
    with pytest.raises(Exception, match="source is not hotpotqa: nq"):
        guards.from_source(df, "hotpotqa").select("n").collect()
    with pytest.raises(Exception, match="training split"):
        guards.training_only(df, "split").select("n").collect()
    assert guards.require_quotas(df, {"nq": 2}).count() == 2
    for wrong in ({"nq": 1}, {"nq": 2, "hotpotqa": 1}, {}):
        with pytest.raises(ValueError, match="expected"):
            guards.require_quotas(df, wrong)
    assert guards.require_balance(df, df.where("n = 1"), df.where("n = 2"), "source").first()[1:] == (2, 1, 1)
    with pytest.raises(ValueError, match="lost"):
        guards.require_balance(df, df.limit(0), df.where("n = 2"), "source")
    with pytest.raises(ValueError, match="twice"):
        guards.require_unique(df, "source")
    with pytest.raises(ValueError, match="fewer than 3"):
        sampling.taken(df, "source", 3, F.col("n"))


def test_assembly(spark):
    turn = "array<struct<valid_action:boolean,strict_valid:boolean,ended_with_im_end:boolean>>"
    schema = f"id long, source string, question string, answers array<string>, termination_reason string, final_answer string, input_tokens_at_failure int, max_input_tokens int, search_count int, turns {turn}"
    rows = [
        (1, "nq", "q", ["An Owl"], "answer", "owl", None, None, 1, [(True, True, True), (True, False, None)]),
        (2, "nq", "q", ["owl"], "input_too_long", "owl", 9000, 8192, 0, []),
        (3, "nq", "q", ["owl"], "max_turns", None, None, None, 0, []),
        (4, "nq", "q", ["the"], "max_turns", None, None, None, 0, []),
    ]
    got = assembly.results(spark.createDataFrame(rows, schema))
    by = {r.id: r for r in got.collect()}
    assert {i: (r.em, r.f1) for i, r in by.items()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}
    assert (by[1].valid_action_count, by[1].strict_protocol_count, by[1].eos_count, by[1].total_turns) == (2, 1, 1, 2)
    assert [t.turn for t in by[1].turns] == [1, 2] and by[2].input_tokens_at_failure == 9000 and by[3].predicted_answer == ""
    after = {r.id: (r.termination_reason, r.em, r.assistant_decision_turns) for r in assembly.budget_scored(got.withColumn("budget_stop", F.col("id") == 1)).collect()}
    assert after == {1: ("length_limit", 0.0, 2), 2: ("input_too_long", 0.0, 0), 3: ("max_turns", 0.0, 0), 4: ("max_turns", 0.0, 0)}
    versions = spark.createDataFrame([([(3, 5), (2, 4)],), ([(1, None)],)], "v array<struct<min_global_steps:long,max_global_steps:long>>")
    assert tuple(versions.where("size(v) = 2").select(assembly.version_range(F.col("v")).alias("r")).first().r) == (2, 5)
    with pytest.raises(Exception, match="lacks its versions"):
        versions.select(assembly.version_range(F.col("v"))).collect()


def test_strict_turns_and_steps(spark):
    df = spark.createDataFrame([([("<think>a</think>", None)], [])], "t array<struct<content:string,reasoning_content:string>>, s array<struct<type:string,content:string,observation:string>>")
    with pytest.raises(Exception, match="differ in number"):
        df.select(trajectory.extract_events(F.col("t"), F.col("s"))).collect()
    bare = spark.createDataFrame([([("x", "r")], [("search", "s", "no tags")])], df.schema)
    with pytest.raises(Exception, match="information tags"):
        bare.select(trajectory.extract_events(F.col("t"), F.col("s"))).collect()


def test_case_folding_is_python_s(spark):
    rnd = random.Random(2)
    texts = ["Straße", "STRASSE", "ẞ", "ﬁn", "FIN", "İı", "Ii", "ΣΑΣ σας", "ſ", "ϴθ", "µμ", "ŉ", "Å", "ǰ", "ᾳ"] + ["".join(rnd.choice("ßẞsSıIiİσςΣſﬁﬀµμϴθΩΩKk") for _ in range(6)) for _ in range(300)]
    assert column(spark, texts, tx.casefold) == [t.casefold() for t in texts]
    assert column(spark, ["Maße", "STRASSE ẞ", "x"], lambda c: tx.casefold(F.upper(c))) == ["masse", "strasse ss", "x"]


def test_prefix_errors(spark):
    want = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "ordinal long, v string")
    got = spark.createDataFrame([(0, "v0"), (1, "x"), (3, "v3"), (3, "v3"), (9, "v9")], "ordinal long, v string")
    assert {r.ordinal: r.error for r in resume.prefix_errors(got, want, ["v"]).collect()} == {1: "different", 2: "missing", 3: "twice", 4: "missing", 9: "unknown"}
    assert resume.prefix_errors(want.where("ordinal < 3"), want, ["v"]).isEmpty() and resume.prefix_errors(want.limit(0), want, ["v"]).isEmpty()


def test_index_is_saved_checked_and_opened(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i}") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word3"), (2, "common common"), (3, "nothing here")], "item_id long, text string")
    index = retrieval.build_index(docs)
    want = [tuple(r) for r in retrieval.search(index, asked).orderBy("item_id", "rank").collect()]
    assert [r[0] for r in want] == [1, 1, 1, 2, 2, 2]
    retrieval.save_index(index, str(tmp_path / "index"))
    assert [tuple(r) for r in retrieval.search(retrieval.open_index(spark, str(tmp_path / "index")), asked).orderBy("item_id", "rank").collect()] == want
    parts = retrieval.build_index(docs, part=5)  # common terms in several parts
    assert parts.corpus.first().parts == 13 and [tuple(r) for r in retrieval.search(parts, asked).orderBy("item_id", "rank").collect()] == want
    with pytest.raises(FileNotFoundError):
        retrieval.open_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        retrieval.search(index, asked, k=0)
    with pytest.raises(Exception, match="a query is blank"):
        retrieval.search(index, spark.createDataFrame([(1, " \t")], "item_id long, text string")).collect()


def test_an_index_is_written_once_a_row_for_each_term_and_block(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common " * (1 + i % 90) + f"only{i} Only{i}") for i in range(200)] + [(200, "")], "doc_id long, text string").coalesce(1)
    with session.recorded() as made:
        index = retrieval.build_index(docs, path=str(tmp_path / "index"))
    assert made == [] and sorted(p.name for p in (tmp_path / "index").iterdir()) == sorted(retrieval.INDEX_TABLES)
    again = retrieval.open_index(spark, str(tmp_path / "index"))
    assert again.packed.count() == 201 and [r.n for r in again.packed.where("term = 'common'").collect()] == [200]
    assert again.total == index.total and again.total.n == 201
    bands = {r.band: (r.n, r.tf, r.dl) for r in again.banded.where("term = 'common'").collect()}
    tfs = [1 + i % 90 for i in range(200)]
    want = {}
    for tf in tfs:
        want.setdefault(math.floor(2 * math.log2(tf + 2)), []).append(tf)
    assert bands == {b: (len(x), max(x), min(x) + 2) for b, x in want.items()} and len(bands) > 5
    asked = spark.createDataFrame([(1, "only7 common"), (2, "common")], "item_id long, text string")
    hits = [[tuple(r) for r in retrieval.search(i, asked).orderBy("item_id", "rank").collect()] for i in (index, again, retrieval.build_index(docs))]
    assert hits[0][0][2] == 7 and len(hits[0]) == 6 and hits[0] == hits[1] == hits[2]
    with pytest.raises(Exception, match="exist"):
        retrieval.build_index(docs, path=str(tmp_path / "index"))


def test_corpus_and_search_tool(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "contents": "\\"Nile\\"\\nlongest river of Africa"}\n{"id": "b", "contents": "Rhine\\na river"}\n')
    docs = retrieval.read_corpus(spark, str(tmp_path / "c.jsonl"))
    find = retrieval.search_tool(retrieval.build_index(docs), docs, k=1, most=9)
    got = find(spark.createDataFrame([(1, "longest river")], "question_id long, query string")).first()
    assert [tuple(h) for h in got.hits] == [(1, "Nile", "longest r")]
    with pytest.raises(ValueError):
        retrieval.search_tool(None, docs, most=0)
    (tmp_path / "d.jsonl").write_text('{"id": "a"}\n')
    with pytest.raises(Exception, match="lacks its id or contents"):
        retrieval.read_corpus(spark, str(tmp_path / "d.jsonl")).collect()
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError, match="empty"):
        retrieval.read_corpus(spark, str(tmp_path / "e.jsonl"))


def test_agent_loop_keeps_steps_and_captures_errors(spark):
    q = spark.createDataFrame([(1, "grows"), (2, "fails"), (3, "long question " * 20), (4, "fine")], "question_id long, question string")

    def generate(messages, turn):
        ask = F.element_at(messages, 2)["content"]
        act = F.when(ask == "grows", "<search>more</search>").otherwise("<answer>ok</answer>")
        raw = F.when((ask != "fails"), F.concat(F.lit("<think>t</think>"), act, F.lit("<|im_end|>")))
        return F.struct(raw.alias("raw"), F.lit(7).alias("input_tokens"), F.lit(5).alias("generated_tokens"), raw.isNotNull().alias("ended"), F.lit(False).alias("reached_max"), F.when(ask == "fails", "server gone").alias("error"))

    find = lambda asked: asked.select("question_id", F.array(F.struct(F.lit(1).alias("rank"), F.lit("T").alias("title"), F.lit("B" * 40).alias("text"))).alias("hits"))
    tokens = lambda messages: F.aggregate(messages, F.lit(0), lambda n, m: n + F.length(m["content"]))
    got = {r.question_id: r for r in rollout.run_agent(q, generate, find, "S", count_tokens=tokens, max_input_tokens=150).collect()}
    assert {k: (r.termination_reason, len(r.steps)) for k, r in got.items()} == {1: ("input_too_long", 2), 2: ("runtime_error", 0), 3: ("input_too_long", 0), 4: ("answer", 1)}
    assert got[1].input_tokens_at_failure > 150 and got[4].input_tokens_at_failure is None
    step = got[4].steps[0]
    assert (step.input_tokens, step.generated_tokens, step.ended_with_im_end, step.strict_valid) == (7, 5, True, True)


def test_visible_loop_and_named_loops(spark):
    q = spark.createDataFrame([(1, "x")], "question_id long, question string")
    find = lambda asked: asked.select("question_id", F.array().cast("array<struct<rank:int,title:string,text:string>>").alias("hits"))
    generate = lambda messages, turn: F.lit("I think <search>a</search>" if turn < 2 else "so <answer> b </answer>")
    r = rollout.loop_named("search_agent")(q, generate, find, "S", strict=False).first()
    assert (r.termination_reason, [s.type for s in r.steps]) == ("answer", ["search", "answer"])
    assert r.messages[2].content == "I think <search>a</search>"
    with pytest.raises(ValueError, match="no loop"):
        rollout.loop_named("other")


def test_trainer_tables_and_order(spark):
    df = spark.createDataFrame([(i, "train" if i % 3 else "validation") for i in range(30)], "id long, split string")
    a, b = sampling.train_validation(df, 5, 3)
    assert [len({r.id for r in x.collect()}) for x in (a, b)] == [5, 3] and {r.split for r in a.collect()} == {"train"}
    assert a.collect() == sampling.train_validation(df.repartition(7), 5, 3)[0].collect()
    assert [r.id for r in sampling.in_order(df.repartition(5), "id").collect()] == list(range(30))


def test_splits_outputs_and_digests(spark, tmp_path):
    for name in ("train", "dev"):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"id": "{name}"}}\n\n')
    got = io.read_splits(spark, {n: str(tmp_path / f"{n}.jsonl") for n in ("train", "dev")}, "id string")
    assert {(r.id, r.source_split) for r in got.collect()} == {("train", "train"), ("dev", "dev")}
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        io.open_output(spark, out, resume=True)
    io.open_output(spark, out, resume=False)
    io.append(got, out)
    io.open_output(spark, out, resume=True)
    with pytest.raises(FileExistsError):
        io.open_output(spark, out, resume=False)
    (tmp_path / "big").write_bytes(b"x" * 3_000_000)
    assert io.file_digests(spark, str(tmp_path / "big")).first().sha256 == hashlib.sha256(b"x" * 3_000_000).hexdigest()
    with pytest.raises(ValueError, match="more than 5 rows"):
        io.write_report(spark.range(6), str(tmp_path / "r"), "T", most=5)
    io.write_messages(spark.createDataFrame([([("user", "ä")],)], "messages array<struct<role:string,content:string>>"), str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0])["messages"][0]["content"] == "ä"


def test_resume(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "uid long")
    assert [r.uid for r in resume.remaining(ids(1, 2, 3, 4), ids(1), ids(3)).orderBy("uid").collect()] == [2, 4]
    with pytest.raises(ValueError, match="completed and skipped"):
        resume.remaining(ids(1), ids(1), ids(1))
    with pytest.raises(ValueError, match="twice"):
        resume.completed_ids(ids(1, 1))


def test_cleaning(spark):
    raw = spark.createDataFrame([("1", " Who  is\tit ", ["A b", "a  B", "Maße", "C", "MASSE"]), ("2", " ", ["x"]), ("3", "q", []), ("4", "q", ["a", " "]), ("5", "q", ["a", None])], "id string, question string, golden_answers array<string>")
    good, bad = qa.quarantine(raw, qa.row_error(F.col("question"), F.col("golden_answers")))
    row = qa.canonical(good, "nq", "id", "train").first()
    assert (row.uid, row.question, row.gold_answers) == ("nq_1", "Who is it", ["A b", "Maße", "C"])
    assert {r.id: r.error for r in bad.collect()} == {"2": "blank question", "3": "no answers", "4": "blank answers", "5": "blank answers"}
    with pytest.raises(Exception, match="blank question|no answers|blank answers"):
        qa.strictly(raw, qa.row_error(F.col("question"), F.col("golden_answers"))).select("id").collect()
    assert spark.range(1).select(qa.row_error(F.lit("q"), F.array(F.lit("a")), F.lit(" "))).first()[0] == "blank id"
    meta = "m struct<type:string,level:string,supporting_facts:struct<title:array<string>>>"
    rows = [(("bridge ", "hard", (["A", "a ", "B"],)),), ((" ", "hard", (["A"],)),), (("x", None, (["A"],)),), (("x", "y", ([],)),), (("x", "y", (["A", " "],)),), (None,)]
    df = spark.createDataFrame(rows, meta)
    assert [r[0] for r in df.select(qa.metadata_error(F.col("m"))).collect()] == [None, "blank type", "blank level", "no titles", "blank titles", "no metadata"]
    assert tuple(df.limit(1).select(*[c.alias(n) for n, c in qa.multi_hop_metadata(F.col("m")).items()]).first()) == ("bridge", "hard", ["A", "B"])
    q = spark.createDataFrame([("nq_train_1", "nq"), ("nq_dev_1", "nq"), ("hotpotqa_train_1", "nq"), ("hotpotqa_train_1", "hotpotqa")], "id string, source string")
    assert qa.training_prefix(q).count() == 2
    asked = spark.createDataFrame([("1", None, [("user", "a"), ("user", "b")]), ("2", "c", None)], "id string, question string, prompt array<struct<role:string,content:string>>")
    asked = asked.withColumn("extra_info", F.struct("id"))
    assert {tuple(r) for r in qa.training_questions(asked).collect()} == {("1", "b"), ("2", "c")}
    with pytest.raises(ValueError, match="missing"):
        qa.require_columns(raw, ["nothing"])


def test_quotas_sum_and_exact_orders(spark):
    df = spark.createDataFrame([(s,) for s, n in (("a", 7), ("b", 5), ("c", 1)) for _ in range(n)], "s string")
    assert sum(r.quota for r in sampling.quotas(df, "s", 10).collect()) == 10
    ids = {"b": ["2", "1", "3"], "a": ["9", "8"]}
    assert sampling.exact_random_ranks(ids, 123, False) != {} and sampling.exact_random_ranks(ids, 123, True) == sampling.exact_random_ranks(ids, 123, True)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "ä"), (1, "b", None)], "ordinal long, id string, t string")
    io.write_jsonl(df, str(tmp_path / "j"))
    back = io.read_eval(spark, str(tmp_path / "j"), df.schema)
    assert isolation.differences(df, back).isEmpty()
    assert io.table_digest(df).first() == io.table_digest(back).first()
    assert io.read_eval(spark, str(tmp_path / "j"), df.schema, 1).count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_jsonl(df, str(tmp_path / "j"))
    io.append(df.limit(1), str(tmp_path / "j"))
    with pytest.raises(ValueError, match="twice"):
        io.read_eval(spark, str(tmp_path / "j"), df.schema)
    io.write_ids(df, str(tmp_path / "ids"), "id")
    assert io.read_ids(spark, str(tmp_path / "ids"), "id").count() == 2
    io.write_csv(df, str(tmp_path / "c"))
    io.write_parquet(df, str(tmp_path / "p"))
    io.write_report(df, str(tmp_path / "r"), "T")
    assert (tmp_path / "r" / "report.md").read_text().startswith("# T")
    assert io.file_digests(spark, str(tmp_path / "r" / "report.json")).count() == 1
    (tmp_path / "bad.json").write_text("{no")
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "bad.json"), df.schema).collect()


def test_entry_has_names_without_the_training_data_operators():
    import __spark_entry__ as entry

    assert len(entry.queries()) >= 40 and set(entry.oracle_sql()) <= set(entry.queries())


def test_terminations_of_a_stream(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T0{h}:10:00Z", "termination_reason": r} for h, r in ((1, "answer"), (1, "answer"), (1, "max_turns"), (2, "answer"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    counts = rollouts.termination_counts(rollouts.read_rollouts(spark, str(tmp_path / "in"), "ts timestamp, termination_reason string"))
    run = counts.writeStream.format("memory").queryName("terminations").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.window.start.hour, r.termination_reason): r.n for r in spark.table("terminations").collect()}
    assert got == {(1, "answer"): 2, (1, "max_turns"): 1, (2, "answer"): 1}


# texts over all code points, file order, samples, components, pruned search


def every_character():
    return [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]


def test_articles_stand_between_python_s_word_boundaries(spark):
    texts = [f"x{c}a {c}an the{c}b" for c in every_character()] + ["a² end", "thé end", "a٣", "an_", "_the"]
    got = column(spark, texts, tx.normalize_answer)
    wrong = [t for t, g in zip(texts, got) if g != plain_answer(t)]
    assert all(unicodedata.category(t[1].lower()) == "Cn" or unicodedata.category(t[1]) == "Cn" for t in wrong) and len(wrong) < 60  # newer than Python's tables


def test_case_folding_of_every_character_is_python_s(spark):
    texts = every_character()
    got = column(spark, texts, tx.casefold)
    wrong = [t for t, g in zip(texts, got) if g != t.casefold()]
    assert len(wrong) < 40 and all(unicodedata.category(t) == "Cn" for t in wrong)  # newer than Python's tables
    assert column(spark, [["ı", "￿", "I￿ẞ", "i￿ß"]], qa.clean_list, "v array<string>") == [["ı", "￿", "I￿ẞ"]]


def test_figures_of_a_comparison_include_counts(spark):
    schema = "source string, em double, f1 double, total_turns long, valid_action_count long, strict_protocol_count long, eos_count long, search_count long, termination_reason string"
    row = ("nq", 1.0, 1.0, 2, 1, 2, 2, 1)
    left = metrics.agent_metrics(spark.createDataFrame([(*row, "answer")], schema), ["nq"])
    right = metrics.agent_metrics(spark.createDataFrame([(*row, "answer"), (*row, "input_too_long")], schema), ["nq"])
    got = {r.metric: r.delta for r in metrics.metric_deltas(left, right).where("source = 'nq'").collect()}
    assert len(got) == 11 and got["samples"] == 1.0 and got["input_too_long_count"] == 1.0 and got["input_too_long_rate"] == 0.5


def test_lines_keep_their_order_over_many_splits(spark, tmp_path):
    rnd = random.Random(2)
    rows, folder = [], tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b", "c"):
        with open(folder / f"{name}.jsonl", "w") as f:
            for _ in range(rnd.randint(200, 900)):
                f.write(json.dumps({"id": f"q{len(rows)}", "t": "x" * rnd.randint(0, 60)}) + "\n" + "\n \t\n" * rnd.randint(0, 1))
                rows.append(f"q{len(rows)}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = io.read_jsonl(spark, str(folder), "id string, t string", ordinal=True)
        plan = df._jdf.queryExecution().toString()
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 30 and "SinglePartition" in plan  # the window over the splits' counts
        assert [r.id for r in df.orderBy("ordinal").collect()] == rows and [r.ordinal for r in df.orderBy("ordinal").collect()] == list(range(len(rows)))
        some = io.read_eval(spark, str(folder), "id string, t string", 300)
        assert [r.id for r in some.orderBy("ordinal").collect()] == rows[:300]
        first = qa.without_excluded(qa.first_rows(df, 250), "id", ["q3", "q249", "q250"])
        assert [r.id for r in first.orderBy("ordinal").collect()] == [q for q in rows[:250] if q not in ("q3", "q249")]
        with pytest.raises(ValueError):
            io.read_eval(spark, str(folder), "id string", 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def sampled(spark, sizes):
    rows = [(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "s string, id string").repartition(5)


def test_cuts_give_the_rows_of_the_whole_order(spark):
    rows, df = sampled(spark, {"a": 6000, "b": 2500, "c": 30, None: 2200})
    md5 = lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest()
    order = {s: sorted((r[1] for r in rows if r[0] == s), key=lambda i: (md5(i), i)) for s in ("a", "b", "c", None)}
    got = sampling.seeded_first(df, "s", "id", 2000, 7, slack=20)
    assert {(r.s, r.id, r["rank"]) for r in got.collect()} == {(s, i, k) for s, ids in order.items() for k, i in enumerate(ids[:2000], 1)}
    shares = spark.createDataFrame([("a", 1500), ("b", 0), ("c", 50), (None, 7)], "s string, n long")
    got = sampling.seeded_first(df, "s", "id", shares, 7, slack=5)
    assert {(r.s, r.id) for r in got.collect()} == {(s, i) for s, n in (("a", 1500), ("c", 50), (None, 7)) for i in order[s][:n]}
    assert got.columns == ["s", "id", "rank"]
    windows = [x for x in sampling.seeded_first(df, "s", "id", 2000, 7)._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x and "_cut" in x]
    assert windows  # rows are cut before the window
    firsts = {(r.s, r.id) for r in sampling.first_of_groups(df, "s", 1500, F.col("id")).collect()}
    assert firsts == {(s, i) for s, ids in order.items() for i in sorted(ids)[:1500]}
    assert sampling.seeded_first(df.limit(0), "s", "id", 2000, 7).count() == 0


def test_samples_are_those_of_python_s_generator(spark):
    rows, df = sampled(spark, {"nq": 5000, "hotpotqa": 3000, "other": 10})
    rng, want = random.Random(123), set()
    for s, n in (("nq", 400), ("hotpotqa", 3)):
        want.update(rng.sample(sorted(i for t, i in rows if t == s), n))
    assert {r.id for r in sampling.exact_sample(df, "s", "id", {"nq": 400, "hotpotqa": 3}).collect()} == want
    with pytest.raises(ValueError, match="fewer than 11"):
        sampling.exact_sample(df, "s", "id", {"other": 11})


def test_round_robin_needs_rows_and_sources(spark):
    _, df = sampled(spark, {"a": 4, "b": 2})
    got = sampling.round_robin(df, "s", "id", 6, sources=2).orderBy("position").collect()
    assert [r.s for r in got] == ["a", "b", "a", "b", "a", "a"]
    with pytest.raises(ValueError, match="fewer than 7"):
        sampling.round_robin(df, "s", "id", 7)
    with pytest.raises(ValueError, match="expected 2 sources, found 1"):
        sampling.round_robin(df.where("s = 'a'"), "s", "id", 1, sources=2)
    with pytest.raises(ValueError, match="twice"):
        sampling.round_robin(df.union(df), "s", "id", 2)


@pytest.mark.parametrize("walk", [50, 100_000])
def test_long_chains_are_walked_in_few_rounds(spark, walk, monkeypatch):
    n = 2000 if walk > 50 else 40
    chain = [(k // 2 + k % 2, k // 2, k) for k in range(n)]  # each row shares its id or its key with the one before
    hot = [(10_000 + k, 777_777, n + k) for k in range(300)]
    rows = chain + hot + [(None, None, 5000), (None, 1, 5001), (3, None, 5002)]
    ids, keys, want = set(), set(), []
    for i, k, _ in rows:
        reason = "duplicate_id" if i in ids else "duplicate_question" if k in keys else None
        want.append(reason)
        if reason is None:
            ids.add(i)
            keys.add(k)
    written = []
    keep = isolation.cut
    monkeypatch.setattr(isolation, "cut", lambda *a: (written.append(1), keep(*a))[1])
    df = spark.createDataFrame(rows, "id long, k long, o long").repartition(7)
    got = isolation.skip_reasons(df, spark.createDataFrame([], "id long, k long"), "id", "k", [F.col("o")], walk=walk)
    assert [r.reason for r in got.orderBy("o").collect()] == want
    assert walk == 50 or len(written) == 4


def test_components_are_least_nodes(spark):
    from questlake.operators.components import components

    rnd = random.Random(6)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(300)] + [(2000, 2001 + k) for k in range(300)] + [(5000, 5000)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def plain_bm25(docs, queries, k, k1=0.9, b=0.4):
    import math

    cut_words = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    tf = {i: collections.Counter(cut_words(t)) for i, t in docs}
    avg = sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = collections.Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries:
        scores = {}
        for i, c in tf.items():
            s = sum(n * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + k1 * (1 - b + b * sum(c.values()) / avg)) for w, n in collections.Counter(cut_words(text)).items() if w in c)
            if s:
                scores[i] = round(s, 6)
        out += [(q, r, i) for r, (s, i) in enumerate(sorted((-s, i) for i, s in scores.items())[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("part, rare, seeds, skipped", [(1 << 18, 400, 24, 0.75), (50, 5, 1, 1.0), (1 << 18, 10, 3, 0.3), (64, 1000, 100, 0.0)])
def test_pruned_search_is_exact(spark, part, rare, seeds, skipped):
    rnd = random.Random(part + rare)
    words = [f"w{int(300 * rnd.random() ** 3)}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80)))) for i in range(400)] + [(1000 + i, "w0 w1 w0") for i in range(60)] + [(2000, ""), (2001, None)]
    queries = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))) for q in range(25)] + [(100, "w0"), (101, "w0 w1"), (102, "zzz"), (103, docs[5][1])]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc_id long, text string"), part=part)
    got = retrieval.search(index, spark.createDataFrame(queries, "item_id long, text string"), 3, rare=rare, seeds=seeds, skipped=skipped)
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got.collect()) == plain_bm25([(i, t or "") for i, t in docs], queries, 3)


def test_a_stop_word_reads_no_more_postings(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(["the"] * rnd.randint(0, 3) + [f"w{int(2000 * rnd.random() ** 2)}" for _ in range(40)])) for i in range(1500)]
    index = retrieval.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = [(q, " ".join(rnd.sample(docs[q][1].split()[5:], 8))) for q in range(20)]

    def read(queries):
        weights = retrieval.cut(retrieval.query_weights(index, spark.createDataFrame(queries, "item_id long, text string")))
        lists = retrieval.cut(retrieval.planned_lists(index, weights, retrieval.floors(index, weights, 3)))
        kept = lists.where("NOT skip").join(index.lists, ["term", "band"])
        return kept.agg(F.sum("df").alias("n")).first().n, retrieval.candidates(index, lists).count(), kept.where("term = 'the'").count()

    (rows, pairs, _), (more, as_many, the) = read(asked), read([(q, t + " the") for q, t in asked])
    assert the == 0 and more <= rows * 1.05 and as_many <= pairs * 1.2 + 20
    assert pairs < 20 * 1500 / 10


def test_an_analyzer_of_one_s_own(spark, tmp_path):
    letters = lambda c: F.filter(F.split(F.lower(c), ""), lambda t: t != "")
    index = retrieval.build_index(spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string"), analyzer=letters)
    retrieval.save_index(index, str(tmp_path / "i"))
    again = retrieval.open_index(spark, str(tmp_path / "i"), letters)
    assert [r.doc_id for r in retrieval.search(again, spark.createDataFrame([(1, "z")], "item_id long, text string")).collect()] == [2]


def test_white_space_is_no_content(spark, tmp_path):
    kept, skipped = assembly.without_empty(spark.createDataFrame([(1, "\n"), (2, " x\n"), (3, None), (4, "　")], "uid long, content string"))
    assert [r.uid for r in kept.collect()] == [2] and {r.uid for r in skipped.collect()} == {1, 3, 4}
    (tmp_path / "ids.txt").write_text("a\t\n \n\x0bb\n")
    assert {r.uid for r in io.read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_search_reads_the_whole_index_once(spark, monkeypatch, kind):
    """What a search reads doesn't have a row for each posting, and only the lists of the queries' terms are read again."""
    docs = spark.createDataFrame([(i, f"common w{i % 3} W{i % 3} only{i}") for i in range(300)] + [(300, ""), (301, None)], "doc_id long, text string")
    index = retrieval.build_index(docs.select(F.col("doc_id").cast(kind), "text"))
    assert index.packed.where("term = 'common'").count() < 30 and index.packed.where("n > 1").count() > 0
    got = {(str(r.doc_id), r.term) for r in index.postings.collect()}
    assert got == {(str(i), t) for i in range(300) for t in ("common", f"w{i % 3}", f"only{i}")}
    assert {r.term: r.df for r in index.stats.collect()}["common"] == 300 and index.total.n == 302
    top = {(r.term, r.band): r.top for r in index.lists.collect()}
    assert all(r.impact <= top[r.term, r.band] for r in index.postings.collect())
    made, cut = {}, retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, name="rows": made.setdefault(name, cut(df, name)))
    hits = retrieval.search(index, spark.createDataFrame([(1, "w1 only7 nothing")], "item_id long, text string")).orderBy("rank").collect()
    assert [str(r.doc_id) for r in hits] == (["7", "1", "4"] if kind == "long" else ["7", "1", "10"])
    assert {r.term for r in made["lists"].collect()} == {"w1", "only7"}
