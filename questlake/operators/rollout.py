"""The agent loop over whole batches: each turn is one pass over all running questions.

The model is a column function or pandas UDF from messages to text (and token counts); retrieval is the batch BM25 join. Turns are
bounded, and each one's state is written to the shared folder, so lineage stays short and a lost executor costs one turn.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from questlake.functions.text import observation, strip
from questlake.operators.protocol import assistant_message, parse_action, parse_raw
from questlake.operators.trajectory import MESSAGES
from questlake.session import cut

MAX_TURNS = 5
STEP = "struct<model_output:string,type:string,content:string,observation:string,input_tokens:int,generated_tokens:int,ended_with_im_end:boolean,reached_max:boolean,valid_action:boolean,strict_valid:boolean>"
# Fixed budgets.
PROMPT, RESPONSE, TOTAL, NEW = 2048, 6144, 8192, 512


#: What a model may give instead of a text: token counts, its last token's kind, and an error for a generation that failed.
GENERATION = "struct<raw:string,input_tokens:int,generated_tokens:int,ended:boolean,reached_max:boolean,error:string>"

LOOPS: dict[str, Callable[..., DataFrame]] = {}


def registered(name: str):
    """Make a loop known by name, as configurations ask for it."""

    def add(loop: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOOPS[name] = loop
        return loop

    return add


def loop_named(name: str) -> Callable[..., DataFrame]:
    if name not in LOOPS:
        raise ValueError(f"no loop is called {name}; known: {sorted(LOOPS)}")
    return LOOPS[name]


def as_generation(made: Column, kind: DataType) -> Column:
    """A text as a generation whose end token is its own text."""
    if not isinstance(kind, StringType):
        return made
    none = lambda t: F.lit(None).cast(t)
    return F.struct(made.alias("raw"), none("int").alias("input_tokens"), none("int").alias("generated_tokens"), F.endswith(made, F.lit("<|im_end|>")).alias("ended"), F.lit(False).alias("reached_max"), none("string").alias("error"))


_MODELS: dict[str, Callable[[list[str]], list[str]]] = {}


def loaded_model(name: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[list[str]], list[str]]:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def model_function(load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 64) -> Callable[[Column, int], Column]:
    """``generate`` of a model that is loaded once a worker process and asked for ``batch`` histories (messages as JSON) at a time. A batch
    that fails is asked for one by one; a history that fails alone gives an error for its own question."""
    name = uuid.uuid4().hex

    def made(histories: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from questlake.operators.rollout import loaded_model  # the worker's own module, which outlives a task

        model = loaded_model(name, load)

        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return model([text])[0], None
            except Exception as e:  # kept with its question
                return None, f"{type(e).__name__}: {e}"

        for texts in histories:
            out = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch].tolist()
                try:
                    said = model(part)
                    if len(said) != len(part):
                        raise ValueError("a model gave another number of texts")
                    out += [(x, None) for x in said]
                except Exception:
                    out += [one(x) for x in part]
            yield pd.DataFrame(out, columns=["raw", "error"])

    udf = F.pandas_udf(made, "raw string, error string")

    def generate(messages: Column, turn: int) -> Column:
        none = lambda t: F.lit(None).cast(t)
        said = F.struct(udf(F.to_json(messages)).alias("m"))["m"]
        return F.struct(said["raw"].alias("raw"), none("int").alias("input_tokens"), none("int").alias("generated_tokens"), F.endswith(said["raw"], F.lit("<|im_end|>")).alias("ended"), F.lit(False).alias("reached_max"), said["error"].alias("error"))

    return generate


@registered("search_agent")
def run_agent(questions: DataFrame, generate: Callable[[Column, int], Column], search: Callable[[DataFrame], DataFrame], system_prompt: str, strict: bool = True, max_turns: int = MAX_TURNS, count_tokens: Callable[[Column], Column] | None = None, max_input_tokens: int = TOTAL) -> DataFrame:
    """``questions`` (question_id, question) with messages, steps, termination_reason and input_tokens_at_failure.

    ``generate`` maps messages and the turn number to text, or to a GENERATION. ``search`` maps (question_id, query) to
    (question_id, hits), hits being an array of rank, title, text. With ``strict`` a turn must follow the raw protocol, end token
    included; an invalid turn ends the loop. With ``count_tokens`` a history beyond ``max_input_tokens`` ends it as input_too_long before
    the turn, the steps so far kept. A generation with an error ends its own question as runtime_error, not the batch.
    """
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))
    state = questions.select(
        "question_id",
        "question",
        F.array(message("system", F.lit(system_prompt)), message("user", F.col("question"))).cast(MESSAGES).alias("messages"),
        F.array().cast(f"array<{STEP}>").alias("steps"),
        F.lit(None).cast("string").alias("termination_reason"),
        F.lit(None).cast("int").alias("input_tokens_at_failure"),
    )
    finished = []
    for turn in range(1, max_turns + 1):
        if count_tokens is not None:
            state = state.withColumn("input_tokens", count_tokens(F.col("messages")).cast("int"))
            long = F.col("input_tokens") > max_input_tokens
            state = cut(state, "history")
            finished.append(state.where(long).withColumns({"termination_reason": F.lit("input_too_long"), "input_tokens_at_failure": F.col("input_tokens")}).drop("input_tokens"))
            state = state.where(~long).drop("input_tokens")
        made = state.withColumn("made", generate(F.col("messages"), turn))
        made = made.withColumn("g", as_generation(F.col("made"), made.schema["made"].dataType).cast(GENERATION)).drop("made")
        parsed = cut(made, "generated")  # the model runs once a turn
        parsed = parsed.withColumn("p", parse_raw(F.col("g.raw"), F.col("g.ended")) if strict else parse_action(F.col("g.raw")))
        kind = F.when(F.col("g.error").isNotNull(), "error").otherwise(F.col("p.type"))
        parsed = parsed.withColumn("kind", kind)
        asked = parsed.where("kind = 'search'").select("question_id", F.col("p.content").alias("query"))
        seen = parsed.join(search(asked), "question_id", "left")
        looked = F.when(F.col("kind") == "search", observation(F.coalesce("hits", F.array().cast("array<struct<rank:int,title:string,text:string>>")))).otherwise("")
        seen = seen.withColumn("observation", looked)
        spoken = F.col("kind").isin("search", "answer")
        said = F.when(spoken, F.array(assistant_message(F.col("p")) if strict else message("assistant", F.col("g.raw"))).cast(MESSAGES)).otherwise(F.array().cast(MESSAGES))
        told = F.when(F.col("kind") == "search", F.array(message("user", strip(F.col("observation")))).cast(MESSAGES)).otherwise(F.array().cast(MESSAGES))
        flags = {"valid_action": F.col("p.valid_action"), "strict_valid": F.col("p.strict_valid")} if strict else {"valid_action": F.col("kind") != "invalid", "strict_valid": F.lit(None).cast("boolean")}
        step = F.struct(F.col("g.raw").alias("model_output"), F.col("p.type").alias("type"), F.col("p.content").alias("content"), F.col("observation"), F.col("g.input_tokens"), F.col("g.generated_tokens"), F.col("g.ended").alias("ended_with_im_end"), F.col("g.reached_max"), *[c.alias(n) for n, c in flags.items()])
        reason = F.when(F.col("kind") == "answer", "answer").when(F.col("kind") == "invalid", "invalid_action").when(F.col("kind") == "error", "runtime_error").when(F.lit(turn == max_turns), "max_turns")
        steps = F.when(F.col("kind") == "error", F.col("steps")).otherwise(F.concat("steps", F.array(step.cast(STEP))))
        moved = cut(seen.select("question_id", "question", F.concat("messages", said, told).alias("messages"), steps.alias("steps"), reason.alias("termination_reason"), "input_tokens_at_failure"), "turn")
        finished.append(moved.where("termination_reason IS NOT NULL"))
        state = moved.where("termination_reason IS NULL")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished) if finished else state.limit(0)


def remaining(initial: Column, now: Column) -> Column:
    """Tokens that may still be made; at most zero means the budget is used up."""
    return F.least(F.lit(RESPONSE) - (now - initial), F.lit(TOTAL) - now)


def next_budget(initial: Column, now: Column) -> Column:
    """struct(status, max_new_tokens): input_too_long for long prompts, length_limit when nothing remains, else ok."""
    left = remaining(initial, now)
    status = F.when((now == initial) & (initial > PROMPT), "input_too_long").when(left <= 0, "length_limit").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", F.least(F.lit(NEW), left)).otherwise(0).alias("max_new_tokens"))


TURN = "struct<kind:string,tokens:int,observation_tokens:int,ended:boolean,log_probs:array<double>>"


def budgeted(turns: Column, prompt_tokens: Column, response: int = RESPONSE, total: int = TOTAL, prompt: int = PROMPT, max_turns: int = MAX_TURNS) -> Column:
    """A fold over turns (TURN) under both budgets and the limit of turns.

    Gives struct(mask, log_probs, n, turns, searches, strict_valid, reason): the mask has 1 for model tokens and 0 for observations, whose
    log-probabilities are 0. An observation that doesn't fit as a whole is left out and ends the rollout with length_limit; an invalid
    turn is length_limit only if the budget is used up and the end token is missing. Errors: a prompt beyond its budget, a turn of more
    tokens than were asked for, a turn whose log-probabilities don't match its tokens.
    """
    kind = "struct<mask:array<int>,log_probs:array<double>,turns:int,searches:int,strict_valid:boolean,reason:string>"
    start = F.struct(F.array().cast("array<int>").alias("mask"), F.array().cast("array<double>").alias("log_probs"), F.lit(0).alias("turns"), F.lit(0).alias("searches"), F.lit(True).alias("strict_valid"), F.lit(None).cast("string").alias("reason"))
    fail = lambda text: F.raise_error(F.lit(text)).cast(kind)

    def step(s: Column, t: Column) -> Column:
        used = F.size(s["mask"])
        left = F.least(F.lit(response) - used, F.lit(total) - prompt_tokens - used)
        asked = F.least(F.lit(NEW), left)
        zeros = F.array_repeat(F.lit(0), t["observation_tokens"])
        mask = F.concat(s["mask"], F.array_repeat(F.lit(1), t["tokens"]))
        probs = F.concat(s["log_probs"], F.coalesce(t["log_probs"], F.array_repeat(F.lit(0.0), t["tokens"])))
        full = (F.size(mask) >= response) | (prompt_tokens + F.size(mask) >= total)
        after = F.size(mask) + t["observation_tokens"]
        over = (after > response) | (prompt_tokens + after > total)
        search = t["kind"] == "search"
        reason = F.when(t["kind"] == "answer", "answer").when(t["kind"] == "invalid", F.when(full & ~t["ended"], "length_limit").otherwise("invalid_action")).when(search & over, "length_limit")
        seen = search & ~over
        moved = F.struct(
            F.when(seen, F.concat(mask, zeros)).otherwise(mask).alias("mask"),
            F.when(seen, F.concat(probs, zeros.cast("array<double>"))).otherwise(probs).alias("log_probs"),
            (s["turns"] + 1).alias("turns"),
            (s["searches"] + search.cast("int")).alias("searches"),
            (s["strict_valid"] & (t["kind"] != "invalid")).alias("strict_valid"),
            reason.alias("reason"),
        )
        stopped = F.struct(s["mask"].alias("mask"), s["log_probs"].alias("log_probs"), s["turns"].alias("turns"), s["searches"].alias("searches"), s["strict_valid"].alias("strict_valid"), F.lit("length_limit").alias("reason"))
        return (
            F.when(s["reason"].isNotNull() | (s["turns"] >= max_turns), s)
            .when(left <= 0, stopped)
            .when(t["tokens"] > asked, fail("a turn has more tokens than were asked for"))
            .when(t["log_probs"].isNotNull() & (F.size(t["log_probs"]) != t["tokens"]), fail("log-probabilities and tokens differ in number"))
            .otherwise(moved)
            .cast(kind)
        )

    def finish(s: Column) -> Column:
        used_up = (F.size(s["mask"]) >= response) | (prompt_tokens + F.size(s["mask"]) >= total)
        reason = F.coalesce(s["reason"], F.when((s["turns"] < max_turns) & used_up, "length_limit"), F.lit("max_turns"))
        return F.struct(s["mask"].alias("mask"), s["log_probs"].alias("log_probs"), F.size(s["mask"]).alias("n"), s["turns"].alias("turns"), s["searches"].alias("searches"), s["strict_valid"].alias("strict_valid"), reason.alias("reason"))

    out = "struct<mask:array<int>,log_probs:array<double>,n:int,turns:int,searches:int,strict_valid:boolean,reason:string>"
    long = F.raise_error(F.concat(F.lit("the prompt is beyond its budget: "), prompt_tokens.cast("string"))).cast(out)
    return F.when(prompt_tokens > min(prompt, total), long).otherwise(F.aggregate(turns, start.cast(kind), step, finish))
