"""Trajectories: rendering events as messages, extracting events, counts and consistency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questlake.functions.text import last_think, strip, unwrapped_observation

MESSAGES = "array<struct<role:string,content:string,reasoning_content:string>>"


def search_count(events: Column) -> Column:
    return F.size(F.filter(events, lambda e: e["type"] == "search"))


def render(events: Column, question: Column, system_prompt: str) -> Column:
    """struct(messages, error): a fold over the events that keeps the first error; messages are null with an error."""

    def message(role: str, content: Column, reasoning: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), (reasoning if reasoning is not None else F.lit(None).cast("string")).alias("reasoning_content"))

    start = F.struct(
        F.array(message("system", F.lit(system_prompt)), message("user", question)).cast(MESSAGES).alias("messages"),
        F.lit(None).cast("string").alias("thought"),
        F.lit(False).alias("waiting"),
        F.lit(False).alias("answered"),
        F.lit(None).cast("string").alias("error"),
    )

    def step(s: Column, e: Column) -> Column:
        kind, content = e["type"], e["content"]
        act, think, info = kind.isin("search", "answer"), kind == "think", kind == "information"
        busy = s["waiting"] | s["answered"]
        # The renderer's messages.
        error = F.coalesce(
            s["error"],
            F.when(think & (s["thought"].isNotNull() | busy), F.lit("think is out of order"))
            .when(act & (s["thought"].isNull() | busy), F.concat(kind, F.lit(" lacks preceding think or is out of order")))
            .when(info & ~s["waiting"], F.lit("information lacks preceding search"))
            .when(~(think | act | info), F.concat(F.lit("unsupported event type: "), kind)),
        )
        turn = message("assistant", F.concat(F.lit("<"), kind, F.lit(">"), content, F.lit("</"), kind, F.lit(">")), s["thought"])
        seen = message("user", F.concat(F.lit("<information>"), content, F.lit("</information>")))
        added = F.when(act, F.array(turn)).when(info, F.array(seen)).otherwise(F.array().cast(MESSAGES))
        return F.struct(
            F.when(error.isNull(), F.concat(s["messages"], added)).otherwise(s["messages"]).alias("messages"),
            F.when(think, content).when(act, F.lit(None)).otherwise(s["thought"]).alias("thought"),
            F.when(kind == "search", True).when(info, False).otherwise(s["waiting"]).alias("waiting"),
            (s["answered"] | (kind == "answer")).alias("answered"),
            error.alias("error"),
        )

    def finish(s: Column) -> Column:
        open_ = ~s["answered"] | s["thought"].isNotNull() | s["waiting"]
        error = F.coalesce(s["error"], F.when(open_, F.lit("trajectory does not end with think and answer")))
        return F.struct(F.when(error.isNull(), s["messages"]).alias("messages"), error.alias("error"))

    return F.aggregate(events, start, step, finish)


def extract_events(turns: Column, steps: Column) -> Column:
    """Events of model turns (content, reasoning_content) and their steps (type, content, observation): think, action, information.

    The last think element counts where the reasoning is blank; invalid actions are left out, their thoughts kept. Turns and steps of
    different number are an error, and so is an observation without its tags.
    """
    event = "array<struct<type:string,content:string>>"

    def of(z: Column) -> Column:
        turn, s = z["turns"], z["steps"]
        reasoning = F.coalesce(turn["reasoning_content"], F.lit(""))
        thought = F.when(strip(reasoning) != "", reasoning).otherwise(last_think(turn["content"]))
        pair = lambda kind, c: F.struct(kind.alias("type"), c.alias("content"))
        think = F.when(F.coalesce(strip(thought), F.lit("")) != "", F.array(pair(F.lit("think"), strip(thought)))).otherwise(F.array().cast(event))
        act = F.when(s["type"] != "invalid", F.array(pair(s["type"], s["content"]))).otherwise(F.array().cast(event))
        info = F.when(s["type"] == "search", F.array(pair(F.lit("information"), unwrapped_observation(s["observation"], strict=True)))).otherwise(F.array().cast(event))
        return F.concat(think, act, info)

    events = F.flatten(F.transform(F.arrays_zip(turns.alias("turns"), steps.alias("steps")), of))
    return F.when(F.size(turns) == F.size(steps), events).otherwise(F.raise_error(F.lit("turns and steps differ in number")).cast(event))


def consistent(events: Column, searches: Column) -> Column:
    """As many searches as the runtime counted, and as many observations."""
    n = lambda kind: F.size(F.filter(events, lambda e: e["type"] == kind))
    return (n("search") == searches) & (n("information") == n("search"))


def loop_columns(steps: Column) -> dict[str, Column]:
    """turns, search_count, done and final_answer of a list of steps (type, content)."""
    last = F.element_at(steps, -1)
    done = F.coalesce(last["type"] == "answer", F.lit(False)) & (F.size(steps) > 0)
    return {"turns": F.size(steps), "search_count": F.size(F.filter(steps, lambda s: s["type"] == "search")), "done": done, "final_answer": F.when(done, last["content"])}


def history_is_prefix(rendered: Column, with_prompt: Column) -> Column:
    return F.startswith(with_prompt, rendered)


def turn_matches_template(before: Column, after: Column, raw: Column) -> Column:
    """The template's text after the history, without line ends, is the raw turn."""
    return F.startswith(after, before) & (F.regexp_replace(F.substr(after, F.length(before) + 1), r"[\r\n]+\z", "") == raw)


def chat_text(messages: Column) -> Column:
    """Messages in a plain chat template."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.when(m["reasoning_content"].isNotNull(), F.concat(F.lit("<think>"), m["reasoning_content"], F.lit("</think>"))).otherwise(""), m["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, one), "")
