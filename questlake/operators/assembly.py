"""From finished runs to result rows, and from records to the shapes of the training and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questlake.functions.scoring import best_scores
from questlake.functions.text import strip
from questlake.operators import trajectory
from questlake.operators.guards import checked

TOO_LONG = "input_too_long"


def numbered(items: Column) -> Column:
    """Items with ``turn``, from 1: array of struct(turn, item)."""
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("turn"), x.alias("item")))


def version_range(turns: Column, low: str = "min_global_steps", high: str = "max_global_steps") -> Column:
    """struct(low, high) over the turns' generation versions; a turn without them is an error."""
    known = F.forall(turns, lambda t: t[low].isNotNull() & t[high].isNotNull())
    span = F.struct(F.array_min(F.transform(turns, lambda t: t[low])).alias(low), F.array_max(F.transform(turns, lambda t: t[high])).alias(high))
    return F.when(known, span).otherwise(F.raise_error(F.lit("a generation lacks its versions")).cast(f"struct<{low}:bigint,{high}:bigint>"))


def results(runs: DataFrame) -> DataFrame:
    """Result rows of ``runs``: id, source, question, answers, termination_reason, final_answer, input_tokens_at_failure, max_input_tokens,
    search_count and turns (array of struct with valid_action, strict_valid and ended_with_im_end).

    A missing answer is an empty prediction; runs that ended because the input grew too long score zero.
    """
    prediction = F.coalesce("final_answer", F.lit(""))
    em, f1 = best_scores(F.col("predicted_answer"), F.col("answers"))
    scored = lambda c: F.when(F.col("termination_reason") == TOO_LONG, 0.0).otherwise(c)
    n = lambda c: F.size(F.filter("turns", lambda t: F.coalesce(t[c], F.lit(False))))
    return runs.withColumn("predicted_answer", prediction).select(
        "id",
        "source",
        "question",
        F.col("answers").alias("gold_answers"),
        "predicted_answer",
        "termination_reason",
        "input_tokens_at_failure",
        "max_input_tokens",
        "search_count",
        F.size("turns").alias("total_turns"),
        n("valid_action").alias("valid_action_count"),
        n("strict_valid").alias("strict_protocol_count"),
        n("ended_with_im_end").alias("eos_count"),
        numbered(F.col("turns")).alias("turns"),
        scored(em).alias("em"),
        scored(f1).alias("f1"),
    )


def budget_scored(rows: DataFrame, budget_stop: str = "budget_stop") -> DataFrame:
    """The stricter scoring: a run that its token budget stopped ended with length_limit, and only answers score."""
    ended = F.when(F.coalesce(F.col(budget_stop), F.lit(False)), "length_limit").otherwise(F.col("termination_reason"))
    out = rows.withColumn("termination_reason", ended).drop(budget_stop)
    only = lambda c: F.when(F.col("termination_reason") == "answer", F.col(c)).otherwise(0.0)
    return out.withColumns({"em": only("em"), "f1": only("f1"), "assistant_decision_turns": F.col("total_turns")})


def supervised(rows: DataFrame) -> DataFrame:
    """(id, source, question, answers, search_count, events): a trajectory as it enters the supervised set; only the count is added."""
    return rows.select("id", "source", "question", "answers", trajectory.search_count(F.col("events")).alias("search_count"), "events")


def renderable(rows: DataFrame, system_prompt: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories that the renderer takes, with ``messages``; and the others as (id, reason, event_types)."""
    marked = rows.withColumn("_rendered", trajectory.render(F.col("events"), F.col("question"), system_prompt))
    good = marked.where("_rendered.error IS NULL").withColumn("messages", F.col("_rendered.messages")).drop("_rendered")
    bad = marked.where("_rendered.error IS NOT NULL").select("id", F.col("_rendered.error").alias("reason"), F.transform("events", lambda e: e["type"]).alias("event_types"))
    return good, bad


def questions(rows: DataFrame) -> DataFrame:
    """(id, source, source_split, question, answers) of canonical records: the shape of evaluation and rollout sets."""
    return rows.select(F.col("uid").alias("id"), "source", "source_split", "question", F.col("gold_answers").alias("answers"))


def without_empty(generated: DataFrame, content: str = "content", key: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Generations with content other than white space, and the ids of the others, for the list of skipped ones."""
    blank = F.coalesce(strip(F.col(content)), F.lit("")) == ""
    return generated.where(~blank), generated.where(blank).select(key)


ERROR_NULLS = ["final_answer", "strict_protocol_valid", "search_count", "reward", "prompt_token_count", "response_token_count", "trajectory_text"]


def captured(rollouts: DataFrame, error: str = "error") -> DataFrame:
    """Rollouts with ``status``: one with an error is kept as runtime_error, without figures, and doesn't end the batch."""
    failed = F.col(error).isNotNull()
    kept = {c: F.when(~failed, F.col(c)) for c in ERROR_NULLS if c in rollouts.columns}
    return rollouts.withColumns({"status": F.when(failed, "error").otherwise("ok"), "termination_reason": F.when(failed, "runtime_error").otherwise(F.col("termination_reason")), **kept})


def consistent_only(rows: DataFrame, searches: str = "search_count") -> DataFrame:
    """Trajectories whose events agree with the runtime's count of searches; others are an error."""
    return checked(rows, trajectory.consistent(F.col("events"), F.col(searches)), "events and searches disagree")
