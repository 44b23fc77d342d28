"""Evaluation and rollout analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from questlake.operators.guards import checked

RATES = ["answer_em", "answer_f1", "valid_action_rate", "strict_raw_protocol_rate", "eos_rate", "answer_completion_rate", "average_search_count", "max_turns_rate", "input_too_long_rate"]


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


COUNTS = ["samples", "input_too_long_count"]
#: Further rates of the evaluation under token budgets.
BUDGET_RATES = ["average_assistant_decision_turns", "length_limit_rate", "invalid_action_rate"]


def agent_metrics(results: DataFrame, groups: list[str], by: str = "source", total: str = "overall", budget: bool = False) -> DataFrame:
    """One row for each of ``groups`` and the total; groups without rows have zeros. Protocol rates are shares of turns, not rows.

    With ``budget`` the rates of runs under token budgets are added.
    """
    n, turns = F.count(by), F.coalesce(F.sum("total_turns"), F.lit(0))
    of = lambda reason: F.count_if(F.col("termination_reason") == reason)
    cols = [
        n.alias("samples"),
        _share(F.sum("em"), n).alias("answer_em"),
        _share(F.sum("f1"), n).alias("answer_f1"),
        _share(F.sum("valid_action_count"), turns).alias("valid_action_rate"),
        _share(F.sum("strict_protocol_count"), turns).alias("strict_raw_protocol_rate"),
        _share(F.sum("eos_count"), turns).alias("eos_rate"),
        _share(of("answer"), n).alias("answer_completion_rate"),
        _share(F.sum("search_count"), n).alias("average_search_count"),
        _share(of("max_turns"), n).alias("max_turns_rate"),
        of("input_too_long").alias("input_too_long_count"),
        _share(of("input_too_long"), n).alias("input_too_long_rate"),
    ]
    if budget:
        cols += [c.alias(name) for name, c in zip(BUDGET_RATES, (_share(turns, n), _share(of("length_limit"), n), _share(of("invalid_action"), n)), strict=True)]
    rows = results.where(F.col(by).isin(groups)).rollup(by).agg(*cols).withColumn(by, F.coalesce(by, F.lit(total)))
    wanted = results.sparkSession.createDataFrame([(g,) for g in [*groups, total]], f"{by} string")
    filled = wanted.join(F.broadcast(rows), by, "left")  # a row a group
    return filled.select(by, *[F.coalesce(c, F.lit(0) if c in COUNTS else F.lit(0.0)).alias(c) for c in rows.columns if c != by])


def depth_crosstab(df: DataFrame, depths: int = 4, by: str = "source", count: str = "search_count") -> DataFrame:
    """Rows by source and search count, dense from 0 to ``depths``, with totals; a greater count is an error."""
    checked = F.when(F.col(count) > depths, F.raise_error(F.lit("search count out of range")).cast("int")).otherwise(F.col(count))
    cells = [F.count_if(F.col("_depth") == d).alias(f"depth_{d}") for d in range(depths + 1)]
    return df.withColumn("_depth", checked).rollup(by).agg(*cells, F.count("*").alias("total")).withColumn(by, F.coalesce(by, F.lit("total")))


def rollout_groups(rollouts: DataFrame, expected: int, selected: DataFrame | None = None, order: str = "rollout_id") -> DataFrame:
    """(question_id, record_count, valid_count, reward_sum, rewards, category) of each question, those without rollouts too.

    Rewards of valid rollouts must be 0 or 1, and no question may have a rollout twice; both are errors whatever is read of the result.
    """
    ok = F.col("status") == "ok"
    rollouts = checked(rollouts, ~F.coalesce(ok, F.lit(False)) | F.col("reward").isin(0.0, 1.0), "a reward is neither 0 nor 1")
    value = F.when(ok, F.col("reward"))
    rewards = F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(F.col(order).alias("o"), F.col("reward").alias("r"))))), lambda x: x["r"])
    g = rollouts.withColumn("_value", value).groupBy("question_id").agg(F.count("*").alias("record_count"), F.count_if(ok).alias("valid_count"), F.coalesce(F.sum("_value"), F.lit(0.0)).alias("reward_sum"), rewards.alias("rewards"), F.collect_list(order).alias("_ids"))
    g = checked(g, F.size("_ids") == F.size(F.array_distinct("_ids")), F.concat(F.lit("a rollout occurs twice: "), F.col("question_id").cast("string"))).drop("_ids")
    if selected is not None:
        g = selected.select("question_id").distinct().join(g, "question_id", "full").select("question_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("record_count", "valid_count")], F.coalesce("reward_sum", F.lit(0.0)).alias("reward_sum"), F.coalesce("rewards", F.array().cast("array<double>")).alias("rewards"))
    complete = (F.col("record_count") == expected) & (F.col("valid_count") == expected)
    category = F.when(~complete, "incomplete").when(F.col("reward_sum") == expected, "all_one").when(F.col("reward_sum") > 0, "mixed").otherwise("all_zero")
    return g.withColumn("category", category).withColumn("rewards", F.to_json("rewards"))


def rollout_summary(rollouts: DataFrame, groups: DataFrame, expected: int) -> DataFrame:
    """One row: rates over valid rows, group ratios over complete groups; null where there are none."""
    ok = F.col("status") == "ok"
    rate = lambda c: F.round(F.avg(F.when(ok, c.cast("double"))), 6)
    rows = rollouts.agg(
        F.count("*").alias("record_count"),
        F.count_if(ok).alias("valid_record_count"),
        F.count_if(~ok).alias("failed_record_count"),
        rate(F.col("termination_reason") == "answer").alias("answer_completion_rate"),
        rate(F.coalesce("strict_protocol_valid", F.lit(False))).alias("strict_protocol_validity"),
        rate(F.col("reward")).alias("mean_reward"),
        rate(F.col("search_count")).alias("mean_search_count"),
    )
    of = lambda k: F.count_if(F.col("category") == k)
    complete = F.count_if(F.col("category") != "incomplete")
    ratio = lambda k: F.round(F.try_divide(of(k).cast("double"), complete.cast("double")), 6)
    per = groups.agg(F.count("*").alias("group_count"), complete.alias("complete_group_count"), of("incomplete").alias("incomplete_group_count"), ratio("mixed").alias("informative_group_ratio"), ratio("all_zero").alias("all_zero_ratio"), ratio("all_one").alias("all_one_ratio"))
    return rows.crossJoin(per).withColumn("expected_rollouts", F.lit(expected))  # one row each


def distribution(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def length_audit(df: DataFrame, length: Column, by: str = "source", accuracy: int | None = None) -> DataFrame:
    """(group, rows, mean, p50, p90, p95, p99, max) of lengths. Null lengths don't count. Quantiles are exact: rows are counted by length
    first, so a window sees one row for each distinct length of a group. With ``accuracy`` they come from sketches that tasks merge, and
    the rank of each is off by at most rows / ``accuracy``; for measures of very many distinct values."""
    marks = {"p50": 50, "p90": 90, "p95": 95, "p99": 99}
    n = df.select(by, length.cast("long").alias("_n"))
    if accuracy is not None:
        got = n.groupBy(by).agg(F.count("_n").alias("rows"), F.round(F.avg("_n"), 6).alias("mean"), F.percentile_approx("_n", [m / 100 for m in marks.values()], accuracy).alias("_q"), F.max("_n").alias("max"))
        return got.select(by, "rows", "mean", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(marks)], "max")
    # null lengths keep their group, with no rows
    each = n.groupBy(by, "_n").agg(F.count("_n").alias("_rows"))
    group = Window.partitionBy(by)
    upto, whole = F.sum("_rows").over(group.orderBy("_n")), F.sum("_rows").over(group)
    ranked = each.withColumns({"_upto": upto, "_all": whole})
    rows = F.sum("_rows")
    at = lambda m: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * m, F.col("_n")))
    mean = F.round(F.try_divide(F.sum(F.col("_n") * F.col("_rows")).cast("double"), rows.cast("double")), 6)
    return ranked.groupBy(by).agg(rows.alias("rows"), mean.alias("mean"), *[at(m).alias(c) for c, m in marks.items()], F.max("_n").alias("max"))


def counts_as_map(df: DataFrame, key: str) -> DataFrame:
    """The same as one row with a map."""
    return distribution(df, key).agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("counts"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row an id with both sides' figures. Ids must be unique and the same on both sides, and questions, gold answers and sources
    must agree; anything else is an error whatever is read of the result. One shuffle, and no product of repeated ids."""
    same = ["question", "source", "gold_answers"]
    cols = [*same, "prediction", "em", "f1", "search_count", "termination_reason"]
    side = lambda df, s: df.select("id", F.lit(s).alias("_side"), F.struct(*cols).alias("_row"))
    of = lambda s: F.max(F.when(F.col("_side") == s, F.col("_row"))).alias(s)
    n = lambda s: F.count_if(F.col("_side") == s).alias(f"_{s}")
    both = side(left, "left").unionByName(side(right, "right")).groupBy("id").agg(n("left"), n("right"), of("left"), of("right"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    both = checked(both, (F.col("_left") <= 1) & (F.col("_right") <= 1), F.concat(F.lit("an id occurs twice: "), name))
    both = checked(both, (F.col("_left") == 1) & (F.col("_right") == 1), F.concat(F.lit("the two sides don't have the same ids: "), name))
    for c in same:
        both = checked(both, F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")), F.concat(F.lit(f"the two sides disagree on {c}: "), name))
    d = lambda c: (F.col(f"right.{c}") - F.col(f"left.{c}")).alias(f"{c}_delta")
    return both.select("id", F.col("left.source").alias("source"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("prediction", "em", "f1", "termination_reason", "search_count") for s in ("left", "right")], d("em"), d("f1"), d("search_count"))


def differing(pairs: DataFrame) -> DataFrame:
    return pairs.where(~F.col("left_prediction").eqNullSafe(F.col("right_prediction")) | (F.col("search_count_delta") != 0) | (F.col("left_termination_reason") != F.col("right_termination_reason")))


def contingency(pairs: DataFrame) -> DataFrame:
    """The 2 x 2 counts of exact matches, zeros included."""
    cell = lambda a, b: F.count_if((F.col("left_em") == a) & (F.col("right_em") == b))
    return pairs.agg(cell(1, 1).alias("both_right"), cell(1, 0).alias("left_only"), cell(0, 1).alias("right_only"), cell(0, 0).alias("both_wrong"))


def metric_deltas(left: DataFrame, right: DataFrame, by: str = "source") -> DataFrame:
    """Right minus left for each group and figure, counts included."""
    figures = [*COUNTS, *(c for c in left.columns if c not in [by, *COUNTS])]
    long = lambda df, name: df.select(by, *[F.col(c).cast("double").alias(c) for c in figures]).unpivot([by], figures, "metric", name)
    return long(left, "l").join(long(right, "r"), [by, "metric"]).select(by, "metric", F.round(F.col("r") - F.col("l"), 6).alias("delta"))


def turn_counts(turns: Column) -> dict[str, Column]:
    """valid_action_count, strict_protocol_count and eos_count of a result's turns."""
    n = lambda c: F.size(F.filter(turns, lambda t: F.coalesce(t[c], F.lit(False))))
    return {"total_turns": F.size(turns), "valid_action_count": n("valid_action"), "strict_protocol_count": n("strict_valid"), "eos_count": n("ended_with_im_end")}
