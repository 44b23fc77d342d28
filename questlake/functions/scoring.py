"""Answer scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from questlake.functions.text import answer_tokens, normalize_answer, once


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def f1_of_tokens(p: Column, g: Column) -> Column:
    """Multiset overlap; two empty lists agree, one empty list doesn't."""
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))))
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def token_f1(prediction: Column, gold: Column) -> Column:
    return once(F.struct(answer_tokens(prediction).alias("p"), answer_tokens(gold).alias("g")), lambda s: f1_of_tokens(s["p"], s["g"]))


def best_scores(prediction: Column, golds: Column) -> tuple[Column, Column]:
    """Best exact match and, on its own, best F1 over all gold answers."""
    em = once(normalize_answer(prediction), lambda p: F.array_max(F.transform(golds, lambda g: (normalize_answer(g) == p).cast("double"))))
    f1 = once(answer_tokens(prediction), lambda p: F.array_max(F.transform(F.transform(golds, answer_tokens), lambda g: f1_of_tokens(p, g))))
    return em, f1


def reward(prediction: Column, golds: Column, termination: Column, strict: Column) -> Column:
    """1 for a strictly valid answer that matches any gold one, else 0."""
    hit = once(normalize_answer(prediction), lambda p: F.exists(golds, lambda g: normalize_answer(g) == p))
    return F.coalesce(((termination == "answer") & strict & hit).cast("double"), F.lit(0.0))
