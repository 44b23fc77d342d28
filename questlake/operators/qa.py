"""Question-answer cleaning: canonical records, validation, counters."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from questlake.functions.text import is_blank, normalize_whitespace, sliced
from questlake.operators.guards import checked

# Ids that are left out of the multi-hop source.
EXCLUDED = ["train_27806", "train_77497", "train_11353", "train_3027", "train_37183", "train_57311", "train_76227", "train_18953", "train_63809", "train_83381", "train_54069", "train_67184"]


def _tidied(items: list[str | None]) -> list[str]:
    """White space normalised (Python's is that of ``normalize_whitespace``), nulls out."""
    return [" ".join(x.split()) for x in items if x is not None]


def _cleaned(items: list[str | None] | None, blanks: bool = False) -> list[str] | None:
    if items is None:
        return None
    first: dict[str, str] = {}
    for x in _tidied(items):
        if x or blanks:
            first.setdefault(x.casefold(), x)
    return list(first.values())


def _counted(items: list[str | None] | None) -> dict[str, int] | None:
    if items is None:
        return None
    tidy = _tidied(items)
    keys = [x.casefold() for x in tidy if x]
    changed = sum(x != raw for x, raw in zip(tidy, (x for x in items if x is not None)))
    return {"normalized": changed, "duplicates": len(keys) - len(set(keys))}


def clean_list(items: Column, blanks: bool = False) -> Column:
    """White space normalised, blanks out (``row_error`` reports them), the first spelling of each value that is the same by case folding
    kept in order. With ``blanks`` a blank is a value like others, the empty string."""
    kind, cleaned = pa.list_(pa.string()), partial(_cleaned, blanks=blanks)
    return F.arrow_udf(lambda lists: sliced(lists, cleaned, kind), "array<string>")(items)


def answer_counts(items: Column) -> Column:
    """struct(normalized, duplicates): how many items white space changes, and how many repeat another by case folding."""
    kind = pa.struct([("normalized", pa.int32()), ("duplicates", pa.int32())])
    return F.arrow_udf(lambda lists: sliced(lists, _counted, kind), "normalized int, duplicates int")(items)


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")


def _has_blank(items: Column) -> Column:
    return F.exists(items, is_blank)


def metadata_error(metadata: Column) -> Column:
    """What is wrong with the multi-hop metadata (type, level, supporting_facts.title), or null."""
    titles = metadata["supporting_facts"]["title"]
    return (
        F.when(metadata.isNull(), "no metadata")
        .when(is_blank(metadata["type"]), "blank type")
        .when(is_blank(metadata["level"]), "blank level")
        .when(titles.isNull() | (F.size(titles) == 0), "no titles")
        .when(_has_blank(titles), "blank titles")
    )


def multi_hop_metadata(metadata: Column) -> dict[str, Column]:
    """The canonical fields of the multi-hop source: type, level and supporting titles, cleaned."""
    return {"type": normalize_whitespace(metadata["type"]), "level": normalize_whitespace(metadata["level"]), "supporting_titles": clean_list(metadata["supporting_facts"]["title"])}


def row_error(question: Column, answers: Column, identity: Column | None = None) -> Column:
    """What is wrong with a raw row, or null; a blank ``identity`` is wrong too where one is given."""
    start = F.when(F.lit(False), "") if identity is None else F.when(is_blank(identity), "blank id")
    return start.when(is_blank(question), "blank question").when(answers.isNull() | (F.size(answers) == 0), "no answers").when(_has_blank(answers), "blank answers")


def quarantine(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their ``error``."""
    marked = df.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def quarantined(df: DataFrame, error: Column, path: str, by: str = "source_split") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, bad ones with their ``error``, and (split, read, excluded, written): the input is read, and the error found, once, in the
    write to ``path``; all three are read from there. A write that lost rows is an error."""
    seen = Observation()
    marked = df.withColumn("error", error).withColumn("excluded", F.col("error").isNotNull())
    marked.observe(seen, F.count(F.lit(1)).alias("read")).write.partitionBy("excluded").parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    counts = back.groupBy(by).agg(F.count("*").alias("read"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("written"))
    if back.count() != seen.get["read"]:
        raise ValueError("rows got lost")
    return back.where("NOT excluded").drop("excluded", "error"), back.where("excluded").drop("excluded"), counts


def strictly(df: DataFrame, error: Column) -> DataFrame:
    """The rows, or an error when a bad one is read."""
    return checked(df, error.isNull(), error)


def canonical(df: DataFrame, source: str, id_col: str, split: str, extra: dict[str, Column] | None = None, normalize_id: bool = False, blanks: bool = False) -> DataFrame:
    """(uid, source, source_split, question, gold_answers, metadata) of raw rows with ``question`` and ``golden_answers``. Blank answers
    are left out, with ``blanks`` kept."""
    key = normalize_whitespace(F.col(id_col).cast("string")) if normalize_id else F.col(id_col).cast("string")
    meta = [F.col(id_col).cast("string").alias("original_id"), *[c.alias(n) for n, c in (extra or {}).items()]]
    return df.select(F.concat(F.lit(f"{source}_"), key).alias("uid"), F.lit(source).alias("source"), F.lit(split).alias("source_split"), normalize_whitespace("question").alias("question"), clean_list(F.col("golden_answers"), blanks).alias("gold_answers"), F.struct(*meta).alias("metadata"))


def without_excluded(df: DataFrame, id_col: str, excluded: list[str] = EXCLUDED) -> DataFrame:
    return df.where(~F.col(id_col).isin(excluded))


def first_rows(df: DataFrame, n: int | None, ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows by input order, counted before any exclusion."""
    return df if n is None else df.where(F.col(ordinal) < n)


def counters(df: DataFrame, by: str = "source_split") -> DataFrame:
    """Rows, normalised answers and dropped duplicates per split and overall, of raw ``golden_answers``."""
    # per row before the rollup, which doubles the rows
    each = df.select(by, answer_counts(F.col("golden_answers")).alias("n"))
    sums = [F.count("*").alias("read"), F.sum("n.normalized").cast("long").alias("normalized"), F.sum("n.duplicates").cast("long").alias("duplicates")]
    return each.groupBy(by).agg(*sums).rollup(by).agg(*[F.sum(c).cast("long").alias(c) for c in ("read", "normalized", "duplicates")]).withColumn(by, F.coalesce(by, F.lit("overall")))


def training_prefix(df: DataFrame) -> DataFrame:
    """Only ids of the two sources' training splits."""
    return df.where(((F.col("source") == "nq") & F.startswith(F.col("id"), F.lit("nq_train_"))) | ((F.col("source") == "hotpotqa") & F.startswith(F.col("id"), F.lit("hotpotqa_train_"))))


def trainer_records(df: DataFrame, split: str, system_prompt: str) -> DataFrame:
    """Rows (id, source, question, answers) in the trainer's shape."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(
        F.col("source").alias("data_source"),
        F.array(message("system", F.lit(system_prompt)), message("user", F.col("question"))).alias("prompt"),
        F.lit("search_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("answers").alias("ground_truth")).alias("reward_model"),
        F.struct("id", F.lit(split).alias("split")).alias("extra_info"),
        F.lit("search_agent").alias("agent_name"),
    )


def training_questions(df: DataFrame) -> DataFrame:
    """(id, question): the question, else the last user message of the prompt."""
    asked = F.element_at(F.filter("prompt", lambda m: m["role"] == "user"), -1)["content"]
    return df.select(F.coalesce(F.col("extra_info.id"), F.col("id")).alias("id"), F.coalesce("question", asked).alias("question"))
