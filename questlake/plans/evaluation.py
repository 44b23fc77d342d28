"""Registered queries of result assembly, guards and projections, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from questlake.functions import text as tx
from questlake.operators import assembly, guards, isolation, metrics, qa, sampling, trajectory
from questlake.plans.catalog import CLEAN, EVENTS_SQL, LANGS, PROMPT, RESULTS, SCORES_SQL, _answers, _events, _results, query, sql_metrics, sql_tokens, table

# 1 results

REASONS = "CASE conv_id % 4 WHEN 0 THEN 'input_too_long' WHEN 1 THEN 'answer' WHEN 2 THEN 'max_turns' ELSE 'invalid_action' END"
FLAGS = {"valid_action": "turn % 5 <> 0", "strict_valid": "turn % 3 <> 0", "ended_with_im_end": "turn % 2 = 1"}


def _runs(spark, sf_dir):
    """Finished runs from conversations: assistant turns with flags, the last text as answer, user texts as gold answers."""
    conv = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    turn = F.struct("turn", *[F.expr(e).alias(n) for n, e in FLAGS.items()], F.sha2("text", 256).alias("raw_sha256"))
    turns = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    none = F.lit(None).cast("int")
    return _answers(spark, sf_dir).join(turns, "conv_id").select(
        F.col("conv_id").alias("id"),
        F.lit("nq").alias("source"),
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"),
        F.col("golds").alias("answers"),
        F.expr(REASONS).alias("termination_reason"),
        F.when(F.col("conv_id") % 7 != 0, F.col("prediction")).alias("final_answer"),
        F.when(F.col("conv_id") % 4 == 0, 9000).otherwise(none).alias("input_tokens_at_failure"),
        F.when(F.col("conv_id") % 4 == 0, 8192).otherwise(none).alias("max_input_tokens"),
        F.size("turns").alias("search_count"),
        "turns",
    )


COUNTS = ", ".join(f"count(*) FILTER (role = 'assistant' AND {e})::INTEGER AS {n}" for n, e in FLAGS.items())
# an empty prediction scores zero against gold answers that have words
RUNS_SQL = f"""
    WITH {SCORES_SQL}, t AS (SELECT conv_id, count(*) FILTER (role = 'assistant')::INTEGER AS total_turns, {COUNTS} FROM conversations GROUP BY conv_id),
    r AS (SELECT s.conv_id AS id, CASE WHEN conv_id % 7 <> 0 THEN prediction ELSE '' END AS predicted_answer, {REASONS} AS termination_reason, conv_id % 7 = 0 AS missing, em, f1, total_turns,
        valid_action AS valid_action_count, strict_valid AS strict_protocol_count, ended_with_im_end AS eos_count FROM s JOIN a USING (conv_id) JOIN t USING (conv_id))
"""


@query(f"""
    {RUNS_SQL}
    SELECT id, sha256(predicted_answer) AS predicted_sha256, termination_reason, total_turns, valid_action_count, strict_protocol_count, eos_count,
        CASE WHEN missing OR termination_reason = 'input_too_long' THEN 0.0 ELSE em END::DOUBLE AS em, CASE WHEN missing OR termination_reason = 'input_too_long' THEN 0.0 ELSE f1 END::DOUBLE AS f1 FROM r
""")
def evaluation_results(spark, sf_dir):
    got = assembly.results(_runs(spark, sf_dir))
    return got.select("id", F.sha2("predicted_answer", 256).alias("predicted_sha256"), "termination_reason", "total_turns", "valid_action_count", "strict_protocol_count", "eos_count", "em", F.round("f1", 6).alias("f1"))


@query(f"""
    {RUNS_SQL}, stopped AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'length_limit' ELSE termination_reason END AS reason FROM r)
    SELECT id, reason AS termination_reason, total_turns AS assistant_decision_turns, CASE WHEN reason = 'answer' AND NOT missing THEN em ELSE 0.0 END::DOUBLE AS em, CASE WHEN reason = 'answer' AND NOT missing THEN f1 ELSE 0.0 END::DOUBLE AS f1 FROM stopped
""")
def budget_scored_results(spark, sf_dir):
    got = assembly.budget_scored(assembly.results(_runs(spark, sf_dir)).withColumn("budget_stop", F.col("id") % 9 == 0))
    return got.select("id", "termination_reason", "assistant_decision_turns", "em", F.round("f1", 6).alias("f1"))


@query(f"""
    WITH l AS ({RESULTS}), m AS ({sql_metrics('l')}),
    x AS (SELECT coalesce(source, 'overall') AS source, round(sum(total_turns)::DOUBLE / count(*), 6) AS average_assistant_decision_turns, round(count(*) FILTER (termination_reason = 'length_limit')::DOUBLE / count(*), 6) AS length_limit_rate,
        round(count(*) FILTER (termination_reason = 'invalid_action')::DOUBLE / count(*), 6) AS invalid_action_rate FROM l GROUP BY ROLLUP (source))
    SELECT * FROM m JOIN x USING (source)
""")
def budget_metrics_by_source(spark, sf_dir):
    return metrics.agent_metrics(_results(spark, sf_dir), ["nq", "hotpotqa"], budget=True)


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS turn, sha256(text) AS text_sha256 FROM conversations WHERE role = 'assistant'")
def turn_numbers(spark, sf_dir):
    rows = _runs_of_texts(spark, sf_dir).select("conv_id", F.explode(assembly.numbered(F.col("texts"))).alias("t"))
    return rows.select("conv_id", "t.turn", F.sha2("t.item", 256).alias("text_sha256"))


def _runs_of_texts(spark, sf_dir):
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.transform(said, lambda x: x["text"]).alias("texts"))


@query("SELECT conv_id, min(turn * 3 % 7) AS min_global_steps, max(turn * 5 % 11 + 7) AS max_global_steps FROM conversations GROUP BY conv_id")
def version_ranges(spark, sf_dir):
    version = F.struct((F.col("turn") * 3 % 7).alias("min_global_steps"), (F.col("turn") * 5 % 11 + 7).alias("max_global_steps"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(version).alias("turns"))
    return rows.select("conv_id", assembly.version_range(F.col("turns")).alias("v")).select("conv_id", "v.*")


@query("""
    SELECT event_id AS rollout_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'runtime_error' ELSE 'answer' END AS termination_reason,
        CASE WHEN event_type <> 'error' THEN value END AS reward, CASE WHEN event_type <> 'error' THEN user_id END AS search_count FROM events
""")
def captured_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("rollout_id"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.lit("answer").alias("termination_reason"), F.col("value").alias("reward"), F.col("user_id").alias("search_count"))
    return assembly.captured(rows).select("rollout_id", "status", "termination_reason", "reward", "search_count")


@query("SELECT doc_id AS uid, doc_id % 6 = 0 AS skipped FROM documents")
def empty_content_skip(spark, sf_dir):
    blank = F.when(F.col("doc_id") % 12 == 0, F.lit("  ")).when(F.col("doc_id") % 6 != 0, F.col("text"))
    kept, skipped = assembly.without_empty(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), blank.alias("content")))
    return kept.select("uid", F.lit(False).alias("skipped")).unionByName(skipped.select("uid", F.lit(True).alias("skipped")))


# 2 guards


@query("SELECT doc_id AS id, 'id' AS overlap FROM documents WHERE doc_id % 6 = 0 UNION ALL "
       f"SELECT id, 'question' FROM (SELECT doc_id AS id, {sql_tokens('text')} AS k FROM documents WHERE doc_id % 2 = 0) WHERE k IN (SELECT {sql_tokens('text')} FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0)")
def isolation_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return isolation.training_overlap(d.where("id % 2 = 0"), d.where("id % 2 = 1 OR id % 6 = 0"))


@query("SELECT lang AS source_split, count(*) AS read, count(*) FILTER (doc_id % 5 = 0) AS excluded, count(*) FILTER (doc_id % 5 <> 0) AS written FROM documents GROUP BY lang")
def count_balance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_split"))
    return guards.require_balance(d, d.where("doc_id % 5 = 0"), d.where("doc_id % 5 != 0"))


@query("SELECT doc_id FROM documents")
def source_check(spark, sf_dir):
    """The source is read off the ids of all rows; a row of another would end the query."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("nq_"), F.col("doc_id").cast("string")).alias("uid"))
    return guards.from_source(rows.withColumn("source", F.substring_index("uid", "_", 1)), "nq").select("doc_id")


@query("SELECT doc_id AS id FROM documents")
def training_guard(spark, sf_dir):
    """The split is read off the ids of all rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("nq_train_"), F.col("doc_id").cast("string")).alias("uid"))
    rows = rows.select(F.struct(F.col("doc_id").alias("id"), F.get(F.split("uid", "_"), F.lit(1)).alias("split")).alias("extra_info"))
    return guards.training_only(rows).select("extra_info.id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('123:' || doc_id), doc_id) <= 10")
def quota_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return guards.require_quotas(sampling.taken(d, "lang", 10, *sampling.seeded(123, "doc_id")), dict.fromkeys(LANGS, 10), "lang").select("doc_id", "lang")


# 3 projections


@query(f"WITH {EVENTS_SQL} SELECT conv_id AS id, 'nq' AS source, 'q' || conv_id AS question, searches::INTEGER AS search_count, (2 * acts + infos)::INTEGER AS events FROM e")
def supervised_projection(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("conv_id").alias("id"), F.lit("nq").alias("source"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question"), F.array(F.lit("x")).alias("answers"), "events")
    return assembly.supervised(rows).select("id", "source", "question", "search_count", F.size("events").alias("events"))


@query("""
    WITH v AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations),
    w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM v WHERE role = 'assistant' OR (role = 'user' AND turn > 0)),
    g AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND previous = 'assistant' OR role = 'user' AND (previous IS NULL OR previous = 'user' OR turn > last)) AS wrong,
        string_agg(CASE WHEN role = 'user' THEN 'information' WHEN turn = last THEN 'think,answer' ELSE 'think,search' END, ',' ORDER BY turn) AS kinds FROM w GROUP BY conv_id)
    SELECT conv_id AS id, wrong = 0 AS renders, kinds FROM g
""")
def renderable_filter(spark, sf_dir):
    good, bad = assembly.renderable(_events(spark, sf_dir).select(F.col("conv_id").alias("id"), F.lit("q").alias("question"), "events"), PROMPT)
    kinds = F.array_join(F.transform("events", lambda e: e["type"]), ",").alias("kinds")
    return good.select("id", F.lit(True).alias("renders"), kinds).unionByName(bad.select("id", F.lit(False).alias("renders"), F.array_join("event_types", ",").alias("kinds")))


@query(f"SELECT 'nq_' || doc_id AS id, 'nq' AS source, 'train' AS source_split, sha256({CLEAN.format('text')}) AS question_sha256, lang AS answers FROM documents")
def question_projection(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.array("lang").alias("golden_answers"))
    rows = assembly.questions(qa.canonical(raw, "nq", "id", "train"))
    return rows.select("id", "source", "source_split", F.sha2("question", 256).alias("question_sha256"), F.array_join("answers", "|").alias("answers"))


@query(f"SELECT 'hotpotqa_' || doc_id AS uid, {CLEAN.format('lang')} AS type, {CLEAN.format('source')} AS level, lang || '|' || source AS titles FROM documents")
def multi_hop_cleaning(spark, sf_dir):
    """Metadata with white space and repeated titles; a blank one would be an error."""
    titles = F.array("lang", F.concat(F.lit(" "), F.upper("lang")), "source", F.concat("source", F.lit("\t")))
    meta = F.struct(F.concat(F.lit(" "), F.col("lang")).alias("type"), F.concat(F.col("source"), F.lit("\n")).alias("level"), F.struct(titles.alias("title")).alias("supporting_facts"))
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.array("lang").alias("golden_answers"), meta.alias("metadata"))
    good = qa.strictly(raw, qa.metadata_error(F.col("metadata")))
    rows = qa.canonical(good, "hotpotqa", "id", "train", qa.multi_hop_metadata(F.col("metadata")), normalize_id=True)
    return rows.select("uid", "metadata.type", "metadata.level", F.array_join("metadata.supporting_titles", "|").alias("titles"))


@query("SELECT doc_id, replace(lower(text), 'ß', 'ss') = replace(lower(upper(text)), 'ß', 'ss') AS same FROM documents")
def casefolded_spellings(spark, sf_dir):
    """Texts, some with a letter whose upper case has two letters, and their upper case: both spellings fold to one key."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (tx.casefold("text") == tx.casefold(F.upper("text"))).alias("same"))


@query(f"WITH {EVENTS_SQL} SELECT conv_id FROM e WHERE infos = searches")
def consistent_trajectories(spark, sf_dir):
    n = trajectory.search_count(F.col("events"))
    rows = _events(spark, sf_dir).withColumn("search_count", n).where(trajectory.consistent(F.col("events"), F.col("search_count")))
    return assembly.consistent_only(rows).select("conv_id")
