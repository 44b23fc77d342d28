"""Registered queries of sources, sinks, samples and trajectory records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from questlake.functions import text as tx
from questlake.operators import isolation, metrics, qa, resume, retrieval, rollout, sampling, trajectory
from questlake.plans.catalog import KEYED, PROMPT, keyed, query, table
from questlake.session import scratch_path
from questlake.sources import io, publish

# 1 files


def _ordered_file(spark, sf_dir):
    """Documents as JSON lines in the order of their ids, in as many files as Spark writes."""
    path = scratch_path(spark, "lines")
    io.write_jsonl(sampling.in_order(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), path)
    return path


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, sha256(text) AS text_sha256 FROM documents")
def file_order(spark, sf_dir):
    """Lines numbered in the order of their files, which are read in splits."""
    return io.read_jsonl(spark, _ordered_file(spark, sf_dir), "id long, text string", ordinal=True).select("id", "ordinal", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id AS id, r - 1 AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 150")
def evaluation_prefix(spark, sf_dir):
    """The first 150 rows of an evaluation file: the limit is the feature."""
    return io.read_eval(spark, _ordered_file(spark, sf_dir), "id long, text string", 150).select("id", "ordinal")


@query("SELECT id FROM (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 120 AND id % 7 <> 3")
def limit_before_exclusion(spark, sf_dir):
    """The limit counts input rows, those that are excluded afterwards too."""
    rows = io.read_jsonl(spark, _ordered_file(spark, sf_dir), "id long, text string", ordinal=True)
    first = qa.first_rows(rows, 120)
    out = [str(r.id) for r in first.where("id % 7 = 3").select("id").collect()]  # at most 120
    return qa.without_excluded(first.withColumn("id", F.col("id").cast("string")), "id", out).select(F.col("id").cast("long").alias("id"))


FORMS = "(VALUES ('json'), ('parquet'), ('csv')) f(source_split)"


@query(f"SELECT source_split, doc_id, lang, sha256(text) AS text_sha256, n_chars FROM documents, {FORMS}")
def written_and_read(spark, sf_dir):
    """Documents through each format and back as splits of one table."""
    path, schema = scratch_path(spark, "forms"), "doc_id long, text string, lang string, n_chars long"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    io.write_jsonl(rows, f"{path}/json")
    io.write_parquet(rows, f"{path}/parquet")
    io.write_csv(rows.withColumn("text", F.hex("text")), f"{path}/csv")
    read = io.read_splits(spark, {"json": f"{path}/json"}, schema).unionByName(io.read_splits(spark, {"parquet": f"{path}/parquet"}, schema, "parquet"))
    lines = spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("text", F.decode(F.unhex("text"), "UTF-8")).withColumn("source_split", F.lit("csv"))
    return read.unionByName(lines).select("source_split", "doc_id", "lang", F.sha2("text", 256).alias("text_sha256"), "n_chars")


@query("SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_sha256 FROM conversations GROUP BY conv_id")
def messages_written(spark, sf_dir):
    """Conversations as lines of messages, written and read back."""
    path = scratch_path(spark, "messages")
    m = F.struct("turn", "role", F.col("text").alias("content"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    named = F.concat(F.array(F.struct(F.lit("id").alias("role"), F.col("conv_id").cast("string").alias("content"))), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    io.write_messages(rows.select(named.alias("messages")), path)
    back = io.read_jsonl(spark, path, "messages array<struct<role string, content string>>")
    shown = F.transform(F.slice("messages", 2, F.size("messages")), lambda x: F.concat(x["role"], F.lit(":"), x["content"]))
    return back.select(F.get("messages", F.lit(0))["content"].cast("long").alias("conv_id"), F.sha2(F.array_join(shown, "\n"), 256).alias("messages_sha256"))


@query("SELECT 'train' AS name, doc_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'validation', doc_id FROM documents WHERE doc_id % 5 = 0")
def published_outputs(spark, sf_dir):
    """Two outputs that appear as one version, read back by its manifest."""
    path, rows = scratch_path(spark, "published"), table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    publish.publish(spark, path, {"train": rows.where("doc_id % 5 != 0"), "validation": rows.where("doc_id % 5 = 0")}, note={"seed": 123})
    parts = [publish.read_published(spark, path, n).select(F.lit(n).alias("name"), "doc_id") for n in ("train", "validation")]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id, (doc_id % 4)::VARCHAR AS batch FROM documents")
def batches_appended_once(spark, sf_dir):
    """Four batches, two of which come again."""
    path, rows = scratch_path(spark, "batches"), table(spark, sf_dir, "documents").select("doc_id")
    for k in (0, 1, 1, 2, 3, 0):
        publish.append_once(rows.where(f"doc_id % 4 = {k}"), path, k)
    return publish.read_appended(spark, path, "doc_id long")


@query("SELECT doc_id AS uid FROM documents WHERE doc_id % 3 = 1")
def ids_resumed(spark, sf_dir):
    """Completed and skipped ids come from files, as a run that resumes reads them."""
    d, path = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uid")), scratch_path(spark, "ids")
    io.write_ids(d.where("uid % 3 = 0"), f"{path}/completed")
    io.write_ids(d.where("uid % 3 = 2"), f"{path}/skipped")
    done = resume.completed_ids(io.read_ids(spark, f"{path}/completed"))
    return resume.remaining(d, done, io.read_ids(spark, f"{path}/skipped")).select(F.col("uid").cast("long").alias("uid"))


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS text_sha256 FROM documents")
def corpus_read(spark, sf_dir):
    """Documents as a corpus file of ids and contents, read and checked as retrieval reads it."""
    path = scratch_path(spark, "corpus")
    io.write_jsonl(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents")), path)
    return retrieval.read_corpus(spark, path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id FROM documents")
def resumed_output(spark, sf_dir):
    """Half of the rows by one run, the others by one that resumes its output."""
    path, d = f"{scratch_path(spark, 'resumed')}/out", table(spark, sf_dir, "documents").select("doc_id")
    io.open_output(spark, path, resume=False)
    io.append(d.where("doc_id % 2 = 0"), path)
    io.open_output(spark, path, resume=True)
    done = io.read_jsonl(spark, path, "doc_id long").select(F.col("doc_id").alias("uid"))
    io.append(resume.remaining(d.select(F.col("doc_id").alias("uid")), resume.completed_ids(done), done.limit(0)).withColumnRenamed("uid", "doc_id"), path)
    return io.read_jsonl(spark, path, "doc_id long")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def report_read_back(spark, sf_dir):
    """A small result as a report beside its Markdown, read back from the JSON."""
    path, rows = scratch_path(spark, "report"), table(spark, sf_dir, "documents")
    qa.require_columns(rows, ["doc_id", "lang"])
    io.write_report(metrics.distribution(rows, "lang"), path, "Documents by language")
    return spark.read.schema("lang string, n long").option("multiLine", True).json(f"{path}/report.json")


@query("SELECT source_split, read, excluded, read - excluded AS written FROM (SELECT lang AS source_split, count(*) AS read, count(*) FILTER (doc_id % 4 = 1) AS excluded FROM documents GROUP BY lang)")
def quarantined_once(spark, sf_dir):
    """Rows with blank questions go aside; counts come from the one write."""
    asked = F.when(F.col("doc_id") % 4 == 1, F.lit(" \n")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_split"), asked.alias("question"), F.array("lang").alias("golden_answers"))
    return qa.quarantined(rows, qa.row_error(F.col("question"), F.col("golden_answers")), scratch_path(spark, "quarantine"))[2]


# 2 samples and keys


@query("""
    SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || doc_id), doc_id) AS position
    FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id FROM documents)
    QUALIFY position <= CASE split WHEN 'train' THEN 100 ELSE 30 END
""")
def trainer_tables(spark, sf_dir):
    """The first rows of both tables' seeded orders."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train").alias("split"), "doc_id")
    parts = sampling.train_validation(rows, 100, 30, "doc_id")
    w = Window.partitionBy("split").orderBy(*sampling.seeded(42, "doc_id"))
    return parts[0].unionByName(parts[1]).withColumn("position", F.row_number().over(w))


@query("""
    SELECT doc_id, lang, CASE WHEN r <= 1500 THEN 'train' ELSE 'validation' END AS split
    FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 1700
""")
def large_seeded_split(spark, sf_dir):
    """More rows a source than Spark's windows limit by themselves: a cut of the seeded order is found first."""
    return sampling.split_by_source(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 1500, 200, seed=7).select("doc_id", "lang", "split")


@query(f"WITH k AS ({KEYED}), p AS (SELECT * FROM k WHERE doc_id % 10 = 0), c AS (SELECT *, doc_id % 450 AS id FROM k WHERE doc_id % 10 <> 0) SELECT doc_id FROM c WHERE qkey NOT IN (SELECT qkey FROM p) AND id NOT IN (SELECT doc_id % 450 FROM p)")
def two_key_isolation(spark, sf_dir):
    """Rows whose id and whose question are none of the protected ones."""
    k = keyed(spark, sf_dir).select("doc_id", (F.col("doc_id") % 450).alias("id"), "qkey")
    return isolation.isolated(k.where("doc_id % 10 != 0"), k.where("doc_id % 10 = 0"), ["id", "qkey"]).select("doc_id")


PREFIXED = "CASE doc_id % 2 WHEN 0 THEN 'nq' ELSE 'hotpotqa' END AS source", "CASE doc_id % 5 WHEN 0 THEN 'nq_train_' WHEN 1 THEN 'hotpotqa_train_' WHEN 2 THEN 'nq_dev_' WHEN 3 THEN 'hotpotqa_train_' ELSE 'nq_train_' END || doc_id AS id"


@query(f"SELECT id, source FROM (SELECT {', '.join(PREFIXED)} FROM documents) WHERE starts_with(id, source || '_train_')")
def training_ids(spark, sf_dir):
    return qa.training_prefix(table(spark, sf_dir, "documents").selectExpr(*PREFIXED)).select("id", "source")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'asked: ' || text END) AS question_sha256 FROM documents")
def questions_of_prompts(spark, sf_dir):
    """The question of a training row: its own, else what its prompt asks last."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    prompt = F.array(turn("system", F.lit(PROMPT)), turn("user", F.lit("an earlier one")), turn("user", F.concat(F.lit("asked: "), F.col("text"))))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("question"), prompt.alias("prompt"), F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("id")).alias("extra_info"))
    return qa.training_questions(rows).select("id", F.sha2("question", 256).alias("question_sha256"))


@query("""
    WITH n AS (SELECT source, len(string_split_regex(trim(text), '\\s+')) AS n FROM documents)
    SELECT source, count(*) AS rows, round(avg(n), 6) AS mean, quantile_disc(n, 0.5)::BIGINT AS p50, quantile_disc(n, 0.9)::BIGINT AS p90, quantile_disc(n, 0.95)::BIGINT AS p95, quantile_disc(n, 0.99)::BIGINT AS p99, max(n)::BIGINT AS max
    FROM n GROUP BY source
""")
def length_audit(spark, sf_dir):
    """Words a text by source."""
    return metrics.length_audit(table(spark, sf_dir, "documents"), F.size(F.split(tx.normalize_whitespace("text"), " ")), "source")


# 3 texts and trajectories


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(substring(text, 1, 300), '\\s+$', '') ELSE text END AS text FROM documents")
def truncated_passages(spark, sf_dir):
    """Passages of at most 300 characters: the cut is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated("text", 300).alias("text"))


def _turns(spark, sf_dir):
    """Assistant turns with their steps: reasoning of its own for even turns, else think elements in the text; every turn but the last
    searches, every fifth is invalid."""
    conv = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = conv.withColumn("last", last).withColumn("kind", F.when(F.col("turn") % 5 == 0, "invalid").when(F.col("turn") == F.col("last"), "answer").otherwise("search"))
    content = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("<think>no</think><think> "), F.col("text"), F.lit(" </think>x")))
    said = F.struct(content.alias("content"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("r"), F.col("turn").cast("string"))).otherwise(F.lit(" ")).alias("reasoning_content"))
    step = F.struct(F.col("kind").alias("type"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("content"), F.concat(F.lit("\n<information>"), F.col("text"), F.lit("</information>\n")).alias("observation"))
    both = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said"), step.alias("step")))).alias("t"))
    return both.select("conv_id", F.transform("t", lambda x: x["said"]).alias("turns"), F.transform("t", lambda x: x["step"]).alias("steps"))


@query("""
    WITH w AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant'),
    k AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'invalid' WHEN turn = last THEN 'answer' ELSE 'search' END AS kind,
        CASE WHEN turn % 2 = 0 THEN 'r' || turn ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS thought FROM w),
    e AS (SELECT conv_id, turn, concat_ws('|', CASE WHEN thought <> '' THEN 'think=' || thought END, CASE WHEN kind <> 'invalid' THEN kind || '=c' || turn END, CASE WHEN kind = 'search' THEN 'information=' || text END) AS shown FROM k)
    SELECT conv_id, sha256(string_agg(shown, '|' ORDER BY turn) FILTER (shown <> '')) AS events_sha256 FROM e GROUP BY conv_id
""")
def extracted_events(spark, sf_dir):
    events = trajectory.extract_events(F.col("turns"), F.col("steps"))
    shown = F.array_join(F.transform(events, lambda e: F.concat(e["type"], F.lit("="), e["content"])), "|")
    return _turns(spark, sf_dir).select("conv_id", F.sha2(shown, 256).alias("events_sha256"))


def _histories(spark, sf_dir):
    """Conversations as messages, assistants' ones with reasoning."""
    m = F.struct("turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("reasoning_content"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))


CHAT = "'<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '<think>t' || turn || '</think>' ELSE '' END || text || '<|im_end|>' || chr(10)"


@query(f"SELECT conv_id, sha256(string_agg({CHAT}, '' ORDER BY turn)) AS chat_sha256 FROM conversations GROUP BY conv_id")
def chat_rendering(spark, sf_dir):
    return _histories(spark, sf_dir).select("conv_id", F.sha2(trajectory.chat_text(F.col("messages")), 256).alias("chat_sha256"))


@query("""
    WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT conv_id, conv_id % 3 <> 0 AS preserved, conv_id % 4 <> 0 AS matches FROM n JOIN l USING (conv_id) WHERE n > 1
""")
def history_checks(spark, sf_dir):
    """Whether a rendering begins with the one before it, and whether what it adds is the raw turn; every third history is changed, every
    fourth raw turn is."""
    rows = _histories(spark, sf_dir).where("size(messages) > 1")
    before, after = trajectory.chat_text(F.slice("messages", 1, F.size("messages") - 1)), trajectory.chat_text(F.col("messages"))
    last = F.element_at("messages", -1)
    raw = F.concat(F.lit("<|im_start|>"), last["role"], F.lit("\n"), F.when(last["reasoning_content"].isNotNull(), F.concat(F.lit("<think>"), last["reasoning_content"], F.lit("</think>"))).otherwise(""), last["content"], F.lit("<|im_end|>"))
    shown = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("!"), before)).otherwise(before)
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(raw, F.lit("?"))).otherwise(raw)
    return rows.select("conv_id", trajectory.history_is_prefix(shown, after).alias("preserved"), trajectory.turn_matches_template(before, after, said).alias("matches"))


@query("""
    WITH RECURSIVE t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, 128 AS tokens, length(text) % 17 * 128 AS obs,
            CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'answer' WHEN turn % 9 = 7 THEN 'invalid' ELSE 'search' END AS kind FROM conversations WHERE role = 'assistant'),
    w AS (
        SELECT conv_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS searches, NULL::VARCHAR AS reason FROM t WHERE r = 1
        UNION ALL
        SELECT w.conv_id, t.r, CASE WHEN room <= 0 THEN used WHEN kind = 'search' AND used + tokens + obs <= 2048 THEN used + tokens + obs ELSE used + tokens END,
            searches + (room > 0 AND kind = 'search')::INTEGER,
            CASE WHEN room <= 0 THEN 'length_limit' WHEN kind = 'answer' THEN 'answer' WHEN kind = 'invalid' THEN 'invalid_action' WHEN kind = 'search' AND used + tokens + obs > 2048 THEN 'length_limit' END
        FROM (SELECT *, 2048 - used AS room FROM w WHERE reason IS NULL AND r < 5) w JOIN t ON t.conv_id = w.conv_id AND t.r = w.r + 1
    ),
    last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) = 1)
    SELECT conv_id, used AS n, searches::INTEGER AS searches, coalesce(reason, CASE WHEN r < 5 AND used >= 2048 THEN 'length_limit' ELSE 'max_turns' END) AS reason FROM last
""")
def budgeted_rollouts(spark, sf_dir):
    """Conversations as rollouts under a budget of 2048 tokens a response: turns of 128 tokens, observations of some 128 each."""
    conv = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    kind = F.when(F.col("turn") == last, "answer").when(F.col("turn") % 9 == 7, "invalid").otherwise("search")
    turn = F.struct(kind.alias("kind"), F.lit(128).alias("tokens"), (F.length("text") % 17 * 128).alias("observation_tokens"), F.lit(True).alias("ended"), F.lit(None).cast("array<double>").alias("log_probs"))
    rows = conv.select("conv_id", "turn", turn.alias("t")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("turns"))
    got = rollout.budgeted(F.col("turns").cast(f"array<{rollout.TURN}>"), F.lit(10), response=2048)
    return rows.select("conv_id", got.alias("g")).select("conv_id", F.col("g.n").cast("long").alias("n"), "g.searches", "g.reason")


@query("SELECT item_id AS question_id, 'answer' AS termination_reason, 2 AS turns, 1 AS search_count, trim(translate(text, '<>', '')) AS final_answer FROM benchmark")
def visible_agent_loop(spark, sf_dir):
    """The loop without the strict protocol, with a model that is loaded once a worker and asked in batches."""
    docs = table(spark, sf_dir, "documents")
    index = retrieval.build_index(docs)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.translate("text", "<>", "").alias("question"))
    done = rollout.run_agent(asked, rollout.model_function(echo_model), retrieval.search_tool(index, docs), PROMPT, strict=False)
    cols = trajectory.loop_columns(F.col("steps"))
    return done.select("question_id", "termination_reason", cols["turns"].alias("turns"), cols["search_count"].alias("search_count"), cols["final_answer"].alias("final_answer"))


def echo_model():
    """A stand-in for a model: searches for the question, then gives it as the answer."""
    import json

    def said(history: str) -> str:
        messages = json.loads(history)
        kind = "search" if len(messages) == 2 else "answer"
        return f"<{kind}>{messages[1]['content']}</{kind}>"

    return lambda histories: [said(h) for h in histories]


