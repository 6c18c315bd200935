"""Structured Streaming over the events table, and batch parsing of service files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatmill import schema as SC
from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.operators import rollouts as R
from chatmill.session import shared_dir
from chatmill.sources import readers, writers
from chatmill.streaming import rollouts as ST
from chatmill.streaming import rubrics as RB


def _work(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark, sf):
    return readers.read_table_stream(spark, sf, "events", table(spark, sf, "events").schema)


def _rollouts(spark, sf, size=8):
    """Eight consecutive events form a prompt."""
    return _events(spark, sf).select(
        F.floor(F.col("event_id") / size).cast("string").alias("prompt_id"), F.col("event_id").alias("rollout_id"), F.col("value").alias("reward"), "ts", "event_type"
    )


def _arriving(spark, sf, n_batches=4):
    """The events as files that arrive in as many micro-batches, dealt by hash, so neighbours come at different times."""
    work = _work(spark, "arriving")
    e = table(spark, sf, "events")
    e.repartition(n_batches, "event_id").write.parquet(work)
    return readers.read_stream(spark, work, e.schema, files_per_trigger=1)


def _one_group(events):
    """The events of a key in a batch, taken as one whole group."""
    return events.withColumns({"group_no": F.lit(0).cast("long"), "complete": F.lit(True)})


@query(
    "stream_advantages",
    """SELECT event_id AS rollout_id, (event_id // 8)::VARCHAR AS prompt_id, true AS complete, round(value - avg(value) OVER (PARTITION BY event_id // 8), 9) AS advantage FROM events""",
)
def stream_advantages(spark, sf):
    """STR1 and STR7: groups of eight samples assembled in keyed state, advantages on completion."""
    work = _work(spark, "stream")
    groups = ST.assemble_groups(_rollouts(spark, sf), 8, "centered")
    ST.run_available(groups, f"{work}/ckpt", f"{work}/out")
    out = spark.read.parquet(f"{work}/out")
    return out.select("rollout_id", "prompt_id", "complete", F.round("advantage", 9).alias("advantage"))


@query(
    "stream_group_counts",
    """SELECT user_id::VARCHAR AS prompt_id, count(*) // 5 AS groups FROM events GROUP BY 1""",
)
def stream_group_counts(spark, sf):
    """STR1 on busy prompts: complete groups of five per user, whatever the arrival order."""
    work = _work(spark, "stream")
    s = _events(spark, sf).select(F.col("user_id").cast("string").alias("prompt_id"), F.col("event_id").alias("rollout_id"), F.col("value").alias("reward"), "ts")
    ST.run_available(ST.assemble_groups(s, 5), f"{work}/ckpt", f"{work}/out")
    return spark.read.parquet(f"{work}/out").groupBy("prompt_id").agg(F.count_distinct("group_no").alias("groups"))


@query(
    "stream_unfinished_groups",
    """SELECT user_id::VARCHAR AS prompt_id, count(*) % 5 AS waiting, sum(event_id)::BIGINT AS ids, count(*) // 5 AS groups FROM events GROUP BY 1 HAVING count(*) % 5 > 0""",
)
def stream_unfinished_groups(spark, sf):
    """STR2 with STR1: groups of five whose samples come in several micro-batches; when a row of long after has moved the
    watermark on, prompts that stay incomplete give their waiting samples as unfinished. Every sample comes out once."""
    work = _work(spark, "unfinished")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("prompt_id"), F.col("event_id").alias("rollout_id"), F.col("value").alias("reward"), "ts")
    e.repartition(3, "rollout_id").write.parquet(f"{work}/in")
    late = e.agg((F.max("ts") + F.expr("interval 8000 days")).alias("ts")).select(F.lit("end").alias("prompt_id"), F.lit(-1).cast(e.schema["rollout_id"].dataType).alias("rollout_id"), F.lit(0.0).alias("reward"), "ts")
    late.coalesce(1).write.mode("append").parquet(f"{work}/in")
    s = readers.read_stream(spark, f"{work}/in", e.schema, files_per_trigger=1)
    ST.run_available(ST.assemble_groups(s, 5, watermark="3650 days"), f"{work}/ckpt", f"{work}/out")
    out = spark.read.parquet(f"{work}/out").groupBy("prompt_id").agg(
        F.count_if(~F.col("complete")).alias("waiting"), F.sum("rollout_id").cast("long").alias("ids"), F.count_distinct(F.when(F.col("complete"), F.col("group_no"))).alias("groups")
    )
    return out.filter("waiting > 0")


@query("stream_length_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def stream_length_filter(spark, sf):
    """STR10 and SRC5."""
    work = _work(spark, "stream")
    s = readers.read_table_stream(spark, sf, "documents", table(spark, sf, "documents").schema)
    ST.run_available(ST.length_filter(s, {"n_chars": 2000}).select("doc_id", "n_chars"), f"{work}/ckpt", f"{work}/out")
    return spark.read.parquet(f"{work}/out")


@query("stream_dedup", "SELECT DISTINCT user_id || '_' || event_type AS epoch_index FROM events")
def stream_dedup(spark, sf):
    """SET6: first arrival of each id within the watermark."""
    work = _work(spark, "stream")
    s = _events(spark, sf).select(F.concat_ws("_", "user_id", "event_type").alias("epoch_index"), F.col("ts").cast("timestamp").alias("ts"))
    ST.run_available(ST.dedup(s, "epoch_index", "3650 days").select("epoch_index"), f"{work}/ckpt", f"{work}/out")
    return spark.read.parquet(f"{work}/out")


@query(
    "stream_step_metrics",
    """SELECT event_type, 0 AS step, avg(value) AS mean_reward, avg((value > 0)::INTEGER) AS correct_rate FROM events GROUP BY ROLLUP (event_type)""",
    approx=["mean_reward", "correct_rate"],
)
def stream_step_metrics(spark, sf):
    """STR6: metrics per micro-batch; the batch number is the step."""
    work = _work(spark, "stream")
    sink = ST.metrics_sink(f"{work}/metrics", lambda b: R.per_verifier_metrics(b, "event_type", "value"))
    ST.run_available(_events(spark, sf), f"{work}/ckpt", sink=sink)
    return spark.read.parquet(f"{work}/metrics")


@query(
    "stream_quota",
    """WITH g AS (SELECT event_id // 4 AS p, bool_or(event_type = 'click') AND bool_or(event_type <> 'click') AS kept FROM events GROUP BY 1)
 SELECT count(*) FILTER (WHERE kept) AS counted, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS filtered, count(*) FILTER (WHERE kept) >= 100 AS "full", 0 AS step FROM g""",
)
def stream_quota(spark, sf):
    """STR3: zero-spread prompts are left out and, with active sampling, do not count. One batch holds whole prompts."""
    work = _work(spark, "stream")
    s = _events(spark, sf).select(F.floor(F.col("event_id") / 4).alias("prompt_id"), (F.col("event_type") == "click").cast("double").alias("reward"))
    ST.run_available(_one_group(s), f"{work}/ckpt", sink=ST.quota_sink(f"{work}/out", 100, True))
    return spark.read.parquet(f"{work}/out/progress")


@query(
    "stream_quota_steps",
    """WITH g AS (SELECT event_id // 4 AS p, min(value) < max(value) AS kept FROM (SELECT event_id, (event_type = 'click')::INTEGER AS value FROM events) GROUP BY 1 HAVING count(*) = 4),
 k AS (SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS filtered FROM g)
 SELECT s AS train_step, least(50, kept - 50 * s) AS n_groups, 4 * least(50, kept - 50 * s) AS n_rollouts, filtered FROM k, range(100000000) r(s) WHERE 50 * s < kept""",
)
def stream_quota_steps(spark, sf):
    """STR2 and STR3 over four micro-batches: prompts are split between batches, the quota of 50 runs through."""
    work = _work(spark, "stream")
    s = _arriving(spark, sf).select(F.floor(F.col("event_id") / 4).cast("string").alias("prompt_id"), F.col("event_id").alias("rollout_id"), (F.col("event_type") == "click").cast("double").alias("reward"), "ts")
    ST.run_available(ST.assemble_groups(s, 4), f"{work}/ckpt", sink=ST.quota_sink(f"{work}/out", 50, True))
    steps = spark.read.parquet(f"{work}/out/rollouts").groupBy("train_step").agg(F.count_distinct("prompt_id", "group_no").alias("n_groups"), F.count("*").alias("n_rollouts"))
    return steps.withColumn("filtered", spark.read.parquet(f"{work}/out/progress").agg(F.max("filtered")).scalar())


@query(
    "stream_exclude_solved",
    """WITH s AS (SELECT user_id FROM events GROUP BY 1 HAVING avg(value) / 30 >= 0.7) SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM s)""",
)
def stream_exclude_solved(spark, sf):
    """STR4: a first pass records solved prompts, a second one anti-joins them."""
    work = _work(spark, "stream")
    sink = ST.solved_sink(f"{work}/solved", 0.7, 30.0, "user_id", "value")
    ST.run_available(_one_group(_events(spark, sf)), f"{work}/c1", sink=sink)
    kept = ST.not_excluded(_events(spark, sf), spark.read.parquet(f"{work}/solved"), "user_id").select("event_id")
    ST.run_available(kept, f"{work}/c2", f"{work}/out")
    return spark.read.parquet(f"{work}/out")


@query(
    "stream_solved_groups",
    """SELECT (event_id // 8)::VARCHAR AS prompt_id FROM events GROUP BY 1 HAVING count(*) = 8 AND avg(value) / 30 >= 0.7""",
)
def stream_solved_groups(spark, sf):
    """STR4 over four micro-batches: a prompt is solved by the mean of its whole group, wherever its samples arrive."""
    work = _work(spark, "stream")
    s = _arriving(spark, sf).select(F.floor(F.col("event_id") / 8).cast("string").alias("prompt_id"), F.col("event_id").alias("rollout_id"), F.col("value").alias("reward"), "ts")
    ST.run_available(ST.assemble_groups(s, 8), f"{work}/ckpt", sink=ST.solved_sink(f"{work}/solved", 0.7, 30.0))
    return spark.read.parquet(f"{work}/solved").select("prompt_id")


@query("stream_staleness", "SELECT event_id, event_id // 1000 AS step FROM events WHERE event_id // 1000 BETWEEN 3 AND 5")
def stream_staleness(spark, sf):
    """STR5: rollouts at most two steps behind step five."""
    work = _work(spark, "stream")
    s = _events(spark, sf).select("event_id", F.floor(F.col("event_id") / 1000).alias("step"))
    ST.run_available(ST.fresh(s, 5, 2), f"{work}/ckpt", f"{work}/out")
    return spark.read.parquet(f"{work}/out")


@query("stream_trace", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 3000 AS shard, 0 AS batch FROM events")
def stream_trace(spark, sf):
    """SNK8 and STR11: rows written so far decide the shard."""
    work = _work(spark, "stream")
    ST.run_available(_events(spark, sf).select("event_id", "value"), f"{work}/ckpt", sink=ST.trace_sink(f"{work}/trace", "event_id", 3000))
    return spark.read.parquet(f"{work}/trace/rows").select("event_id", "shard", "batch")


@query("stream_resume", "SELECT event_id FROM events")
def stream_resume(spark, sf):
    """STR9: a second run on the same checkpoint adds nothing and loses nothing."""
    work = _work(spark, "stream")
    for _ in range(2):
        ST.run_available(_events(spark, sf).select("event_id"), f"{work}/ckpt", f"{work}/out")
    return spark.read.parquet(f"{work}/out")


@query(
    "fix_empty_response",
    """SELECT event_id, CASE WHEN value < 5 AND event_type <> 'error' THEN '2' WHEN value < 5 THEN '' ELSE '7,8' END AS response, CASE WHEN value < 5 AND event_type <> 'error' THEN '1' WHEN value < 5 THEN '' ELSE '1,1' END AS mask FROM events""",
)
def fix_empty_response(spark, sf):
    """STR12."""
    none = F.array().cast("array<int>")
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") < 5, none).otherwise(F.array(F.lit(7), F.lit(8))).alias("response"), F.when(F.col("value") < 5, none).otherwise(F.array(F.lit(1), F.lit(1))).alias("mask"),
        F.array().cast("array<double>").alias("logprobs"), F.when(F.col("event_type") == "error", "length").otherwise("stop").alias("finish_reason"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return e.withColumns(ST.fix_empty("response", "finish_reason", 2)).select("event_id", text("response"), text("mask"))


def _rubric(title, weight):
    return F.struct(title.alias("title"), F.lit("d").alias("description"), F.lit(weight).alias("weight"))


@query(
    "rubric_buffer",
    """SELECT c_custkey::VARCHAR AS query, CASE WHEN c_custkey % 2 = 0 THEN 'n1' ELSE 'b,n1' END || CASE WHEN c_nationkey < 10 THEN ',n2' ELSE '' END AS active,
  CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS inactive FROM customer""",
)
def rubric_buffer(spark, sf):
    """STR8 as a table merge: one buffer row per customer gains rubrics; flat and weak ones go inactive."""
    c = table(spark, sf, "customer").withColumn("query", F.col("c_custkey").cast("string"))
    none = F.array().cast(RB.RUBRICS)
    buffer = c.select("query", F.array(_rubric(F.lit("a"), 1.0), _rubric(F.lit("b"), 1.0)).alias("active"), none.alias("inactive"), none.alias("persistent"))
    fresh = lambda t: F.struct(F.lit(t).alias("title"), F.lit("d").alias("description"))
    empty = F.array().cast("array<struct<title:string,description:string>>")
    new = c.select("query", F.lit(0).alias("position"), F.array(fresh("n1")).alias("positive"), F.when(F.col("c_nationkey") < 10, F.array(fresh("n2"))).otherwise(empty).alias("negative"))
    later = new.withColumn("position", F.lit(1)).withColumn("positive", F.array(fresh("late")))
    # "a" never varies; "b" has the lowest deviation and goes where the cap of two scored rubrics is exceeded
    stats = c.select("query", F.explode(F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(0.4))).alias("t", "std"))
    stats = stats.select("query", F.concat_ws("::", "query", "t").alias("key"), "std")
    out = RB.prune_rubrics(RB.add_rubrics(buffer, new.unionByName(later)), stats, 2)
    titles = lambda col: F.array_join(F.transform(col, lambda r: r["title"]), ",").alias(col)
    return out.select("query", titles("active"), titles("inactive"))


# -- files of a batch service -----------------------------------------------------------------------


@query(
    "batch_results",
    """SELECT o_orderkey || '_hon' AS custom_id, o_orderpriority AS content, 'stop' AS finish_reason, o_custkey AS prompt_tokens, o_orderkey % 100 AS completion_tokens FROM orders
 WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""",
)
def batch_results(spark, sf):
    """SRC4: response lines with blank, broken and content-filtered ones among them."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    choice = F.struct(
        F.when(key % 13 == 0, "content_filter").otherwise("stop").alias("finish_reason"), F.struct(F.lit("assistant").alias("role"), F.col("o_orderpriority").alias("content")).alias("message")
    )
    body = F.struct(F.array(choice).alias("choices"), F.struct(F.col("o_custkey").alias("prompt_tokens"), (key % 100).alias("completion_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.concat(F.lit("20240101-10_"), key, F.lit("_hon")).alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    lines = o.select(F.when(key % 22 == 0, "  ").when(key % 11 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))
    return readers.parse_batch_results(lines)


@query(
    "batch_requests",
    """SELECT o_orderkey::VARCHAR AS custom_id, 'gpt' AS model, 0.5::DOUBLE AS temperature, 'user: ' || o_orderpriority AS dialogue, 'POST' AS method FROM orders""",
)
def batch_requests(spark, sf):
    """SNK5, parsed back."""
    from chatmill.operators.convert import message, messages_to_text

    reqs = writers.batch_requests(table(spark, sf, "orders"), F.col("o_orderkey").cast("string"), F.array(message("user", "o_orderpriority")), "gpt", 0.5)
    schema = "custom_id string, method string, url string, body struct<model:string, messages:array<struct<role:string,content:string>>, temperature:double>"
    r = reqs.select(F.from_json("value", schema).alias("r"))
    return r.select("r.custom_id", "r.body.model", "r.body.temperature", messages_to_text(F.col("r.body.messages"), "lines").alias("dialogue"), "r.method")


@query(
    "sharded_write",
    """SELECT lang AS aspect, count(*) AS n, (count(*) + 99) // 100 AS min_files FROM documents GROUP BY 1""",
)
def sharded_write(spark, sf):
    """SNK4 then SRC3: at most 100 rows per file in a folder per aspect, read back with the folder as tag."""
    work = _work(spark, "shards")
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("aspect"))
    writers.write_sharded(d, work, 100, "aspect")
    back = readers.read_many_with_tag(spark, work, "doc_id long", "aspect", "*.json", "folder")
    files = back.withColumn("aspect", F.regexp_replace("aspect", "^aspect=", "")).groupBy("aspect", F.input_file_name().alias("f")).agg(F.count("*").alias("k"))
    return files.groupBy("aspect").agg(F.sum("k").alias("n"), F.ceil(F.sum("k") / F.greatest(F.lit(100), F.max("k"))).alias("min_files"))


@query(
    "kept_and_removed_files",
    f"SELECT {S.n_words('text')} >= 50 AS kept, count(*) AS n FROM documents GROUP BY 1",
)
def kept_and_removed_files(spark, sf):
    """SNK9."""
    work = _work(spark, "kept")
    writers.write_kept_and_removed(table(spark, sf, "documents"), X.word_count(F.col("text")) >= 50, work)
    return spark.read.parquet(work).withColumn("kept", F.col("kept").cast("boolean")).groupBy("kept").agg(F.count("*").alias("n"))


_SOURCES = [f"src{i}" for i in range(20)]


@query("score_matrix", f"SELECT lang, {', '.join(f"format('{{:.4f}}', avg(n_chars) FILTER (WHERE source = '{s}')) AS {s}" for s in _SOURCES)} FROM documents GROUP BY 1")
def score_matrix(spark, sf):
    """SNK3's matrix, a column for each source."""
    return writers.score_matrix(table(spark, sf, "documents"), "lang", "source", "n_chars", _SOURCES)


@query("conversation_schema", "SELECT conv_id::VARCHAR AS id, count(*) AS n FROM conversations GROUP BY 1")
def conversation_schema(spark, sf):
    """SNK1 then SRC1: conversations written as JSON lines and read with a stated schema."""
    from chatmill.plans.tables import chat

    work = _work(spark, "jsonl")
    writers.write_jsonl(chat(spark, sf).select(F.col("conv_id").cast("string").alias("id"), F.lit("chat").alias("source"), "messages"), work)
    back = readers.read_json(spark, work, SC.CONVERSATION)
    SC.require_messages(back)
    return back.select("id", F.size("messages").cast("long").alias("n"))
