"""Statistics over scored rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.operators import filters as P
from chatmill.operators import joins as J
from chatmill.operators import rollouts as R
from chatmill.operators import stats as ST
from chatmill.plans.tables import rollouts


def near(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query(
    "group_reward_stats",
    """SELECT user_id AS prompt_id, count(*) AS n, round(avg(value), 6) AS mean_reward, round(stddev_pop(value), 6) AS std_reward, min(value) AS min_reward, max(value) AS max_reward FROM events GROUP BY 1""",
)
def group_reward_stats(spark, sf):
    """AGG7."""
    g = R.group_reward_stats(rollouts(spark, sf))
    return g.select("prompt_id", "n", near("mean_reward"), near("std_reward"), "min_reward", "max_reward")


def _adv(expr):
    return f"""SELECT event_id AS rollout_id, user_id AS prompt_id, round({expr}, 9) AS advantage FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s FROM events)"""


@query("advantage_standard", _adv("(value - m) / (s + 1e-8)"))
def advantage_standard(spark, sf):
    """WIN1."""
    return R.grpo_advantage(rollouts(spark, sf)).select("rollout_id", "prompt_id", near("advantage", 9))


@query("advantage_centered", _adv("value - m"))
def advantage_centered(spark, sf):
    return R.grpo_advantage(rollouts(spark, sf), "centered").select("rollout_id", "prompt_id", near("advantage", 9))


_PAIRS = "SELECT event_id AS rollout_id, user_id || '_' || event_type AS prompt_id, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM events"


def _binary(spark, sf):
    """Prompts with a handful of rollouts and 0/1 rewards."""
    r = rollouts(spark, sf)
    return r.select("rollout_id", F.concat_ws("_", "prompt_id", "verifier").alias("prompt_id"), F.when(F.col("reward") > 20, 1.0).otherwise(0.0).alias("reward"), "finish_reason")


@query(
    "zero_std_filter",
    f"WITH p AS ({_PAIRS}), g AS (SELECT prompt_id FROM p GROUP BY 1 HAVING min(reward) < max(reward)) SELECT rollout_id, prompt_id, reward FROM p JOIN g USING (prompt_id)",
)
def zero_std_filter(spark, sf):
    """WIN14."""
    return R.zero_std_filter(_binary(spark, sf), 1.0).select("rollout_id", "prompt_id", "reward")


@query(
    "batch_statistics",
    f"""WITH p AS ({_PAIRS}), g AS (SELECT prompt_id, avg(reward) AS m, min(reward) AS lo, max(reward) AS hi FROM p GROUP BY 1)
 SELECT count(*) AS total_prompts, avg(m) FILTER (WHERE lo < hi) AS percent_solved_mean, count(*) FILTER (WHERE lo = hi) AS filtered_prompts, count(*) FILTER (WHERE lo = hi AND lo = 0) AS filtered_prompts_zero,
  count(*) FILTER (WHERE lo = hi AND lo = 1) AS filtered_prompts_solved, count(*) FILTER (WHERE lo = hi AND lo NOT IN (0, 1)) AS filtered_prompts_nonzero, count(*) FILTER (WHERE m >= 0.5) AS no_resampled_prompts FROM g""",
    approx=["percent_solved_mean"],
)
def batch_statistics(spark, sf):
    """AGG9."""
    return R.batch_statistics(_binary(spark, sf), 1.0, no_resample_rate=0.5)


@query(
    "passrate",
    f"""WITH p AS ({_PAIRS}), g AS (SELECT prompt_id, count(*) AS n, avg(reward) AS r FROM p GROUP BY 1), k AS (SELECT DISTINCT user_id || '_' || t AS prompt_id FROM events, (SELECT unnest(['click', 'refund']) AS t))
 SELECT prompt_id, coalesce(n, 0) AS total_rollouts, coalesce(round(r * n)::BIGINT, 0) AS total_correct, coalesce(r, 0) AS passrate FROM k LEFT JOIN g USING (prompt_id) WHERE coalesce(r, 0) BETWEEN 0 AND 0.5""",
)
def passrate(spark, sf):
    """AGG8 then FLT21; prompts without rollouts have rate 0."""
    users = rollouts(spark, sf).select("prompt_id").distinct().withColumn("t", F.explode(F.array(F.lit("click"), F.lit("refund"))))
    prompts = users.select(F.concat_ws("_", "prompt_id", "t").alias("prompt_id"))
    return P.passrate_between(R.annotate_passrate(prompts, _binary(spark, sf), "prompt_id", "reward"), 0, 0.5)


@query(
    "step_metrics",
    """WITH a AS (SELECT *, length(props) AS n, value - avg(value) OVER (PARTITION BY user_id) AS adv FROM events)
 SELECT avg(value) AS scores, count(*) / 20000 AS real_batch_size_ratio, count(*) FILTER (WHERE value < 20) / count(*) AS unsolved_batch_size_ratio, count(*) / 8 AS total_reward_groups, avg(n) AS sequence_lengths,
  min(n) AS sequence_lengths_min, max(n) AS sequence_lengths_max, coalesce(avg(n) FILTER (WHERE value = 0), 0) AS sequence_lengths_unsolved, coalesce(avg(n) FILTER (WHERE value = 20), 0) AS sequence_lengths_solved,
  avg((event_type <> 'error')::INTEGER) AS stop_rate, round(avg(adv), 6) AS advantages_mean, round(min(adv), 6) AS advantages_min, round(max(adv), 6) AS advantages_max FROM a""",
    approx=["scores"],
    cast={"sequence_lengths_min": "INTEGER", "sequence_lengths_max": "INTEGER"},
)
def step_metrics(spark, sf):
    """AGG10."""
    a = R.grpo_advantage(rollouts(spark, sf).withColumn("length", F.length("props")), "centered")
    m = R.step_metrics(a, 20.0, 20000, 8)
    rounded = {c: F.round(F.col(c) + 0.0, 6) for c in ("advantages_mean", "advantages_min", "advantages_max")}
    return m.withColumns(rounded)


@query(
    "per_verifier_metrics",
    "SELECT event_type AS verifier, avg(value) AS mean_reward, avg((value > 0)::INTEGER) AS correct_rate FROM events GROUP BY ROLLUP (event_type)",
    approx=["mean_reward", "correct_rate"],
)
def per_verifier_metrics(spark, sf):
    """AGG11."""
    return R.per_verifier_metrics(rollouts(spark, sf))


_CALLS = """c AS (SELECT event_type AS tool, value > 5 AS ok, value / 10 AS runtime FROM events WHERE event_type <> 'view'
 UNION ALL SELECT 'search', user_id % 2 = 0, 0.5 FROM events WHERE event_type = 'click'), n AS (SELECT count(*) AS n FROM events)"""


@query(
    "tool_statistics",
    f"""WITH {_CALLS}, g AS (SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS f, sum(runtime) AS rt FROM c GROUP BY ROLLUP (tool) UNION ALL SELECT 'browser', 0, 0, 0)
 SELECT tool AS tool_name, calls / n AS avg_calls_per_rollout, CASE WHEN calls > 0 THEN f / calls ELSE 0 END AS failure_rate, CASE WHEN calls > 0 THEN rt / calls ELSE 0 END AS avg_runtime FROM g, n""",
    approx=["avg_calls_per_rollout", "failure_rate", "avg_runtime"],
)
def tool_statistics(spark, sf):
    """AGG12: rollouts without calls count in the denominator, unused tools are listed."""
    call = lambda name, ok, rt: F.struct(name.alias("tool_name"), ok.alias("success"), rt.alias("runtime"))
    own = call(F.col("event_type"), F.col("value") > 5, F.col("value") / 10)
    search = call(F.lit("search"), F.col("user_id") % 2 == 0, F.lit(0.5))
    none = F.array().cast("array<struct<tool_name:string,success:boolean,runtime:double>>")
    calls = F.when(F.col("event_type") == "view", none).when(F.col("event_type") == "click", F.array(own, search)).otherwise(F.array(own))
    return R.tool_statistics(table(spark, sf, "events").select(calls.alias("tool_calls")), tools=["browser", "click"])


@query(
    "env_metrics",
    """SELECT event_type AS env, 'k' AS key, avg((props::JSON->>'$.k')::DOUBLE) AS mean FROM events GROUP BY 1 UNION ALL SELECT event_type, 'value', avg(value) FROM events GROUP BY 1""",
    approx=["mean"],
)
def env_metrics(spark, sf):
    """AGG13."""
    info = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("note"), F.lit("text")))
    return R.env_metrics(table(spark, sf, "events").select(F.col("event_type").alias("env"), info.alias("info")), "env", "info")


@query(
    "rubric_metrics",
    """WITH w AS (SELECT l_returnflag = 'A' AS ev, (l_linenumber % 3) * (l_quantity - 25) AS w FROM lineitem)
 SELECT avg(w) FILTER (WHERE ev) AS avg_evolving_reward, stddev_pop(w) FILTER (WHERE ev) AS std_evolving_reward, avg(w) FILTER (WHERE NOT ev) AS avg_persistent_reward, stddev_pop(w) FILTER (WHERE NOT ev) AS std_persistent_reward FROM w""",
    approx=["avg_evolving_reward", "std_evolving_reward", "avg_persistent_reward", "std_persistent_reward"],
)
def rubric_metrics(spark, sf):
    """AGG14."""
    li = table(spark, sf, "lineitem")
    return R.rubric_metrics(li.select(F.when(F.col("l_returnflag") == "A", "evolving").otherwise("persistent").alias("type"), (F.col("l_linenumber") % 3).alias("score"), (F.col("l_quantity") - 25).alias("weight")))


@query(
    "merge_metrics",
    """SELECT event_type, avg(value) AS value, arg_max(props, event_id) AS props FROM events GROUP BY 1""",
    approx=["value"],
)
def merge_metrics(spark, sf):
    """AGG15: numbers averaged, text of the last step."""
    return R.merge_metrics(table(spark, sf, "events"), "event_type", "event_id", number="value", text="props")


@query(
    "merge_metric_lists",
    """WITH e AS (SELECT event_type, event_id, unnest([user_id, event_id % 7]) AS v, unnest([0, 1]) AS i FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id, i) - 1 AS rank FROM e)
 SELECT event_type, rank // 1000 AS part, count(*) AS n, sha256(string_agg(v::VARCHAR, ',' ORDER BY rank)) AS list FROM r GROUP BY 1, 2""",
    cast={"part": "BIGINT"},
)
def merge_metric_lists(spark, sf):
    """AGG15: lists concatenated in step order, in parts of 1 000; one event type has a large share of all rows."""
    df = table(spark, sf, "events").select("event_type", "event_id", F.array(F.col("user_id").cast("long"), F.col("event_id") % 7).alias("v"))
    parts = R.merge_metric_lists(df, "event_type", "event_id", "v", 1000)
    return parts.select("event_type", "part", F.size("v").cast("long").alias("n"), F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("list"))


@query(
    "masked_mean",
    """SELECT sum(l_quantity * m) / nullif(sum(m), 0) AS masked_mean FROM (SELECT l_quantity, (l_returnflag = 'R')::INTEGER AS m FROM lineitem)""",
)
def masked_mean(spark, sf):
    """AGG26 over a long table."""
    return R.masked_mean_long(table(spark, sf, "lineitem").withColumn("m", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "m")


@query(
    "masked_mean_rows",
    """SELECT vec_id, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: x::DOUBLE)) / nullif(len(list_filter(embedding, lambda x: x > 0)), 0), 0), 6) AS masked_mean FROM embeddings""",
)
def masked_mean_rows(spark, sf):
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(R.masked_mean(F.col("embedding"), mask), 6).alias("masked_mean"))


@query(
    "token_counts",
    f"""SELECT lang, source, sum(greatest({S.n_words('text')} - 1, 0))::BIGINT AS tokens FROM documents GROUP BY ALL""",
)
def token_counts(spark, sf):
    """AGG27: the first position of a response does not count."""
    d = table(spark, sf, "documents").withColumn("mask", F.transform(X.words(F.col("text")), lambda w: F.lit(1)))
    return R.token_counts(d, ["lang", "source"], "mask")


@query(
    "baseline_projections",
    """WITH b AS (SELECT user_id, event_type AS layer, avg(value) AS b FROM events GROUP BY 1, 2)
 SELECT layer, count(*) AS prompts, avg(b) AS mean, stddev_pop(b) AS std, min(b) AS min, max(b) AS max FROM b GROUP BY 1""",
    approx=["mean", "std", "min", "max"],
)
def baseline_projections(spark, sf):
    """AGG24."""
    b = R.baseline_projections(table(spark, sf, "events"), "user_id", "event_type", "value")
    return R.layer_summary(b, "event_type").withColumnRenamed("event_type", "layer")


@query(
    "baseline_filter",
    """WITH b AS (SELECT user_id, avg(value) AS baseline FROM events WHERE event_type = 'view' GROUP BY 1), j AS (SELECT event_id, event_id // 64 AS pack, value - baseline AS diff, baseline IS NULL AS missing FROM events LEFT JOIN b USING (user_id)),
 k AS (SELECT *, coalesce(diff < -5, false) AS hit, floor(count(*) OVER (PARTITION BY pack) * 0.25::DOUBLE) AS quota FROM j),
 r AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY hit DESC, diff NULLS FIRST, event_id) AS rank FROM k)
 SELECT event_id, pack, missing AS missing_baseline, hit AND rank <= quota AS removed FROM r""",
)
def baseline_filter(spark, sf):
    """JN16."""
    ev = table(spark, sf, "events")
    base = ev.filter("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("baseline"))
    r = ev.select("event_id", "user_id", "value", F.floor(F.col("event_id") / 64).alias("pack"))
    return J.baseline_filter(r, base, "user_id", "value", "pack", "event_id", -5.0, 0.25).select("event_id", "pack", "missing_baseline", "removed")


@query(
    "rubric_update_rates",
    """SELECT avg((quality IS NOT NULL)::INTEGER) AS valid_rate, avg(3) FILTER (WHERE quality IS NOT NULL) AS avg_ground_truths, avg(quality) AS avg_new, avg(toxic) AS avg_active, count(*) FILTER (WHERE quality IS NULL) AS skipped
 FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rubric_update_rates(spark, sf):
    """AGG29."""
    from chatmill.plans.tables import labelled_docs

    return R.rubric_update_rates(labelled_docs(spark, sf).withColumn("three", F.lit(3)), "quality", "three", "toxic")


@query(
    "rollouts_with_prompts",
    """SELECT event_id AS rollout_id, c_custkey AS index, value AS reward, c_name AS query, c_mktsegment AS ground_truth FROM events JOIN customer ON user_id = c_custkey""",
)
def rollouts_with_prompts(spark, sf):
    """JN12: prompts by index, users with very many rollouts served by broadcast."""
    r = table(spark, sf, "events").select(F.col("event_id").alias("rollout_id"), F.col("user_id").alias("index"), F.col("value").alias("reward"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("index"), F.col("c_name").alias("query"), F.col("c_mktsegment").alias("ground_truth"))
    counts = r.groupBy("index").agg(F.count("*").alias("n"))
    return J.rollouts_with_prompts(r, p, "index", counts).drop("n")


@query("keep_stop_only", "SELECT event_id AS rollout_id, value AS reward FROM events WHERE event_type <> 'error'")
def keep_stop_only(spark, sf):
    """FLT26."""
    return P.keep_stop_only(rollouts(spark, sf)).select("rollout_id", "reward")


@query(
    "keep_passed_tests",
    """WITH t AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag <> 'R') >= 0.8 * count(*))
 SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN t USING (l_orderkey) WHERE l_returnflag <> 'R'""",
)
def keep_passed_tests(spark, sf):
    """JN19 in long form: line items are tests of an order, returned ones failed."""
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_returnflag") != "R").alias("passed"))
    return J.passed_tests(r, "l_orderkey").drop("passed")


@query(
    "eval_summary",
    """SELECT user_id AS model, round(max((props::JSON->>'$.k')::DOUBLE / 100) FILTER (WHERE event_type = 'click'), 4) AS click, round(max((props::JSON->>'$.k')::DOUBLE) FILTER (WHERE event_type = 'view'), 4) AS view
 FROM (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def eval_summary(spark, sf):
    """AGG25 over the last result of a task per model."""
    from chatmill.operators.ordering import first_per_key

    last = first_per_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"], keep="last")
    return ST.eval_summary(last, [("click", "$.k", True), ("view", "$.k", False)], "props", "event_type", "user_id").withColumnRenamed("user_id", "model")
