"""Conversation filters, converters and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query
from chatmill.functions import text as X
from chatmill.functions import wordlists as L
from chatmill.functions.arrays import last
from chatmill.operators import convert as C
from chatmill.operators import filters as P
from chatmill.operators import stats as ST
from chatmill.operators import templates as T
from chatmill.operators.ordering import first_per_key
from chatmill.plans.tables import chat, collect_messages, turns

KEYWORDS_SQL = r"\b(?:" + "|".join(k.lower() for k in L.SELF_REFERENCE_KEYWORDS) + r")\b"
ANY_SQL = "|".join(k.lower().replace(".", r"\.") for k in L.ANY_ROLE_KEYWORDS)
EMPTY_SQL = f"(text IS NULL OR NOT regexp_matches(text, '[^{S.WS}]'))"
FLAG = "SELECT conv_id, coalesce(bool_or(coalesce({p}, false)), false) AS flagged FROM conversations GROUP BY conv_id"
SELF_SQL = f"role = 'assistant' AND regexp_matches(lower(text), {S.q(KEYWORDS_SQL)})"


def _flagged(predicate):
    return lambda spark, sf: P.flag_conversations(turns(spark, sf), "conv_id", flagged=predicate)


query("drop_keyword_self_reference", FLAG.format(p=SELF_SQL))(_flagged(P.mentions_self_reference))
query("drop_keyword_any_role", FLAG.format(p=f"regexp_matches(lower(text), {S.q(ANY_SQL)})"))(_flagged(P.mentions_keyword))
query("drop_empty_message", FLAG.format(p=EMPTY_SQL))(_flagged(P.is_empty_message))
query("drop_provider_identity", FLAG.format(p=f"role IN ('assistant', 'user') AND (text IS NULL OR regexp_matches(text, {S.q(L.identity_pattern())}))"))(
    _flagged(P.claims_provider_identity(include_user=True))
)


_LONG_KEPT = f"""WITH flags AS (SELECT conv_id, bool_or({EMPTY_SQL} OR ({SELF_SQL})) AS bad FROM conversations GROUP BY conv_id),
 m AS (SELECT c.*, {S.n_words('text')} AS n FROM conversations c JOIN flags f USING (conv_id) WHERE NOT f.bad),
 i AS (SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS turns,
         coalesce(sum(n) FILTER (WHERE role IN ('user', 'assistant')), 0)::BIGINT AS total FROM m GROUP BY conv_id)"""


@query(
    "clean_chat_stats",
    f"""{_LONG_KEPT}
 SELECT * FROM (SELECT count(*) AS num_instances, {S.describe('turns', 'turns')}, {S.describe('total', 'total')},
   {', '.join(f'count(*) FILTER (WHERE total > {t}) AS n_gt_{t}' for t in ST.THRESHOLDS)} FROM i),
 (SELECT {S.describe('n', 'user', "role = 'user'")}, {S.describe('n', 'assistant', "role = 'assistant'")} FROM m)""",
    approx=["turns_mean", "turns_std", "total_mean", "total_std", "user_mean", "user_std", "assistant_mean", "assistant_std"],
)
def clean_chat_stats(spark, sf):
    """AGG1 over conversations that pass FLT1 and FLT3: flags are aggregated per conversation and anti-joined,
    so no conversation is gathered."""
    long = turns(spark, sf)
    flags = P.flag_conversations(long, "conv_id", empty=P.is_empty_message, keyword=P.mentions_self_reference)
    kept = long.join(flags.filter("empty or keyword"), "conv_id", "left_anti")
    return ST.message_stats(kept, "conv_id", X.word_count(F.col("content")).cast("long"))


@query(
    "top_longest_conversations",
    f"""SELECT conv_id, coalesce(sum({S.n_words('text')}) FILTER (WHERE role IN ('user','assistant')), 0)::BIGINT AS total_length,
        count(*) FILTER (WHERE role <> 'system') AS turns FROM conversations GROUP BY conv_id ORDER BY total_length DESC, conv_id LIMIT 100""",
)
def top_longest_conversations(spark, sf):
    from chatmill.operators.ordering import top_k_longest

    lengths = ST.instance_lengths(turns(spark, sf), "conv_id", X.word_count(F.col("content")).cast("long"))
    return top_k_longest(lengths, "total_length", "conv_id", 100)


@query(
    "drop_script_ratio",
    f"""WITH l AS (SELECT conv_id, max_by(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
 SELECT conv_id, length(regexp_replace(t, '[^À-ÿ]', '', 'g')) / length(t)::DOUBLE >= 0.05 AND regexp_matches(t, '[À-ÿ]') AS flagged FROM l""",
)
def drop_script_ratio(spark, sf):
    """FLT5 on the final assistant message, found by an aggregate; the script is Latin letters with marks."""
    final = turns(spark, sf).filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("content", "turn").alias("t"))
    return final.select("conv_id", P.in_script(F.col("t"), 0.05, "À", "ÿ").alias("flagged"))


@query(
    "valid_alternation",
    f"""WITH c AS ({S.chat()}), r AS (SELECT conv_id, list_transform(messages, lambda m: m.role) AS roles FROM c)
 SELECT conv_id, len(list_filter(list_zip(roles, range(len(roles))), lambda z: z[1] <> CASE WHEN z[2] % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 AS ok FROM r""",
)
def valid_alternation(spark, sf):
    roles = F.transform("messages", lambda m: m["role"])
    return chat(spark, sf).select("conv_id", P.valid_alternation(roles, "user", "assistant").alias("ok"))


_RENDER_TAGS = f"""WITH c AS ({S.chat()}), z AS (SELECT conv_id, len(messages) AS n, list_zip(messages, range(len(messages))) AS z FROM c)
 SELECT conv_id, array_to_string(list_transform(z, lambda x: CASE x[1].role
   WHEN 'system' THEN '<|system|>' || chr(10) || x[1].content || chr(10)
   WHEN 'user' THEN '<|user|>' || chr(10) || x[1].content || chr(10)
   ELSE '<|assistant|>' || chr(10) || x[1].content || '<eos>' || CASE WHEN x[2] = n - 1 THEN '' ELSE chr(10) END END), '') || '<|assistant|>' || chr(10) AS rendered FROM z"""


@query("render_chat_tags", _RENDER_TAGS)
def render_chat_tags(spark, sf):
    return chat(spark, sf).select("conv_id", T.render_chat(F.col("messages"), "tags", "<eos>", add_generation_prompt=True).alias("rendered"))


@query(
    "render_chat_im",
    f"""WITH c AS ({S.chat()}), z AS (SELECT conv_id, messages, len(messages) AS n, list_zip(messages, range(len(messages))) AS z FROM c)
 SELECT conv_id, CASE WHEN len(list_filter(messages, lambda m: m.role = 'system')) > 0 THEN '' ELSE '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) END ||
  array_to_string(list_transform(z, lambda x: '<|im_start|>' || x[1].role || chr(10) || x[1].content ||
    CASE x[1].role WHEN 'system' THEN ' You do not currently have access to any functions. <functions></functions><|im_end|>' || chr(10)
     WHEN 'user' THEN '<|im_end|>' || chr(10) ELSE CASE WHEN x[2] = n - 1 THEN '<eos>' ELSE '<|im_end|>' || chr(10) END END), '') AS rendered FROM z""",
)
def render_chat_im(spark, sf):
    return chat(spark, sf).select("conv_id", T.render_chat(F.col("messages"), "im", "<eos>", default_system="Be brief.").alias("rendered"))


@query(
    "render_chat_role_labels",
    f"""WITH c AS ({S.chat()}) SELECT conv_id, array_to_string(list_transform(messages, lambda m: upper(m.role[1]) || m.role[2:] || ': ' || m.content), chr(10) || chr(10)) || '<eos>' AS rendered FROM c""",
)
def render_chat_role_labels(spark, sf):
    return chat(spark, sf).select("conv_id", T.render_chat(F.col("messages"), "role_labels", "<eos>").alias("rendered"))


@query(
    "messages_to_text",
    f"""WITH c AS ({S.chat()}), f AS (SELECT conv_id, list_filter(messages, lambda m: m.content <> '') AS messages FROM c)
 SELECT conv_id, array_to_string(list_transform(messages, lambda m: upper(m.role[1]) || m.role[2:] || ': ' || m.content), chr(10) || chr(10)) AS labels,
   array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10)) AS lines,
   array_to_string(list_transform(messages, lambda m: CASE WHEN m.role = 'user' THEN 'User A: ' ELSE 'User B: ' END || {S.strip('m.content')}), chr(10)) AS sides FROM f""",
)
def messages_to_text(spark, sf):
    return chat(spark, sf).select("conv_id", *[C.messages_to_text("messages", s).alias(s) for s in ("labels", "lines", "sides")])


@query(
    "split_prompt",
    f"""WITH c AS ({S.chat()}), p AS (SELECT conv_id, CASE WHEN len(messages) > 1 AND messages[-1].role = 'assistant' THEN messages[:-2] ELSE messages END AS p FROM c),
 o AS (SELECT conv_id, [{{'role': 'system', 'content': 'Answer shortly.'}}] || CASE WHEN p[1].role = 'system' THEN p[2:] ELSE p END AS p FROM p)
 SELECT conv_id, len(p)::INTEGER AS n_prompt, array_to_string(list_transform(p, lambda m: m.role || ': ' || m.content), chr(10)) AS raw_prompt FROM o""",
)
def split_prompt(spark, sf):
    p = chat(spark, sf).withColumn("p", C.split_prompt("messages", system_override="Answer shortly."))
    return p.select("conv_id", F.size("p").alias("n_prompt"), C.messages_to_text("p", "lines").alias("raw_prompt"))


@query(
    "append_turn_alternating",
    f"""WITH c AS ({S.chat()}), t AS (SELECT conv_id, list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m: m.content) AS t FROM c),
 e AS (SELECT conv_id, t[:len(t) - len(t) % 2] || ['done'] AS t FROM t)
 SELECT conv_id, array_to_string(list_transform(list_zip(t, range(len(t))), lambda z: CASE WHEN z[1] = 'done' AND z[2] = len(t) - 1 THEN 'assistant' WHEN z[2] % 2 = 0 THEN 'user' ELSE 'assistant' END || ': ' || z[1]), chr(10)) AS dialogue FROM e""",
)
def append_turn_alternating(spark, sf):
    """CNV6 then CNV8."""
    t = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: m["content"])
    df = chat(spark, sf).withColumn("t", t).withColumn("m", C.from_alternating_list("t"))
    return df.select("conv_id", C.messages_to_text(C.append_turn("m", "assistant", F.lit("done")), "lines").alias("dialogue"))


@query(
    "from_transcript",
    f"""WITH c AS ({S.chat()}), u AS (SELECT conv_id, list_filter(messages, lambda m: m.role <> 'system') AS m FROM c),
 x AS (SELECT conv_id, m, list_filter(list_zip(m, range(len(m))), lambda z: z[1].role = CASE WHEN z[2] % 2 = 0 THEN 'user' ELSE 'assistant' END) AS good FROM u)
 SELECT conv_id, array_to_string(list_transform(list_zip(m[:len(m) - len(m) % 2], range(len(m) - len(m) % 2)), lambda z: z[1].role || '=' ||
   CASE WHEN z[2] = len(m) - 2 + 1 - len(m) % 2 AND len(m) % 2 = 1 THEN z[1].content || chr(10) || chr(10) || 'Human: ' || m[-1].content ELSE z[1].content END), '|') AS dialogue
 FROM x WHERE len(good) = len(m)""",
)
def from_transcript(spark, sf):
    """Alternating conversations written as a flat transcript and split again (CNV7); a trailing user
    turn has no partner and stays in the text."""
    spoken = F.filter("messages", lambda m: m["role"] != "system")
    df = chat(spark, sf).withColumn("m", spoken)
    ok = F.size("m") == F.size(F.filter(F.transform("m", lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b))
    flat = F.array_join(
        F.transform("m", lambda m: F.concat(F.when(m["role"] == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), m["content"])), ""
    )
    parsed = df.filter(ok).withColumn("flat", flat).withColumn("p", C.from_transcript("flat"))
    return parsed.select("conv_id", F.array_join(F.transform("p", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("dialogue"))


@query(
    "think_roundtrip",
    """WITH p AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS question, min_by(text, turn) FILTER (WHERE role = 'assistant') AS reasoning,
      max_by(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id)
 SELECT conv_id, '<think>' || reasoning || '</think><answer>' || answer || '</answer>' AS built, answer AS ground_truth, true AS is_think_answer,
   trim('<think>' || reasoning || '</think>' || chr(10) || answer) AS removed,
   chr(10) || reasoning || chr(10) || chr(10) || answer AS plain FROM p WHERE question <> '' AND reasoning <> '' AND answer <> ''""",
)
def think_roundtrip(spark, sf):
    """CNV16 build, FLT6 check, CNV17 removal, CNV18 stripping."""
    t = turns(spark, sf)
    of = lambda r, agg: agg(F.when(F.col("role") == r, F.col("content")), F.when(F.col("role") == r, F.col("turn")))
    p = t.groupBy("conv_id").agg(of("user", F.min_by).alias("question"), of("assistant", F.min_by).alias("reasoning"), of("assistant", F.max_by).alias("answer"))
    built = P.keep_think_format(C.think_from_parts(p, "question", "reasoning", "answer"), "think_answer")
    content = last(F.col("messages"))["content"]
    return built.select(
        "conv_id",
        content.alias("built"),
        "ground_truth",
        content.rlike(P.THINK_ANSWER).alias("is_think_answer"),
        last(C.remove_answer("messages"))["content"].alias("removed"),
        C.strip_special_tokens(content).alias("plain"),
    )


@query(
    "fill_placeholders",
    f"""WITH c AS ({S.chat()}), f AS (SELECT conv_id, CASE WHEN len(list_filter(messages, lambda m: m.role = 'system')) > 0 THEN messages ELSE [{{'role': 'system', 'content': 'I am Milo.'}}] || messages END AS m FROM c)
 SELECT conv_id, len(m)::INTEGER AS n, array_to_string(list_transform(m, lambda x: x.role || ': ' || replace(x.content, 'the', 'Milo')), chr(10)) AS filled FROM f""",
)
def fill_placeholders(spark, sf):
    m = C.fill_placeholders("messages", {"the": "Milo", "unused": None}, system="I am the.")
    return chat(spark, sf).withColumn("m", m).select("conv_id", F.size("m").alias("n"), C.messages_to_text("m", "lines").alias("filled"))


@query(
    "from_pair_first_exchange",
    """WITH p AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS prompt, min_by(text, turn) FILTER (WHERE role = 'assistant') AS completion FROM conversations GROUP BY conv_id)
 SELECT conv_id, 'user: ' || prompt || chr(10) || 'assistant: ' || completion AS dialogue,
  CASE WHEN prompt LIKE '%' || chr(10) OR rtrim(prompt, ' ' || chr(10) || chr(9)) LIKE '%:' THEN prompt ELSE prompt || chr(10) END AS prompt_line
 FROM p WHERE prompt IS NOT NULL AND completion IS NOT NULL""",
)
def from_pair_first_exchange(spark, sf):
    """CNV1 dispatch over (prompt, completion) with CNV10."""
    t = turns(spark, sf)
    of = lambda r: F.min_by(F.when(F.col("role") == r, F.col("content")), F.when(F.col("role") == r, F.col("turn")))
    p = t.groupBy("conv_id").agg(of("user").alias("prompt"), of("assistant").alias("completion")).filter("prompt is not null and completion is not null")
    return C.to_messages(p).select("conv_id", C.messages_to_text("messages", "lines").alias("dialogue"), C.prompt_newline_rule("prompt").alias("prompt_line"))


@query(
    "from_conversations",
    f"""WITH c AS ({S.chat()}) SELECT conv_id, array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m: m.role || ': ' || m.content), chr(10)) AS dialogue
 FROM c WHERE len(list_filter(messages, lambda m: m.role = 'system')) = 0""",
)
def from_conversations(spark, sf):
    """CNV5: from/value senders renamed; conversations with an unmapped sender (system) dropped."""
    sender = lambda r: F.when(r == "assistant", "gpt").when(r == "user", "human").otherwise(r)
    exported = chat(spark, sf).select(
        "conv_id", F.transform("messages", lambda m: F.struct(sender(m["role"]).alias("from"), m["content"].alias("value"))).alias("conversations")
    )
    out = exported.withColumn("messages", C.from_conversations(on_unknown="drop")).filter("messages is not null")
    return out.select("conv_id", C.messages_to_text("messages", "lines").alias("dialogue"))


@query(
    "drop_identical_completions",
    """WITH v AS (SELECT conv_id FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING count(DISTINCT text) > 1)
 SELECT conv_id, turn FROM conversations JOIN v USING (conv_id) WHERE role = 'assistant'""",
)
def drop_identical_completions(spark, sf):
    return P.drop_identical_completions(turns(spark, sf).filter("role = 'assistant'"), "conv_id", "content").select("conv_id", "turn")


@query(
    "latest_user_turn",
    """SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def latest_user_turn(spark, sf):
    """SET2 with order: one row per id, kept by order."""
    return first_per_key(turns(spark, sf).filter("role = 'user'"), "conv_id", ["turn"], keep="last").select("conv_id", "turn", "content")


@query(
    "prune_messages",
    f"""WITH c AS ({S.chat()}) SELECT conv_id, coalesce(len(list_filter(messages, lambda m: m.role = 'user')), 0)::INTEGER AS n_user, len(messages)::INTEGER AS n FROM c""",
)
def prune_messages(spark, sf):
    m = collect_messages(turns(spark, sf))
    return m.select("conv_id", F.size(F.filter("messages", lambda x: x["role"] == "user")).alias("n_user"), F.size("messages").alias("n"))
