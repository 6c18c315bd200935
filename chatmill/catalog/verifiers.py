"""Verifier jobs over completion tables derived from the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import constraints as K
from chatmill.functions import text as X
from chatmill.functions import verifiers as V
from chatmill.operators import scoring as SC
from chatmill.plans.tables import documents, turns

# -- answers with numbers, tags and lengths ---------------------------------------------------------


def _completions(spark, sf):
    """Orders as completions: reasoning, an answer in tags, a final number."""
    o = table(spark, sf, "orders")
    price = F.format_string("%.2f", "o_totalprice")
    text = F.concat(
        F.lit("<think>about 1,234 maybe "), F.col("o_orderpriority"), F.lit("</think> <answer>The "), F.col("o_orderpriority"), F.lit("!</answer> it is "),
        F.format_number("o_totalprice", 2), F.lit(". The answer is: a "), F.col("o_orderstatus"),
    )
    return o.select("o_orderkey", text.alias("prediction"), price.alias("price"), "o_orderpriority", "o_orderstatus", "o_custkey")


_TEXT = "'<think>about 1,234 maybe ' || o_orderpriority || '</think> <answer>The ' || o_orderpriority || '!</answer> it is ' || format('{:,.2f}', o_totalprice) || '. The answer is: a ' || o_orderstatus"


@query(
    "score_rule_verifiers",
    f"""SELECT o_orderkey, (o_orderkey % 2 = 0)::INTEGER::DOUBLE AS gsm8k, (o_orderkey % 3 = 0)::INTEGER::DOUBLE AS flan, (o_orderkey % 5 < 3)::INTEGER::DOUBLE AS string_matcher,
  1 - abs(length({_TEXT}) - (80 + o_orderkey % 50)) / 100.0 AS max_length, CASE WHEN length({_TEXT}) < 80 + o_orderkey % 50 THEN 1.0 ELSE 1 - (length({_TEXT}) - (80 + o_orderkey % 50)) / 100.0 END AS up_to_max_length, 0.0 AS passthrough FROM orders""",
    cast={"passthrough": "DOUBLE"},
)
def score_rule_verifiers(spark, sf):
    """VER1, VER6, VER7, VER12–VER14 on every completion; labels are right for a known part of the rows."""
    c, k = _completions(spark, sf), F.col("o_orderkey")
    p, n = F.col("prediction"), F.length("prediction")
    target = (F.lit(80) + k % 50).cast("string")
    # the last digits-only run of "…,ddd.dd. The answer is: a X" is the price itself
    return c.select(
        "o_orderkey",
        V.gsm8k(p, F.when(k % 2 == 0, F.col("price")).otherwise("0")).alias("gsm8k"),
        V.flan(p, F.when(k % 3 == 0, F.concat(F.lit("the "), F.lower("o_orderstatus"), F.lit("."))).otherwise("none")).alias("flan"),
        V.string_matcher(p, F.when(k % 5 < 3, F.col("o_orderpriority")).otherwise("other")).alias("string_matcher"),
        V.max_length(p, target, n, 100).alias("max_length"),
        V.up_to_max_length(p, target, n, 100).alias("up_to_max_length"),
        V.passthrough(p, target).alias("passthrough"),
    )


@query(
    "score_job",
    """WITH s AS (SELECT o_orderkey, 10.0 * (o_orderkey % 2 = 0)::INTEGER AS g, 10.0 * 0.5 * (o_orderkey % 3 = 0)::INTEGER AS f FROM orders)
 SELECT o_orderkey, (g + f)::DOUBLE AS reward, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS n_rewards FROM (SELECT o_orderkey, g, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE f END AS f FROM s)""",
)
def score_job(spark, sf):
    """Dispatch over (verifier, label) arrays with weights; unknown verifiers are skipped (VER20 alias included)."""
    c, k = _completions(spark, sf), F.col("o_orderkey")
    labels = F.array(F.when(k % 2 == 0, F.col("price")).otherwise("0"), F.when(k % 3 == 0, F.lower("o_orderstatus")).otherwise("none"))
    names = F.array(F.lit("GSM8K"), F.when(k % 7 == 0, "unheard_of").otherwise("choice"))
    df = c.withColumns({"ground_truth": labels, "dataset": names})
    scored = SC.score(df, mult=10.0, weights={"choice": 0.5}, verifiers=V.registry("choice=flan"), use=["gsm8k", "choice"])
    return scored.select("o_orderkey", "reward", F.size("rewards").alias("n_rewards"))


@query(
    "per_verifier_rewards",
    """WITH r AS (SELECT 'gsm8k' AS verifier, (o_orderkey % 2 = 0)::INTEGER AS r FROM orders UNION ALL SELECT 'flan', (o_orderkey % 3 = 0)::INTEGER FROM orders)
 SELECT verifier, avg(r) AS mean_reward, avg((r > 0)::INTEGER) AS correct_rate FROM r GROUP BY ROLLUP (verifier)""",
)
def per_verifier_rewards(spark, sf):
    """AGG11 over the score job's rewards."""
    from chatmill.operators.rollouts import per_verifier_metrics

    c, k = _completions(spark, sf), F.col("o_orderkey")
    labels = F.array(F.when(k % 2 == 0, F.col("price")).otherwise("0"), F.when(k % 3 == 0, F.lower("o_orderstatus")).otherwise("none"))
    df = c.withColumns({"ground_truth": labels, "dataset": F.array(F.lit("gsm8k"), F.lit("flan"))})
    scored = SC.score(df, use=["gsm8k", "flan"])
    return per_verifier_metrics(SC.rewards_long(scored, "o_orderkey"))


@query(
    "judge_override",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 1.0 ELSE 0.0 END AS reward FROM orders""",
    cast={"reward": "DOUBLE"},
)
def judge_override(spark, sf):
    """VER21: one verifier for all rows whatever they name."""
    c, k = _completions(spark, sf), F.col("o_orderkey")
    df = c.withColumns({"ground_truth": F.array(F.when(k % 5 < 3, F.col("o_orderpriority")).otherwise("other")), "dataset": F.array(F.lit("gsm8k"))})
    return SC.score(df, use=["gsm8k", "string_matcher"], override="general-string_matcher").select("o_orderkey", "reward")


_F1 = f"""WITH a AS (SELECT conv_id, turn, list_filter(string_split({S.normalise('text')}, ' '), lambda w: w <> '') AS p FROM conversations WHERE role = 'assistant'),
 u AS (SELECT conv_id, turn + 1 AS turn, list_filter(string_split({S.normalise('text')}, ' '), lambda w: w <> '') AS t FROM conversations WHERE role <> 'assistant'),
 j AS (SELECT conv_id, turn, p, t FROM a JOIN u USING (conv_id, turn)),
 pc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS w FROM j) GROUP BY ALL), tc AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(t) AS w FROM j) GROUP BY ALL),
 c AS (SELECT conv_id, turn, sum(least(pc.n, tc.n)) AS same FROM pc JOIN tc USING (conv_id, turn, w) GROUP BY ALL)
 SELECT conv_id, turn, coalesce(2.0::DOUBLE * same / (len(p) + len(t)), 0) AS f1"""


def _replies(spark, sf):
    """Assistant turns with the turn before them."""
    t = turns(spark, sf)
    before = t.filter("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("question"))
    return t.filter("role = 'assistant'").join(before, ["conv_id", "turn"])


@query("score_string_f1", _F1 + " FROM j LEFT JOIN c USING (conv_id, turn)")
def score_string_f1(spark, sf):
    """VER8: reply against the question before it."""
    return _replies(spark, sf).select("conv_id", "turn", V.string_f1(F.col("content"), F.col("question")).alias("f1"))


@query(
    "score_search_f1",
    _F1.replace("SELECT conv_id, turn, coalesce(2.0::DOUBLE * same / (len(p) + len(t)), 0) AS f1", "")
    + """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 0.0 WHEN coalesce(same, 0) = 0 THEN 0.1 ELSE 2.0::DOUBLE * same / (len(p) + len(t)) END AS f1, CASE WHEN turn % 4 = 3 THEN 0.0 ELSE 1.0 END AS exact FROM j LEFT JOIN c USING (conv_id, turn)""",
    cast={"exact": "DOUBLE"},
)
def score_search_f1(spark, sf):
    """VER10 and VER11: answers in finish tags against JSON label lists."""
    r = _replies(spark, sf).filter(F.col("content").isNotNull())
    tagged = F.when(F.col("turn") % 4 == 3, F.col("content")).otherwise(F.concat(F.lit("so <finish>"), F.col("content"), F.lit("</finish> done")))
    f1 = V.re_search_f1(tagged, F.to_json(F.array("question")))
    exact = V.re_search(F.replace(tagged, F.lit("finish"), F.lit("FINISH")), F.to_json(F.array(F.lit("zzz"), F.col("content"))))
    return r.select("conv_id", "turn", f1.alias("f1"), exact.alias("exact"))


@query(
    "score_puzzle",
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE ({S.normalise('text')} = 'nothing')::INTEGER::DOUBLE END AS score FROM documents""",
)
def score_puzzle(spark, sf):
    """VER9."""
    p = F.concat(F.lit("<think>x</think>\n<answer> The "), F.col("text"), F.lit("</answer>"))
    label = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a "), F.upper(F.lit("")), F.col("text"), F.lit("?"))).otherwise("nothing")
    return documents(spark, sf).select("doc_id", V.puzzle(p, label).alias("score"))


@query(
    "score_math",
    """SELECT p_partkey, 1.0 AS boxed, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS dollars, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END AS stated, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END AS strict FROM part""",
    cast={"boxed": "DOUBLE", "dollars": "DOUBLE", "stated": "DOUBLE", "strict": "DOUBLE"},
)
def score_math(spark, sf):
    """VER2 and VER3 on answers written in different notations."""
    n = F.col("p_size").cast("string")
    frac = F.concat(F.lit(r"\dfrac"), F.lit("{"), n, F.lit("}{3}"))
    boxed = F.concat(F.lit(r"we get \boxed{x} then \boxed{"), frac, F.lit("}."))
    dollars = F.concat(F.lit("so $y$ is $z = "), n, F.lit(r"\text{ cm}$"))
    stated = F.concat(F.lit("Final Answer: The final answer is "), n, F.lit(" meters. I hope it is correct."))
    want = lambda k: F.when(F.col("p_size") % k == 0, n).otherwise("none")
    return table(spark, sf, "part").select(
        "p_partkey",
        V.math(boxed, F.concat(F.lit(r"\frac{"), n, F.lit("}{3}"))).alias("boxed"),
        V.math(dollars, want(2)).alias("dollars"),
        V.math(stated, want(3)).alias("stated"),
        V.strict_math(stated, want(3)).alias("strict"),
    )


@query(
    "score_code_results",
    """WITH s AS (SELECT l_orderkey, avg((l_returnflag <> 'R')::INTEGER) AS pass_rate, avg((l_returnflag <> 'R')::INTEGER * (60.0 - l_quantity) / 60.0) AS timed FROM lineitem GROUP BY 1)
 SELECT l_orderkey, pass_rate, CASE WHEN pass_rate < 0.4 OR pass_rate = 0 THEN 0 ELSE timed END AS score FROM s""",
    approx=["pass_rate", "score"],
)
def score_code_results(spark, sf):
    """VER15: results table to score, with threshold and runtime penalty."""
    r = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("passed"), "l_quantity")
    return SC.code_scores(r, "l_orderkey", "passed", "l_quantity", threshold=0.4, max_seconds=60.0)


@query(
    "score_judgements",
    """WITH e AS (SELECT event_id, event_type, (props::JSON->>'$.k')::DOUBLE AS k FROM events)
 SELECT event_id, CASE event_type WHEN 'click' THEN k / 10 WHEN 'view' THEN k WHEN 'error' THEN k WHEN 'signup' THEN CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS score,
  CASE event_type WHEN 'click' THEN k / 100 WHEN 'view' THEN k / 100 WHEN 'error' THEN k WHEN 'signup' THEN 1.0 ELSE 0.0 END AS free FROM e""",
)
def score_judgements(spark, sf):
    """VER16: judgement texts (clean JSON, broken JSON, yes/no) by kind, and the free-text cascade."""
    k = F.get_json_object("props", "$.k")
    by = lambda c, v, e, s, other: F.when(F.col("event_type") == "click", c).when(F.col("event_type") == "view", v).when(F.col("event_type") == "error", e).when(F.col("event_type") == "signup", s).otherwise(other)
    text = by(
        F.concat(F.lit('<think>9</think>```json\n{"REASONING": "ok", "SCORE": '), k, F.lit("}```")),
        F.concat(F.lit('{"REASONING": "line\none", "SCORE": "'), k, F.lit('"}')),
        F.concat(F.lit('{"REASONING": "broken, "SCORE": '), k, F.lit("}")),
        F.when(k.cast("double") > 50, "Final Decision: Yes").otherwise("Final decision: no"),
        F.lit("no score"),
    )
    kind = by(F.lit("general-quality"), F.lit("quality_rubric"), F.lit("safety"), F.lit("web_instruct_general_verifier"), F.lit("factuality"))
    free = by(F.concat(k, F.lit("/100")), F.concat(F.lit("about "), k, F.lit("%")), F.concat(F.lit("score "), k), F.lit("that is Correct"), F.lit("unclear"))
    return table(spark, sf, "events").select("event_id", V.judge_score(kind, text).alias("score"), V.free_text_score(free).alias("free"))


@query(
    "score_rubrics",
    """SELECT l_orderkey, CASE WHEN sum(abs(w)) > 0 THEN sum(s / 2.0 * w) / sum(abs(w)) ELSE 0 END AS score FROM (SELECT l_orderkey, l_linenumber % 3 AS s, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity - 20 END AS w FROM lineitem) GROUP BY 1""",
)
def score_rubrics(spark, sf):
    """VER17."""
    r = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("score"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity") - 20).alias("weight"))
    return SC.rubric_scores(r, "l_orderkey")


@query(
    "combine_rewards",
    """WITH e AS (SELECT event_id, value AS v, (event_type IN ('click', 'view'))::INTEGER::DOUBLE AS f, user_id % 3 <> 0 AS good, event_type = 'error' AS cut FROM events)
 SELECT event_id, CASE WHEN cut THEN -10 WHEN NOT good THEN f ELSE 1 + (2 + v) + f END AS additive, CASE WHEN cut THEN -10 WHEN f = 1 THEN 2 + v ELSE 0 END AS gated FROM e""",
)
def combine_rewards(spark, sf):
    """VER18 and VER19."""
    tagged = F.col("event_type").isin("click", "view")
    text = F.when(tagged, F.lit("x</think>\n<answer>y</answer>")).otherwise("plain")
    f, turns_ = V.format_reward(text), F.array(F.lit(1.0), F.lit(2.0))
    stop = F.when(F.col("event_type") == "error", "length").otherwise("stop")
    add = SC.combine_rewards(F.col("value"), f, turns_, F.col("user_id") % 3 != 0, stop, "sum", True, -10.0)
    gate = SC.combine_rewards(F.col("value"), f, turns_, None, stop, "last", False, -10.0)
    return table(spark, sf, "events").select("event_id", add.alias("additive"), gate.alias("gated"))


@query(
    "judged_pairs",
    """SELECT o_orderkey, CASE WHEN (o_orderkey + o_custkey) % 2 = 0 THEN 'A' ELSE 'B' END AS chosen, CASE WHEN (o_orderkey + o_custkey) % 2 = 0 THEN 'B' ELSE 'A' END AS rejected, o_orderpriority AS comparison,
  o_orderpriority AS explanation, lower(o_orderstatus) AS decision FROM orders""",
)
def judged_pairs(spark, sf):
    """VER23 and VER24: verdict texts to pairs, undoing the display shuffle."""
    o = table(spark, sf, "orders")
    shuffled = (F.col("o_custkey") % 2).cast("int")
    verdict = F.concat(F.lit("Comparison: "), F.col("o_orderpriority"), F.lit("\nPreferred: "), (F.col("o_orderkey") % 2).cast("string"), F.lit("\n"))
    c, r, why = V.judged_pair(verdict, shuffled, F.lit("A"), F.lit("B"))
    e, d = V.prompt_verdict(F.concat(F.lit("Explanation: "), F.col("o_orderpriority"), F.lit("\nDecision: "), F.col("o_orderstatus")))
    return o.select("o_orderkey", c.alias("chosen"), r.alias("rejected"), why.alias("comparison"), e.alias("explanation"), d.alias("decision"))


# -- constraints ------------------------------------------------------------------------------------

_W = S.words("text")
_RULES = [
    ("length_constraints:number_words", {"num_words": 200, "relation": "at least"}, r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) >= 200"),
    ("punctuation:no_comma", {}, "NOT contains(text, ',')"),
    ("punctuation:punctuation_exclamation", {}, "NOT contains(text, '!')"),
    ("letters:letter_counting", {"N": 900, "relation": "less than"}, "len(regexp_extract_all(text, '[a-zA-Z]')) < 900"),
    ("keywords:letter_frequency", {"letter": "e", "let_frequency": 100, "let_relation": "at least"}, "length(lower(text)) - length(replace(lower(text), 'e', '')) >= 100"),
    ("keywords:existence", {"keywords": ["the", "of"]}, "regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)of')"),
    ("keywords:frequency", {"keyword": "er", "frequency": 40, "relation": "less than"}, "len(regexp_extract_all(text, '(?i)er')) < 40"),
    ("paragraphs:paragraphs2", {}, f"len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^{S.WS}]'))) = 2"),
    ("keywords:palindrome", {}, f"len(list_filter({_W}, lambda w: w = reverse(w))) > 0"),
    ("count:lowercase_counting", {"N": 50}, r"len(regexp_extract_all(text, '(?:^|[^\p{L}\p{M}\p{N}_])[a-z]+')) < 0 OR len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))) <= 50"),
    ("startend:quotation", {}, f"starts_with({S.strip('text')}, '\"') AND ends_with({S.strip('text')}, '\"')"),
    ("keywords:exclude_word_harder", {"keyword": "and"}, "NOT contains(text, ' and ')"),
    ("first_word:first_word_answer", {"first_word": "the"}, f"coalesce(lower({_W}[1]) = 'the', false)"),
    ("startend:end_checker", {"end_phrase": "ha."}, f"ends_with(lower({S.strip('text')}), 'ha.')"),
]
_FUNCS = [
    ({"func_name": "verify_keywords", "keyword_list": ["the", "and"]}, "contains(lower(text), 'the') AND contains(lower(text), 'and')"),
    ({"func_name": "validate_word_constraint", "N": 100, "quantifier": "around"}, f"abs({S.n_words('text')} - 100) <= 10"),
    ({"func_name": "verify_letter_frequency", "letter": "z", "N": 3}, "length(text) - length(replace(text, 'z', '')) = 3"),
    ({"func_name": "validate_no_commas"}, "NOT contains(text, ',')"),
    ({"func_name": "verify_keyword_frequency", "word": "The", "N": 2}, r"len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: w = 'the')) = 2"),
    ({"func_name": "validate_two_responses"}, "false"),
    ({"func_name": "validate_uppercase"}, "text = upper(text)"),
    ({"func_name": "validate_paragraphs", "N": 1, "i": 1, "first_word": "T"}, f"NOT contains(text, chr(10) || chr(10)) AND starts_with({S.strip('text')}, 'T')"),
]


def _avg(conditions) -> str:
    return " + ".join(f"coalesce(({c}), false)::INTEGER" for c in conditions)


@query(
    "score_ifeval",
    f"SELECT doc_id, CASE WHEN {S.strip('text')} = '' THEN 0 ELSE ({_avg(r[2] for r in _RULES)}) / {len(_RULES)}.0::DOUBLE END AS score FROM (SELECT doc_id, {S.strip('text')} AS text FROM documents)",
)
def score_ifeval(spark, sf):
    """VER4: share of constraints each document meets."""
    label = json.dumps([json.dumps({"instruction_id": [r[0] for r in _RULES], "kwargs": [r[1] for r in _RULES]})])
    label = json.loads(label)[0]
    rules = [r[0] for r in _RULES]
    return documents(spark, sf).select("doc_id", V.constraints_score(F.col("text"), F.lit("[" + label + "]"), rules).alias("score"))


@query(
    "score_ifeval_functions",
    "SELECT doc_id, " + ", ".join(f"coalesce(({c}), false)::INTEGER::DOUBLE AS f{i}" for i, (_, c) in enumerate(_FUNCS)) + f" FROM (SELECT doc_id, {S.strip('text')} AS text FROM documents)",
)
def score_ifeval_functions(spark, sf):
    """VER5."""
    return documents(spark, sf).select("doc_id", *[V.ifeval_old(F.col("text"), F.lit(json.dumps(a))).alias(f"f{i}") for i, (a, _) in enumerate(_FUNCS)])


@query(
    "constraint_rates",
    "SELECT rule, avg(met) AS rate FROM (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS rule, coalesce(({r[2]}), false)::INTEGER AS met FROM documents" for r in _RULES) + ") GROUP BY 1",
)
def constraint_rates(spark, sf):
    """Share of documents that meet each constraint: rules as rows, one pass over the texts."""
    rows = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.from_json(F.lit(json.dumps(r[1])), K.ARGS).alias("args")) for r in _RULES])
    names = [r[0] for r in _RULES]
    met = documents(spark, sf).select(F.transform(rows, lambda c: F.struct(c["rule"].alias("rule"), K.check(c["rule"], F.col("text"), c["args"], names).alias("met"))).alias("m"))
    flat = met.select(F.explode("m").alias("m")).select("m.*")
    return flat.groupBy("rule").agg(F.avg(F.col("met").cast("double")).alias("rate"))


@query(
    "extract_answers",
    f"""SELECT doc_id, {S.strip('text')} AS answer, text AS question FROM (SELECT doc_id, {S.strip('text')} AS text FROM documents)""",
)
def extract_answers(spark, sf):
    """Final-answer cascade and user-query extraction from rendered chats."""
    t = X.strip(F.col("text"))
    out = F.concat(F.lit("<think>a</think> <answer> "), t, F.lit(" </answer>"))
    chat = F.concat(F.lit("<|user|>\nfirst\n<|assistant|>\nok<eos>\n<|user|>\n"), t, F.lit("\n<|assistant|>\n<think>"))
    last_turn = F.regexp_replace(X.user_query(chat), r"(?s)\Afirst.*<\|user\|>\n", "")
    return documents(spark, sf).select("doc_id", X.final_answer(out).alias("answer"), last_turn.alias("question"))
