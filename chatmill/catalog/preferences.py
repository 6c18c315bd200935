"""Preference pairs, best-of-n and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import verifiers as V
from chatmill.operators import annotations as A
from chatmill.operators import joins as J
from chatmill.operators import prefs as R
from chatmill.plans.tables import ratings, turns

ORDER = ["l_orderkey", "l_linenumber", "a2", "a1", "a3", "a4"]


def _binarize_sql(score: str, cond: str) -> str:
    return f"""WITH s AS (SELECT l_partkey AS prompt_id, l_orderkey, l_linenumber, l_quantity AS a1, l_extendedprice AS a2, l_discount AS a3, l_tax AS a4, {score} AS s FROM lineitem),
 k AS (SELECT *, {{'s': s, 'o': -l_orderkey, 'l': -l_linenumber, 'b': -a2, 'a': -a1, 'c': -a3, 'd': -a4}} AS k FROM s),
 g AS (SELECT prompt_id, arg_max(l_orderkey, k) AS chosen_l_orderkey, arg_max(l_linenumber, k) AS chosen_l_linenumber, arg_min(l_orderkey, k) AS rejected_l_orderkey,
  arg_min(l_linenumber, k) AS rejected_l_linenumber, max(s) AS chosen_score, min(s) AS rejected_score, count(*) AS n FROM k GROUP BY 1)
 SELECT * EXCLUDE (n) FROM g WHERE n >= 2 AND chosen_score <> rejected_score AND {cond}"""


@query("binarize_by_aspects", _binarize_sql("(l_quantity + l_discount + l_tax) / 3", "chosen_score >= 10 AND chosen_score - rejected_score >= 5"))
def binarize_by_aspects(spark, sf):
    """WIN6: mean of the kept aspects, minimum score and margin."""
    return R.binarize_by_aspects(
        ratings(spark, sf), "prompt_id", ["a1", "a2", "a3", "a4"], ORDER, ["l_orderkey", "l_linenumber"], ignore=["a2"], min_score=10, margin=5, digits=None
    )


@query("binarize_weighted", _binarize_sql("0.65::DOUBLE * l_quantity + 0.8::DOUBLE * l_extendedprice + -0.4::DOUBLE * l_discount", "true"))
def binarize_weighted(spark, sf):
    """WIN7."""
    w = {"a1": 0.65, "a2": 0.8, "a3": -0.4}
    return R.binarize_weighted(ratings(spark, sf), "prompt_id", w, ORDER, ["l_orderkey", "l_linenumber"], digits=None)


@query(
    "binarize_ranked",
    f"""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P'),
 c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {S.hash_key('7|chosen', 'o_custkey', 'o_orderkey')}) AS r FROM a WHERE rank <= 4),
 x AS (SELECT a.o_custkey, a.o_orderkey, row_number() OVER (PARTITION BY a.o_custkey ORDER BY {S.hash_key('7|rejected', 'a.o_custkey', 'a.o_orderkey')}) AS r FROM a JOIN c ON a.o_custkey = c.o_custkey AND c.r = 1 AND a.o_orderkey <> c.o_orderkey)
 SELECT c.o_custkey, c.o_orderkey::VARCHAR AS chosen_text, x.o_orderkey::VARCHAR AS rejected_text FROM c JOIN x USING (o_custkey) WHERE c.r = 1 AND x.r = 1""",
)
def binarize_ranked(spark, sf):
    """WIN8 over orders as answers ranked by key; pending ones are not valid."""
    a = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("text"))
    return R.binarize_ranked(a, "o_custkey", ["o_orderkey"], "text", F.col("o_orderstatus") != "P", 7)


_SCORES = """s AS (SELECT l_orderkey AS prompt_id, l_linenumber * 1000000 + l_partkey AS cand, 'm1' AS model, l_extendedprice AS score FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber * 1000000 + l_partkey, 'm2', l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber * 1000000 + l_partkey, 'm3', l_discount FROM lineitem),
 b AS (SELECT prompt_id, model, min_by(cand, (-score, cand)) AS best, min_by(cand, (score, cand)) AS worst FROM s GROUP BY 1, 2)"""


def _best(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("cand"),
        F.explode(F.create_map(F.lit("m1"), "l_extendedprice", F.lit("m2"), "l_quantity", F.lit("m3"), "l_discount")).alias("model", "score"),
    )
    return R.best_worst_of_n(li, "prompt_id", "model", "cand", "score")


@query("best_worst_of_n", f"WITH {_SCORES} SELECT * FROM b")
def best_worst_of_n(spark, sf):
    """WIN2."""
    return _best(spark, sf)


@query(
    "majority_vote",
    f"""WITH {_SCORES}, t AS (SELECT prompt_id, best, count(*) AS n, min(model) AS m, min({S.hash_key(3, 'prompt_id', 'model')}) AS h FROM b GROUP BY 1, 2)
 SELECT prompt_id, CASE WHEN max(n) = 1 AND count(*) > 1 THEN min_by(best, h) ELSE min_by(best, (-n, m)) END AS best FROM t GROUP BY 1""",
)
def majority_vote(spark, sf):
    """AGG16."""
    return R.majority_vote(_best(spark, sf), "prompt_id", "model", "best", 3)


@query(
    "longest_per_parent",
    "SELECT conv_id, min_by(turn, (-length(text), turn)) AS turn, max(length(text)) AS len FROM conversations GROUP BY 1",
    cast={"len": "INTEGER"},
)
def longest_per_parent(spark, sf):
    """WIN4."""
    t = turns(spark, sf).select("conv_id", "turn", F.length("content").alias("len"))
    return R.longest_per_parent(t, "conv_id", F.col("len"), "turn")


@query("random_per_parent", f"SELECT o_custkey, min_by(o_orderkey, ({S.hash_key(5, 'o_orderkey')}, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def random_per_parent(spark, sf):
    return R.random_per_parent(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 5, "o_orderkey")


@query(
    "sample_k_models",
    f"""WITH d AS (SELECT o_custkey, o_orderpriority AS model, max(o_orderkey)::VARCHAR AS text FROM orders GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {S.hash_key(4, 'o_custkey', 'model')}, model) AS r FROM d)
 SELECT o_custkey, string_agg(model, ',' ORDER BY r) AS models, string_agg(text, ',' ORDER BY r) AS completions FROM r WHERE r <= 4 GROUP BY 1 HAVING count(*) = 4""",
)
def sample_k_models(spark, sf):
    """WIN13: order priorities stand for models, one completion each."""
    d = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("model")).agg(F.max("o_orderkey").cast("string").alias("text"))
    k = R.sample_k_models(d, "o_custkey", "model", "text", 4)
    return k.select("o_custkey", F.array_join("models", ",").alias("models"), F.array_join("completions", ",").alias("completions"))


@query(
    "prompts_short_of_models",
    "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_models FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 4",
)
def prompts_short_of_models(spark, sf):
    """WIN13: the prompts it leaves out."""
    return R.prompts_short_of_models(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 4)


@query(
    "collect_candidates",
    """WITH d AS (SELECT o_custkey, o_orderpriority AS model, o_orderkey::VARCHAR AS text, o_orderstatus AS query FROM orders),
 r AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY model, text) - 1) // 8 AS part, first(query) OVER (PARTITION BY o_custkey ORDER BY model, text) AS q FROM d)
 SELECT o_custkey, part, string_agg(model, ',' ORDER BY model, text) AS models, string_agg(text, ',' ORDER BY model, text) AS completions, q AS query FROM r GROUP BY o_custkey, part, q""",
)
def collect_candidates(spark, sf):
    """AGG19, in parts of eight."""
    d = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("model"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderstatus").alias("query"))
    c = R.collect_candidates(d, "o_custkey", "model", "text", "query", 8)
    return c.select("o_custkey", "part", F.array_join("models", ",").alias("models"), F.array_join("completions", ",").alias("completions"), "query")


@query(
    "one_side_pairs",
    f"""WITH d AS (SELECT o_custkey, o_orderpriority AS model, max(o_orderkey)::VARCHAR AS text FROM orders GROUP BY 1, 2),
 o AS (SELECT o_custkey, min_by(model, ({S.hash_key(8, 'o_custkey', 'model')}, model)) AS m, min_by(text, ({S.hash_key(8, 'o_custkey', 'model')}, model)) AS t FROM d WHERE model <> '1-URGENT' GROUP BY 1),
 f AS (SELECT o_custkey, text AS ft FROM d WHERE model = '1-URGENT')
 SELECT o_custkey, CASE WHEN {S.hash_unit('8|order', 'o_custkey')} >= 0.5 THEN m || ',1-URGENT' ELSE '1-URGENT,' || m END AS models,
  CASE WHEN {S.hash_unit('8|order', 'o_custkey')} >= 0.5 THEN t || ',' || ft ELSE ft || ',' || t END AS completions FROM o JOIN f USING (o_custkey)""",
)
def one_side_pairs(spark, sf):
    """JN15."""
    d = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("model")).agg(F.max("o_orderkey").cast("string").alias("text"))
    p = J.one_side_pairs(d, "o_custkey", "model", "text", "1-URGENT", 8)
    return p.select("o_custkey", F.array_join("models", ",").alias("models"), F.array_join("completions", ",").alias("completions"))


@query(
    "include_reference_candidate",
    """SELECT l_orderkey AS prompt_id, l_linenumber + 1 AS sample_idx, l_partkey::VARCHAR AS model_completion FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT o_orderkey, 0, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def include_reference_candidate(spark, sf):
    """JN14: line items are completions of an order, the order's priority is the reference."""
    li = table(spark, sf, "lineitem")
    c = li.join(table(spark, sf, "orders"), li.l_orderkey == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("sample_idx"), F.col("l_partkey").cast("string").alias("model_completion"), F.col("o_orderpriority").alias("reference_completion")
    )
    return J.include_reference_candidate(c).select("prompt_id", "sample_idx", "model_completion")


@query(
    "binarize_pairwise",
    """SELECT doc_id, CASE WHEN q > t THEN 'quality' ELSE 'toxic' END AS chosen, CASE WHEN q > t THEN 'toxic' ELSE 'quality' END AS rejected, abs(q - t) AS margin
 FROM (SELECT doc_id, quality AS q, toxic AS t FROM labels) WHERE q <> t""",
)
def binarize_pairwise(spark, sf):
    """FLT20 then WIN9."""
    from chatmill.operators.filters import drop_ties

    c, r, m = R.binarize_pairwise("quality", "toxic", F.lit("quality"), F.lit("toxic"))
    return drop_ties(table(spark, sf, "labels"), "quality", "toxic").select("doc_id", c.alias("chosen"), r.alias("rejected"), m.alias("margin"))


@query(
    "mean_ratings_binarized",
    f"""WITH r AS (SELECT p_partkey, [(p_size + 3) / 2.0::DOUBLE, (p_size % 7 + 1) / 1.0::DOUBLE, 9.0::DOUBLE] AS r FROM part),
 c AS (SELECT p_partkey, r, list_position(r, list_max(r))::INTEGER - 1 AS ci, {S.hash_int(6, 'p_partkey')} % 2 AS o FROM r)
 SELECT p_partkey, ci AS chosen_idx, (o + CASE WHEN o >= ci THEN 1 ELSE 0 END)::INTEGER AS rejected_idx, r[ci + 1] AS chosen_rating, r[o + CASE WHEN o >= ci THEN 1 ELSE 0 END + 1] AS rejected_rating FROM c""",
)
def mean_ratings_binarized(spark, sf):
    """VER22, AGG17 and WIN10: rating texts of ragged length to mean ratings to pairs."""
    block = lambda n: F.concat(F.lit("Rating: "), n.cast("string"), F.lit("\nRationale: fine"))
    a = F.concat(block(F.col("p_size")), F.lit("\n\n"), block(F.col("p_size") % 7 + 1))
    b = F.concat(block(F.lit(3)), F.lit("\n\n"), block(F.col("p_size") % 7 + 1), F.lit("\n\n"), block(F.lit(9)))
    parsed = lambda t: F.transform(V.rating_list(t, False), R.parse_rating)
    df = table(spark, sf, "part").select("p_partkey", parsed(a).alias("x"), parsed(b).alias("y")).withColumn("r", R.mean_ratings(["x", "y"]))
    df = df.withColumn("c", F.array(F.lit("p"), F.lit("q"), F.lit("s")))
    return R.binarize_by_mean_rating(df, "r", "c", "c", 6, "p_partkey").select("p_partkey", "chosen_idx", "rejected_idx", "chosen_rating", "rejected_rating")


@query(
    "mean_ratings_long",
    "SELECT l_partkey, l_linenumber, avg(l_quantity) AS mean_rating FROM lineitem GROUP BY 1, 2",
)
def mean_ratings_long(spark, sf):
    return R.mean_ratings_long(table(spark, sf, "lineitem"), ["l_partkey", "l_linenumber"], "l_quantity")


@query(
    "pivot_aspects",
    """SELECT user_id, coalesce(max(event_type) FILTER (WHERE event_type = 'click'), '') AS click, coalesce(max(event_type) FILTER (WHERE event_type = 'signup'), '') AS signup,
 coalesce(max(event_type) FILTER (WHERE event_type = 'review'), '') AS review FROM events GROUP BY 1""",
)
def pivot_aspects(spark, sf):
    """AGG18."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_type").alias("out"))
    return R.pivot_aspects(e, "user_id", "event_type", "out", ["click", "signup", "review"])


@query(
    "pair_eval",
    """SELECT avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS accuracy, avg(ln(1 + exp(-m))) AS loss, avg(a) AS chosen_score, avg(b) AS rejected_score, avg(m) AS margin
 FROM (SELECT l_quantity / 10 AS a, l_discount * 20 AS b, l_quantity / 10 - l_discount * 20 AS m FROM lineitem)""",
    approx=["accuracy", "loss", "chosen_score", "rejected_score", "margin"],
)
def pair_eval(spark, sf):
    """AGG30."""
    return R.pair_eval(table(spark, sf, "lineitem").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b")), "a", "b")


# -- annotations ----------------------------------------------------------------------------------

_PREF = "CASE event_type WHEN 'click' THEN 'a-is-better' WHEN 'view' THEN 'a-is-slightly-better' WHEN 'error' THEN 'b-is-better' WHEN 'signup' THEN 'b-is-slightly-better' ELSE 'tie' END"
_ANN = f"""a AS (SELECT event_id, user_id AS instance_id, event_id % 5 AS evaluator, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, {_PREF} AS preference,
   CASE WHEN value > 5 THEN 'yes' ELSE 'no' END AS acc_a, CASE WHEN value > 15 THEN 'yes' ELSE 'no' END AS acc_b FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY instance_id, evaluator ORDER BY t DESC, event_id DESC) AS last FROM a),
 n AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY t, event_id, evaluator) AS nth FROM k WHERE last = 1)"""


def _annotations(spark, sf):
    kind = F.col("event_type")
    pref = (
        F.when(kind == "click", "a-is-better").when(kind == "view", "a-is-slightly-better").when(kind == "error", "b-is-better")
        .when(kind == "signup", "b-is-slightly-better").otherwise("tie")
    )
    yes = lambda t: F.when(F.col("value") > t, "yes").otherwise("no")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("instance_id"), (F.col("event_id") % 5).alias("evaluator"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        pref.alias("preference"), yes(5).alias("completion_a_is_acceptable"), yes(15).alias("completion_b_is_acceptable"),
    )


@query("latest_per_evaluator", f"WITH {_ANN} SELECT instance_id, evaluator, event_id, nth::INTEGER AS nth FROM n WHERE nth <= 2")
def latest_per_evaluator(spark, sf):
    """WIN3."""
    return A.latest_per_evaluator(_annotations(spark, sf), tie="event_id").select("instance_id", "evaluator", "event_id", "nth")


@query(
    "annotation_acceptance",
    f"""WITH {_ANN}, t AS (SELECT instance_id, max(nth) AS n, max(acc_a) FILTER (WHERE nth = 1) AS a1, max(acc_a) FILTER (WHERE nth = 2) AS a2, max(acc_b) FILTER (WHERE nth = 1) AS b1, max(acc_b) FILTER (WHERE nth = 2) AS b2 FROM n WHERE nth <= 2 GROUP BY 1)
 SELECT count(*) AS instances, avg((a1 = 'yes')::INTEGER) AS a_acceptance, avg((b1 = 'yes')::INTEGER) AS b_acceptance, count(*) FILTER (WHERE n > 1) AS multi_annotated,
  avg((a1 = a2)::INTEGER) AS a_agreement, avg((b1 = b2)::INTEGER) AS b_agreement, (avg((a1 = a2)::INTEGER) + avg((b1 = b2)::INTEGER)) / 2 AS acceptance_agreement FROM t""",
)
def annotation_acceptance(spark, sf):
    """AGG21."""
    return A.acceptance(A.latest_per_evaluator(_annotations(spark, sf), tie="event_id"))


@query(
    "annotation_comparison",
    f"""WITH {_ANN}, t AS (SELECT instance_id, max(nth) AS n, max(preference) FILTER (WHERE nth = 1) AS p1, max(left(preference, 1)) FILTER (WHERE nth = 1) AS s1, max(left(preference, 1)) FILTER (WHERE nth = 2) AS s2 FROM n WHERE nth <= 2 GROUP BY 1)
 SELECT avg((p1 = 'a-is-better')::INTEGER) AS a_clearly_better, avg((p1 = 'a-is-slightly-better')::INTEGER) AS a_slightly_better, avg((p1 = 'b-is-better')::INTEGER) AS b_clearly_better,
  avg((p1 = 'b-is-slightly-better')::INTEGER) AS b_slightly_better, avg((p1 = 'tie')::INTEGER) AS tie, avg((s1 = 'a')::INTEGER) AS a_wins, avg((s1 = 'b')::INTEGER) AS b_wins,
  count(*) FILTER (WHERE n > 1) AS multi_annotated, avg((s1 = s2)::INTEGER) AS agreement, avg(CASE WHEN s2 IS NULL THEN NULL WHEN s1 = s2 THEN 1.0 WHEN s1 = 't' OR s2 = 't' THEN 0.5 ELSE 0.0 END) AS relaxed_agreement FROM t""",
)
def annotation_comparison(spark, sf):
    return A.comparison(A.latest_per_evaluator(_annotations(spark, sf), tie="event_id"))
