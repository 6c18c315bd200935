"""Decontamination and other joins between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.operators import decontam as D
from chatmill.operators import joins as J
from chatmill.operators.metric_index import MetricIndex
from chatmill.plans.tables import doc_messages, documents, turns

TOK = f"""t AS (SELECT doc_id, {S.phrase_tokens('text')} AS w FROM documents), e AS (SELECT item_id, {S.phrase_tokens('text')} AS w FROM benchmark)"""
_EXACT = f"""WITH {TOK}, m AS (SELECT doc_id, item_id FROM t JOIN e ON len(e.w) > 0 AND contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' '))"""


def _docs(spark, sf):
    return D.messages_to_docs(doc_messages(spark, sf))


@query("decontam_exact", _EXACT + " SELECT doc_id AS original_id, item_id AS item FROM m")
def decontam_exact(spark, sf):
    """JN5 then JN1: training messages that contain a benchmark item as a phrase."""
    return D.phrase_matches(_docs(spark, sf), table(spark, sf, "benchmark"), "original_id", "item_id", ["text"]).select("original_id", "item")


@query("decontam_exact_item_scores", _EXACT + " SELECT item_id AS item, (item_id IN (SELECT item_id FROM m))::INTEGER::DOUBLE AS score FROM e")
def decontam_exact_item_scores(spark, sf):
    bench = table(spark, sf, "benchmark")
    return D.exact_item_scores(D.phrase_matches(_docs(spark, sf), bench, "original_id", "item_id", ["text"]), bench, "item_id", ["text"])


@query(
    "decontam_exact_two_fields",
    f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({S.phrase_tokens('text')}, ' ') || ' ' AS w FROM documents),
 e AS (SELECT item_id, {S.phrase_tokens("split_part(text, '.', 1)")} AS a, {S.phrase_tokens("split_part(text, '.', 2)")} AS b FROM benchmark WHERE contains(text, '.') AND strip <> '')
 SELECT doc_id AS original_id, item_id AS item FROM t JOIN e ON contains(t.w, ' ' || array_to_string(a, ' ') || ' ') AND contains(t.w, ' ' || array_to_string(b, ' ') || ' ')
  WHERE len(a) > 0 AND len(b) > 0""".replace(" AND strip <> ''", ""),
)
def decontam_exact_two_fields(spark, sf):
    """JN1 with several fields: both sentences must occur in the same message."""
    parts = F.split("text", r"\.")
    bench = table(spark, sf, "benchmark").select("item_id", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))
    return D.phrase_matches(_docs(spark, sf), bench, "original_id", "item_id", ["a", "b"]).select("original_id", "item")


@query(
    "decontam_exact_tokens",
    f"""WITH t AS (SELECT doc_id, {S.phrase_tokens('text')} AS w FROM documents), e AS (SELECT item_id, {S.phrase_tokens('text')} AS w FROM benchmark)
 SELECT doc_id AS original_id, item_id AS item FROM t JOIN e ON len(e.w) > 0 AND list_contains(t.w, e.w[1]) AND list_contains(t.w, e.w[-1])""",
)
def decontam_exact_tokens(spark, sf):
    """JN1 with fields of one token each, some of them in a large share of all messages: the first and the last word of an item."""
    w = X.phrase_tokens(F.col("text"))
    bench = table(spark, sf, "benchmark").select("item_id", F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"))
    return D.phrase_matches(_docs(spark, sf), bench, "original_id", "item_id", ["first", "last"]).select("original_id", "item")


_NGRAM = f"""WITH {TOK},
 eg AS (SELECT item_id, len(w) AS len, array_to_string(w[i:i+7], ' ') AS g, max(i) AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM e WHERE len(w) >= 8) GROUP BY ALL),
 tg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
 pos AS (SELECT DISTINCT doc_id, item_id, len, p + unnest(range(8)) AS q FROM tg JOIN eg USING (g)),
 pair AS (SELECT doc_id, item_id, count(*) / len::DOUBLE AS score FROM pos GROUP BY doc_id, item_id, len)"""


@query("decontam_ngram_train", _NGRAM + " SELECT doc_id AS original_id, max(score) AS score FROM pair GROUP BY 1")
def decontam_ngram_train(spark, sf):
    """JN2: best overlap of every training row that shares an 8-gram with the benchmark."""
    return D.NgramOverlap(_docs(spark, sf), table(spark, sf, "benchmark"), "original_id", "item_id", ["text"], 8).train_scores()


@query("decontam_ngram_items", _NGRAM + " SELECT item_id AS item, coalesce(max(score), 0) AS score FROM e LEFT JOIN pair USING (item_id) GROUP BY 1")
def decontam_ngram_items(spark, sf):
    return D.NgramOverlap(_docs(spark, sf), table(spark, sf, "benchmark"), "original_id", "item_id", ["text"], 8).item_scores()


@query("decontaminate", _NGRAM + " SELECT doc_id AS original_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pair WHERE score > 0.5)")
def decontaminate(spark, sf):
    """JN4 with SET5: rows left after the exact and the n-gram matcher."""
    docs, bench = _docs(spark, sf), table(spark, sf, "benchmark")
    fuzzy = D.contaminated(D.NgramOverlap(docs, bench, "original_id", "item_id", ["text"], 8).train_scores(), "original_id", 0.5)
    return D.decontaminate(documents(spark, sf).select(F.col("doc_id").alias("original_id")), [fuzzy])


@query(
    "decontam_report",
    _NGRAM + """ SELECT total, kept, total - kept AS removed, 100.0 * kept / total AS kept_pct FROM (SELECT count(*) AS total,
  count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM pair WHERE score > 0.5)) AS kept FROM documents)""",
)
def decontam_report(spark, sf):
    train = documents(spark, sf).select(F.col("doc_id").alias("original_id"))
    return D.removal_report(train, decontaminate(spark, sf))


@query(
    "contamination_matrix",
    f"""WITH {TOK}, m AS (SELECT lang, item_id FROM t JOIN documents USING (doc_id) JOIN e ON contains(' ' || array_to_string(t.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' ')),
 s AS (SELECT l.lang, item_id, (EXISTS (SELECT 1 FROM m WHERE m.lang = l.lang AND m.item_id = e.item_id))::INTEGER AS hit, CASE WHEN len(w) > 25 THEN 'long' ELSE 'short' END AS ev FROM (SELECT DISTINCT lang FROM documents) l, e)
 SELECT lang AS train_set, avg(hit) FILTER (WHERE ev = 'long') AS long, avg(hit) FILTER (WHERE ev = 'short') AS short FROM s GROUP BY 1""",
)
def contamination_matrix(spark, sf):
    """AGG20: training sets are the languages, evaluation sets long and short items."""
    from chatmill.functions.text import phrase_tokens

    d, bench = doc_messages(spark, sf), table(spark, sf, "benchmark")
    langs = documents(spark, sf).select(F.col("doc_id").alias("original_id"), F.col("lang").alias("train_set"))
    hits = D.phrase_matches(D.messages_to_docs(d), bench, "original_id", "item_id", ["text"]).join(langs, "original_id").select("train_set", "item").distinct()
    sets = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    items = bench.select(
        F.col("item_id").alias("item"), F.when(F.size(phrase_tokens(F.col("text"))) > 25, "long").otherwise("short").alias("eval_set"), F.explode(sets).alias("train_set")
    )
    scores = items.join(hits.withColumn("hit", F.lit(1.0)), ["item", "train_set"], "left").withColumn("score", F.coalesce("hit", F.lit(0.0)))
    return D.contamination_matrix(scores, evals=["long", "short"])


_VEC = """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n),
 c AS (SELECT label AS item, list(s ORDER BY i) AS q FROM (SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM u) GROUP BY label, i) GROUP BY label),
 s AS (SELECT item, vec_id, list_dot_product(q, v) / sqrt(list_dot_product(q, q)) AS score FROM c, u),
 r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _centroids(spark, sf):
    """One query vector per label: the sum of its unit vectors."""
    from chatmill.functions.arrays import norm

    e = table(spark, sf, "embeddings").withColumn("n", norm(F.col("embedding")))
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"), "n").groupBy("label", "i").agg(F.sum(F.col("x").cast("double") / F.col("n")).alias("s"))
    packed = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("p"))
    return packed.select(F.col("label").alias("item"), F.transform("p", lambda p: p["s"]).alias("embedding"))


@query("decontam_vector_hits", _VEC + " SELECT item, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5", cast={"rank": "INTEGER"})
def decontam_vector_hits(spark, sf):
    """JN3: the five nearest training vectors of every query vector."""
    hits = D.nearest(table(spark, sf, "embeddings"), _centroids(spark, sf), 5)
    return hits.select("item", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("decontam_vector_train", _VEC + " SELECT vec_id, round(max((1 + score) / 2), 6) AS score FROM r WHERE rank <= 5 GROUP BY 1")
def decontam_vector_train(spark, sf):
    hits = D.nearest(table(spark, sf, "embeddings"), _centroids(spark, sf), 5, half_open=True)
    return D.vector_train_scores(hits).select("vec_id", F.round("score", 6).alias("score"))


_MANY = """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM n),
 s AS (SELECT q.vec_id AS item, t.vec_id, list_dot_product(q.v, t.v) AS score FROM u q, u t),
 r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)"""


def _many(spark, sf):
    """Every vector searches all vectors through the metric index, as a query side over any broadcast limit does."""
    vectors = table(spark, sf, "embeddings")
    return MetricIndex(vectors).search(vectors.select(F.col("vec_id").alias("item"), "embedding"), 5)


@query("decontam_vector_many", _MANY + " SELECT item, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5", cast={"rank": "INTEGER"})
def decontam_vector_many(spark, sf):
    """JN3, large against large: the five nearest of all vectors for every vector."""
    return _many(spark, sf)[0].select("item", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("decontam_vector_reads")
def decontam_vector_reads(spark, sf):
    """What the search read for each query: rings of cells, and rows in them."""
    return _many(spark, sf)[1]


# -- other joins ----------------------------------------------------------------------------------


@query("drop_prompts_in", f"SELECT doc_id FROM documents WHERE {S.strip('text')} NOT IN (SELECT text FROM conversations)")
def drop_prompts_in(spark, sf):
    """JN6."""
    from chatmill.functions.text import strip

    other = turns(spark, sf).select(F.col("content").alias("prompt"))
    return J.drop_prompts_in(documents(spark, sf), other, strip(F.col("text")), "prompt").select("doc_id")


@query(
    "apply_results",
    """SELECT d.doc_id, 'quality ' || l.quality AS content, d.lang FROM documents d JOIN labels l USING (doc_id)""",
)
def apply_results(spark, sf):
    """JN7: the last message takes the joined result."""
    base = doc_messages(spark, sf).withColumnRenamed("original_id", "doc_id").join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    results = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("answer"))
    return J.apply_results(base, results, "doc_id", "answer").select("doc_id", F.col("messages")[0]["content"].alias("content"), "lang")


@query("unmatched_results", "SELECT count(*) AS unmatched FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unmatched_results(spark, sf):
    return J.unmatched_results(documents(spark, sf).filter("lang = 'en'"), table(spark, sf, "labels"), "doc_id")


@query(
    "lookup_multi_source",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice, CASE WHEN l.l_returnflag = 'A' THEN p.p_name ELSE s.s_name END AS name FROM lineitem l
 LEFT JOIN part p ON l.l_partkey = p.p_partkey AND l.l_returnflag = 'A' LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND l.l_returnflag <> 'A'""",
)
def lookup_multi_source(spark, sf):
    """JN8: each line item names the table (part or supplier) its text comes from."""
    part = table(spark, sf, "part").select(F.lit("train").alias("split"), F.col("p_partkey").alias("index"), F.col("p_name").alias("name"))
    supp = table(spark, sf, "supplier").select(F.lit("train").alias("split"), F.col("s_suppkey").alias("index"), F.col("s_name").alias("name"))
    flag = F.col("l_returnflag") == "A"
    refs = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(flag, "part").otherwise("supplier").alias("dataset"),
        F.lit("train").alias("split"), F.when(flag, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("index"),
    )
    return J.lookup_multi_source(refs, {"part": part, "supplier": supp}).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "name")


@query(
    "expand_one_to_many",
    """SELECT o_orderkey, l_linenumber, l_partkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey) AS num_outputs, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def expand_one_to_many(spark, sf):
    """JN9."""
    long = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_extendedprice")
    return J.expand_one_to_many(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), long, "o_orderkey")


@query(
    "rows_common_to_all",
    "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages",
)
def rows_common_to_all(spark, sf):
    """JN10 and SET4."""
    t = {"d": documents(spark, sf), "l": table(spark, sf, "labels"), "p": table(spark, sf, "pages").withColumnRenamed("page_id", "doc_id")}
    return J.rows_common_to_all(t, "doc_id")


@query("attach_ratings", "SELECT doc_id, quality, toxic, lang, source FROM labels LEFT JOIN documents USING (doc_id)")
def attach_ratings(spark, sf):
    """JN11."""
    return J.attach_ratings(table(spark, sf, "labels"), documents(spark, sf).select("doc_id", "lang", "source"), "doc_id")


@query("removed_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def removed_ids(spark, sf):
    """SET3."""
    return documents(spark, sf).select("doc_id").exceptAll(table(spark, sf, "labels").filter("quality = 1").select("doc_id"))


@query("exclude", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 55)")
def exclude(spark, sf):
    """JN18."""
    ev = table(spark, sf, "events")
    return J.exclude(ev.select("event_id", "user_id"), ev.filter("event_type = 'purchase' and value > 55"), "user_id")


@query(
    "coverage_merge",
    "SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1",
)
def coverage_merge(spark, sf):
    """JN17: partial caches merged by index; every index must be covered."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return J.coverage_check(li.select("l_orderkey").distinct(), li, "l_orderkey", "l_extendedprice")


@query(
    "tree_paths",
    """WITH RECURSIVE n AS (SELECT conv_id, turn, role, text, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS leaf FROM conversations),
 w AS (SELECT conv_id, turn, role, leaf, role || ': ' || text AS path FROM n WHERE turn = 0
  UNION ALL SELECT n.conv_id, n.turn, n.role, n.leaf, w.path || chr(10) || n.role || ': ' || n.text FROM n JOIN w ON n.conv_id = w.conv_id AND n.turn = w.turn + 1)
 SELECT conv_id || '_' || turn AS leaf, replace(path, 'system: ', 'user: ') AS path FROM w WHERE leaf AND role = 'assistant'""",
)
def tree_paths(spark, sf):
    """JN20 over conversations read as parent-pointer chains."""
    from chatmill.operators.convert import messages_to_text

    t = turns(spark, sf)
    nodes = t.select(
        F.concat_ws("_", "conv_id", "turn").alias("message_id"),
        F.when(F.col("turn") > 0, F.concat_ws("_", F.col("conv_id"), F.col("turn") - 1)).alias("parent_id"),
        "role", F.col("content").alias("text"), F.lit(False).alias("deleted"), F.lit(0.0).alias("quality"),
    )
    return J.tree_paths(nodes, top_k=3).select("leaf", messages_to_text("messages", "lines").alias("path"))


@query(
    "tree_paths_deep",
    """WITH n AS (SELECT event_id, event_id // 4096 AS chain, CASE WHEN event_id % 2 = 1 THEN 'assistant' ELSE 'user' END AS role, event_type FROM events),
 l AS (SELECT chain, max(event_id) AS leaf, count(*) AS n, sha256(string_agg(role || ': ' || event_type, chr(10) ORDER BY event_id)) AS path FROM n GROUP BY chain)
 SELECT leaf, n::INTEGER AS n, path FROM l WHERE leaf % 2 = 1""",
)
def tree_paths_deep(spark, sf):
    """JN20 over chains of 4 096 events, each the child of the one before."""
    from chatmill.operators.convert import messages_to_text

    nodes = table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"),
        F.when(F.col("event_id") % 4096 > 0, F.col("event_id") - 1).alias("parent_id"),
        F.when(F.col("event_id") % 2 == 1, "assistant").otherwise("user").alias("role"),
        F.col("event_type").alias("text"), F.lit(False).alias("deleted"), F.lit(0.0).alias("quality"),
    )
    return J.tree_paths(nodes).select("leaf", F.size("messages").alias("n"), F.sha2(messages_to_text("messages", "lines").cast("binary"), 256).alias("path"))
