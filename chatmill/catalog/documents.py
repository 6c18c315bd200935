"""Document-level filters, repetition reports, text projections and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.functions import wordlists as L
from chatmill.functions.arrays import computed_once, ngrams
from chatmill.operators import convert as C
from chatmill.operators import filters as P
from chatmill.operators import repetition as R
from chatmill.operators import stats as ST
from chatmill.plans.tables import documents, labelled_docs

NL2 = "chr(10) || chr(10)"
SENTENCES = f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {S.strip('s')}), lambda s: s <> '')"
PARAGRAPHS = f"list_filter(list_transform(string_split(text, {NL2}), lambda s: {S.strip('s')}), lambda s: s <> '')"


def _units(units: str, least: int) -> str:
    """CTEs: o (one row per unit occurrence), g (runs), r (per unit: total, run, first)."""
    return f"""o AS (SELECT doc_id, unnest(u) AS unit, unnest(range(len(u))) AS p FROM (SELECT doc_id, {units} AS u FROM documents)),
 k AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, unit ORDER BY p) AS island FROM o WHERE length(unit) >= {least}),
 i AS (SELECT doc_id, unit, island, count(*) AS n, min(p) AS first FROM k GROUP BY ALL),
 r AS (SELECT doc_id, unit, sum(n)::INTEGER AS total, max(n)::INTEGER AS run, min(first) AS first FROM i GROUP BY doc_id, unit HAVING sum(n) > 1)"""


@query(
    "repeated_line_runs",
    f"""WITH {_units(SENTENCES, 10)} SELECT doc_id, unit, total, run,
  CASE WHEN run >= total THEN 'total_line_repeated_' || total || 'x' ELSE 'consecutive_line_repeated_' || run || 'x' END AS label FROM r WHERE run > 1""",
)
def repeated_line_runs(spark, sf):
    return R.run_report(documents(spark, sf), "doc_id", F.col("text"), "line")


@query(
    "repeated_paragraph_runs",
    f"""WITH {_units(PARAGRAPHS, 20)} SELECT doc_id, unit, total, run,
  CASE WHEN run >= total THEN 'total_paragraph_repeated_' || total || 'x' ELSE 'consecutive_paragraph_repeated_' || run || 'x' END AS label FROM r WHERE run > 1""",
)
def repeated_paragraph_runs(spark, sf):
    return R.run_report(documents(spark, sf), "doc_id", F.col("text"), "paragraph")


@query(
    "longest_runs",
    f"""WITH {_units(SENTENCES, 5)} SELECT doc_id, unit, total::BIGINT AS total, run::BIGINT AS run FROM r
 UNION ALL SELECT doc_id, unit, n::BIGINT, n::BIGINT FROM i WHERE (doc_id, unit) NOT IN (SELECT (doc_id, unit) FROM r)""",
)
def longest_runs(spark, sf):
    """WIN12 over one row per sentence. The window key is (document, sentence), so it is as small as one text."""
    long = documents(spark, sf).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("p", "unit")).filter(F.length("unit") >= 5)
    return R.longest_runs(long, ["doc_id", "unit"], "p")


def _rx(p: str) -> str:
    """The rule's pattern for RE2: Unicode word class spelled out."""
    return S.q(p.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"\w", r"[\p{L}\p{M}\p{N}_]"))


_CODE = f"""((regexp_matches(unit, {_rx(R.OPEN_UNCLOSED)}) OR regexp_matches(unit, {_rx(R.CLOSE_UNOPENED)})) AND NOT regexp_matches(unit, {_rx(R.MATCHED_BRACKETS)})
   OR regexp_matches(unit, {_rx(R.CODE_LINE)}))"""
_SHORT = f"""(regexp_matches(lower(unit), {S.q('|'.join(R.SHORT_PHRASES))}) OR (regexp_matches(unit, {_rx(R.COMPARISON)}) AND NOT regexp_matches(lower(unit), '{R.CODE_WORDS}')))"""
_STRUCT = r"""(SELECT doc_id, greatest(len(list_filter(ls, lambda l: regexp_matches(l, '^[0-9]+\.\s'))), len(list_filter(ls, lambda l: regexp_matches(l, '^[\-*•]\s')))) >= 2 AS s
   FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: """ + S.strip("l") + """) AS ls FROM documents))"""


def _reason_sql(mp: int, ms: int, mc: int) -> str:
    return f"""WITH st AS {_STRUCT}, pr AS (WITH {_units(PARAGRAPHS, 10)} SELECT * FROM r), sr AS (WITH {_units(SENTENCES, 5)} SELECT * FROM r),
 pf AS (SELECT doc_id, 0 AS part, first, 'paragraph_repeated_' || total || 'x' AS reason,
   {mp} * greatest(CASE WHEN s THEN 3 ELSE 1 END, CASE WHEN contains(unit, chr(10)) THEN 4 ELSE 1 END, CASE WHEN regexp_matches(unit, {S.q(R.MATH_SYMBOLS)}) THEN 2 ELSE 1 END) AS t, total, run
   FROM pr JOIN st USING (doc_id) WHERE NOT (run = 1 AND length(unit) < 20) AND NOT {_CODE} AND NOT regexp_matches(unit, {_rx(R.COMPLEX_MATH)}) AND lower(unit) NOT IN ('alternatively,', 'therefore,', 'however,')),
 sf AS (SELECT doc_id, 1 AS part, first, 'line_repeated_' || total || 'x' AS head, {_SHORT} AS short, total, run, length(unit) AS len,
   {_CODE} OR regexp_matches(unit, {_rx(R.COMPLEX_MATH)}) OR lower(unit) IN ('alternatively,', 'therefore,', 'however,') AS odd,
   greatest(CASE WHEN s THEN 3 ELSE 1 END, CASE WHEN regexp_matches(unit, {S.q(R.MATH_SYMBOLS)}) THEN 2 ELSE 1 END) AS f
   FROM sr JOIN st USING (doc_id) WHERE {S.n_words('unit')} > 1),
 hits AS (SELECT doc_id, part, first, reason FROM pf WHERE total >= CASE WHEN run = 1 THEN least(t * 2, 30) ELSE t END
  UNION ALL SELECT doc_id, part, first, CASE WHEN short THEN head || '_consecutive_short_phrase' WHEN run >= f * {mc} THEN head || '_consecutive' ELSE head END
   FROM sf WHERE CASE WHEN short THEN run >= {2 * mc} ELSE NOT odd AND (run >= f * {mc} OR (total >= f * {ms} AND len >= 10)) END)
 SELECT doc_id, min_by(reason, part * 1000000 + first) AS repetition_reason FROM hits GROUP BY doc_id"""


@query("repetition_filter", _reason_sql(10, 40, 4))
def repetition_filter(spark, sf):
    """FLT16 with the per-example thresholds: documents that are removed, with the reason."""
    return R.flag_repetition(documents(spark, sf), F.col("text")).filter("repetition_reason is not null").select("doc_id", "repetition_reason")


@query("repetition_filter_tight", _reason_sql(2, 3, 2))
def repetition_filter_tight(spark, sf):
    df = R.flag_repetition(
        documents(spark, sf), F.col("text"), min_repetitions=2, min_sentence_repetitions=3, min_consecutive_sentence_repetitions=2
    )
    return df.filter("repetition_reason is not null").select("doc_id", "repetition_reason")


@query(
    "repetition_reason_counts",
    f"WITH reasons AS ({_reason_sql(2, 3, 2)}) SELECT repetition_reason, count(*) AS n FROM reasons GROUP BY 1",
)
def repetition_reason_counts(spark, sf):
    """AGG23."""
    return ST.counts_by(repetition_filter_tight(spark, sf), "repetition_reason")


@query(
    "repeated_ngrams",
    f"""WITH w AS (SELECT doc_id, {S.words('lower(text)')} AS w FROM documents),
 g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS ngram, unnest(range(len(w) - 2)) AS p FROM w WHERE len(w) >= 3)
 SELECT doc_id, ngram, count(*)::INTEGER AS occurrences, min(p)::INTEGER AS first, max(p)::INTEGER AS last FROM g GROUP BY doc_id, ngram HAVING count(*) >= 3""".replace("w -> ", "lambda w: "),
)
def repeated_ngrams(spark, sf):
    """FLT16b: word trigrams that occur at least three times in a text."""
    found = R.repeated_ngrams(documents(spark, sf), "doc_id", F.col("text"), 3, 3)
    return found.select("doc_id", "ngram", "occurrences", "first", F.array_max("positions").alias("last"))


@query(
    "drop_cutoff_mentions",
    f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(text, {S.q(L.CUTOFF_PATTERN)}))",
)
def drop_cutoff_mentions(spark, sf):
    df = documents(spark, sf).select("doc_id", F.array(C.message("assistant", "text")).alias("messages"))
    return P.drop_cutoff_mentions(df, "doc_id").select("doc_id")


@query(
    "labelled_filters",
    """SELECT doc_id, lang, source FROM documents LEFT JOIN labels USING (doc_id)
 WHERE coalesce(toxic, 0) = 0 AND lower(lang) = 'en' AND source NOT IN ('src1', 'src2') AND NOT starts_with(source, 'src1')""",
)
def labelled_filters(spark, sf):
    """FLT8, FLT9, FLT10."""
    df = P.drop_flag(labelled_docs(spark, sf), "toxic")
    df = P.drop_sources(P.keep_language(df, "EN", "lang"), ["src1", "src2"])
    return P.drop_source_prefix(df, "src1").select("doc_id", "lang", "source")


@query("keep_model_regex", "SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src1[0-4]$')")
def keep_model_regex(spark, sf):
    return P.keep_model_regex(documents(spark, sf), "^src1[0-4]$", "source").select("doc_id", "source")


@query("drop_tags", "SELECT doc_id FROM documents WHERE lang NOT IN ('fr', 'de')")
def drop_tags(spark, sf):
    df = documents(spark, sf).withColumn("tags", F.array("lang", "source"))
    return P.drop_tags(df, ["continental", "unknown"], {"continental": ["fr", "de"]}).select("doc_id")


@query("length_filter", f"SELECT doc_id, n_chars FROM documents WHERE n_chars <= 4000 AND {S.n_words('text')} <= 512")
def length_filter(spark, sf):
    df = documents(spark, sf).withColumn("tokens", computed_once(X.words(F.col("text"))))
    return P.length_filter(df, {"tokens": 512, "n_chars": 4000}).select("doc_id", "n_chars")


@query("drop_marker_leak", "SELECT page_id FROM pages WHERE NOT regexp_matches(html, '<title>|Assistant:')")
def drop_marker_leak(spark, sf):
    return P.drop_marker_leak(table(spark, sf, "pages"), "html", ("<title>", "Assistant:")).select("page_id")


@query(
    "kept_and_removed",
    "SELECT kept, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, lang = 'en' AS kept FROM documents) GROUP BY kept",
)
def kept_and_removed(spark, sf):
    """SNK9's split column; the writer partitions by it."""
    return P.split_kept(documents(spark, sf), F.col("lang") == "en").groupBy("kept").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "language_parts",
    "SELECT lang AS part, count(*) AS n FROM documents GROUP BY lang",
)
def language_parts(spark, sf):
    """FLT11: named parts that must cover the table."""
    parts = P.partition_by_predicate(documents(spark, sf), {x: F.col("lang") == x for x in ("en", "de", "fr", "es")})
    out = None
    for name, df in parts.items():
        one = df.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "require_fields",
    """SELECT count(*) FILTER (WHERE quality IS NULL) AS errors, count(*) FILTER (WHERE quality IS NOT NULL AND quality = 0) AS skipped,
  count(*) FILTER (WHERE quality = 1) AS kept FROM documents LEFT JOIN labels USING (doc_id)""",
)
def require_fields(spark, sf):
    df = labelled_docs(spark, sf).withColumn("good", F.col("quality") == 1)
    kept, errors, skipped = P.require_fields(df, ["quality"], "good")
    return df.agg(errors.alias("errors"), skipped.alias("skipped"), F.count_if(F.col("good")).alias("kept"))


# -- projections ----------------------------------------------------------------------------------


@query(
    "multiple_choice",
    """WITH o AS (SELECT p_partkey, p_name, list_transform(list_sort([{'k': lower(p_name), 'i': 0, 'v': p_name}, {'k': lower(p_brand), 'i': 1, 'v': p_brand}, {'k': lower(p_type), 'i': 2, 'v': p_type}, {'k': 'medium', 'i': 3, 'v': 'Medium'}]), lambda s: s.v) AS v FROM part)
 SELECT p_partkey, chr(64 + list_position(v, p_name)::INTEGER) AS letter, 'A: ' || v[1] || ', B: ' || v[2] || ', C: ' || v[3] || ', D: ' || v[4] AS shown FROM o""",
)
def multiple_choice(spark, sf):
    letter, shown = C.multiple_choice("p_name", ["p_brand", "p_type", F.lit("Medium")])
    return table(spark, sf, "part").select("p_partkey", letter.alias("letter"), shown.alias("shown"))


@query(
    "length_constraint",
    f"""WITH t AS (SELECT item_id, text, 100 + {S.hash_int(7, 'item_id')} % 3996 AS n FROM benchmark)
 SELECT item_id, text || chr(10) || 'Use no more than ' || n || ' tokens.' AS budget, 'ans<sep>' || n AS budget_truth,
  {S.strip('text')} || ' Let''s think step by step and output the final answer within \\boxed{{}}. Think for ' || n || ' tokens.' AS think, n::VARCHAR AS think_truth FROM t""",
)
def length_constraint(spark, sf):
    t = table(spark, sf, "benchmark").withColumn("n", C.length_target(100, 4096, 7, "item_id"))
    p, g, _ = C.length_constraint("text", F.lit("ans"), F.col("n"), "budget")
    p2, g2, _ = C.length_constraint("text", F.lit("ans"), F.col("n"), "answer_length")
    return t.select("item_id", p.alias("budget"), g[0].alias("budget_truth"), p2.alias("think"), g2[1].alias("think_truth"))


@query(
    "weighted_template",
    f"""SELECT p_partkey, CASE WHEN {S.hash_unit(3, 'p_partkey')} < 0.5 THEN 'Task: ' || p_name || chr(10) WHEN {S.hash_unit(3, 'p_partkey')} < 0.8 THEN p_name || ' Output:' ELSE 'Do ' || p_name || ' with ' || p_type END AS prompt FROM part""",
)
def weighted_template(spark, sf):
    t = [("Task: {instruction}\n", 5.0), ("{instruction} Output:", 3.0), ("Do {instruction} with {input}", 2.0)]
    return table(spark, sf, "part").select("p_partkey", C.weighted_template(t, 3, "p_partkey", instruction="p_name", input="p_type").alias("prompt"))


@query(
    "few_shot_prompt",
    f"""WITH h AS (SELECT *, {S.hash_key(11, 'p_partkey')} AS h FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS rn FROM h),
 s AS (SELECT p_brand, string_agg('Input:' || chr(10) || p_name || chr(10) || 'Output:' || chr(10) || p_type || {NL2}, '' ORDER BY h, p_partkey) AS shots FROM r WHERE rn <= 3 GROUP BY p_brand)
 SELECT p_partkey, 'Name the kind.' || {NL2} || shots || 'Input:' || chr(10) || p_name || chr(10) || 'Output:' || chr(10) AS prompt FROM part JOIN s USING (p_brand)""",
)
def few_shot_prompt(spark, sf):
    part = table(spark, sf, "part")
    ex = part.select("p_brand", "p_partkey", F.col("p_name").alias("input"), F.col("p_type").alias("output"))
    qs = part.select("p_brand", "p_partkey", F.col("p_name").alias("input"), F.lit("Name the kind.").alias("instruction"))
    return C.few_shot_prompt(qs, ex, "p_brand", 3, 11, "p_partkey").select("p_partkey", "prompt")


@query(
    "extract_code",
    """SELECT p_partkey, p_type AS code, CASE WHEN p_size > 25 THEN p_name ELSE 'NO SOLUTION' END AS sized FROM part""",
)
def extract_code(spark, sf):
    two = F.concat(F.lit("try ```python\n"), F.col("p_name"), F.lit("``` or ```"), F.col("p_type"), F.lit("\n``` end"))
    some = F.when(F.col("p_size") > 25, F.concat(F.lit("```python "), F.col("p_name"), F.lit("```"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", C.extract_code(two).alias("code"), C.extract_code(some, "NO SOLUTION").alias("sized"))


@query(
    "hash_id",
    "SELECT doc_id, sha256(text) AS id, 'docs_' || (row_number() OVER (ORDER BY doc_id) - 1) AS positional FROM documents",
)
def hash_id(spark, sf):
    """CNV30: positional ids from a dense index, and content ids."""
    df = C.ensure_id(documents(spark, sf).select("doc_id", "text"), "docs", "doc_id", "positional")
    return df.select("doc_id", C.hash_id("text").alias("id"), "positional")


@query(
    "align_columns",
    "SELECT doc_id, text, lang, 'documents' AS source FROM documents UNION ALL SELECT item_id, text, NULL, 'benchmark' FROM benchmark",
)
def align_columns(spark, sf):
    """CNV27, CNV28, CNV29, SET1."""
    docs = C.tag_source(C.select_rename(documents(spark, sf), drop=["n_chars", "source"]), "documents")
    bench = C.tag_source(C.select_rename(table(spark, sf, "benchmark"), rename={"item_id": "doc_id"}), "benchmark")
    return C.align_columns([docs, bench], ["doc_id", "text", "lang", "source"])


@query(
    "judge_prompts",
    f"""SELECT item_id, aspect, CASE aspect WHEN 'truth' THEN 'Is it true? ' || text || chr(10) ELSE 'Helpful? ' END || '<text 1> ' || reverse(text) || chr(10) || '<text 2> ' || lower(text) AS prompt
 FROM benchmark, (SELECT unnest(['truth', 'help']) AS aspect)""",
)
def judge_prompts(spark, sf):
    """CNV34: aspects are exploded from a literal array, no cross join."""
    df = table(spark, sf, "benchmark").withColumn("c", F.array(F.reverse("text"), F.lower("text")))
    t = {"truth": "Is it true? {instruction}\n{completions}", "help": "Helpful? {completions}"}
    return C.render_judge_prompts(df, t, "text", "c").select("item_id", "aspect", "prompt")


@query(
    "shared_prefix",
    """WITH p AS (SELECT page_id, url AS a, replace(url, 'example', 'sample') AS b FROM pages),
 n AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS n FROM p)
 SELECT page_id, substr(a, 1, n) AS prompt, substr(a, n + 1) AS chosen, substr(b, n + 1) AS rejected FROM n""",
)
def shared_prefix(spark, sf):
    p, a, b = C.split_shared_prefix(F.col("url"), F.replace(F.col("url"), F.lit("example"), F.lit("sample")))
    return table(spark, sf, "pages").select("page_id", p.alias("prompt"), a.alias("chosen"), b.alias("rejected"))


@query(
    "describe_problem",
    f"""SELECT p_partkey, p_name || {NL2} || 'Input' || {NL2} || p_brand || CASE WHEN p_size > 10 THEN {NL2} || 'Output' || {NL2} || p_type ELSE '' END ||
  {NL2} || 'Examples' || {NL2} || 'Input' || {NL2} || 'a' || {NL2} || 'Output' || {NL2} || p_type AS question,
  p_name || {NL2} || '1. ' || p_brand || {NL2} || '2. ' || p_type AS quoted FROM part""",
)
def describe_problem(spark, sf):
    """CNV31 and CNV33."""
    ex = F.array(F.struct(F.lit("a").alias("input"), F.col("p_type").alias("output")))
    question = C.describe_problem("p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_type")), ex, F.lit(None).cast("string"))
    quoted = C.quoted_context("p_name", F.array("p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", question.alias("question"), quoted.alias("quoted"))


@query(
    "prompt_markers",
    f"SELECT item_id, text AS cleaned, text AS verifiable, text AS boxed FROM (SELECT item_id, {S.strip('text')} AS text FROM benchmark)",
)
def prompt_markers(spark, sf):
    """CNV32 and the ground-truth rules of CNV13."""
    wrapped = F.concat(F.lit("Human: "), F.col("text"), F.lit(" Assistant:"))
    hashes = F.concat(F.lit("steps #### 1 #### "), F.col("text"))
    boxed = F.concat(F.lit(r"so \boxed{1} and \boxed{"), X.strip(F.col("text")), F.lit("}."))
    return table(spark, sf, "benchmark").select(
        "item_id", C.strip_prompt_markers(wrapped).alias("cleaned"), C.gt_after_hashes(hashes).alias("verifiable"), C.gt_last_boxed(boxed).alias("boxed")
    )


# -- statistics -----------------------------------------------------------------------------------


@query("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf):
    return ST.counts_by(documents(spark, sf), "source")


@query(
    "length_histogram",
    """WITH s AS (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM documents)
 SELECT CASE WHEN c >= 50 THEN source ELSE 'Other' END AS category, least(n_chars // 2000, 5)::INTEGER AS bin, count(*) AS n FROM s WHERE n_chars <= 12000 GROUP BY ALL""",
)
def length_histogram(spark, sf):
    edges = [0, 2000, 4000, 6000, 8000, 10000, 12000]
    return ST.length_histogram(documents(spark, sf), "source", F.col("n_chars"), edges, 50)


@query("seq_len_summary", "SELECT min(n_chars) AS min, max(n_chars) AS max, avg(n_chars) AS mean, quantile_cont(n_chars::DOUBLE, 0.5) AS median FROM documents")
def seq_len_summary(spark, sf):
    return ST.seq_len_summary(documents(spark, sf), "n_chars")


_OVER = ", ".join(f"count(*) FILTER (WHERE p + c > {t}) AS n_gt_{t}" for t in ST.THRESHOLDS)


@query(
    "prompt_completion_stats",
    f"""WITH l AS (SELECT length(url) AS p, length(html) AS c FROM pages) SELECT count(*) AS num_instances, {S.describe('p', 'prompt')}, {S.describe('c', 'completion')}, {S.describe('p + c', 'total')}, {_OVER} FROM l""",
    approx=["prompt_mean", "prompt_std", "completion_mean", "completion_std", "total_mean", "total_std"],
)
def prompt_completion_stats(spark, sf):
    return ST.prompt_completion_stats(table(spark, sf, "pages"), F.length("url").cast("long"), F.length("html").cast("long"))


@query(
    "stats_table",
    f"""WITH l AS (SELECT lang, n_chars, {S.n_words('text')} AS w FROM documents)
 SELECT lang, count(*) AS num_instances, avg(n_chars) AS prompt_mean, avg(w) AS completion_mean, avg(n_chars + w) AS total_mean,
  100.0 * count(*) FILTER (WHERE n_chars + w > 512) / count(*) AS pct_gt_512, 100.0 * count(*) FILTER (WHERE n_chars + w > 2048) / count(*) AS pct_gt_2048 FROM l GROUP BY lang""",
)
def stats_table(spark, sf):
    """AGG3 over AGG2 per language."""
    st = ST.prompt_completion_stats(documents(spark, sf), F.col("n_chars"), X.word_count(F.col("text")).cast("long"), ["lang"])
    return ST.stats_table(st, "lang")


@query(
    "output_stats",
    f"""WITH t AS (SELECT source, {S.n_words('text')} AS t, CASE WHEN coalesce(quality, 0) = 1 THEN {S.n_words('text')} ELSE 0 END AS l FROM documents LEFT JOIN labels USING (doc_id)),
 g AS (SELECT source, count(*) AS instances, sum(t)::BIGINT AS tokens, sum(l)::BIGINT AS trainable_tokens, count(*) FILTER (WHERE l = 0) AS no_label FROM t GROUP BY ROLLUP (source))
 SELECT *, 100.0 * tokens / max(tokens) OVER () AS pct_tokens, 100.0 * instances / max(instances) OVER () AS pct_instances FROM g""",
)
def output_stats(spark, sf):
    n = X.word_count(F.col("text"))
    return ST.output_stats(labelled_docs(spark, sf), "source", n, F.when(F.coalesce("quality", F.lit(0)) == 1, n).otherwise(0))


@query(
    "win_lose_tie",
    f"""WITH t AS (SELECT doc_id, len(list_distinct({S.words('text')})) AS a, len({S.words('text')}) // 2 AS b FROM documents)
 SELECT count(*) FILTER (WHERE a > b) AS win, count(*) FILTER (WHERE a < b) AS lose, count(*) FILTER (WHERE a = b) AS tie FROM t""".replace("w -> ", "lambda w: "),
)
def win_lose_tie(spark, sf):
    """AGG31: distinct tokens against half the number of tokens."""
    d = documents(spark, sf)
    a = d.select("doc_id", ST.distinct_tokens(X.words(F.col("text"))).alias("a"))
    b = d.select("doc_id", F.floor(X.word_count(F.col("text")) / 2).alias("b"))
    from chatmill.operators.prefs import win_lose_tie as wlt

    return wlt(a, b.withColumnRenamed("b", "a"), "doc_id", "a", lambda c: c)


@query(
    "token_usage_cost",
    f"""SELECT lang AS model, sum(n_chars)::BIGINT AS prompt_tokens, sum({S.n_words('text')})::BIGINT AS completion_tokens,
  (sum(n_chars) * CASE lang WHEN 'en' THEN 2.5 WHEN 'de' THEN 1.25 ELSE 0.0 END::DOUBLE + sum({S.n_words('text')}) * CASE lang WHEN 'en' THEN 10.0 WHEN 'de' THEN 5.0 ELSE 0.0 END::DOUBLE) / 1e6 AS cost FROM documents GROUP BY lang""",
)
def token_usage_cost(spark, sf):
    usage = documents(spark, sf).select(F.col("lang").alias("model"), F.col("n_chars").alias("prompt_tokens"), X.word_count(F.col("text")).cast("long").alias("completion_tokens"))
    return ST.token_usage_cost(usage, {"en": (2.5, 10.0), "de": (1.25, 5.0)})


@query(
    "ngram_count",
    f"SELECT doc_id, greatest(len({S.words('text')}) - 4, 0)::INTEGER AS n FROM documents".replace("w -> ", "lambda w: "),
)
def ngram_count(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(ngrams(X.words(F.col("text")), 5)).alias("n"))


@query(
    "resolve_tools",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'search,code' WHEN 'click' THEN 'search' WHEN 'error' THEN 'search,code' END AS tools FROM events""",
)
def resolve_tools(spark, sf):
    """CNV24: named tools, all when none are named, null when none match."""
    defs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("{}").alias("parameters")) for n in ("search", "code")])
    named = F.when(F.col("event_type") == "view", F.array(F.lit("code"), F.lit("search"))).when(F.col("event_type") == "click", F.array(F.lit("search")))
    named = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.coalesce(named, F.array(F.lit("browser"))))
    e = table(spark, sf, "events").withColumn("t", C.resolve_tools(defs, named))
    return e.select("event_id", F.array_join(F.transform("t", lambda d: d["name"]), ",").alias("tools"))


@query(
    "merge_env_config",
    """SELECT event_id, 'env_name=' || CASE WHEN event_type = 'click' THEN 'own' ELSE 'base' END || ',k=' || coalesce(props::JSON->>'$.k', 'none') || ',limit=5' AS config FROM events""",
)
def merge_env_config(spark, sf):
    """CNV25: row entries over base entries."""
    own = F.from_json("props", "map<string,string>")
    row = F.when(F.col("event_type") == "click", F.map_concat(own, F.create_map(F.lit("env_name"), F.lit("own")))).otherwise(own)
    e = table(spark, sf, "events").withColumn("c", C.merge_env_config({"env_name": "base", "limit": "5", "k": "none"}, row))
    pairs = F.transform(F.sort_array(F.map_entries("c")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("event_id", F.array_join(pairs, ",").alias("config"))


@query(
    "unused_tools",
    "SELECT t AS tool FROM (SELECT unnest(['click', 'view', 'error', 'signup', 'purchase', 'refund']) AS t) WHERE t NOT IN (SELECT event_type FROM events)",
)
def unused_tools(spark, sf):
    """FLT24: every tool in the data is configured; configured ones that never occur are reported."""
    known = ["click", "view", "error", "signup", "purchase", "refund"]
    unused = P.validate_tools(table(spark, sf, "events").select(F.array("event_type").alias("tools")), known)
    return spark.createDataFrame([(t,) for t in unused], "tool string")
