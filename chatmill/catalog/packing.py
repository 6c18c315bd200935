"""Token counts, vocabularies, packing and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.operators import pack as K
from chatmill.operators.ordering import dense_index
from chatmill.plans.tables import chat, documents, labelled_docs

# sequential next-fit over ordered lengths, the way a single pass does it
_NEXT_FIT = """WITH RECURSIVE l AS ({rows}),
 f AS (SELECT i, {init}, 0::BIGINT AS pack FROM l WHERE i = 0
  UNION ALL SELECT l.i, {step}, f.pack + CASE WHEN {over} THEN 1 ELSE 0 END FROM f JOIN l ON l.i = f.i + 1)
 SELECT i AS index, pack AS {name} FROM f"""


@query(
    "pack_next_fit",
    _NEXT_FIT.format(
        rows="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, n_chars AS n FROM documents", init="n AS fill", over="f.fill + l.n > 8192",
        step="CASE WHEN f.fill + l.n > 8192 THEN l.n ELSE f.fill + l.n END", name="pack",
    ),
)
def pack_next_fit(spark, sf):
    """PK8: pack numbers of the whole table; blocks of 64 rows show that the cut does not matter."""
    rows = dense_index(documents(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return K.pack_next_fit(rows, "index", "n_chars", 8192, block_rows=64)


@query(
    "pack_min_batches",
    _NEXT_FIT.format(
        rows="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, n_chars AS n, (SELECT sum(n_chars) // 40 FROM documents)::BIGINT AS lim FROM documents",
        init="n AS fill, lim", over="f.fill + l.n > least(f.lim, 200000)", step="CASE WHEN f.fill + l.n > least(f.lim, 200000) THEN l.n ELSE f.fill + l.n END, f.lim", name="pack",
    ),
)
def pack_min_batches(spark, sf):
    """PK8 with a pack length that shrinks so that there are at least 40 packs."""
    rows = dense_index(documents(spark, sf).select("doc_id", "n_chars"), "doc_id")
    return K.pack_next_fit(rows, "index", "n_chars", 200_000, min_batches=40, block_rows=100)


@query(
    "token_budget_batches",
    _NEXT_FIT.format(
        rows=f"SELECT row_number() OVER (ORDER BY page_id) - 1 AS i, length(html) AS a, length(html) // 2 + page_id % 900 AS b FROM pages", init="a AS fa, b AS fb",
        over="f.fa + l.a > 9000 OR f.fb + l.b > 5000",
        step="CASE WHEN f.fa + l.a > 9000 OR f.fb + l.b > 5000 THEN l.a ELSE f.fa + l.a END, CASE WHEN f.fa + l.a > 9000 OR f.fb + l.b > 5000 THEN l.b ELSE f.fb + l.b END", name="batch",
    ),
)
def token_budget_batches(spark, sf):
    """PK12."""
    n = F.length("html").cast("long")
    pages = table(spark, sf, "pages").select("page_id", n.alias("a"), (F.floor(n / 2) + F.col("page_id") % 900).alias("b"))
    return K.token_budget_batches(dense_index(pages, "page_id"), "index", "a", "b", (9000, 5000), 64)


@query(
    "batch_by_max_tokens",
    _NEXT_FIT.format(
        rows="SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, n_chars AS n FROM documents WHERE n_chars <= 16384", init="n AS mx, 1 AS k", over="greatest(f.mx, l.n) * (f.k + 1) > 16384",
        step="CASE WHEN greatest(f.mx, l.n) * (f.k + 1) > 16384 THEN l.n ELSE greatest(f.mx, l.n) END, CASE WHEN greatest(f.mx, l.n) * (f.k + 1) > 16384 THEN 1 ELSE f.k + 1 END", name="batch",
    ),
)
def batch_by_max_tokens(spark, sf):
    """PK18."""
    return K.batch_by_max_tokens(documents(spark, sf).select("doc_id", "n_chars"), "doc_id", "n_chars", 16384, block_rows=64)[0]


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]|\n')"


@query(
    "token_length",
    rf"SELECT doc_id, length(text) AS chars, {S.n_words('text')} AS words, len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]')) AS tokens FROM documents",
)
def token_length(spark, sf):
    """PK1."""
    c = F.col("text")
    return documents(spark, sf).select("doc_id", *[K.token_length(c, k).cast("long").alias(k) for k in ("chars", "words", "tokens")])


@query(
    "fits_context",
    f"SELECT conv_id, sum({S.n_words('text')} + CASE WHEN role = 'system' THEN 4 ELSE 3 END) + 200 + 150 <= 600 AS fits FROM conversations GROUP BY 1",
)
def fits_context(spark, sf):
    return chat(spark, sf).select("conv_id", K.fits_context(F.col("messages"), 200, 600).alias("fits"))


@query(
    "build_vocab",
    f"""WITH t AS (SELECT unnest({_TOKENS}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
 SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::INTEGER AS id FROM c ORDER BY n DESC, token LIMIT 500""",
)
def build_vocab(spark, sf):
    """PK2."""
    return K.build_vocab(documents(spark, sf), K.tokens(F.col("text")), 500)


_VOCAB = f"""t AS (SELECT unnest({_TOKENS}) AS token FROM conversations), cn AS (SELECT token, count(*) AS n FROM t GROUP BY 1),
 v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM cn ORDER BY n DESC, token LIMIT 400)"""
_HEAD = r"""CASE role WHEN 'system' THEN ['<','|','system','|','>',chr(10)] WHEN 'user' THEN ['<','|','user','|','>',chr(10)] ELSE ['<','|','assistant','|','>',chr(10)] END"""


# the tokens of every conversation in order, and whether they are trained on
CHAT_TOKENS = f"""WITH m AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lead(role) OVER w AS after, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 p AS (SELECT conv_id, turn, 0 AS part, {_HEAD} AS k, role = 'assistant' AND (before IS NULL OR before = 'assistant') AS train FROM m
  UNION ALL SELECT conv_id, turn, 1, {_TOKENS} || CASE WHEN role = 'assistant' THEN ['<', 'eos', '>'] ELSE [chr(10)] END, role = 'assistant' FROM m
  UNION ALL SELECT conv_id, turn, 2, CASE WHEN role = 'assistant' AND turn < top THEN [chr(10)] ELSE [] END, role = 'assistant' AND coalesce(after, 'assistant') = 'assistant' FROM m),
 x AS (SELECT conv_id, turn, part, unnest(range(len(k))) AS j, unnest(k) AS token, train FROM p),
 o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part, j) AS pos, token, train FROM x)"""


@query(
    "encode_chat",
    f"""{CHAT_TOKENS.replace('WITH ', 'WITH ' + _VOCAB + ', ', 1)},
 e AS (SELECT conv_id, pos, coalesce(id, 0) AS id, train FROM o LEFT JOIN v USING (token) WHERE pos <= 300)
 SELECT conv_id, count(*)::INTEGER AS n, count(*) FILTER (WHERE train)::INTEGER AS n_train, string_agg(id, ' ' ORDER BY pos) AS ids, string_agg(CASE WHEN train THEN id ELSE -100 END, ' ' ORDER BY pos) AS labels FROM e GROUP BY 1""",
)
def encode_chat(spark, sf):
    """PK2 and PK3: vocabulary ids and label masks of whole conversations, truncated to 300 tokens."""
    c = chat(spark, sf)
    from chatmill.plans.tables import turns

    vocab = K.build_vocab(turns(spark, sf), K.tokens(F.col("content")), 400)
    e = K.encode_chat(c, K.encoder(vocab), template="tags", eos="<eos>", max_len=300)
    text = lambda col: F.array_join(F.transform(col, lambda i: i.cast("string")), " ")
    return e.select(
        "conv_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != -100)).alias("n_train"), text("input_ids").alias("ids"), text("labels").alias("labels")
    )


@query(
    "position_ids",
    f"""WITH w AS (SELECT conv_id, turn, {S.n_words('text')} AS n FROM conversations), g AS (SELECT conv_id, string_agg(array_to_string(range(n), ' '), ' ' ORDER BY turn) AS position_ids, sum(n)::INTEGER AS n FROM w GROUP BY 1)
 SELECT * FROM g""",
)
def position_ids(spark, sf):
    """PK9 on segment ids built from turn lengths."""
    seg = F.flatten(F.transform("messages", lambda m, i: F.array_repeat(i + 1, X.word_count(m["content"]))))
    c = chat(spark, sf).withColumn("seg", seg)
    return c.select("conv_id", F.array_join(F.transform(K.position_ids(F.col("seg")), lambda p: p.cast("string")), " ").alias("position_ids"), F.size("seg").alias("n"))


@query(
    "token_stream",
    f"""WITH d AS (SELECT doc_id, {S.n_words('text')} AS n FROM documents), s AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS a, sum(n) OVER (ORDER BY doc_id) AS b FROM d),
 c AS (SELECT doc_id, a, b, unnest(range((a // 5000)::BIGINT, ((b - 1) // 5000)::BIGINT + 1)) AS chunk FROM s WHERE n > 0)
 SELECT chunk, doc_id, (greatest(a, chunk * 5000) - chunk * 5000)::BIGINT AS start, (least(b, (chunk + 1) * 5000) - chunk * 5000)::BIGINT AS "end",
  (least(b, (chunk + 1) * 5000) - greatest(a, chunk * 5000))::INTEGER AS n_ids, greatest(0, least(b, (chunk + 1) * 5000) - greatest(a + 3, chunk * 5000))::INTEGER AS n_mask FROM c""",
)
def token_stream(spark, sf):
    """PK15: chunk boundaries over the concatenated stream; the first three tokens of a row carry no label."""
    d = documents(spark, sf).withColumn("input_ids", F.transform(X.words(F.col("text")), lambda w, i: i))
    d = d.withColumn("labels", F.transform("input_ids", lambda i: F.when(i < 3, -100).otherwise(i)))
    s = K.token_stream(d, "doc_id", 5000)
    return s.select("chunk", "doc_id", "start", "end", F.size("ids").alias("n_ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


@query(
    "pad_batch",
    f"""WITH d AS (SELECT doc_id, doc_id // 16 AS batch, {S.n_words('text')} AS n, n_chars % 300 AS m FROM documents)
 SELECT doc_id, batch, max(greatest(n, m)) OVER (PARTITION BY batch)::INTEGER AS padded, (max(greatest(n, m)) OVER (PARTITION BY batch) - n)::INTEGER AS pads FROM d""",
)
def pad_batch(spark, sf):
    """PK13."""
    d = documents(spark, sf).select(
        "doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.transform(X.words(F.col("text")), lambda w: F.lit(1)).alias("chosen"),
        F.array_repeat(F.lit(1), (F.col("n_chars") % 300).cast("int")).alias("rejected"),
    )
    p = K.pad_batch(d, "batch", {"chosen": 0, "rejected": 0})
    return p.select("doc_id", "batch", F.size("rejected").alias("padded"), F.size(F.filter("chosen", lambda x: x == 0)).alias("pads"))


@query(
    "flatten_batch",
    """WITH d AS (SELECT doc_id, doc_id // 8 AS batch, n_chars % 50 + 1 AS n FROM documents)
 SELECT batch, string_agg(array_to_string(list_transform(range(n), lambda j: doc_id), ' '), ' ' ORDER BY doc_id) AS input_ids,
  string_agg('-100' || CASE WHEN n > 1 THEN ' ' || array_to_string(range(1, n), ' ') ELSE '' END, ' ' ORDER BY doc_id) AS labels,
  string_agg(array_to_string(range(n), ' '), ' ' ORDER BY doc_id) AS position_ids, max(n)::INTEGER AS max_length, sum(n)::INTEGER AS total FROM d GROUP BY 1""",
)
def flatten_batch(spark, sf):
    """PK11 and PK19: concatenated examples with separators."""
    n = (F.col("n_chars") % 50 + 1).cast("int")
    d = documents(spark, sf).select(
        "doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), F.array_repeat(F.col("doc_id").cast("int"), n).alias("input_ids"), F.sequence(F.lit(0), n - 1).alias("labels")
    )
    b = K.flatten_batch(d, "batch", "doc_id")
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ").alias(c)
    return b.select("batch", text("input_ids"), text("labels"), text("position_ids"), "max_length", K.batch_tokens(b, cu=["cu_seq_lens"]).alias("total"))


@query(
    "packed_rollouts",
    """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, 2 + event_id % 9 AS q, 1 + user_id % 13 AS r FROM events),
 f AS (SELECT i, q + r AS fill, 0::BIGINT AS pack FROM l WHERE i = 0 UNION ALL SELECT l.i, CASE WHEN f.fill + l.q + l.r > 64 THEN l.q + l.r ELSE f.fill + l.q + l.r END, f.pack + CASE WHEN f.fill + l.q + l.r > 64 THEN 1 ELSE 0 END FROM f JOIN l ON l.i = f.i + 1)
 SELECT pack, sum(q + r)::INTEGER AS n, sum(r)::INTEGER AS n_response, count(*)::INTEGER AS sequences, sum(r * (i + 1))::BIGINT AS mask_sum, sum((q + r) * (q + r - 1) // 2)::BIGINT AS position_sum, sum(i + 1)::BIGINT AS done_sum
 FROM f JOIN l USING (i) GROUP BY 1""",
)
def packed_rollouts(spark, sf):
    """PK8 with its arrays, PK9 and the done markers, reduced to checksums per pack."""
    e = dense_index(table(spark, sf, "events").select("event_id", "user_id"), "event_id")
    q, r = (F.lit(2) + F.col("event_id") % 9).cast("int"), (F.lit(1) + F.col("user_id") % 13).cast("int")
    rows = e.select("index", F.array_repeat(F.lit(7), q).alias("query"), F.array_repeat(F.lit(9), r).alias("response"))
    packs = K.pack_next_fit(rows.withColumn("n", F.size("query") + F.size("response")), "index", "n", 64, block_rows=1000)
    p = K.packed_arrays(rows, packs)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select(
        "pack", F.size("query_responses").alias("n"), F.size(F.filter("response_masks", lambda m: m > 0)).alias("n_response"), F.array_max("attention_masks").alias("sequences"),
        total("response_masks").alias("mask_sum"), total("position_ids").alias("position_sum"), total("dones").alias("done_sum"),
    )


@query(
    "gae",
    """WITH RECURSIVE e AS (SELECT event_id // 20 AS g, event_id % 20 AS t, value AS v, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS r FROM events),
 b AS (SELECT *, lead(v, 1, 0) OVER (PARTITION BY g ORDER BY t) AS nv, max(t) OVER (PARTITION BY g) AS top FROM e),
 a AS (SELECT g, t, (r + 0.99::DOUBLE * nv - v)::DOUBLE AS adv FROM b WHERE t = top UNION ALL SELECT b.g, b.t, (b.r + 0.99::DOUBLE * b.nv - b.v + 0.99::DOUBLE * 0.95 * a.adv)::DOUBLE FROM a JOIN b ON b.g = a.g AND b.t = a.t - 1)
 SELECT g, t, round(adv, 6) AS advantage FROM a""",
)
def gae(spark, sf):
    """PK16 over trajectories of 20 events."""
    e = table(spark, sf, "events").withColumn("g", F.floor(F.col("event_id") / 20)).withColumn("r", (F.col("event_type") == "click").cast("double"))
    rows = e.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("event_id", "value", "r"))).alias("s"))
    v, r = F.transform("s", lambda x: x["value"]), F.transform("s", lambda x: x["r"])
    a = rows.select("g", K.gae(0.99, 0.95)(v, r).alias("a"))
    return a.select("g", F.posexplode("a").alias("t", "x")).select("g", F.col("t").cast("long").alias("t"), F.round("x", 6).alias("advantage"))


@query(
    "spread",
    f"""WITH d AS (SELECT doc_id, coalesce(quality, 0) AS q, {S.n_words('text')} AS n FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, (n // 3 + (n % 3 > 1)::INTEGER) * 2.5 + (n // 3 + (n % 3 > 2)::INTEGER) * q AS total FROM d""",
    cast={"total": "DOUBLE"},
)
def spread(spark, sf):
    """PK10: token masks 0, 1, 2, 0, 1, 2, … take the values of their sequence."""
    mask = F.transform(X.words(F.col("text")), lambda w, i: i % 3)
    d = labelled_docs(spark, sf).withColumn("s", K.spread(mask, F.array(F.lit(2.5), F.coalesce("quality", F.lit(0)).cast("double"))))
    return d.select("doc_id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    "split_conversation",
    f"""WITH RECURSIVE c AS ({S.chat()}), l AS (SELECT conv_id, list_transform(messages[:len(messages) - len(messages) % 2], lambda m: {S.n_words('m.content')} + 6) AS n FROM c),
 p AS (SELECT conv_id, unnest(range(len(n) // 2)) AS k, unnest(list_transform(range(len(n) // 2), lambda k: n[2 * k + 1] + n[2 * k + 2])) AS here, len(n) // 2 AS pairs FROM l),
 f AS (SELECT conv_id, k, CASE WHEN here > 150 THEN CASE WHEN here > 150 THEN 2 ELSE 0 END ELSE 0 END AS start, here AS len, CASE WHEN here > 150 THEN {{'a': 0, 'b': 0}} WHEN k = pairs - 1 THEN {{'a': 0, 'b': 2}} END AS seg FROM p WHERE k = 0
  UNION ALL SELECT p.conv_id, p.k, CASE WHEN f.len + p.here > 150 THEN CASE WHEN p.here > 150 THEN 2 * p.k + 2 ELSE 2 * p.k END ELSE f.start END, CASE WHEN f.len + p.here > 150 THEN 0 ELSE f.len END + p.here,
   CASE WHEN f.len + p.here > 150 THEN {{'a': f.start, 'b': 2 * p.k}} WHEN p.k = p.pairs - 1 THEN {{'a': f.start, 'b': 2 * p.k + 2}} END FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1)
 SELECT conv_id || '_' || seg.a AS id, (seg.b - seg.a)::INTEGER AS n FROM f WHERE seg IS NOT NULL""",
)
def split_conversation(spark, sf):
    """PK14."""
    c = chat(spark, sf).withColumnRenamed("conv_id", "id")
    lengths = F.transform("messages", lambda m: X.word_count(m["content"]))
    return K.split_conversations(c, "id", "messages", lengths, 150).select("id", F.size("messages").alias("n"))


@query(
    "fit_context",
    f"""WITH m AS (SELECT conv_id, turn, role, {S.n_words('text')} AS w FROM conversations), s AS (SELECT conv_id, coalesce(sum(w + 4) FILTER (WHERE role = 'system'), 0) AS u, count(*) FILTER (WHERE role = 'system') AS k FROM m GROUP BY 1),
 o AS (SELECT m.*, sum(w + 3) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM m WHERE role <> 'system'),
 x AS (SELECT o.*, u, c <= 120 - u AS fits, 120 - u - (c - w - 3) - 3 AS room, coalesce(lag(c <= 120 - u) OVER (PARTITION BY conv_id ORDER BY turn), true) AS before FROM o JOIN s USING (conv_id))
 SELECT s.conv_id, (k + coalesce((SELECT count(*) FROM x WHERE x.conv_id = s.conv_id AND u < 120 AND (fits OR (before AND room > 0))), 0))::INTEGER AS n,
  coalesce((SELECT sum(CASE WHEN fits THEN w ELSE room END) FROM x WHERE x.conv_id = s.conv_id AND u < 120 AND (fits OR (before AND room > 0))), 0)::BIGINT AS words FROM s""",
)
def fit_context(spark, sf):
    """PK17 without the doubled system count: kept messages and the words kept of the others."""
    c = chat(spark, sf).withColumn("f", K.fit_context(F.col("messages"), 120, compat=False))
    spoken = F.filter("f", lambda m: m["role"] != "system")
    words = F.aggregate(spoken, F.lit(0).cast("long"), lambda a, m: a + X.word_count(m["content"]))
    return c.select("conv_id", F.size("f").alias("n"), words.alias("words"))


@query(
    "encode_plain",
    f"""WITH t AS (SELECT unnest({_TOKENS}) AS token FROM documents), cn AS (SELECT token, count(*) AS n FROM t GROUP BY 1),
 v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM cn ORDER BY n DESC, token LIMIT 2000),
 x AS (SELECT doc_id, unnest({_HEAD.replace("role", "'user'")} || {_TOKENS} || [chr(10)]) AS token FROM documents)
 SELECT doc_id, count(*)::INTEGER AS n, sum(coalesce(id, 0))::BIGINT AS id_sum, count(*) FILTER (WHERE id IS NULL)::INTEGER AS unknown FROM x LEFT JOIN v USING (token) GROUP BY 1""",
)
def encode_plain(spark, sf):
    """PK2 and PK5: whole documents encoded, nothing masked."""
    from chatmill.plans.tables import doc_messages

    vocab = K.build_vocab(documents(spark, sf), K.tokens(F.col("text")), 2000)
    e = K.encode_chat(doc_messages(spark, sf), K.encoder(vocab), mode="none")
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)
    return e.select(
        F.col("original_id").alias("doc_id"), F.size("input_ids").alias("n"), total.alias("id_sum"), F.size(F.filter("input_ids", lambda i: i == 0)).alias("unknown")
    )


_TURN_TOKENS = f"""t AS (SELECT conv_id, turn, role, len({_TOKENS}) + CASE WHEN role = 'assistant' THEN 3 ELSE 1 END AS body,
   max(turn) OVER (PARTITION BY conv_id) AS top, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 c AS (SELECT conv_id, sum(6 + body + (role = 'assistant' AND turn < top)::INTEGER) AS total, max(CASE WHEN turn = top THEN body + CASE WHEN role = 'assistant' AND n > 1 THEN 0 ELSE 6 END END) AS last_turn,
   max(CASE WHEN turn = top AND n > 1 THEN body + CASE WHEN role = 'assistant' THEN 0 ELSE 6 END ELSE 0 END) AS prompt FROM t GROUP BY 1)"""


@query("encode_label_modes", f"WITH {_TURN_TOKENS} SELECT conv_id, total::INTEGER AS n, last_turn::INTEGER AS n_last_turn, prompt::INTEGER AS n_prompt FROM c")
def encode_label_modes(spark, sf):
    """PK4, PK5 and PK6: trainable tokens when all but the last turn, or the prompt, is masked."""
    pair = chat(spark, sf).select("conv_id", F.col("messages").alias("chosen"), F.col("messages").alias("rejected"))
    ids = lambda toks: F.transform(toks, lambda t: F.lit(1))  # any encoder will do for counting
    e = K.encode_preference(pair, ids, mode="last_turn")
    e = K.encode_chat(e, ids, "rejected", mode="prompt", prefix="masked_")
    kept = lambda c: F.size(F.filter(c, lambda x: x != -100))
    return e.select("conv_id", F.size("chosen_input_ids").alias("n"), kept("chosen_labels").alias("n_last_turn"), kept("masked_labels").alias("n_prompt"))


@query(
    "encode_verifiable",
    f"""WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 p AS (SELECT * FROM m WHERE NOT (turn = top AND n > 1 AND role = 'assistant')), q AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS ptop FROM p)
 SELECT conv_id, (sum(6 + len({_TOKENS}) + CASE WHEN role = 'assistant' THEN 3 + (turn < ptop)::INTEGER ELSE 1 END) + 6)::INTEGER AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS raw_prompt, 'gsm8k' AS verifier FROM q GROUP BY 1""",
)
def encode_verifiable(spark, sf):
    """PK7 and CNV23: prompt ids with the generation header, raw prompt, list-valued verifier."""
    df = chat(spark, sf).withColumns({"ground_truth": F.lit("1"), "dataset": F.lit("gsm8k")})
    e = K.encode_verifiable(df, lambda toks: F.transform(toks, lambda t: F.lit(1)), pad_id=0)
    return e.select("conv_id", F.size("input_ids_prompt").alias("n"), "raw_prompt", F.col("dataset")[0].alias("verifier"))
