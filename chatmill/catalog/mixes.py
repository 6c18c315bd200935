"""Ordering, sampling and mixing of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.operators import joins as J
from chatmill.operators import mixing as M
from chatmill.operators import ordering as O
from chatmill.operators import stats as ST
from chatmill.plans.tables import documents, labelled_docs


def _h(seed, c="doc_id"):
    return f"{S.hash_key(seed, c)}, {c}"


@query("shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_h(42)}) - 1 AS rank FROM documents")
def shuffle(spark, sf):
    """ORD6: rank of every row in the seeded permutation."""
    return O.hash_rank(documents(spark, sf).select("doc_id"), 42, "doc_id")


@query(
    "dense_index",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS index FROM lineitem",
)
def dense_index(spark, sf):
    """ORD5 over an order that ends in unique columns."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return O.dense_index(df, order).drop("l_suppkey")


@query(
    "dense_offsets",
    'SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT - n_chars AS start, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS "end" FROM documents',
)
def dense_offsets(spark, sf):
    """WIN11."""
    return O.prefix_sum(documents(spark, sf).select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "start", "end")


@query("positional_slice", "SELECT doc_id, index FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) WHERE index >= 100 AND index < 350")
def positional_slice(spark, sf):
    """ORD7."""
    return O.slice_rows(O.dense_index(documents(spark, sf).select("doc_id"), "doc_id"), 100, 250)


@query(
    "contiguous_shard",
    """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, count(*) OVER () AS n FROM documents) SELECT doc_id, index FROM i WHERE index >= 2 * (n // 3)""",
)
def contiguous_shard(spark, sf):
    d = documents(spark, sf).select("doc_id")
    return O.contiguous_shard(O.dense_index(d, "doc_id"), 2, 3, d.count())


@query("train_test_split", f"SELECT doc_id, CASE WHEN {S.hash_unit(5, 'doc_id')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents")
def train_test_split(spark, sf):
    return O.train_test_split(documents(spark, sf).select("doc_id"), 0.1, 5, "doc_id")


@query("repeat", "SELECT item_id, unnest([1, 2, 3]) AS copy FROM benchmark")
def repeat(spark, sf):
    return O.repeat(table(spark, sf, "benchmark").select("item_id"), 3)


@query("limit_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def limit_rows(spark, sf):
    return O.limit_rows(documents(spark, sf).select("doc_id", "n_chars"), 50, [F.col("n_chars").desc(), F.col("doc_id")])


@query("sample_exact", f"SELECT doc_id FROM documents ORDER BY {_h(9)} LIMIT 333")
def sample_exact(spark, sf):
    return O.sample_exact(documents(spark, sf).select("doc_id"), 333, 9, "doc_id")


# by the number of the source: half as much again, twenty rows, or two and a quarter times as much
_AMOUNTS = ["1.5", "20", "2.25"]
_KIND = "substr(source, 4)::INTEGER % {n}"
_MIX = f"""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h(42)}) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
 f AS (SELECT *, floor(target / n)::BIGINT AS k FROM (SELECT doc_id, source, r, n, CASE {_KIND.format(n=3)} WHEN 0 THEN floor(1.5 * n)::BIGINT WHEN 1 THEN 20 ELSE floor(2.25 * n)::BIGINT END AS target FROM s))
 SELECT doc_id, source, unnest(range(1, k + 1)) AS copy FROM f WHERE k > 0 UNION ALL SELECT doc_id, source, k + 1 FROM f WHERE r < target % n"""


def _names(spark, sf) -> list[str]:
    """The sources of the table, as a mix list names them."""
    return sorted((r["source"] for r in documents(spark, sf).select("source").distinct().collect()), key=lambda x: int(x[3:]))


def _sources(spark, sf, names):
    d = documents(spark, sf).select("doc_id", "source")
    return {n: d.filter(F.col("source") == n) for n in names}


@query("mix_by_amounts", _MIX, cast={"copy": "INTEGER"})
def mix_by_amounts(spark, sf):
    """ORD1 and ORD2: proportions and counts, up- and downsampling."""
    names = _names(spark, sf)
    out, _ = M.mix_table(documents(spark, sf).select("doc_id", "source"), [x for n in names for x in (n, _AMOUNTS[int(n[3:]) % 3])], "doc_id")
    return out.select("doc_id", "source", "copy")


@query(
    "resample_by_source",
    f"""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h(1)}) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
 f AS (SELECT *, floor(n * 1.3)::BIGINT AS target FROM s) SELECT doc_id, lang, unnest(range(1, target // n + 1)) AS copy FROM f UNION ALL SELECT doc_id, lang, target // n + 1 FROM f WHERE r < target % n""",
    cast={"copy": "INTEGER"},
)
def resample_by_source(spark, sf):
    """ORD2 for all sources of one table in one plan."""
    d = documents(spark, sf).select("doc_id", "lang")
    sizes = d.groupBy("lang").agg(F.count("*").alias("size")).withColumn("target", F.floor(F.col("size") * F.lit(1.3)))
    return M.resample_by_source(d, sizes, "lang", 1, "doc_id")


@query(
    "mix_fixed",
    f"""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h(42)}) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT doc_id, source FROM s WHERE r <= floor(CASE {_KIND.format(n=2)} WHEN 0 THEN 0.25 ELSE 0.5 END * n)""",
)
def mix_fixed(spark, sf):
    """ORD3."""
    names = _names(spark, sf)
    return M.mix_fixed(_sources(spark, sf, names), {n: (0.25, 0.5)[int(n[3:]) % 2] for n in names}, "doc_id")


@query(
    "combine",
    f"""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h(42)}) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT doc_id, source FROM s WHERE CASE {_KIND.format(n=3)} WHEN 2 THEN r <= 15 WHEN 0 THEN r <= floor(0.75 * n) ELSE true END""",
)
def combine(spark, sf):
    """ORD4: counts, fractions and test sources, which are never subsampled."""
    names = _names(spark, sf)
    return M.combine(_sources(spark, sf, names), {n: (0.75, 0.1, 15.0)[int(n[3:]) % 3] for n in names}, "doc_id", splits={n: "test" for n in names if int(n[3:]) % 3 == 1})


@query(
    "stratified_portions",
    f"""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h(8)}) AS r FROM documents) SELECT doc_id, lang FROM s
 WHERE r <= CASE lang WHEN 'en' THEN 250 WHEN 'de' THEN 100 WHEN 'fr' THEN 150 END""",
)
def stratified_portions(spark, sf):
    return M.stratified_portions(documents(spark, sf).select("doc_id", "lang"), {"en": 0.5, "de": 0.2, "fr": 0.3}, 500, "lang", 8, "doc_id")


@query(
    "sample_per_task",
    f"""WITH s AS (SELECT doc_id, source, toxic = 1 AS shot FROM documents JOIN labels USING (doc_id) WHERE source <> 'src9'),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, shot ORDER BY {_h(4)}) AS r FROM s) SELECT doc_id, source, shot FROM r WHERE r <= CASE WHEN shot THEN 2 ELSE 5 END""",
)
def sample_per_task(spark, sf):
    d = labelled_docs(spark, sf).filter("toxic is not null").select("doc_id", "source", (F.col("toxic") == 1).alias("shot"))
    return M.sample_per_task(d, "source", "shot", 5, 2, 4, "doc_id", ["src9"])


@query(
    "sample_unique",
    f"""WITH u AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey FROM u ORDER BY {_h(6, 'o_custkey')} LIMIT 200""",
)
def sample_unique(spark, sf):
    """ORD15: last row per id wins, then a sample of ids."""
    return M.sample_unique(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 200, 6, ["o_orderkey"])


@query("distinct_by_id", "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def distinct_by_id(spark, sf):
    """SET2."""
    return M.distinct_by_id(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "sample_n_per_id",
    f"""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_h(2, 'o_orderkey')}) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT o_custkey, o_orderkey FROM s WHERE n >= 8 AND r <= 8""",
)
def sample_n_per_id(spark, sf):
    """WIN5."""
    from chatmill.operators.prefs import sample_n_per_id as pick

    return pick(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 8, 2, "o_orderkey")


def _epoch_sql(drop: bool) -> str:
    rows = (
        "SELECT pos, doc_id FROM p WHERE pos < (n // 48) * 48"
        if drop
        else "SELECT pos, doc_id FROM p UNION ALL SELECT pos + n, doc_id FROM p WHERE pos + n < n + (48 - n % 48) % 48"
    )
    return f"""WITH k AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
 p AS (SELECT doc_id, row_number() OVER (ORDER BY {_h(45)}) - 1 AS pos, count(*) OVER () AS n FROM k), r AS ({rows})
 SELECT 3 AS epoch, (pos % 48 % 4)::INTEGER AS rank, pos // 48 AS step, pos, doc_id AS index FROM r"""


def _epoch(spark, sf, drop):
    bad = table(spark, sf, "labels").filter("toxic = 1")
    kept = J.exclude(documents(spark, sf).select("doc_id"), bad, "doc_id")
    return O.epoch_shards(kept, "doc_id", 42, 3, world=4, batch=48, total=kept.count(), drop_last=drop)


@query("epoch_shards", _epoch_sql(True))
def epoch_shards(spark, sf):
    """ORD13 with JN18's exclusions."""
    return _epoch(spark, sf, True)


@query("epoch_shards_padded", _epoch_sql(False))
def epoch_shards_padded(spark, sf):
    return _epoch(spark, sf, False)


@query(
    "split_for_workers",
    f"""WITH p AS (SELECT doc_id AS pack, count(*) OVER () // 3 AS per FROM documents), k AS (SELECT pack, pack // per AS worker FROM p WHERE pack < per * 3),
 r AS (SELECT pack, worker, row_number() OVER (PARTITION BY worker ORDER BY {_h(12, 'pack')}) - 1 AS slot FROM k) SELECT pack, worker::INTEGER AS worker, slot, slot // 8 AS micro_batch FROM r""",
)
def split_for_workers(spark, sf):
    """ORD14; document ids are dense and serve as pack numbers."""
    d = documents(spark, sf).select(F.col("doc_id").alias("pack"))
    return O.split_for_workers(d, "pack", 3, 8, d.count(), 12)


@query(
    "mix_statistics",
    f"""WITH s AS (SELECT source, count(*) AS original_size, floor(count(*) * 1.3)::BIGINT AS initial_instances FROM documents GROUP BY 1),
 b AS (SELECT doc_id, source, {S.n_words('text')} AS w, row_number() OVER (PARTITION BY source ORDER BY {_h(1)}) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
 c AS (SELECT source, w, unnest(range(1, floor(n * 1.3)::BIGINT // n + 1)) AS copy FROM b UNION ALL SELECT source, w, 0 FROM b WHERE r < floor(n * 1.3)::BIGINT % n),
 f AS (SELECT source, count(*) AS final_instances, sum(w)::BIGINT AS total_tokens, sum(greatest(w - 5, 0))::BIGINT AS trainable_tokens FROM c WHERE w >= 20 GROUP BY 1)
 SELECT source, original_size, initial_instances, coalesce(final_instances, 0) AS final_instances, initial_instances - coalesce(final_instances, 0) AS instances_filtered,
  coalesce(total_tokens, 0) AS total_tokens, coalesce(trainable_tokens, 0) AS trainable_tokens, initial_instances > original_size AS is_upsampled,
  CASE WHEN coalesce(final_instances, 0) > 0 THEN total_tokens / final_instances ELSE 0 END AS avg_tokens_per_instance FROM s LEFT JOIN f USING (source)""",
)
def mix_statistics(spark, sf):
    """AGG4 over an upsampled, length-filtered mix; the first five tokens of a row are not trained on."""
    from chatmill.functions import text as X

    d = documents(spark, sf)
    sizes = d.groupBy("source").agg(F.count("*").alias("original_size")).withColumn("initial_instances", F.floor(F.col("original_size") * F.lit(1.3)))
    targets = sizes.select("source", F.col("original_size").alias("size"), F.col("initial_instances").alias("target"))
    mixed = M.resample_by_source(d.select("doc_id", "source", "text"), targets, "source", 1, "doc_id")
    tok = mixed.withColumn("input_ids", F.transform(X.words(F.col("text")), lambda w, i: i))
    tok = tok.withColumn("labels", F.transform("input_ids", lambda i: F.when(i < 5, -100).otherwise(i))).filter(F.size("input_ids") >= 20)
    return ST.mix_stats(tok, sizes.withColumn("is_upsampled", F.col("initial_instances") > F.col("original_size")), "source")


@query(
    "built_mix",
    f"""WITH s AS (SELECT doc_id, source, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY {_h(42)}) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
 f AS (SELECT *, CASE {_KIND.format(n=3)} WHEN 0 THEN floor(1.5 * n)::BIGINT WHEN 1 THEN 20 ELSE floor(2.25 * n)::BIGINT END AS target FROM s),
 c AS (SELECT doc_id, source, n_chars, unnest(range(1, target // n + 1)) AS copy FROM f UNION ALL SELECT doc_id, source, n_chars, target // n + 1 FROM f WHERE r < target % n)
 SELECT doc_id, source, copy::INTEGER AS copy, row_number() OVER (ORDER BY source, copy, doc_id) - 1 AS index FROM c WHERE n_chars <= 5000""",
)
def built_mix(spark, sf):
    """UDF1, ORD1, ORD5 and SNK7: a specification to an indexed table kept under its hash; the second build reads the cache."""
    import uuid

    from chatmill.plans.transforms import MixSpec, build_mix
    from chatmill.session import shared_dir

    root = f"{shared_dir(spark).rstrip('/')}/mix-{uuid.uuid4().hex}"
    d = documents(spark, sf).select("doc_id", "source", "n_chars")
    sources = {n: d.filter(F.col("source") == n) for n in _names(spark, sf)}
    spec = MixSpec(tuple(x for n in sources for x in (n, _AMOUNTS[int(n[3:]) % 3])), steps=(("max_length", {"n_chars": 5000}),), keep=("n_chars",), ids="doc_id")
    build_mix(spark, spec, sources, root=root)
    rows, _ = build_mix(spark, spec, {}, root=root)
    return rows.select("doc_id", "source", "copy", "index")


@query(
    "mix_stats_file",
    """SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""",
)
def mix_stats_file(spark, sf):
    """SNK6 then SRC1: statistics written as JSON and read back."""
    import uuid

    from chatmill.session import shared_dir
    from chatmill.sources.writers import write_stats

    path = f"{shared_dir(spark).rstrip('/')}/stats-{uuid.uuid4().hex}"
    stats = documents(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    write_stats(stats, path, "source")
    return spark.read.schema("source string, n long, chars long").json(path)
