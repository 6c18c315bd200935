"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.llm import alignment, binary_codes, decontamination, importance, mixing, near_duplicates, quality, secrets, sentence_spans, sharding, sqltext, suffix_buckets, toxicity, url_reputation
from chatmill.llm.common import remainder, table
from chatmill.llm.registry import query
from chatmill.llm.url_reputation import Rule

# fixed values: the contract's rules
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def scored(df, fold: int):
    """The columns that both classifiers return, from documents with a score and maybe more columns."""
    return df.withColumn("held_out", F.coalesce(F.col("_fold") == fold, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.7).cast("int")).drop("_fold")


def training(spark, sf_dir: str, folds: int, held_out: int):
    """Labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").filter(remainder(folds) != held_out)


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, training(spark, sf_dir, 3, 1), "toxic")
    df = toxicity.score(docs.select("doc_id", remainder(3).alias("_fold"), "text"), model)
    return scored(df.select("doc_id", "_fold", "score", F.size("passages").alias("n_passages"), F.array_max("passages.score").alias("best_passage_score")), 1)


@query("op2_near_duplicates")
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates.components_of(table(spark, sf_dir, "documents"), words_per_shingle=2)


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op4_nearest")
def op4_nearest(spark, sf_dir):
    return binary_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_suffix_buckets")
def op5_suffix_buckets(spark, sf_dir):
    return suffix_buckets.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(docs, 40, settled=True).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op7_sentence_spans")
def op7_sentence_spans(spark, sf_dir):
    df = sentence_spans.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_sentences", "n_removed", "n_removed_words", F.col("kept_text").alias("text"))


@query("op8_url_reputation")
def op8_url_reputation(spark, sf_dir):
    """A page's outcome is that of the document its path numbers: bad when labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]{2}/([0-9]{1,18})", 1)
    numbered = pages.withColumn("_doc", F.when(number != "", number).cast("long"))
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("outcome"))
    labelled = numbered.join(bad, F.col("_doc") == F.col("_id"), "left").select("page_id", "url", "outcome")
    judged = url_reputation.judge(labelled, RULES, "outcome")
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_rate_low", 9).alias("bad_rate_low"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, training(spark, sf_dir, 4, 2), "quality")
    df = quality.score(docs.select("doc_id", remainder(4).alias("_fold"), "text"), model)
    return scored(df.select("doc_id", "_fold", "score"), 2)


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    found = decontamination.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    done = decontamination.digest(found, "n_words", "spans", "items")
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op11_importance", sqltext.IMPORTANCE)
def op11_importance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = importance.score(docs, table(spark, sf_dir, "benchmark")).drop("text")  # with single words, features are words
    return importance.draw(scored, (10, 100), 20, names=("n_features", "n_features", "score", "rank"))


@query("op12_secrets", sqltext.secrets(secrets.RULES, [r.kind for r in secrets.BASE]))
def op12_secrets(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.of_kinds(F.col("secrets"), [r.kind for r in secrets.BASE])
    return found.select(
        "doc_id",
        *[F.size(secrets.of_kinds(F.col("secrets"), [r.kind])).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    done = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *alignment.NUMBERS)
