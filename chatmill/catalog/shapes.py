"""Converters of raw record shapes, pair and label filters, and Parquet files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.packing import CHAT_TOKENS
from chatmill.catalog.registry import query
from chatmill.functions import text as X
from chatmill.functions import wordlists as L
from chatmill.operators import convert as C
from chatmill.operators import filters as P
from chatmill.plans.tables import chat, documents
from chatmill.session import shared_dir
from chatmill.sources.readers import read_parquet
from chatmill.sources.writers import write_parquet

_PAIR = "[{{'role': 'user', 'content': {u}}}, {{'role': 'assistant', 'content': {a}}}]"


def _apart(sql: str) -> str:
    return f"SELECT * EXCLUDE (messages), list_transform(messages, lambda m: m.role) AS roles, list_transform(messages, lambda m: m.content) AS contents FROM ({sql})"


def _columns(df):
    """Roles and contents as two lists, which both engines print alike."""
    return df.select("*", F.col("messages.role").alias("roles"), F.col("messages.content").alias("contents")).drop("messages")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "from_instruction_input_output",
    _apart("SELECT doc_id, "
    + _PAIR.format(
        u="""'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.'
  || chr(10) || chr(10) || '### Instruction:' || chr(10) || 'Name the language of {input}.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:'""",
        a="lang",
    )
    + " AS messages FROM documents"),
)
def from_instruction_input_output(spark, sf):
    """CNV3; a slot name inside a filled text stays as it is."""
    d = documents(spark, sf).withColumn("instruction", F.lit("Name the language of {input}."))
    return _columns(d.select("doc_id", C.from_instruction_input_output("instruction", "text", "lang").alias("messages")))


@query(
    "from_system_question_response",
    _apart("SELECT doc_id, [{'role': 'system', 'content': source}, {'role': 'user', 'content': text}, {'role': 'assistant', 'content': lang}] AS messages FROM documents"),
)
def from_system_question_response(spark, sf):
    """CNV4."""
    return _columns(documents(spark, sf).select("doc_id", C.from_system_question_response("source", "text", "lang").alias("messages")))


def _pairs(spark, sf):
    """Chosen: the conversation; rejected: the same without its last message, which may end in any role."""
    c = chat(spark, sf)
    return c.select("conv_id", F.col("messages").alias("chosen"), F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0))).alias("rejected"))


@query("chosen_as_messages", _apart(S.chat()))
def chosen_as_messages(spark, sf):
    """CNV9: pairs to training conversations."""
    return _columns(_pairs(spark, sf).select("conv_id", C.chosen_as_messages().alias("messages")))


_OK = "len(list_filter({c}, lambda m: coalesce(m.content, '') = '')) = 0 AND {c}[-1].role = 'assistant'"


@query(
    "valid_pair",
    f"""WITH p AS (SELECT conv_id, messages AS chosen, messages[1:len(messages) - 1 - conv_id % 2] AS rejected FROM ({S.chat()}))
 SELECT conv_id, coalesce({_OK.format(c='chosen')} AND {_OK.format(c='rejected')}, false) AS ok FROM p""",
)
def valid_pair(spark, sf):
    """FLT18: the rejected side lacks the last message or, for odd conversations, the last two."""
    p = _pairs(spark, sf)
    shorter = F.slice("rejected", F.lit(1), F.greatest(F.size("rejected") - (F.col("conv_id") % 2).cast("int"), F.lit(0)))
    return p.withColumn("rejected", shorter).select("conv_id", P.valid_pair().alias("ok"))


@query(
    "has_trainable_label",
    f"{CHAT_TOKENS} SELECT DISTINCT conv_id FROM o WHERE pos <= 4096 AND train",
)
def has_trainable_label(spark, sf):
    """FLT15 behind PK3: labels of whole conversations, encoded up to 4 096 tokens."""
    from chatmill.operators import pack as K
    from chatmill.plans.tables import turns

    vocab = K.build_vocab(turns(spark, sf), K.tokens(F.col("content")), 400)
    return K.encode_chat(chat(spark, sf), K.encoder(vocab), template="tags", eos="<eos>", max_len=4096).filter(P.has_trainable_label()).select("conv_id")


@query("keep_equal", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def keep_equal(spark, sf):
    """FLT27."""
    return P.keep_equal(documents(spark, sf), lang="en", source="src1").select("doc_id", "lang", "source")


@query("count_guard", "SELECT count(*) AS n_in, count(*) FILTER (WHERE doc_id % 997 <> 5) AS n_out FROM documents")
def count_guard(spark, sf):
    """FLT25: results that lost a few rows pass the guard and are reported; it raises past one in a hundred."""
    n = documents(spark, sf).agg(F.count("*").alias("n_in"), F.count_if(F.col("doc_id") % 997 != 5).alias("n_out"))
    r = n.first()
    P.count_guard(r["n_in"], r["n_out"])
    return n


_KEYWORDS = r"\b(?:" + "|".join(k.lower() for k in L.SELF_REFERENCE_KEYWORDS) + r")\b"


@query(
    "convert_sft",
    _apart(f"""SELECT doc_id AS id, {_PAIR.format(u='lang', a='text')} AS messages, 'docs' AS source FROM documents
 WHERE NOT coalesce(regexp_matches(lower(text), {S.q(_KEYWORDS)}), false) AND regexp_matches(lang, '[^{S.WS}]') AND regexp_matches(text, '[^{S.WS}]')"""),
)
def convert_sft(spark, sf):
    """UDF5: projection, keyword filter, empty filter."""
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), "lang", "text")
    return _columns(C.convert_sft(d, C.from_pair("lang", "text"), (P.drop_keyword_self_reference, P.drop_empty_message), source="docs"))


@query(
    "parquet_files",
    """SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents""",
)
def parquet_files(spark, sf):
    """SNK2 and SRC2: two folders with different columns, read as one table with merged schema."""
    d, even, odd = documents(spark, sf), _folder(spark, "even"), _folder(spark, "odd")
    write_parquet(d.filter("doc_id % 2 = 0").select("doc_id", "lang", "n_chars"), f"{even}")
    write_parquet(d.filter("doc_id % 2 = 1").select("doc_id", "lang", "source"), f"{odd}")
    return read_parquet(spark, f"{even}", f"{odd}", merge_schema=True).select("doc_id", "lang", "n_chars", "source")


@query("parquet_partitions", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('de', 'en') GROUP BY 1")
def parquet_partitions(spark, sf):
    """SNK2 with a folder per language; a filter on the language reads only its folders."""
    path = _folder(spark, "by-lang")
    write_parquet(documents(spark, sf).select("doc_id", "lang", "n_chars"), path, ["lang"])
    return read_parquet(spark, path).filter(F.col("lang").isin("de", "en")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
