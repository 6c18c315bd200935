"""Quantiles out of mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatmill.catalog import sqlparts as S
from chatmill.catalog.registry import query, table
from chatmill.functions import text as X
from chatmill.operators import sketches as K
from chatmill.plans.tables import documents, turns

# the bound of a whole number's bucket: its eight leading binary digits
LOW = "CASE WHEN {v} < 256 THEN {v} ELSE ({v} >> (length(bin({v})) - 8)) << (length(bin({v})) - 8) END"
P = (0.01, 0.25, 0.5, 0.75, 0.99)


def _quantiles(rows: str, by: str = "") -> str:
    """Quantiles of (by, measure, x): exact ranks, then the bucket of the value found there."""
    keys = f"{by}, measure" if by else "measure"
    at = f"a.measure = r.measure" + (f" AND a.{by} IS NOT DISTINCT FROM r.{by}" if by else "")
    return f"""WITH rows AS ({rows}), low AS (SELECT {keys}, x, {LOW.format(v='x')} AS b FROM rows WHERE x IS NOT NULL),
 a AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS place, count(*) OVER (PARTITION BY {keys}) AS n FROM low),
 p AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in P)}]) AS p),
 r AS (SELECT {keys}, p, b, place AS rank, n FROM a, p WHERE place = greatest(ceil(p * n), 1))
 SELECT {", ".join(f"r.{k}" for k in keys.split(", "))}, r.p, r.b::DOUBLE AS value, r.rank, min(a.place) AS rank_low, max(a.place) AS rank_high, r.n
 FROM r JOIN a ON {at} AND a.b = r.b GROUP BY {", ".join(f"r.{k}" for k in keys.split(", "))}, r.p, r.b, r.rank, r.n"""


def _lengths(by: str = "") -> str:
    return f"SELECT {by} 'chars' AS measure, n_chars::BIGINT AS x FROM documents UNION ALL SELECT {by} 'words', {S.n_words('text')}::BIGINT FROM documents"


def _measures(spark, sf):
    return documents(spark, sf), {"chars": F.col("n_chars"), "words": X.word_count(F.col("text"))}


@query("quantile_sketch", _quantiles(_lengths("source,"), "source"))
def quantile_sketch(spark, sf):
    """AGG28 by source: quantiles of lengths with the ranks their buckets hold."""
    docs, measures = _measures(spark, sf)
    return K.quantiles(K.cells(docs, measures, ["source"]), P, ["source"])


@query("quantile_sketch_merged", _quantiles(_lengths()))
def quantile_sketch_merged(spark, sf):
    """Sketches of every source and language, kept as one value each and merged: the same answers as one sketch of all rows."""
    docs, measures = _measures(spark, sf)
    by = ["source", "lang"]
    kept = K.pack(K.cells(docs, measures, by), by)
    return K.quantiles(K.merge([K.unpack(kept, by)]), P)


_SUMMARY = """SELECT {by} measure, count(*) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x)::DOUBLE AS min,
 max(b) FILTER (place = greatest(ceil(0.25::DOUBLE * n), 1))::DOUBLE AS p25, max(b) FILTER (place = greatest(ceil(0.5::DOUBLE * n), 1))::DOUBLE AS p50,
 max(b) FILTER (place = greatest(ceil(0.75::DOUBLE * n), 1))::DOUBLE AS p75, max(x)::DOUBLE AS max
 FROM (SELECT *, """ + LOW.format(v="x") + """ AS b, row_number() OVER (PARTITION BY {by} measure ORDER BY x) AS place, count(*) OVER (PARTITION BY {by} measure) AS n FROM ({rows}) WHERE x IS NOT NULL)
 GROUP BY {by} measure"""


@query(
    "message_stats_sketch",
    _SUMMARY.format(
        by="",
        rows=f"""SELECT role AS measure, {S.n_words('text')}::BIGINT AS x FROM conversations WHERE role IN ('user', 'assistant')
 UNION ALL SELECT 'turns', count(*) FILTER (WHERE role <> 'system') FROM conversations GROUP BY conv_id
 UNION ALL SELECT 'total', coalesce(sum({S.n_words('text')}) FILTER (WHERE role IN ('user', 'assistant')), 0)::BIGINT FROM conversations GROUP BY conv_id""",
    ),
    approx=["mean", "std"],
)
def message_stats_sketch(spark, sf):
    """AGG1 with sketched quartiles."""
    return K.summary(K.message_cells(turns(spark, sf), "conv_id", X.word_count(F.col("content"))))


@query(
    "prompt_completion_sketch",
    _SUMMARY.format(by="", rows="SELECT 'prompt' AS measure, length(url)::BIGINT AS x FROM pages UNION ALL SELECT 'completion', length(html) FROM pages UNION ALL SELECT 'total', length(url) + length(html) FROM pages"),
    approx=["mean", "std"],
)
def prompt_completion_sketch(spark, sf):
    """AGG2 with sketched quartiles."""
    p, c = F.length("url"), F.length("html")
    return K.summary(K.cells(table(spark, sf, "pages"), {"prompt": p, "completion": c, "total": p + c}))
