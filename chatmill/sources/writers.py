"""Writers. Each is one distributed write; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def score_matrix(scores: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """Means as strings with four decimals, one row per ``row`` and one column per ``column``."""
    m = scores.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return m.select(row, *[F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).alias(c) for c in m.columns if c != row])


def write_tsv_matrix(scores: DataFrame, path: str, row: str, column: str, value: str, columns: list[str] | None = None) -> None:
    score_matrix(scores, row, column, value, columns).repartition(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_sharded(df: DataFrame, path: str, rows_per_file: int, partition_by: str, fmt: str = "json") -> None:
    """A folder per value of ``partition_by``, at most ``rows_per_file`` rows per file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(partition_by).format(fmt).save(path)


def batch_requests(df: DataFrame, custom_id: Column, messages: Column, model: str, temperature: float = 0.7, url: str = "/v1/chat/completions", extra: dict | None = None) -> DataFrame:
    """One JSON line per request."""
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()])
    request = F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))
    return df.select(F.to_json(request).alias("value"))


def write_batch_requests(df: DataFrame, path: str, custom_id: Column, messages: Column, model: str, rows_per_file: int = 10_000, **kw) -> None:
    batch_requests(df, custom_id, messages, model, **kw).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def write_stats(stats: DataFrame, path: str, order_by: str, as_text: bool = False) -> None:
    """Statistics rows (one per source) as JSON, or as aligned ``name: value`` text."""
    ordered = stats.repartition(1).sortWithinPartitions(order_by)
    if not as_text:
        ordered.write.mode("overwrite").json(path)
        return
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats.columns]
    ordered.select(F.concat_ws(", ", *parts).alias("value")).write.mode("overwrite").text(path)


def write_kept_and_removed(df: DataFrame, predicate: Column, path: str) -> None:
    """Kept and removed rows of a predicate in one pass, as folders kept=true and kept=false."""
    df.withColumn("kept", F.coalesce(predicate, F.lit(False))).write.mode("overwrite").partitionBy("kept").parquet(path)


def write_chunks(stream: DataFrame, path: str) -> None:
    """Token-stream pieces in a folder per chunk, each chunk's pieces in order."""
    stream.repartition("chunk").sortWithinPartitions("chunk", "start").write.mode("overwrite").partitionBy("chunk").parquet(path)
