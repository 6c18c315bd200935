"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill import schema as SC
from chatmill.functions import text as X


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines with a stated schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, *paths: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(*paths)


def read_many_with_tag(spark: SparkSession, path: str, schema: T.StructType, tag: str = "aspect", pattern: str = "*.jsonl", level: str = "file") -> DataFrame:
    """All JSON-lines files under ``path``; ``tag`` is the file stem, or with ``level='folder'`` the folder
    (``___`` in it stands for a slash)."""
    df = spark.read.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").json(path)
    if level == "file":
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    else:
        name = F.replace(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1), F.lit("___"), F.lit("/"))
    return df.select("*", name.alias(tag))


def parse_batch_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """Response rows of a batch service out of text lines: (custom_id, content, finish_reason, prompt_tokens,
    completion_tokens). Blank and corrupt lines and responses stopped by a content filter are left out;
    the time-stamp prefix of ids is removed."""
    j = lines.filter(F.col(column).rlike(r"\S")).select(
        F.from_json(column, SC.BATCH_RESULT, {"mode": "PERMISSIVE"}).alias("r"), X.is_json(F.col(column)).alias("ok")
    )
    choice = F.get(F.col("r.response.body.choices"), F.lit(0))
    out = j.filter(F.col("ok") & F.col("r.custom_id").isNotNull() & choice.isNotNull()).select(
        F.regexp_replace("r.custom_id", r"^[^_]*_", "").alias("custom_id"),
        choice["message"]["content"].alias("content"),
        choice["finish_reason"].alias("finish_reason"),
        F.col("r.response.body.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("r.response.body.usage.completion_tokens").alias("completion_tokens"),
    )
    return out.filter(~F.coalesce(F.col("finish_reason") == "content_filter", F.lit(False)))


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_batch_results(spark.read.text(path))


def read_aspect_outputs(results: DataFrame, aspects: dict[str, str]) -> DataFrame:
    """(id, aspect, output) from batch results whose ids read ``{id}_{aspect code}_…``."""
    codes = F.create_map(*[F.lit(x) for kv in aspects.items() for x in kv])
    return results.select(
        F.substring_index("custom_id", "_", 1).alias("id"),
        F.element_at(codes, F.get(F.split("custom_id", "_"), F.lit(1))).alias("aspect"),
        F.coalesce("content", F.lit("")).alias("output"),
    )


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Streaming read of a folder; ``files_per_trigger`` bounds how far a batch may run ahead."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(path)


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Streaming read of one table of a folder, which is a file or a folder of files. The source takes a file only as the
    match of a pattern, and a pattern that matches a folder stands for its files."""
    return read_stream(spark, f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}.{fmt}", schema, fmt)
