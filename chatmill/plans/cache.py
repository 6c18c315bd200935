"""Built tables kept under a hash of their configuration and of the data they were built from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_VERSION = 1


def _plain(x):
    if is_dataclass(x):
        x = asdict(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v is not None}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def config_hash(*configs) -> str:
    """Ten hex digits of the SHA-256 of the canonical JSON; unset values do not count."""
    text = json.dumps({"version": CACHE_VERSION, "configs": _plain(list(configs))}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:10]


def fingerprint(df: DataFrame) -> str:
    """Names the content of a table: its schema and its rows as a multiset, whatever their order and partitions.

    One aggregate: the number of rows, the sum of one row hash and the exclusive or of another."""
    columns = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    r = df.select(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b")).agg(
        F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.bit_xor("b").alias("b")
    ).first()
    return config_hash(df.schema.simpleString(), r["n"], str(r["a"]), r["b"])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, root: str, config, build: Callable[[], tuple[DataFrame, DataFrame | None]], skip: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(table, statistics) from the cache when a finished write is there, else built and written first.
    ``skip`` builds without reading or writing the cache."""
    if skip:
        return build()
    path = f"{root.rstrip('/')}/{config_hash(config)}"
    data, stats = f"{path}/data", f"{path}/stats"
    if not exists(spark, f"{data}/_SUCCESS"):
        df, st = build()
        if st is not None:
            st.write.mode("overwrite").parquet(stats)
        df.write.mode("overwrite").parquet(data)  # last: its success marker makes the entry valid
    return spark.read.parquet(data), spark.read.parquet(stats) if exists(spark, f"{stats}/_SUCCESS") else None
