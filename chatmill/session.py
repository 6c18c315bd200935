"""Session helpers: where intermediate tables live, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "chatmill") -> SparkSession:
    """Session for tests and local benchmarks. On a cluster the caller brings their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")  # small inputs still use all cores
        .config("spark.sql.files.maxPartitionBytes", "4m")  # and a small file is cut where its row groups allow
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="chatmill-ckpt-"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session names it.

    Only a local-mode session that names none gets a temporary folder of its own; on a cluster a
    missing setting is an error, because a machine-local path would not survive losing an executor.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    named = tempfile.mkdtemp(prefix="chatmill-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes non-deterministic
    placement, and survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps partition numbers and row order inside partitions."""
    shared = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
