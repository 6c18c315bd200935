"""Streams of scored rollouts: group assembly, filters, metrics and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatmill.operators.ordering import dense_index
from chatmill.plans.cache import exists

GROUP_SCHEMA = "prompt_id string, group_no long, complete boolean, rollout_id long, reward double, advantage double"
STATE_SCHEMA = "waiting binary"
WAITING = pa.schema([("prompt_id", pa.string()), ("rollout_id", pa.int64()), ("reward", pa.float64()), ("latest", pa.int64()), ("due", pa.int64())])
BUCKETS = 1024  # of prompts; a stream keeps its number as long as its checkpoint


def group_advantages(rewards: np.ndarray, mode: str = "standard") -> np.ndarray:
    """Advantages inside each group; the last axis runs over the samples of a group."""
    centred = rewards - rewards.mean(axis=-1, keepdims=True)
    return centred / (rewards.std(axis=-1, keepdims=True) + 1e-8) if mode == "standard" else centred


def _packed(waiting: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING) as out:
        out.write_table(pa.Table.from_pandas(waiting, WAITING, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes | None) -> pd.DataFrame:
    return (WAITING.empty_table() if state is None else pa.ipc.open_stream(pa.py_buffer(bytes(state))).read_all()).to_pandas()


def assemble_groups(
    stream: DataFrame, n: int, mode: str = "standard", watermark: str | None = None, drop_zero_std: bool = False, salts: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """Emit the samples of a prompt, with their advantages, as soon as ``n`` have arrived.

    ``stream``: prompt_id string, rollout_id long (unique within a prompt), reward double, ts timestamp.
    ``group_no`` is the group's first rollout_id, so it stays unique when a prompt returns after its state is
    gone. State is kept by bucket of prompts, so a call of the function serves many prompts: at most n - 1 waiting
    samples for each prompt of the bucket, and none where none waits; samples are taken batch by batch, so a busy
    prompt is not held in memory. With a watermark, waiting samples of a prompt that stays incomplete for that long are
    emitted with ``complete = false``. ``drop_zero_std`` leaves out complete groups whose rewards are all equal.
    ``salts`` spreads a prompt that returns in huge numbers over several buckets; any n of its samples make a group,
    so groups stay valid and only the number of waiting samples grows.
    """
    wait = int(pd.Timedelta(watermark).total_seconds() * 1000) if watermark else 0

    def groups(prompts, complete, numbers, ids, rewards, advantages):
        return pd.DataFrame({"prompt_id": prompts, "group_no": numbers, "complete": complete, "rollout_id": ids, "reward": rewards, "advantage": advantages})

    def take(waiting: pd.DataFrame, new: list[pd.DataFrame], now: int) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """What waits after the new samples, and the rows of the groups they complete."""
        fresh = sum(map(len, new))
        columns = {c: np.concatenate([f[c].to_numpy() for f in (waiting, *new)]) for c in ("rollout_id", "reward")}
        columns = {"rollout_id": columns["rollout_id"].astype(np.int64), "reward": columns["reward"].astype(float)}
        prompt, names = pd.factorize(np.concatenate([f["prompt_id"].to_numpy(dtype=object) for f in (waiting, *new)]), use_na_sentinel=False)
        seen = np.concatenate([waiting["latest"].to_numpy(np.int64), *[f["ts_ms"].fillna(0).to_numpy(np.int64) for f in new]])
        latest = np.zeros(len(names), np.int64)
        np.maximum.at(latest, prompt, seen)
        due = np.zeros(len(names), np.int64)
        due[prompt[: len(waiting)]] = waiting["due"].to_numpy(np.int64)
        touched = prompt[len(prompt) - fresh :]
        due[touched] = np.maximum(latest[touched] + wait, now + 1)
        order = np.argsort(prompt, kind="stable")  # in order of arrival inside a prompt
        prompt, ids, rewards = prompt[order], columns["rollout_id"][order], columns["reward"][order]
        sizes = np.bincount(prompt, minlength=len(names))
        full = np.arange(len(prompt)) - (np.cumsum(sizes) - sizes)[prompt] < (sizes // n * n)[prompt]
        g_prompt, g_ids, g_rewards = prompt[full].reshape(-1, n)[:, 0], ids[full].reshape(-1, n), rewards[full].reshape(-1, n)
        if drop_zero_std:
            varied = g_rewards.min(axis=1) != g_rewards.max(axis=1)
            g_prompt, g_ids, g_rewards = g_prompt[varied], g_ids[varied], g_rewards[varied]
        left = pd.DataFrame({"prompt_id": names[prompt[~full]], "rollout_id": ids[~full], "reward": rewards[~full], "latest": latest[prompt[~full]], "due": due[prompt[~full]]})
        if not len(g_ids):
            return left, None
        return left, groups(names[np.repeat(g_prompt, n)], True, np.repeat(g_ids[:, 0], n), g_ids.ravel(), g_rewards.ravel(), group_advantages(g_rewards, mode).ravel())

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = _unpacked(state.get[0] if state.exists else None)
        now = state.getCurrentWatermarkMs() if watermark else 0
        new: list[pd.DataFrame] = []
        for b in () if state.hasTimedOut else batches:
            new.append(b)
            if sum(map(len, new)) >= len(waiting):  # so that what waits is sorted as often as its size allows
                waiting, done = take(waiting, new, now)
                new = []
                if done is not None:
                    yield done
        if new:
            waiting, done = take(waiting, new, now)
            if done is not None:
                yield done
        if watermark:
            late = waiting["due"].to_numpy() < now
            gone, waiting = waiting[late], waiting[~late]
            if len(gone):
                prompt, names = pd.factorize(gone["prompt_id"].to_numpy(dtype=object), use_na_sentinel=False)
                ids = gone["rollout_id"].to_numpy()
                first = ids[np.unique(prompt, return_index=True)[1]]
                yield groups(names[prompt], False, first[prompt], ids, gone["reward"].to_numpy(), np.full(len(ids), np.nan))
        if len(waiting):
            state.update((_packed(waiting),))
            if watermark:
                state.setTimeoutTimestamp(max(int(waiting["due"].min()), now + 1))
        elif state.exists:
            state.remove()

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    s = (s.withWatermark("ts", watermark) if watermark else s).withColumn("ts_ms", F.unix_millis("ts"))
    salt = F.pmod(F.xxhash64("rollout_id"), F.lit(salts))
    s = s.withColumn("_bucket", F.pmod(F.xxhash64("prompt_id", salt), F.lit(buckets)))
    s = s.select("_bucket", "prompt_id", "rollout_id", "reward", "ts_ms", *(["ts"] if watermark else []))
    return s.groupBy("_bucket").applyInPandasWithState(step, GROUP_SCHEMA, STATE_SCHEMA, "append", timeout)


def dedup(stream: DataFrame, key: str, watermark: str, ts: str = "ts") -> DataFrame:
    """First arrival of each epoch-and-index id within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def length_filter(stream: DataFrame, limits: dict[str, int]) -> DataFrame:
    from chatmill.operators.filters import length_filter as keep

    return keep(stream, limits)


def fix_empty(response: str, finish: str, eos: int) -> dict[str, Column]:
    """Columns for a response that stopped without a token: one eos token, mask 1, NaN log-probability."""
    empty = (F.size(response) == 0) & (F.col(finish) == "stop")
    return {
        response: F.when(empty, F.array(F.lit(eos))).otherwise(F.col(response)),
        "mask": F.when(empty, F.array(F.lit(1))).otherwise(F.col("mask")),
        "logprobs": F.when(empty, F.array(F.lit(float("nan")))).otherwise(F.col("logprobs")),
    }


def not_excluded(stream: DataFrame, excluded: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Stream-static anti join against the prompts solved so far."""
    return stream.join(excluded.select(key).distinct().withColumn("_x", F.lit(True)), key, "left").filter("_x is null").drop("_x")


def fresh(stream: DataFrame, current_step: int, steps: int, column: str = "step") -> DataFrame:
    """Rollouts at most ``steps`` behind the current step."""
    return stream.filter((F.col(column) >= current_step - steps) & (F.col(column) <= current_step))


# -- sinks ----------------------------------------------------------------------------------------


def write_step(df: DataFrame, path: str, step: int, column: str = "step") -> None:
    """Write the rows of one step to its own folder; running the step again replaces them."""
    df.drop(column).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{column}={step}")


def metrics_sink(path: str, metrics: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: metrics of every micro-batch under step = batch id."""
    return lambda batch, step: write_step(metrics(batch), path, step)


def solved_sink(path: str, rate: float, max_score: float, key: str = "prompt_id", reward: str = "reward") -> Callable[[DataFrame, int], None]:
    """foreachBatch function over assembled groups: append prompts with a complete group whose mean reward
    reaches the rate to the exclusion table. A group is never split over batches, so its mean is final."""

    def sink(batch: DataFrame, step: int) -> None:
        means = batch.filter("complete").groupBy(key, "group_no").agg(F.avg(reward).alias("m"))
        write_step(means.filter(F.col("m") / max_score >= rate).select(key).distinct(), path, step)

    return sink


def quota_sink(path: str, quota: int, active_sampling: bool, key: str = "prompt_id", reward: str = "reward") -> Callable[[DataFrame, int], None]:
    """foreachBatch function over assembled groups: keep complete groups with differing rewards and deal them to
    training steps of ``quota`` groups. Filtered groups count towards the quota unless active sampling is on.

    ``rollouts``: rows of the kept groups with ``train_step``, the number of full quotas before the group.
    ``progress``: per batch, what has been counted, kept and filtered since the start, and whether the first
    quota is full. Totals come from the batches before, so a repeated batch gives the same rows.
    """
    totals = ["counted", "kept", "filtered"]

    def so_far(spark: SparkSession, step: int) -> dict:
        if not exists(spark, f"{path}/progress"):
            return dict.fromkeys(totals, 0)
        # totals never fall, so the largest of the earlier batches are the latest
        return spark.read.parquet(f"{path}/progress").filter(F.col("step") < step).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in totals]).first().asDict()

    def sink(batch: DataFrame, step: int) -> None:
        batch = batch.filter("complete").persist()  # read by both writes
        before = so_far(batch.sparkSession, step)
        g = batch.groupBy(key, "group_no").agg((F.min(reward) < F.max(reward)).alias("kept")).persist()
        counted = g.filter("kept") if active_sampling else g
        stats = g.agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"))
        stats = stats.withColumn("counted", F.col("kept") if active_sampling else F.col("n")).select(*[(F.col(c) + before[c]).alias(c) for c in totals])
        dealt = dense_index(counted, [key, "group_no"], "_i").filter("kept").withColumn("train_step", F.floor((F.col("_i") + before["counted"]) / quota)).drop("_i", "kept")
        renamed = dealt.withColumnRenamed(key, "_key").withColumnRenamed("group_no", "_no")
        # null-safe: a null prompt is a prompt
        write_step(batch.join(renamed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("group_no") == F.col("_no"))).drop("_key", "_no"), f"{path}/rollouts", step)
        write_step(stats.withColumn("full", F.col("counted") >= quota), f"{path}/progress", step)
        g.unpersist()
        batch.unpersist()

    return sink


def trace_sink(path: str, order_by: str, shard_rows: int = 10_000) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: append rollouts with shard = rows written before // shard_rows. The number of
    rows written so far is kept beside the data per batch, so a repeated batch gets the same shards."""

    def written(spark: SparkSession, step: int) -> int:
        if not exists(spark, f"{path}/_counts"):
            return 0
        return spark.read.parquet(f"{path}/_counts").filter(F.col("batch") < step).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def sink(batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        before = written(spark, step)
        rows = dense_index(batch, order_by, "_i").withColumn("shard", F.floor((F.col("_i") + before) / shard_rows)).drop("_i")
        write_step(rows, f"{path}/rows", step, "batch")
        write_step(rows.agg(F.count("*").alias("n")), f"{path}/_counts", step, "batch")

    return sink


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything available and stop. The checkpoint makes a second run go on where this one ended."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink is not None else w.format("parquet").option("path", path).start()
    q.awaitTermination()
