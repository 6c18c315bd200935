"""Order, exact sampling, dense indices and prefix sums without a single-partition window.

Hash orders are cut into 65 536 buckets by the first 16 bits of the digest. Bucket counts are one
small aggregate, their running total is at most 65 536 rows per stratum, and ranking happens inside
buckets, so no task ever sees more than its bucket whatever the size of the table or stratum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions.rand import hash_key, hash_unit
from chatmill.session import checkpointed, materialise

HASH, BUCKET = "_hash", "_bucket"
CUT = (HASH, BUCKET, "_last", "_take")


def _hashed(df: DataFrame, seed, ids) -> DataFrame:
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.withColumn(HASH, hash_key(seed, *ids)).withColumn(BUCKET, F.conv(F.substring(HASH, 1, 4), 16, 10).cast("int"))


def _running(counts: DataFrame, strata: list[str]) -> DataFrame:
    """``_before``: the rows in earlier buckets of the stratum. Without strata the window holds at most 65 536 counts."""
    running = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0).cast("long")))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null, keeping one copy of the keys."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def hash_rank(df: DataFrame, seed, ids, strata=(), name: str = "rank") -> DataFrame:
    """0-based rank of each row in the seeded permutation, per stratum. ``ids`` must be unique there."""
    strata, ids = list(strata), [ids] if isinstance(ids, str) else list(ids)
    h = _hashed(df, seed, ids)
    offsets = _running(h.groupBy(*strata, BUCKET).agg(F.count("*").alias("_n")), strata).drop("_n")
    inside = Window.partitionBy(*strata, BUCKET).orderBy(HASH, *ids)
    return (
        _null_safe_join(h, offsets, [*strata, BUCKET])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop(HASH, BUCKET, "_before")
    )


def with_cut(df: DataFrame, n, seed, ids, strata=()) -> DataFrame:
    """``df`` with its hash, bucket, and per stratum the bucket in which the quota is filled (``_last``) and how
    many rows of that bucket still fit (``_take``). Rows of earlier buckets are all within the quota; both
    columns are null where the quota is null or not positive.

    Buckets are counted in one pass. The cuts, one row per stratum, are written, so Spark knows their size: it
    broadcasts them when they are small, and no row is shuffled for them.
    """
    strata, ids = list(strata), [ids] if isinstance(ids, str) else list(ids)
    h = _hashed(df, seed, ids).withColumn("_quota", (n if isinstance(n, Column) else F.lit(n)).cast("long"))
    counts = h.groupBy(*strata, BUCKET).agg(F.count("*").alias("_n"), F.max("_quota").alias("_quota"))
    open_ = F.col("_before") < F.col("_quota")
    cuts = (
        _running(counts, strata)
        .groupBy(*strata)
        .agg(F.max(F.when(open_, F.col(BUCKET))).alias("_last"), (F.max("_quota") - F.max(F.when(open_, F.col("_before")))).alias("_take"))
    )
    cuts, h = materialise(cuts, "cuts"), h.drop("_quota")
    if strata:
        return _null_safe_join(h, cuts, strata)
    return h.withColumns({c: cuts.select(c).scalar() for c in ("_last", "_take")})


def of_last_bucket(cut: DataFrame, ids, strata=()) -> DataFrame:
    """The rows of a table made by ``with_cut`` that fill up the quota out of its last bucket."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    inside = Window.partitionBy(*strata, BUCKET).orderBy(HASH, *ids)
    ranked = cut.filter(F.col(BUCKET) == F.col("_last")).withColumn("_rn", F.row_number().over(inside))
    return ranked.filter(F.col("_rn") <= F.col("_take")).drop("_rn")


def sample_exact(df: DataFrame, n, seed, ids, strata=()) -> DataFrame:
    """Exactly ``n`` distinct rows (all when fewer) chosen by hash order, per stratum.

    ``n`` is a number or a column of ``df`` that is constant within a stratum. Rows in buckets that
    lie wholly under the quota are kept by a filter; only the one bucket the quota falls into is ranked.
    """
    cut = with_cut(df, n, seed, ids, strata)
    sure = cut.filter(F.col(BUCKET) < F.col("_last"))
    return sure.unionByName(of_last_bucket(cut, ids, strata)).drop(*CUT)


def shuffle(df: DataFrame, seed, ids) -> DataFrame:
    """Deterministic permutation: rows sorted by their seeded digest."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.orderBy(hash_key(seed, *ids), *ids)


def _sorted_parts(df: DataFrame, order_by) -> DataFrame:
    """Range-sorted rows with stable partition numbers. ``order_by`` should end in a unique column, so a
    hot leading value is split across ranges."""
    order_by = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return checkpointed(df.orderBy(*order_by)).withColumn("_part", F.spark_partition_id())


def _offsets(parts: DataFrame, measure: Column) -> DataFrame:
    """(_part, _offset): total of ``measure`` over all earlier partitions. One row per partition."""
    sums = parts.groupBy("_part").agg(F.sum(measure).alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")).alias("_offset"))


def dense_index(df: DataFrame, order_by, name: str = "index") -> DataFrame:
    """Positions 0..n-1 in ``order_by`` order: partition counts plus a partition-local row number."""
    parts = _sorted_parts(df, order_by).withColumn("_mono", F.monotonically_increasing_id())
    # the low 33 bits of monotonically_increasing_id are the row's place inside its partition
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = F.broadcast(_offsets(parts, F.lit(1).cast("long")))
    return parts.join(offsets, "_part").withColumn(name, F.col("_offset") + local).drop("_part", "_mono", "_offset")


def prefix_sum(df: DataFrame, order_by, value: str, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open [start, end) of every row over the running total of ``value`` in ``order_by`` order."""
    parts = _sorted_parts(df, order_by)
    schema = T.StructType([*parts.schema.fields, T.StructField("_running", T.LongType())])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0  # rows of a partition arrive in order, so no shuffle is needed to sum along them
        for b in batches:
            sums = total + np.cumsum(pc.fill_null(b.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, "_running"])

    summed = parts.mapInArrow(running, schema)
    offsets = _offsets(parts, F.col(value).cast("long"))
    return (
        summed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(end, F.col("_offset") + F.col("_running"))
        .withColumn(start, F.col(end) - F.coalesce(F.col(value).cast("long"), F.lit(0)))
        .drop("_part", "_running", "_offset")
    )


def slice_rows(df: DataFrame, offset: int, size: int, index: str = "index") -> DataFrame:
    """Rows at positions [offset, offset + size)."""
    return df.filter((F.col(index) >= offset) & (F.col(index) < offset + size))


def contiguous_shard(df: DataFrame, shard: int, shards: int, total: int, index: str = "index") -> DataFrame:
    """One contiguous shard; the last takes the remainder."""
    per = total // shards
    return slice_rows(df, shard * per, total - shard * per if shard == shards - 1 else per, index)


def train_test_split(df: DataFrame, test_fraction: float, seed, ids) -> DataFrame:
    """Add ``split``; a row is test when its hash falls below the fraction."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.withColumn("split", F.when(hash_unit(seed, *ids) < test_fraction, "test").otherwise("train"))


def repeat(df: DataFrame, times: int) -> DataFrame:
    """The whole table ``times`` times, with the copy number in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else df.limit(0).withColumn("copy", F.lit(0))


def limit_rows(df: DataFrame, max_rows: int, order_by) -> DataFrame:
    """First rows in a stated order."""
    order_by = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return df.orderBy(*order_by).limit(max_rows)


def top_k_longest(df: DataFrame, length: str, ids: str, k: int = 100) -> DataFrame:
    return df.orderBy(F.col(length).desc(), F.col(ids)).limit(k)


def first_per_key(df: DataFrame, keys, order_by: list[Column | str], keep: str = "first") -> DataFrame:
    """One row per key: first or last in order. min_by/max_by combine on the map side, so a hot key
    reaches its reducer as one row per task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = F.struct(*order_by)
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    pick = F.min_by(row, order) if keep == "first" else F.max_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_n_per_key(df: DataFrame, keys, n: int, order_by, min_rows: int = 0) -> DataFrame:
    """At most ``n`` rows per key in order. Catalyst turns the rank filter into a per-task group limit
    ahead of the shuffle, so hot keys are reduced before they move. With ``min_rows`` only keys that
    have at least that many rows are kept."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
        .filter(F.col("_rn") <= n)
    )
    if min_rows:
        if min_rows > n:
            raise ValueError("min_rows above n would need every row of a key")
        # a key has min_rows rows exactly when its limited list reaches min_rows
        full = ranked.filter(F.col("_rn") == min_rows).select(*keys)
        ranked = ranked.join(full, keys, "left_semi")
    return ranked.drop("_rn")


def join_stats(df: DataFrame, stats: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Attach one-row-per-key ``stats`` to every row of a possibly skewed ``df`` in one join. A null key is a key.

    The statistics are written first, so Spark knows their bytes: it broadcasts them if they are few, and no row of
    ``df`` moves. Otherwise both sides are plain shuffles (the statistics no longer carry their aggregate's
    partitioning, which would forbid it), so adaptive execution splits a key with a third of all rows over many tasks.
    """
    return _null_safe_join(df, materialise(stats, "stats"), [keys] if isinstance(keys, str) else list(keys), how)


def rank_in_key(df: DataFrame, keys, order_by, name: str = "rank") -> DataFrame:
    """0-based rank of each row among the rows of its key, whatever a key's size. A null key is a key.

    Rows are range-partitioned by (keys, order) and written with their place; a key that spans partitions is put together
    from one count for each partition. ``order_by`` should end in a unique column, so that a hot key can be cut anywhere.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in ([order_by] if isinstance(order_by, (str, Column)) else order_by)]
    line = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of monotonically_increasing_id are the row's place inside its partition
    line = materialise(line.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    heads = line.groupBy(*keys, "_part").agg(F.min("_pos").alias("_start"), F.count("*").alias("_n"))
    heads = heads.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"))
    return _null_safe_join(line, materialise(heads, "heads"), [*keys, "_part"]).withColumn(name, F.col("_shift") + F.col("_pos")).drop("_part", "_pos", "_shift")


def segmented_lists(df: DataFrame, keys, order_by, values: dict[str, Column], size: int, part: str = "part") -> DataFrame:
    """(keys, part, one array for each of ``values``): a key's elements in order, in arrays of ``size`` elements at most."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = rank_in_key(df, keys, order_by, "_rank")
    row = F.struct("_rank", *[c.alias(n) for n, c in values.items()])
    grouped = ranked.groupBy(*keys, F.floor(F.col("_rank") / size).alias(part)).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return grouped.select(*keys, part, *[F.col(f"_rows.{n}").alias(n) for n in values])


def epoch_shards(
    df: DataFrame, ids: str, seed: int, epoch: int, world: int, batch: int, total: int, drop_last: bool = True
) -> DataFrame:
    """Index plan of one epoch: permute, cut or pad to whole batches, row i of a batch goes to rank
    i mod world. ``total`` is the number of rows left after exclusions."""
    ranked = hash_rank(df.select(ids), seed + epoch, ids, name="pos")
    if drop_last:
        rows = ranked.filter(F.col("pos") < (total // batch) * batch)
    else:
        missing = -total % batch
        padded = [total * k for k in range(1, 1 + -(-missing // max(total, 1)))]
        extra = [
            ranked.withColumn("pos", F.col("pos") + F.lit(base)).filter(F.col("pos") < total + missing) for base in padded
        ]
        rows = ranked
        for e in extra:
            rows = rows.unionByName(e)
    return rows.select(
        F.lit(epoch).alias("epoch"),
        (F.col("pos") % batch % world).cast("int").alias("rank"),
        F.floor(F.col("pos") / batch).alias("step"),
        F.col("pos"),
        F.col(ids).alias("index"),
    )


def split_for_workers(packs: DataFrame, pack: str, world: int, micro: int, total: int, seed) -> DataFrame:
    """Contiguous floor(P/world) packs per worker, remainder dropped, shuffled inside the worker and
    cut in micro-batches."""
    per = total // world
    kept = packs.filter(F.col(pack) < per * world).withColumn("worker", F.floor(F.col(pack) / max(per, 1)).cast("int"))
    ranked = hash_rank(kept, seed, pack, strata=["worker"], name="slot")
    return ranked.withColumn("micro_batch", F.floor(F.col("slot") / micro).cast("long"))
