"""Mixing sources to target sizes by systematic sampling.

Sources share a total by weight; a target stops at ``cap`` times its source's size and the excess is shared again among
the others. Every document of a source then expects r = target / size copies. Documents of a source are lined up by
(size, hash), their expected copies are added up, one random offset per source is added, and a document is emitted once
for each integer that its stretch crosses: floor(r) or ceil(r) times, never more than ``cap``. Lining up by size makes
the words taken differ from the target by about one document's size.

The line is a range-partitioned sort of (source, size, hash, id); ranks are counted inside partitions and moved on by
partition totals, so a source with any share of all rows is spread over all tasks. Repeated rows are drawn one by one:
a group of them takes the integers that their whole stretch crosses. Null text has size 0; a null source is a source of its own and comes last; null ids are one id. Empty
tables give no rows. Draws depend on ids and the seed only, so reruns agree. Clashing extra columns are kept, working
names avoid them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.llm.common import fresh
from chatmill.operators.ordering import _null_safe_join
from chatmill.session import materialise

MAX_SOURCES = 1_000_000  # per-source totals pass through the driver


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(sizes: Sequence[int], weights: Sequence[int], share: Fraction, cap: Fraction) -> list[Fraction]:
    """Targets of the sources: ``share`` of all sizes by weight, none above ``cap`` times its size."""
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    rest, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def targets(sized: DataFrame, source: str, size: str, weights: Sequence[int], share: Fraction, cap: Fraction, seed: int) -> DataFrame:
    """(source, source_size, target, rate, offset), one row per source; weights repeat in code point order, null last."""
    rows = sized.groupBy(source).agg(F.sum(size).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(((r[0], int(r["n"] or 0)) for r in rows), key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0])))
    goals = share_out([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    out = [(s, n, float(t), float(t / n) if n else 0.0) for (s, n), t in zip(rows, goals)]
    kind = sized.schema[source].dataType.simpleString()
    made = sized.sparkSession.createDataFrame(out, f"source {kind}, source_size long, target double, rate double")
    unit = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return made.withColumn("offset", unit)


def _ranked(units: DataFrame, order: list[str], part_name: str = "_part", rank_name: str = "_rank") -> DataFrame:
    """Units with (_part, _rank): the 0-based rank inside the first column of ``order`` and the partition."""
    names = [*units.columns, part_name, rank_name]
    at = units.columns.index(order[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode(null_encoding="encode")
            index = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(index, prepend=-1))
            rank = np.arange(len(index)) - np.repeat(starts, np.diff(np.append(starts, len(index))))
            values = codes.dictionary.to_pylist()
            if values[index[0]] == last:
                rank[: starts[1] if len(starts) > 1 else None] += seen
            last, seen = values[index[-1]], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(index), part, dtype=np.int32)), pa.array(rank.astype(np.int64))], names=names)

    line = units.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return line.mapInArrow(run, f"{schema}, `{part_name}` int, `{rank_name}` long")


def draws(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: Fraction = Fraction(2), seed: int = 11) -> DataFrame:
    """``sized`` (doc_id, source, size, row) plus source_size, target and copies, row by row; ``row`` is unique."""
    goal = targets(sized, "source", "size", weights, share, cap, seed).withColumnRenamed("source", "_source")
    units = sized.select("doc_id", "source", "size", "row").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    ranked = materialise(_ranked(units, ["source", "size", "_h", "doc_id", "row"]).drop("_h"), "mix-line")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    moved = ranked.groupBy("source", "_part").agg(F.count("*").alias("_n")).select("source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line = _null_safe_join(ranked, moved, ["source", "_part"])
    j = F.col("_before") + F.col("_rank")
    copies = F.floor((j + 1) * F.col("rate") + F.col("offset")) - F.floor(j * F.col("rate") + F.col("offset"))
    with_goal = line.join(F.broadcast(goal), line["source"].eqNullSafe(goal["_source"]))  # MAX_SOURCES rows at most
    return with_goal.select("doc_id", "source", "size", "row", "source_size", "target", copies.cast("long").alias("copies"))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, row) of each document, written once: texts are read a single time."""
    return materialise(docs.select("doc_id", "source", size_in_words(F.col(text)).alias("size")).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    return draws(sizes(docs), **options).withColumn("taken", F.col("copies") * F.col("size")).drop("row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every document as often as it was drawn, with its own columns.

    Rows of one (doc_id, source, size) are alike to the draw; they share its copies evenly, and which of them get one more
    is dealt along their order in a written table, so a group of any size is spread over all tasks."""
    drawn = materialise(draws(sizes(docs), **options), "mix-drawn").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    size, i, s, n, copies, row = fresh(docs, "_size", "_i", "_s", "_n", "_copies", "_row")
    right = materialise(drawn.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(f"{size}_r"), F.col("n").alias(n), F.col("copies").alias(copies)).filter(F.col(copies) > 0), "mix-units")
    sized = docs.withColumn(size, size_in_words(F.col("text")))
    alike = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(size) == F.col(f"{size}_r"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    repeated = lambda df: df.withColumn(i, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*own)
    out = repeated(sized.join(right.filter(F.col(n) == 1), alike))
    several = right.filter(F.col(n) > 1)
    if several.isEmpty():
        return out
    shared = materialise(sized.join(several, alike).withColumn(row, F.monotonically_increasing_id()), "mix-repeated")
    unit = fresh(shared, "_unit")[0]
    keyed = shared.withColumn(unit, F.xxhash64(F.col(i).isNull(), i, F.col(s).isNull(), s, f"{size}_r")).select(unit, row)  # a clash of hashes only deals two units together
    part, place, first = fresh(shared, "_part", "_rank", "_before")
    ranked = materialise(_ranked(keyed, [unit, row], part, place), "mix-dealt")
    before = Window.partitionBy(unit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    moved = ranked.groupBy(unit, part).agg(F.count("*").alias(first)).withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    dealt = ranked.join(moved, [unit, part]).select(F.col(row).alias(f"{row}_r"), (F.col(first) + F.col(place)).alias(place))
    mine = F.floor(F.col(copies) / F.col(n)) + (F.pmod(F.col(place), F.col(n)) < F.pmod(F.col(copies), F.col(n))).cast("long")
    return out.unionByName(repeated(shared.join(dealt, F.col(row) == F.col(f"{row}_r")).withColumn(copies, mine)))
