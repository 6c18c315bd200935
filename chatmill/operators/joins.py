"""Joins between example tables, result tables and other data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chatmill.functions.rand import hash_key, hash_unit
from chatmill.operators.convert import edit_last
from chatmill.operators.ordering import first_per_key, join_stats


def drop_prompts_in(df: DataFrame, other: DataFrame, prompt: Column, other_prompt: str) -> DataFrame:
    """Rows whose cleaned prompt is not a prompt of the other table."""
    seen = other.select(F.col(other_prompt).alias("_p")).distinct()
    return df.withColumn("_p", prompt).join(seen, "_p", "left_anti").drop("_p")


def apply_results(base: DataFrame, results: DataFrame, ids: str, answer: str, messages: str = "messages") -> DataFrame:
    """Inner join; the last message takes the result's answer."""
    joined = base.join(results.select(ids, answer), ids)
    return joined.withColumn(messages, edit_last(messages, lambda _: F.col(answer))).drop(answer)


def unmatched_results(base: DataFrame, results: DataFrame, ids: str) -> DataFrame:
    return results.join(base.select(ids), ids, "left_anti").agg(F.count("*").alias("unmatched"))


def lookup_multi_source(refs: DataFrame, sources: dict[str, DataFrame], keys=("split", "index"), name: str = "dataset") -> DataFrame:
    """Row of the source table each reference names, by (dataset, split, index)."""
    tagged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(name, F.lit(n)) for n, t in sources.items()]
    )
    return refs.join(tagged, [name, *keys], "left")


def expand_one_to_many(base: DataFrame, long: DataFrame, ids: str) -> DataFrame:
    """Every long row of an id, with the number of rows the id has."""
    counts = long.groupBy(ids).agg(F.count("*").alias("num_outputs"))
    return join_stats(long, counts.join(base, ids), ids)


def rows_common_to_all(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys present in every table."""
    tagged = [t.select(key).distinct() for t in tables.values()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(tables)).select(key)


def keep_common(tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    common = rows_common_to_all(tables, key)
    return {n: t.join(common, key, "left_semi") for n, t in tables.items()}


def attach_ratings(ratings: DataFrame, reference: DataFrame, ids: str = "id") -> DataFrame:
    return ratings.join(reference, ids, "left")


def rollouts_with_prompts(rollouts: DataFrame, prompts: DataFrame, index: str = "index", per_prompt: DataFrame | None = None) -> DataFrame:
    """Query, ground truth and verifier for every sample, by data set index, and what is known per prompt, if given. Prompts are
    broadcast only if their written bytes allow it; one with very many samples is split by the join."""
    return join_stats(rollouts, prompts if per_prompt is None else prompts.join(per_prompt, index), index)


def include_reference_candidate(completions: DataFrame, prompt: str = "prompt_id", sample: str = "sample_idx", text: str = "model_completion", reference: str = "reference_completion") -> DataFrame:
    """Candidates renumbered from 1 with the reference completion as candidate 0."""
    numbered = completions.withColumn(sample, F.col(sample) + 1)
    first = first_per_key(completions, prompt, [sample]).withColumn(text, F.col(reference)).withColumn(sample, F.lit(0).cast(completions.schema[sample].dataType))
    return numbered.unionByName(first)


def one_side_pairs(completions: DataFrame, prompt: str, model: str, text: str, fixed: str, seed) -> DataFrame:
    """The fixed model against one other model drawn per prompt, in random order."""
    other = first_per_key(
        completions.filter(F.col(model) != fixed), prompt, [hash_key(seed, prompt, model), F.col(model)]
    ).select(prompt, F.col(model).alias("_m"), F.col(text).alias("_t"))
    mine = completions.filter(F.col(model) == fixed).select(prompt, F.col(model).alias("_fm"), F.col(text).alias("_ft"))
    first = hash_unit(f"{seed}|order", prompt) >= 0.5
    swap = lambda a, b: F.when(first, F.array(a, b)).otherwise(F.array(b, a))
    return mine.join(other, prompt).select(prompt, swap(F.col("_m"), F.col("_fm")).alias("models"), swap(F.col("_t"), F.col("_ft")).alias("completions"))


def baseline_filter(rollouts: DataFrame, baselines: DataFrame, prompt: str, projection: str, pack: str, ids: str, threshold: float, max_rate: float) -> DataFrame:
    """Mark rollouts whose mean projection lies below the prompt's baseline by more than the threshold
    (mean − baseline < threshold), at most int(n · max_rate) per pack, most negative first. Rollouts
    without a baseline stay and are counted. Packs are bounded by the pack length."""
    joined = rollouts.join(baselines.select(prompt, F.col("baseline")), prompt, "left").withColumn("diff", F.col(projection) - F.col("baseline"))
    over = Window.partitionBy(pack)
    quota = F.floor(F.count("*").over(over) * F.lit(max_rate))
    hit = F.coalesce(F.col("diff") < threshold, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(pack).orderBy(hit.desc(), "diff", ids))
    return joined.withColumns({"missing_baseline": F.col("baseline").isNull(), "removed": hit & (rank <= quota)})


def coverage_check(expected: DataFrame, partial: DataFrame, index: str, value: str) -> DataFrame:
    """Merge partial results by index (max wins); raise with the first ten indices that have none."""
    merged = partial.groupBy(index).agg(F.max(value).alias(value))
    missing = [r[index] for r in expected.select(index).join(merged, index, "left_anti").orderBy(index).limit(10).collect()]
    if missing:
        raise ValueError(f"missing indices, first {len(missing)}: {missing}")
    return merged


def exclude(df: DataFrame, ids: DataFrame, key: str = "index") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def keep_passed_tests(df: DataFrame, results: DataFrame, ids: str, tests: str = "tests", passed: str = "passed", ratio: float = 0.8) -> DataFrame:
    """Keep rows whose solutions pass at least ``ratio`` of their tests; tests shrink to the passed ones."""
    j = df.join(results.select(ids, passed), ids)
    n_ok = F.size(F.filter(F.col(passed), lambda p: p == 1))
    kept = F.transform(
        F.filter(F.arrays_zip(F.col(tests).alias("t"), F.col(passed).alias("p")), lambda z: z["p"] == 1), lambda z: z["t"]
    )
    return j.filter((n_ok >= ratio * F.size(tests)) & (n_ok > 0)).withColumn(tests, kept).drop(passed)


def passed_tests(results: DataFrame, ids: str, passed: str = "passed", ratio: float = 0.8) -> DataFrame:
    """The same over one row per test: the passed tests of ids that pass at least ``ratio`` of theirs."""
    ok = F.col(passed).cast("double") == 1
    rate = results.groupBy(ids).agg(F.count("*").alias("_n"), F.count_if(ok).alias("_ok")).filter((F.col("_ok") >= ratio * F.col("_n")) & (F.col("_ok") > 0))
    return join_stats(results.filter(ok), rate, ids).drop("_n", "_ok")


def tree_paths(nodes: DataFrame, top_k: int | None = None) -> DataFrame:
    """Every root-to-leaf path that ends in an assistant message: (leaf, messages).

    ``nodes``: message_id, parent_id, role, text, deleted, quality. A deleted node cuts its subtree; an inner node keeps its
    ``top_k`` best children. Nodes under a missing parent or on a cycle reach no root and give no path; a message_id that
    occurs twice is an error.

    Paths are shortened first: rounds that cut out a quarter of the inner nodes each, see ``_cut_out``, until a sixteenth of the
    rows is left or inner nodes are under three quarters of them, so that these rounds together write a few times the table.
    Ancestors among the nodes left are found by pointer doubling: after round j every node knows its ancestor 2 ** j steps up, or
    the end of its chain, so a depth of d takes log2(d) rounds of one join, each written once. Leaves that reach a root then list
    their ancestors by the binary digits of the distance, through the same tables, and get the nodes cut out back, last round
    first, as many rows as the paths have messages.
    Texts are joined to those rows at the end; a node on many paths is a hot key of that join, which adaptive execution splits.
    """
    from chatmill.session import materialise

    n = nodes.select("message_id", "parent_id", "role", "text", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("quality", F.lit(0.0)).alias("quality"))
    live = n.filter(~F.col("deleted"))
    if top_k is not None:
        best = Window.partitionBy("parent_id").orderBy(F.col("quality").desc(), "message_id")
        kids = live.filter("parent_id is not null").withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= top_k).drop("_rn")
        live = kids.unionByName(live.filter("parent_id is null"))
    # a node with children of any kind, deleted ones included, is no leaf
    parents = n.filter("parent_id is not null").select(F.col("parent_id").alias("message_id")).distinct().withColumn("has_child", F.lit(True))
    live = live.join(parents, "message_id", "left").withColumn("has_child", F.coalesce("has_child", F.lit(False)))
    msg = F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.col("text").alias("content"))
    live = materialise(live.select("message_id", "parent_id", "has_child", "role", msg.alias("m")), "tree")
    on_path = F.col("has_child") | (F.col("role") == "assistant")  # other leaves are on no path
    inner = F.col("has_child") & F.col("parent_id").isNotNull()
    size = live.agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("ids"), F.count_if(on_path).alias("rows"), F.count_if(inner).alias("inner")).first()
    if size["n"] != size["ids"]:
        raise ValueError("a message_id occurs twice")
    ids = F.array("message_id", "parent_id")  # both of one type, so that they hash alike
    edges = live.filter(on_path).select(ids[0].alias("message_id"), ids[1].alias("far"), F.lit(1).cast("long").alias("dist"), inner.alias("inner"), F.col("parent_id").isNotNull().alias("open"))
    cut, rows = _cut_out(edges, size["rows"], size["inner"])
    up = _doubled_pointers((cut[-1] if cut else edges).select("message_id", "far", "dist", "open"), rows)
    # the last table holds the end of every chain: a node whose own parent is null
    ends = up[-1].filter("not open").select(F.col("message_id").alias("leaf"), F.coalesce("far", "message_id").alias("root"))
    leaves = live.filter("not has_child and role = 'assistant'").select(F.col("message_id").alias("leaf"))
    roots = live.filter("parent_id is null").select(F.col("message_id").alias("root"))
    line = leaves.join(ends, "leaf").join(roots, "root", "left_semi").select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    steps = [up[j].filter(F.col("steps") == 1 << j).select(F.col("message_id").alias("node"), "far", "dist") for j in range(len(up))]
    vias = [t.filter("via is not null").select(F.col("message_id").alias("node"), F.col("via").alias("far"), F.col("via_dist").alias("dist")) for t in cut]
    for step in reversed(vias + steps):
        line = line.join(step, "node", "left").select(
            "leaf", F.explode(F.array(F.struct("node", "above"), F.struct(F.col("far").alias("node"), (F.col("above") + F.col("dist")).alias("above")))).alias("x")
        ).filter("x.node is not null").select("leaf", "x.node", "x.above")
    texts = live.select(F.col("message_id").alias("node"), "m")
    path = F.sort_array(F.collect_list(F.struct(-F.col("above"), "m")))
    return line.join(texts, "node").groupBy("leaf").agg(F.transform(path, lambda x: x["m"]).alias("messages"))


def _cut_out(edges: DataFrame, rows: int, inner: int) -> tuple[list[DataFrame], int]:
    """Shorter chains, one written table a round, and the rows of the last: (message_id, far, dist, inner, open, via, via_dist).
    ``edges`` has the first five: ``far`` is the next node up that is left, ``dist`` steps away; ``open`` says that it may have
    a next one itself; only ``inner`` nodes may go.

    Each round tosses a coin for every id. An inner node whose coin is 1 and whose ``far`` has 0 goes, so never two in a row,
    and the nodes below it point past it, with it in ``via`` and the way to it in ``via_dist``. Only nodes below a coin of 1
    are joined, and only with nodes that go or are roots."""
    from chatmill.session import materialise

    tables, now, start, before = [], edges, rows, None
    while 4 * inner >= 3 * rows and 16 * rows > start and (before is None or 16 * (before - rows) >= before):

        def coin(node, salt=len(tables)):
            return F.xxhash64(F.col(node), F.lit(salt)).bitwiseAND(1) == 1

        goes, asks = F.col("inner") & coin("message_id") & ~coin("far"), F.col("open") & coin("far")
        to = now.filter(goes | (F.col("far").isNull() & coin("message_id"))).select(F.col("message_id").alias("_at"), F.col("far").alias("_far"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        past, seen = F.col("_far").isNotNull(), Observation()
        moved = now.filter(asks).join(to, F.col("far") == F.col("_at"), "left").select(
            "message_id", F.coalesce("_far", "far").alias("far"), (F.col("dist") + F.when(past, F.col("_dist")).otherwise(0)).alias("dist"), "inner",
            F.coalesce("_open", F.lit(True)).alias("open"), F.when(past, F.col("_at")).alias("via"), F.when(past, F.col("dist")).alias("via_dist"),
        )
        rest = now.filter(~goes & ~asks).select("message_id", "far", "dist", "inner", "open")
        both = moved.unionByName(rest, allowMissingColumns=True).observe(seen, F.count("*").alias("rows"), F.count_if("inner").alias("inner"))
        now = materialise(both, "tree-cut")
        tables.append(now)
        before, rows, inner = rows, seen.get["rows"], seen.get["inner"]
    return tables, rows


def _doubled_pointers(parents: DataFrame, rows: int) -> list[DataFrame]:
    """Tables (message_id, far, steps, dist, open): ``far`` is the ancestor ``steps`` up, 2 ** j in table j or all there are, and
    ``dist`` the sum of the steps' own. ``open`` says that there may be more; in the last table only nodes on or under a cycle
    are open. The first table is ``parents`` as it is, the others are written. A parent that is no node of the table ends its
    chain and stays in ``far``."""
    from chatmill.session import materialise

    tables, left = [parents.select("message_id", "far", F.col("far").isNotNull().cast("long").alias("steps"), "dist", "open")], 1
    while left and (1 << (len(tables) - 1)) <= rows:
        now, seen = tables[-1], Observation()
        to = now.select(F.col("message_id").alias("_at"), F.col("far").alias("_far"), F.col("steps").alias("_steps"), F.col("dist").alias("_dist"), F.col("open").alias("_open"))
        further = F.col("_far").isNotNull()
        moved = now.filter("open").join(to, F.col("far") == F.col("_at"), "left").select(
            "message_id", F.coalesce("_far", "far").alias("far"), (F.col("steps") + F.when(further, F.col("_steps")).otherwise(0)).alias("steps"),
            (F.col("dist") + F.when(further, F.col("_dist")).otherwise(0)).alias("dist"), F.coalesce("_open", F.lit(False)).alias("open"),
        )
        both = moved.unionByName(now.filter("not open")).observe(seen, F.count_if("open").alias("open"))
        tables.append(materialise(both, "tree-up"))
        left = seen.get["open"]
    return tables
