"""Tokenising, label masking, packing and batching.

Packing decides on lengths only. Next-fit is sequential, yet its result does not have to be computed by one
task: rows are cut in blocks by position, every block summarises where each possible carry-over would leave
it (a few numbers), the summaries are chained in a tree, and the blocks then number their packs independently. The
result is the one a single pass over the whole table gives, whatever the number of blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import computed_once, indices, last, let
from chatmill.operators.ordering import dense_index, prefix_sum
from chatmill.operators.templates import NO_FUNCTIONS, TEMPLATES, Template, head_text, message_content
from chatmill.session import materialise

IGNORE = -100
MAX_VOCABULARY = 2_000_000
FAN = 64  # block summaries that one task of next-fit holds

# -- token counts and vocabulary ------------------------------------------------------------------

COUNTERS: dict[str, Callable[[Column], Column]] = {
    "chars": F.length,
    "words": X.word_count,
    "tokens": lambda c: F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]")),
}


def tokens(c: Column) -> Column:
    """Word runs and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]|\n"), 0)


def token_length(c: Column, counter: str | Callable[[Column], Column] = "words") -> Column:
    f = COUNTERS[counter] if isinstance(counter, str) else counter
    return F.coalesce(f(c), F.lit(0))


def message_tokens(messages: Column, counter="words") -> Column:
    """Tokens of all messages with the per-role overhead (4 for system, 3 for others)."""
    one = lambda m: token_length(m["content"], counter) + F.when(m["role"] == "system", 4).otherwise(3)
    return F.aggregate(messages, F.lit(0), lambda a, m: a + one(m))


def fits_context(messages: Column, completion: int, context: int, margin: int = 150, counter="words") -> Column:
    return message_tokens(messages, counter) + completion + margin <= context


def build_vocab(df: DataFrame, token_arrays: Column, max_size: int, reserved: int = 2) -> DataFrame:
    """(token, id, n): ids by descending frequency, ties by token, after ``reserved`` special ids. Counting
    combines on the map side; only ``max_size`` rows reach the ranking. Rarer tokens become the unknown id:
    ``unknown_tokens`` says how many."""
    if max_size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary over {MAX_VOCABULARY} entries cannot be broadcast")
    counts = df.select(F.explode(token_arrays).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(max_size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "token"))
    return top.withColumn("id", (rank - 1 + reserved).cast("int"))


def unknown_tokens(df: DataFrame, token_arrays: Column, vocab: DataFrame) -> DataFrame:
    """One row: distinct tokens and occurrences that ``vocab`` leaves out."""
    counts = df.select(F.explode(token_arrays).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    left = counts.join(vocab.select("token"), "token", "left_anti")
    return left.agg(F.count("*").alias("unknown_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("unknown_occurrences"))


def encoder(vocab: DataFrame, unknown: int = 0) -> Callable[[Column], Column]:
    """Column function array<string> -> array<int>. The vocabulary, bounded by ``build_vocab``, is broadcast once."""
    rows = vocab.select("token", "id").limit(MAX_VOCABULARY + 1).toPandas()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError("vocabulary too large to broadcast")
    table = vocab.sparkSession.sparkContext.broadcast((pa.array(rows["token"], pa.string()), pa.array(rows["id"].astype("int32"))))

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        known, ids = table.value
        flat = lists.flatten()
        found = pc.fill_null(pc.take(ids, pc.index_in(flat.cast(pa.string()), value_set=known)), pa.scalar(unknown, pa.int32()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)

    # filters on the ids must stay above the projection that makes them
    return encode.asNondeterministic()


# -- label masks ----------------------------------------------------------------------------------


def chat_pieces(messages: Column, template: str | Template, eos: str = "<eos>", mode: str = "assistant") -> Column:
    """array<struct<text, train>>: the rendered conversation in pieces with the label decision of each.

    ``assistant``: everything but assistant turns is masked, and so is an assistant header that follows
    another role. ``last_turn``: all but the last message. ``prompt``: the rendered prompt with its
    generation header. ``none``: nothing is masked.
    """
    t = TEMPLATES[template] if isinstance(template, str) else template
    if not t.wrap:
        raise ValueError("label masks need a template with role wraps")
    n = F.size(messages)

    def piece(text, train):
        return F.struct(text.alias("text"), train.alias("train"))

    def one(m, i):
        is_last, is_bot = i == n - 1, m["role"] == "assistant"
        before_bot = F.when(i > 0, F.get(messages, i - 1)["role"] == "assistant").otherwise(F.lit(False))
        next_bot = F.coalesce(F.get(messages, i + 1)["role"] == "assistant", F.lit(False))
        head = body_end = trail = F.lit("")
        for role, (prefix, suffix) in t.wrap.items():
            mine = m["role"] == role
            head = F.when(mine, F.lit(prefix)).otherwise(head)
            if role in t.eos_roles:
                if t.functions:
                    end, tail = F.when(is_last, F.lit(eos)).otherwise(F.lit(t.after_eos)), F.lit("")
                else:
                    end, tail = F.lit(eos), F.when(is_last, F.lit(t.after_last_eos)).otherwise(F.lit(t.after_eos))
            else:
                end, tail = F.lit(NO_FUNCTIONS + suffix if t.functions and role == "system" else suffix), F.lit("")
            body_end = F.when(mine, end).otherwise(body_end)
            trail = F.when(mine, tail).otherwise(trail)
        shown = m["role"].isin(list(t.wrap))
        body = F.when(shown, F.concat(message_content(t, m, is_last), body_end)).otherwise(F.lit(""))
        if mode == "assistant":
            flags = (is_bot & ((i == 0) | before_bot), is_bot, is_bot & (is_last | next_bot))
        elif mode == "last_turn":
            flags = (is_last & ~(is_bot & (n > 1)), is_last, is_last)
        elif mode == "prompt":
            flags = (is_last & (n > 1) & ~is_bot, is_last & (n > 1), is_last & (n > 1))
        elif mode == "none":
            flags = (F.lit(True), F.lit(True), F.lit(True))
        else:
            raise ValueError(f"unknown mask mode {mode!r}")
        return F.array(piece(head, flags[0]), piece(body, flags[1]), piece(trail, flags[2]))

    def build(ms):
        nonlocal messages, n
        messages, n = ms, F.size(ms)
        # what comes before the first message shares the fate of a masked first message
        opens = F.lit(mode == "none") if mode != "assistant" else F.coalesce(F.get(ms, F.lit(0))["role"] == "assistant", F.lit(False))
        return F.concat(F.array(piece(head_text(ms, t), opens)), F.flatten(F.transform(ms, one)))

    pieces = let(messages, build)
    return F.filter(pieces, lambda p: p["text"] != "")


def encode_chat(df: DataFrame, encode: Callable[[Column], Column], messages: str = "messages", template="tags", eos="<eos>", mode="assistant",
                max_len: int | None = None, prefix: str = "") -> DataFrame:
    """Add input_ids, attention_mask and labels (−100 where masked), truncated to ``max_len``."""
    pieces = chat_pieces(F.col(messages), template, eos, mode)
    pairs = F.flatten(F.transform(pieces, lambda p: F.transform(tokens(p["text"]), lambda k: F.struct(k.alias("k"), p["train"].alias("train")))))
    if max_len is not None:
        pairs = F.slice(pairs, 1, max_len)
    out = df.withColumn("_p", computed_once(pairs))
    out = out.withColumn(f"{prefix}input_ids", encode(F.transform("_p", lambda p: p["k"])))
    labels = F.zip_with(f"{prefix}input_ids", "_p", lambda i, p: F.when(p["train"], i).otherwise(F.lit(IGNORE)))
    return out.withColumns(
        {f"{prefix}attention_mask": F.transform(f"{prefix}input_ids", lambda _: F.lit(1)), f"{prefix}labels": labels}
    ).drop("_p")


def encode_preference(df: DataFrame, encode, mode: str = "last_turn", **kw) -> DataFrame:
    """Both sides of a pair, six arrays."""
    for side in ("chosen", "rejected"):
        df = encode_chat(df, encode, side, mode=mode, prefix=f"{side}_", **kw)
    return df


def encode_verifiable(df: DataFrame, encode, messages: str = "messages", template="tags", eos="<eos>", pad_id: int | None = None, system: str | None = None) -> DataFrame:
    """Prompt ids with the generation header, pad id removed, raw prompt text, list-valued verifier columns."""
    from chatmill.operators.convert import messages_to_text, normalise_verifier_lists, split_prompt
    from chatmill.operators.templates import render_chat

    prompt = df.withColumn("_prompt", split_prompt(messages, system_override=system))
    text = render_chat(F.col("_prompt"), template, eos, add_generation_prompt=True)
    out = prompt.withColumn("_t", computed_once(tokens(text))).withColumn("input_ids_prompt", encode(F.col("_t"))).drop("_t")
    if pad_id is not None:
        out = out.withColumn("input_ids_prompt", F.filter("input_ids_prompt", lambda i: i != pad_id))
    return normalise_verifier_lists(out.withColumn("raw_prompt", messages_to_text("_prompt", "lines")).drop("_prompt"))


# -- next-fit -------------------------------------------------------------------------------------


class _Sums:
    """Pack fits while every length column stays within its budget; the first row always fits."""

    def __init__(self, limits):
        self.limits = np.asarray(limits, dtype=np.int64)

    def next_starts(self, a):
        m = len(a)
        p = np.vstack([np.zeros((1, a.shape[1]), np.int64), np.cumsum(a, axis=0)])
        nxt = np.full(m, m, np.int64)
        for b, lim in enumerate(self.limits):
            nxt = np.minimum(nxt, np.searchsorted(p[:, b], p[:-1, b] + lim, side="right") - 1)
        return np.maximum(nxt, np.arange(m) + 1)

    def prefix(self, a, rows):
        return np.cumsum(a[:rows], axis=0)

    def horizon(self, a):
        """No carry can keep the first pack open beyond this row."""
        over = np.flatnonzero((np.cumsum(a, axis=0) > self.limits).any(axis=1))
        return int(over[0]) if len(over) else len(a)

    def first_start(self, carry, prefix, m):
        over = np.flatnonzero((prefix + carry > self.limits).any(axis=1))
        return int(over[0]) if len(over) else m

    def state(self, a):
        return a.sum(axis=0)

    def absorb(self, carry, total):
        return carry + total

    def after(self, total, prefix):
        """Prefixes of rows that follow rows of the given state."""
        return total + prefix


class _MaxTimesCount:
    """Pack fits while (longest row) x (rows) stays within the budget."""

    def __init__(self, limit):
        self.limit = int(limit)

    def next_starts(self, a):
        v, m = a[:, 0], len(a)
        nxt, window, j = np.empty(m, np.int64), deque(), 0
        for i in range(m):
            if j <= i:
                window.clear()
                window.append(i)
                j = i + 1
            while j < m and max(v[window[0]], v[j]) * (j - i + 1) <= self.limit:
                while window and v[window[-1]] <= v[j]:
                    window.pop()
                window.append(j)
                j += 1
            nxt[i] = j
            if window and window[0] == i:
                window.popleft()
        return nxt

    def prefix(self, a, rows):
        return np.maximum.accumulate(a[:rows, :1], axis=0)

    def horizon(self, a):
        over = np.flatnonzero(np.maximum.accumulate(a[:, 0]) * (np.arange(len(a)) + 1) > self.limit)
        return int(over[0]) if len(over) else len(a)

    def first_start(self, carry, prefix, m):
        longest, rows = carry
        over = np.flatnonzero(np.maximum(prefix[:, 0], longest) * (rows + np.arange(len(prefix)) + 1) > self.limit)
        return int(over[0]) if len(over) else m

    def state(self, a):
        return np.array([a[:, 0].max() if len(a) else 0, len(a)], dtype=np.int64)

    def absorb(self, carry, total):
        return np.array([max(carry[0], total[0]), carry[1] + total[1]], dtype=np.int64)

    def after(self, total, prefix):
        return np.maximum(total[0], prefix)


def _summary(a: np.ndarray, rule) -> dict:
    """For every row a carried pack could end at: packs started from there on, and the open pack's state."""
    m = len(a)
    nxt = rule.next_starts(a)
    rows = min(rule.horizon(a) + 1, m)
    count, end = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(m - 1, -1, -1):
        j = nxt[i]
        count[i] = 1 + (count[j] if j < m else 0)
        end[i] = end[j] if j < m else i
    left = {int(e): rule.state(a[e:]) for e in set(end[:rows].tolist())}
    return {
        "prefix": rule.prefix(a, rows).ravel().tolist(),
        "count": count[:rows].tolist(),
        "left": np.concatenate([left[int(e)] for e in end[:rows]]).tolist(),
        "total": rule.state(a).tolist(),
        "m": m,
    }


@dataclass
class _Node:
    """What a run of rows does to any open pack that is carried in."""

    prefix: np.ndarray
    count: np.ndarray
    left: np.ndarray
    total: np.ndarray
    m: int

    @classmethod
    def read(cls, row) -> _Node:
        rows, total = len(row.count), np.asarray(row.total, np.int64)
        shaped = [np.asarray(x, np.int64).reshape(rows, -1) for x in (row.prefix, row.left)]
        return cls(shaped[0], np.asarray(row.count, np.int64), shaped[1], total, int(row.m))

    def fields(self) -> dict:
        return {"prefix": self.prefix.ravel(), "count": self.count, "left": self.left.ravel(), "total": self.total, "m": self.m}

    def follow(self, carry, rule) -> tuple[int, int, np.ndarray]:
        """(first new pack row, packs opened, state of the pack left open)."""
        first = 0 if carry is None else rule.first_start(carry, self.prefix, self.m)
        return (first, int(self.count[first]), self.left[first]) if first < self.m else (first, 0, rule.absorb(carry, self.total))

    def then(self, other: _Node, rule) -> _Node:
        """This run and the next one as one run."""
        states, which = np.unique(self.left, axis=0, return_inverse=True)
        ends = [other.follow(s, rule) for s in states]
        which = which.reshape(-1)
        prefix = self.prefix
        count = self.count + np.array([e[1] for e in ends])[which]
        left = np.stack([e[2] for e in ends])[which]
        if len(self.count) == self.m:  # a carry may take in the whole run and end in the next
            prefix = np.concatenate([prefix, rule.after(self.total, other.prefix)])
            count, left = np.concatenate([count, other.count]), np.concatenate([left, other.left])
        m = self.m + other.m
        rows = min(rule.first_start(np.zeros_like(self.total), prefix, m) + 1, len(count))
        return _Node(prefix[:rows], count[:rows], left[:rows], rule.absorb(self.total, other.total), m)


def _compose(nodes: pd.DataFrame, rule, fan: int) -> pd.DataFrame:
    """One node for a run of consecutive nodes."""
    ordered = [_Node.read(r) for r in nodes.sort_values("node").itertuples()]
    return pd.DataFrame([{"node": nodes["node"].iloc[0] // fan, **reduce(lambda a, b: a.then(b, rule), ordered).fields()}])


def _chain(nodes: pd.DataFrame, rule, carry=None, packs: int = 0) -> pd.DataFrame:
    """Per node in order: the carry that enters it, its first new pack row, the number of packs opened before."""
    out = []
    for r in nodes.sort_values("node").itertuples():
        first, opened, left = _Node.read(r).follow(carry, rule)
        out.append((r.node, carry, first, packs))
        carry, packs = left, packs + opened
    return pd.DataFrame(out, columns=["node", "carry", "first", "packs"])


NODE = "node long, prefix array<long>, count array<long>, left array<long>, total array<long>, m long"
ENTRY = "node long, carry array<long>, first long, packs long"


def _chained(blocks: DataFrame, n: int, rule) -> DataFrame:
    """``_chain`` over ``n`` blocks without a task that holds more than ``FAN`` of them: runs of blocks are composed to
    nodes of the next level until one run is left, then the carries go down again, level by level."""

    def descend(entered: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
        carry, packs = entered["carry"].iloc[0], int(entered["packs"].iloc[0])
        return _chain(children, rule, None if carry is None else np.asarray(carry, np.int64), packs)

    fan = FAN  # a value that goes to the tasks with the function
    run, levels = F.floor(F.col("node") / fan), [blocks]
    while n > fan:  # a level is used on the way up and on the way down
        levels[-1] = materialise(levels[-1], "packing")
        levels.append(levels[-1].groupBy(run).applyInPandas(lambda pdf: _compose(pdf, rule, fan), NODE))
        n = -(-n // fan)
    entered = levels.pop().groupBy(run).applyInPandas(lambda pdf: _chain(pdf, rule), ENTRY)
    for level in reversed(levels):
        entered = entered.groupBy("node").cogroup(level.groupBy(run)).applyInPandas(descend, ENTRY)
    return entered


def _next_fit(df: DataFrame, index: str, lengths: list[str], rule, block_rows: int, name: str) -> DataFrame:
    """(index, pack): global next-fit over rows in index order; ``index`` must be dense from 0."""
    rows = df.select(index, *[F.col(c).cast("long").alias(c) for c in lengths]).withColumn("node", F.floor(F.col(index) / block_rows))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values(index)[lengths].to_numpy(np.int64)
        return pd.DataFrame([{"node": pdf["node"].iloc[0], **_summary(a, rule)}])

    last_block = rows.agg(F.max("node")).first()[0]
    summaries = rows.groupBy("node").applyInPandas(summarise, NODE)
    chained = _chained(summaries, (last_block or 0) + 1, rule).select("node", "first", "packs")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        nxt, m = rule.next_starts(pdf[lengths].to_numpy(np.int64)), len(pdf)
        opened, i = np.zeros(m, np.int64), int(pdf["first"].iloc[0])
        while i < m:
            opened[i] = 1
            i = int(nxt[i])
        return pd.DataFrame({index: pdf[index].to_numpy(), name: pdf["packs"].iloc[0] - 1 + np.cumsum(opened)})

    return rows.join(chained, "node").groupBy("node").applyInPandas(assign, f"{index} long, {name} long")


def pack_next_fit(df: DataFrame, index: str, length: str, pack_length: int, min_batches: int = 1, total: int | None = None, block_rows: int = 250_000) -> DataFrame:
    """(index, pack). A row that would overflow a non-empty pack opens the next one; longer rows get their
    own. With ``min_batches`` the pack length shrinks to at most total // min_batches."""
    if min_batches > 1:
        total = total if total is not None else (df.agg(F.sum(length)).first()[0] or 0)
        if total:
            pack_length = min(total // min_batches, pack_length)
    return _next_fit(df, index, [length], _Sums([pack_length]), block_rows, "pack")


def token_budget_batches(df: DataFrame, index: str, chosen: str, rejected: str, budget: int | tuple[int, int], block_rows: int = 250_000) -> DataFrame:
    """(index, batch): greedy batches within the budget on both sides, at least one row each."""
    limits = list(budget) if isinstance(budget, tuple) else [budget, budget]
    return _next_fit(df, index, [chosen, rejected], _Sums(limits), block_rows, "batch")


def batch_by_max_tokens(df: DataFrame, order_by, length: str, budget: int, block_rows: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """((index, batch), indexed rows): greedy batches with longest x rows within the budget; rows longer than
    the budget are left out."""
    kept = dense_index(df.filter(F.col(length) <= budget), order_by)
    return _next_fit(kept, "index", [length], _MaxTimesCount(budget), block_rows, "batch"), kept


def packed_arrays(rows: DataFrame, packs: DataFrame, index: str = "index", query: str = "query", response: str = "response", mask: str | None = None, logprobs: str | None = None) -> DataFrame:
    """One row per pack: token ids, segment ids from 1 inside the pack, position ids, response mask (row
    index + 1 on response tokens, 0 on query tokens; tool-masked tokens 0), done markers at last tokens."""
    n_q, n_r = F.size(query), F.size(response)
    number = F.col(index).cast("int") + 1
    fields = {
        "ids": F.concat(query, response),
        "rmask": F.concat(
            F.array_repeat(F.lit(0), n_q), F.transform(response, lambda _: number) if mask is None else F.transform(mask, lambda m: F.when(m != 0, number).otherwise(0))
        ),
        "done": F.concat(F.array_repeat(F.lit(0), n_q + n_r - 1), F.array(number)),
        "n_actions": n_r,
        "n": n_q + n_r,
    }
    if logprobs:
        fields["lp"] = F.concat(F.array_repeat(F.lit(float("nan")), n_q), F.col(logprobs).cast("array<double>"))
    j = rows.join(packs, index)
    member = F.struct(F.col(index).alias("_index"), *[c.alias(k) for k, c in fields.items()])
    g = j.groupBy("pack").agg(F.sort_array(F.collect_list(member)).alias("m"))  # bounded by the pack length
    flat = lambda k: F.flatten(F.transform("m", lambda x: x[k]))
    out = {
        "query_responses": flat("ids"),
        "attention_masks": F.flatten(F.transform("m", lambda x, i: F.array_repeat(i + 1, x["n"]))),
        "position_ids": F.flatten(F.transform("m", lambda x: F.sequence(F.lit(0), x["n"] - 1))),
        "response_masks": flat("rmask"),
        "dones": flat("done"),
        "num_actions": F.transform("m", lambda x: x["n_actions"]),
        "packed_seq_lens": F.transform("m", lambda x: x["n"]),
    }
    if logprobs:
        out["logprobs"] = flat("lp")
    return g.select("pack", *[c.alias(k) for k, c in out.items()])


def drop_pad(ids: Column, pad_id: int) -> Column:
    return F.filter(ids, lambda t: t != pad_id)


def position_ids(segments: Column) -> Column:
    """Positions that restart from 0 in every segment of an ascending segment-id array."""

    def build(s):
        starts = F.filter(indices(F.size(s)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda g: F.flatten(F.transform(g, lambda a, k: indices(F.coalesce(F.get(g, k + 1), F.size(s)) - a))))

    return let(segments, build)


def spread(mask: Column, values: Column) -> Column:
    """Per-sequence value at each token whose mask names the sequence (1-based), 0 elsewhere."""
    return F.transform(mask, lambda m: F.when(m == 0, F.lit(0.0)).otherwise(F.get(values, m - 1).cast("double")))


def flatten_batch(df: DataFrame, batch: str, order_by: str, ids: str = "input_ids", labels: str = "labels", max_len: int | None = None, separator: int = IGNORE) -> DataFrame:
    """Concatenate the examples of a batch: ids, labels with the separator in place of each first label,
    cumulative lengths, longest length, position ids, sequence numbers; right-padded to ``max_len``."""
    member = F.struct(order_by, F.col(ids).alias("_ids"), F.col(labels).alias("_labels"))
    g = df.groupBy(batch).agg(F.sort_array(F.collect_list(member)).alias("m"))  # bounded by the batch budget
    flat = lambda f: F.flatten(F.transform("m", f))
    shifted = lambda x: F.concat(F.array(F.lit(separator)), F.slice(x["_labels"], F.lit(2), F.greatest(F.size(x["_labels"]) - 1, F.lit(0))))
    sizes = F.transform("m", lambda x: F.size(x["_ids"]))
    cu = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(last(a) + n)))
    cols = {
        "input_ids": (flat(lambda x: x["_ids"]), 0),
        "labels": (flat(shifted), IGNORE),
        "position_ids": (flat(lambda x: indices(F.size(x["_ids"]))), 0),
        "seq_idx": (F.flatten(F.transform("m", lambda x, k: F.array_repeat(k, F.size(x["_ids"])))), -1),
    }
    padded = lambda c, p: c if max_len is None else F.concat(c, F.array_repeat(F.lit(p), F.greatest(F.lit(max_len) - F.size(c), F.lit(0))))
    return g.select(batch, *[padded(c, p).alias(k) for k, (c, p) in cols.items()], cu.alias("cu_seq_lens"), F.array_max(sizes).alias("max_length"))


def batch_tokens(batch: DataFrame, cu: list[str] = (), mask: str | None = None, ids: list[str] = ()) -> Column:
    """Tokens of a batch row: last cumulative lengths, else the mask sum, else the number of ids."""
    have = [F.col(c) for c in cu if c in batch.columns]
    if have:
        return sum((last(c) for c in have), F.lit(0))
    if mask and mask in batch.columns:
        return F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return sum((F.size(c) for c in ids), F.lit(0))


def batch_sequences(cu: list[str]) -> Column:
    return sum((F.size(c) - 1 for c in cu), F.lit(0))


def pad_batch(df: DataFrame, batch: str, sides: dict[str, int]) -> DataFrame:
    """Right-pad each array column (name -> pad value) to the longest array of the batch over all columns."""
    longest = df.groupBy(batch).agg(F.max(F.greatest(*[F.size(c) for c in sides], F.lit(0))).alias("_w"))
    j = df.join(longest, batch)
    return j.withColumns({c: F.concat(F.col(c), F.array_repeat(F.lit(p), F.col("_w") - F.size(c))) for c, p in sides.items()}).drop("_w")


# -- cutting --------------------------------------------------------------------------------------


def split_conversation(lengths: Column, max_len: int, overhead: int = 6) -> Column:
    """array<struct<start, end>> of message ranges, greedy over turn pairs; an odd last message is left out.

    A pair that would overflow closes the segment before it, empty or not; a pair longer than the limit is
    skipped, though its length still counts; the last pair is emitted only when it did not overflow.
    """

    def cut(ls):
        pairs = F.floor(F.size(ls) / 2).cast("int")
        segments = F.array().cast("array<struct<start:int,end:int>>")
        zero = F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("len"), segments.alias("out"))

        def step(s, k):
            i = k * 2
            here = (F.get(ls, i) + F.get(ls, i + 1) + 2 * overhead).cast("long")
            over, final = s["len"] + here > max_len, k == pairs - 1
            seg = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
            out = F.when(over, F.concat(s["out"], seg(s["start"], i))).when(final, F.concat(s["out"], seg(s["start"], i + 2))).otherwise(s["out"])
            start = F.when(over, F.when(here > max_len, i + 2).otherwise(i)).otherwise(s["start"])
            return F.struct(start.alias("start"), (F.when(over, F.lit(0)).otherwise(s["len"]) + here).alias("len"), out.alias("out"))

        return F.aggregate(indices(pairs), zero, step, lambda s: s["out"])

    return let(lengths, cut)


def split_conversations(df: DataFrame, ids: str, messages: str, lengths: Column, max_len: int) -> DataFrame:
    """One row per segment with id ``{id}_{start}``."""
    seg = df.withColumn("_s", F.explode(split_conversation(lengths, max_len)))
    part = F.slice(F.col(messages), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    return seg.withColumns({messages: part, "start": F.col("_s.start"), ids: F.concat_ws("_", F.col(ids).cast("string"), F.col("_s.start").cast("string"))}).drop("_s")


def fit_context(messages: Column, available: int, counter="words", compat: bool = True) -> Column:
    """System messages first, then others until the budget; the one that overflows is cut to its first
    words, the rest is left out. System messages alone over the budget stay alone. ``compat`` keeps the
    budget test that counts system tokens twice."""

    def build(ms):
        system = F.filter(ms, lambda m: m["role"] == "system")
        others = F.filter(ms, lambda m: m["role"] != "system")
        used = F.aggregate(system, F.lit(0), lambda a, m: a + token_length(m["content"], counter) + 4)

        def fill(u):
            budget = F.lit(available) - u
            zero = F.struct((u if compat else F.lit(0)).alias("n"), F.lit(False).alias("full"), F.array().cast("array<struct<role:string,content:string>>").alias("out"))

            def step(s, m):
                need = token_length(m["content"], counter) + 3
                room = budget - s["n"] - 3
                fits = s["n"] + need <= budget
                keep = F.struct(m["role"].alias("role"), m["content"].alias("content"))
                cut = F.struct(m["role"].alias("role"), F.array_join(F.slice(X.words(m["content"]), F.lit(1), F.greatest(room, F.lit(1))), " ").alias("content"))
                out = F.when(s["full"], s["out"]).when(fits, F.concat(s["out"], F.array(keep))).when(room > 0, F.concat(s["out"], F.array(cut))).otherwise(s["out"])
                return F.struct(F.when(fits & ~s["full"], s["n"] + need).otherwise(s["n"]).alias("n"), (s["full"] | ~fits).alias("full"), out.alias("out"))

            plain = F.transform(system, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
            return F.when(budget <= 0, plain).otherwise(F.concat(plain, F.aggregate(others, zero, step, lambda s: s["out"])))

        return let(used, fill)

    return let(messages, build)


def token_stream(df: DataFrame, order_by, chunk: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Pieces of the concatenated token stream per fixed-size chunk: (chunk, start, end, ids, mask), start
    and end relative to the chunk. A row longer than a chunk is cut; the writer partitions by chunk."""
    placed = prefix_sum(df.select(order_by, ids, labels, F.size(ids).alias("_n")), order_by, "_n", "_start", "_end").filter("_n > 0")
    c = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_start") / chunk), F.floor((F.col("_end") - 1) / chunk))))
    base = F.col("chunk") * chunk
    lo, hi = F.greatest(F.col("_start"), base), F.least(F.col("_end"), base + chunk)
    part = lambda a: F.slice(a, (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int"))
    return c.select(
        "chunk", (lo - base).alias("start"), (hi - base).alias("end"), part(F.col(ids)).alias("ids"),
        part(F.transform(labels, lambda x: (x != IGNORE).cast("int"))).alias("mask"), order_by,
    )


def id_type(vocab_size: int) -> str:
    """Smallest Spark integer type that holds every id."""
    for name, top in (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31)):
        if vocab_size <= top:
            return name
    return "bigint"


# -- advantage estimation over arrays -------------------------------------------------------------


def gae(gamma: float, lam: float, packed: bool = False) -> Callable[..., Column]:
    """Column function (values, rewards[, dones, masks]) -> array<double> of generalised advantages. The
    packed form starts anew at done tokens and outside responses. Null and empty rows give an empty array.

    All rows of a batch step back from their last tokens together, so a step is one vector operation.
    """

    def flat(rows: pd.Series, values: pd.Series) -> np.ndarray:
        """The rows end to end, without those whose values are null."""
        known = [(x, v) for x, v in zip(rows, values) if v is not None]
        if any(x is None or len(x) != len(v) for x, v in known):
            raise ValueError("values, rewards, dones and masks differ in length")
        return np.concatenate([np.zeros(0), *[np.asarray(x, float) for x, _ in known]])

    def run(v: pd.Series, r: pd.Series, live: np.ndarray | None = None) -> pd.Series:
        lens = np.array([0 if x is None else len(x) for x in v], dtype=np.int64)
        value, gain, ends = flat(v, v), flat(r, v), np.cumsum(lens)
        live = np.ones(len(value)) if live is None else live
        longest = np.argsort(-lens, kind="stable")
        falling, last = -lens[longest], ends[longest] - 1
        out, carry, ahead = np.zeros(len(value)), np.zeros(len(lens)), np.zeros(len(lens))
        for k in range(int(lens.max(initial=0))):
            m = np.searchsorted(falling, -k, "left")  # rows with more than k tokens
            at = last[:m] - k
            carry[:m] = gain[at] + gamma * ahead[:m] * live[at] - value[at] + gamma * lam * carry[:m] * live[at]
            out[at], ahead[:m] = carry[:m], value[at]
        return pd.Series(np.split(out, ends[:-1]) if len(lens) else [], dtype=object)

    if packed:

        @F.pandas_udf("array<double>")
        def packed_gae(v: pd.Series, r: pd.Series, d: pd.Series, m: pd.Series) -> pd.Series:
            return run(v, r, (1 - np.clip(flat(d, v), 0, 1)) * np.clip(flat(m, v), 0, 1))

        return packed_gae

    @F.pandas_udf("array<double>")
    def plain_gae(v: pd.Series, r: pd.Series) -> pd.Series:
        return run(v, r)

    return plain_gae
