import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatmill.operators import pack as K


def next_fit(rows, limits):
    out, pack, fill = [], -1, None
    for r in rows:
        if fill is None or any(f + x > lim for f, x, lim in zip(fill, r, limits)):
            pack, fill = pack + 1, list(r)
        else:
            fill = [f + x for f, x in zip(fill, r)]
        out.append(pack)
    return out


def max_times_count(rows, limit):
    out, batch, cur = [], -1, []
    for n in rows:
        if not cur or max(cur + [n]) * (len(cur) + 1) > limit:
            batch, cur = batch + 1, [n]
        else:
            cur.append(n)
        out.append(batch)
    return out


def blocks(rule, rows, size):
    """The block-wise algorithm in plain numpy, as the Spark tasks run it."""
    import pandas as pd

    a = np.asarray(rows, np.int64).reshape(len(rows), -1)
    parts = [a[i : i + size] for i in range(0, len(a), size)]
    nodes = pd.DataFrame([{"node": i, **K._summary(p, rule)} for i, p in enumerate(parts)])
    chain = K._chain(nodes, rule)
    # runs of composed blocks take a carry where the single blocks take it
    for lo in range(0, len(parts), 5):
        run = [K._Node.read(r) for r in nodes.iloc[lo : lo + 5].itertuples()]
        one, carry, packs = reduce(lambda a, b: a.then(b, rule), run), chain["carry"].iloc[lo], chain["packs"].iloc[lo]
        _, opened, left = one.follow(carry, rule)
        if lo + 5 < len(parts):
            assert packs + opened == chain["packs"].iloc[lo + 5] and (left == chain["carry"].iloc[lo + 5]).all()
    chain = chain[["node", "first", "packs"]]
    out = []
    for p, (_, first, packs) in zip(parts, chain.itertuples(index=False)):
        nxt, opened, i = rule.next_starts(p), np.zeros(len(p), np.int64), first
        while i < len(p):
            opened[i] = 1
            i = int(nxt[i])
        out += (packs - 1 + np.cumsum(opened)).tolist()
    return out


@pytest.mark.parametrize("seed", range(30))
def test_blocks_equal_one_pass(seed):
    rng = random.Random(seed)
    n, limit = rng.randint(1, 120), rng.randint(5, 60)
    one = [(rng.randint(1, 40),) for _ in range(n)]
    two = [(rng.randint(1, 40), rng.randint(1, 30)) for _ in range(n)]
    short = [rng.randint(1, limit) for _ in range(n)]
    for size in (1, 3, 7, 50, 200):
        assert blocks(K._Sums([limit]), one, size) == next_fit(one, [limit])
        assert blocks(K._Sums([limit, limit + 5]), two, size) == next_fit(two, [limit, limit + 5])
        assert blocks(K._MaxTimesCount(limit * 2), short, size) == max_times_count(short, limit * 2)


def test_pack_on_spark_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 300)) for i in range(500)]
    df = spark.createDataFrame(rows, "index long, n long").repartition(7)
    want = next_fit([(n,) for _, n in rows], [512])
    monkeypatch.setattr(K, "FAN", 3)  # several levels of composed blocks
    for size in (1, 37, 1000):
        got = [r["pack"] for r in K.pack_next_fit(df, "index", "n", 512, block_rows=size).orderBy("index").collect()]
        assert got == want


def test_packed_arrays(spark):
    df = spark.createDataFrame(
        [(0, [1, 2], [3], [1], [0.5]), (1, [4], [5, 6], [0, 1], [0.1, 0.2]), (2, [7, 8, 9], [10, 11], [1, 1], [0.3, 0.4])],
        "index long, query array<int>, response array<int>, mask array<int>, lp array<double>",
    )
    sized = df.withColumn("n", F.size("query") + F.size("response"))
    packs = K.pack_next_fit(sized, "index", "n", 6)
    got = {r["pack"]: r for r in K.packed_arrays(df, packs, mask="mask", logprobs="lp").collect()}
    assert got[0]["query_responses"] == [1, 2, 3, 4, 5, 6] and got[1]["query_responses"] == [7, 8, 9, 10, 11]
    assert got[0]["attention_masks"] == [1, 1, 1, 2, 2, 2]
    assert got[0]["position_ids"] == [0, 1, 2, 0, 1, 2]
    assert got[0]["response_masks"] == [0, 0, 1, 0, 0, 2]
    assert got[0]["dones"] == [0, 0, 1, 0, 0, 2]
    assert got[0]["num_actions"] == [1, 2] and got[0]["packed_seq_lens"] == [3, 3]
    assert np.isnan(got[0]["logprobs"][0]) and got[0]["logprobs"][2] == 0.5
    assert sum(len(r["query_responses"]) for r in got.values()) == 11


def test_min_batches(spark):
    df = spark.createDataFrame([(i, 10) for i in range(8)], "index long, n long")
    assert K.pack_next_fit(df, "index", "n", 1000, min_batches=4).select("pack").distinct().count() == 4


def test_gae(spark):
    v, r = [0.5, 0.4, 0.3], [0.0, 0.0, 1.0]

    def plain():
        out, carry = [0.0] * 3, 0.0
        for t in (2, 1, 0):
            carry = r[t] + 0.9 * (v[t + 1] if t < 2 else 0.0) - v[t] + 0.9 * 0.8 * carry
            out[t] = carry
        return out

    df = spark.createDataFrame([(v, r, [0, 1, 1], [1, 1, 1])], "v array<double>, r array<double>, d array<int>, m array<int>")
    got = df.select(K.gae(0.9, 0.8)("v", "r").alias("a"), K.gae(0.9, 0.8, packed=True)("v", "r", "d", "m").alias("b")).first()
    assert got["a"] == pytest.approx(plain())
    assert got["b"][1] == pytest.approx(0.0 - 0.4) and got["b"][2] == pytest.approx(0.7)


def test_gae_of_rows_of_many_lengths(spark):
    rng = random.Random(3)
    rows = [(i, *[[rng.random() for _ in range(n)] for _ in "vr"]) for i, n in enumerate([5, 0, 1, 9, 5, 2])] + [(6, None, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>, r array<double>").coalesce(1)
    got = {x["i"]: x["a"] for x in df.select("i", K.gae(0.9, 0.8)("v", "r").alias("a")).collect()}
    for i, v, r in rows:
        want, carry = [], 0.0
        for t in range(len(v or []) - 1, -1, -1):
            carry = r[t] + 0.9 * (v[t + 1] if t + 1 < len(v) else 0.0) - v[t] + 0.9 * 0.8 * carry
            want.insert(0, carry)
        assert got[i] == pytest.approx(want)


CHAT = [("system", "be kind"), ("user", "hi there"), ("assistant", "hello"), ("user", "bye"), ("assistant", "see you")]


def chat_df(spark, turns=CHAT):
    return spark.createDataFrame([(1, [{"role": r, "content": c} for r, c in turns])], "id int, messages array<struct<role:string,content:string>>")


def trained(spark, mode, turns=CHAT, template="tags"):
    rows = chat_df(spark, turns).select(F.explode(K.chat_pieces(F.col("messages"), template, "<eos>", mode)).alias("p")).select("p.*").collect()
    return "".join(r["text"] for r in rows), "".join(r["text"] for r in rows if r["train"])


def test_label_modes(spark):
    text, kept = trained(spark, "assistant")
    assert text == "<|system|>\nbe kind\n<|user|>\nhi there\n<|assistant|>\nhello<eos>\n<|user|>\nbye\n<|assistant|>\nsee you<eos>"
    assert kept == "hello<eos>see you<eos>"
    assert trained(spark, "last_turn")[1] == "see you<eos>"
    assert trained(spark, "prompt")[1] == "see you<eos>"
    assert trained(spark, "none")[1] == text
    two = [("user", "a"), ("assistant", "b"), ("assistant", "c")]
    assert trained(spark, "assistant", two)[1] == "b<eos>\n<|assistant|>\nc<eos>"


def test_pieces_join_to_the_rendered_chat(spark):
    from chatmill.operators.templates import TEMPLATES, render_chat

    for name, t in TEMPLATES.items():
        for turns in (CHAT, CHAT[1:]) if t.wrap else ():
            text, kept = trained(spark, "none", turns, name)
            assert text == kept == chat_df(spark, turns).select(render_chat(F.col("messages"), name, "<eos>").alias("x")).first()["x"], name


def test_encode_and_filter(spark):
    from chatmill.operators.filters import has_trainable_label

    df = chat_df(spark)
    vocab = K.build_vocab(df.select(F.explode("messages").alias("m")), K.tokens(F.col("m.content")), 100)
    enc = K.encoder(vocab)
    e = K.encode_chat(df, enc, max_len=30)
    row = e.first()
    assert len(row["input_ids"]) == len(row["labels"]) == len(row["attention_mask"]) == 30
    assert e.filter(has_trainable_label()).count() == 1
    assert K.encode_chat(df, enc, max_len=5).filter(has_trainable_label()).count() == 0
    pair = df.select(F.col("messages").alias("chosen"), F.col("messages").alias("rejected"))
    assert {f"{s}_{c}" for s in ("chosen", "rejected") for c in ("input_ids", "attention_mask", "labels")} <= set(K.encode_preference(pair, enc).columns)
    ver = df.withColumns({"ground_truth": F.lit("5"), "dataset": F.lit("gsm8k")})
    v = K.encode_verifiable(ver, enc, pad_id=0).first()
    assert v["dataset"] == ["gsm8k"] and v["raw_prompt"].endswith("user: bye") and 0 not in v["input_ids_prompt"]


def test_context_and_split(spark):
    d = chat_df(spark, [("system", "a b"), ("user", "c d e"), ("assistant", "f g h i")])
    assert d.select(K.message_tokens(F.col("messages")).alias("n")).first()["n"] == 2 + 4 + 3 + 3 + 4 + 3
    got = d.select(K.fit_context(F.col("messages"), 20, compat=False).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in got] == [("system", "a b"), ("user", "c d e"), ("assistant", "f g h i")] or got[-1]["content"] == "f g h i"
    got = d.select(K.fit_context(F.col("messages"), 17, compat=False).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in got] == [("system", "a b"), ("user", "c d e"), ("assistant", "f g")]
    got = d.select(K.fit_context(F.col("messages"), 4, compat=False).alias("m")).first()["m"]
    assert [m["role"] for m in got] == ["system"]
    cut = lambda ls, n: [tuple(x) for x in spark.createDataFrame([(ls,)], "l array<int>").select(K.split_conversation(F.col("l"), n, 0).alias("s")).first()["s"]]
    assert cut([5, 5, 5, 5], 100) == [(0, 4)]
    assert cut([5, 5, 5, 5], 15) == [(0, 2)]
    assert cut([5, 5, 20, 20, 1, 1], 15) == [(0, 2), (4, 4)]  # the skipped pair's length still counts
    assert cut([5], 15) == []


def test_spread_flatten_pad(spark):
    df = spark.createDataFrame([([0, 1, 2, 0], [1.5, 2.5])], "m array<int>, v array<double>")
    assert df.select(K.spread(F.col("m"), F.col("v")).alias("x")).first()["x"] == [0.0, 1.5, 2.5, 0.0]
    b = spark.createDataFrame([(0, 0, [1, 2], [1, 2]), (0, 1, [3], [3])], "b int, i int, input_ids array<int>, labels array<int>")
    r = K.flatten_batch(b, "b", "i", max_len=5).first()
    assert r["input_ids"] == [1, 2, 3, 0, 0] and r["labels"] == [-100, 2, -100, -100, -100]
    assert r["position_ids"] == [0, 1, 0, 0, 0] and r["seq_idx"] == [0, 0, 1, -1, -1] and r["cu_seq_lens"] == [0, 2, 3] and r["max_length"] == 2
    assert K.id_type(100) == "tinyint" and K.id_type(50_000) == "int"
