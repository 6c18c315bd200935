import random

import numpy as np
from pyspark.sql import functions as F

from chatmill.operators import decontam as D
from chatmill.operators.convert import from_pair
from chatmill.operators.phrases import Automaton


def tables(spark, seed=1, n_docs=120, n_items=15):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 14]))), " ".join(word() for _ in range(10))) for i in range(n_items)]
    items.append((99, None, "x"))
    docs = []
    for d in range(n_docs):
        t = " ".join(word() for _ in range(rng.randint(0, 40)))
        if d % 3 == 0:  # a third of all messages share the same passage
            t += " " + items[3][1] + ". " + items[3][2]
        docs.append((d, 0, t))
    return spark.createDataFrame(docs, "original_id int, msg int, text string"), spark.createDataFrame(items, "item_id int, q string, a string"), docs, items


def toks(t):
    return [w for w in __import__("re").split(r'[ ,.?!:;()"\-\n\\]+', t.lower()) if w]


def has(tokens, phrase):
    return any(tokens[i : i + len(phrase)] == phrase for i in range(len(tokens) - len(phrase) + 1))


def test_exact_matches_equal_brute_force(spark, monkeypatch):
    docs, evals, d_rows, e_rows = tables(spark)
    want = {(d, i) for d, _, t in d_rows for i, q, a in e_rows if q is not None and has(toks(t), toks(q)) and has(toks(t), toks(a))}
    threshold, given = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size, tokens in ((given, D.SLICE_TOKENS), (given, 20), ("-1", 20)):  # one automaton; several and a join, broadcast or shuffled
        spark.conf.set(threshold, size)
        monkeypatch.setattr(D, "SLICE_TOKENS", tokens)
        try:
            rows = D.phrase_matches(docs, evals, "original_id", "item_id", ["q", "a"]).collect()
        finally:
            spark.conf.set(threshold, given)
        got = {(r["original_id"], r["item"]) for r in rows}
        assert got == want and len(got) == len(rows) and len(want) >= 40
    scores = {r["item"]: r["score"] for r in D.exact_item_scores(D.phrase_matches(docs, evals, "original_id", "item_id", ["q"]), evals, "item_id", ["q"]).collect()}
    assert 99 not in scores and set(scores.values()) <= {0.0, 1.0}


def test_ngram_scores_equal_brute_force(spark):
    docs, evals, d_rows, e_rows = tables(spark, 2)
    n = 3
    pair = {}
    for d, _, t in d_rows:
        w = toks(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, q, a in e_rows:
            if q is None:
                continue
            total = 0.0
            for f in (q, a):
                e = toks(f)
                last = {tuple(e[k : k + n]): k for k in range(len(e) - n + 1)}
                covered = {k + j for g, k in last.items() if g in grams for j in range(n)}
                total += len(covered) / len(e)
            if total:
                pair[d, i] = total / 2
    o = D.NgramOverlap(docs, evals, "original_id", "item_id", ["q", "a"], n)
    items = {r["item"]: r["score"] for r in o.item_scores().collect()}
    train = {r["original_id"]: r["score"] for r in o.train_scores().collect()}
    for i, q, _ in e_rows:
        if q is not None:
            assert abs(items[i] - max([s for (d, k), s in pair.items() if k == i], default=0.0)) < 1e-9
    assert set(train) == {d for d, _ in pair}
    for d in train:
        assert abs(train[d] - max(s for (k, _), s in pair.items() if k == d)) < 1e-9
    bad = D.contaminated(o.train_scores(), "original_id", 0.9)
    assert D.decontaminate(docs, [bad]).count() == len(d_rows) - sum(s > 0.9 for s in train.values())


def test_nearest_broadcast_and_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    t, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    train = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(t)], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "item long, embedding array<float>")
    tn, qn = np.float32(t).astype(float), np.float32(q).astype(float)
    s = (qn / np.linalg.norm(qn, axis=1, keepdims=True)) @ (tn / np.linalg.norm(tn, axis=1, keepdims=True)).T
    want = {(i, int(j)) for i in range(7) for j in np.argsort(-s[i])[:5]}
    for limit in (1 << 20, 0):
        got = D.nearest(train, queries, 5, broadcast_bytes=limit, block_rows=40).collect()
        assert {(r["item"], r["vec_id"]) for r in got} == want
        assert all(abs(r["score"] - s[r["item"], r["vec_id"]]) < 1e-9 for r in got)


def test_messages_to_docs(spark):
    df = spark.createDataFrame([(7, "u", "a")], "original_id int, u string, a string").withColumn("messages", from_pair("u", "a"))
    assert [tuple(r) for r in D.messages_to_docs(df).collect()] == [(7, 0, "u")]
    assert D.messages_to_docs(df, role=None).count() == 2
    m = spark.createDataFrame([("t", "e1", 1.0), ("t", "e1", 0.0), ("t", "e2", 0.5)], "train_set string, eval_set string, score double")
    assert D.contamination_matrix(m, evals=["e1", "e2"]).first().asDict() == {"train_set": "t", "e1": 0.5, "e2": 0.5}
    assert m.select(D.covered_tokens(F.array(F.lit(0), F.lit(2), F.lit(9)), 3).alias("x")).first()["x"] == 8


def test_automaton_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        patterns = list({tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))})
        text = [rng.randrange(-1, 3) for _ in range(rng.randrange(0, 40))]  # -1 stands for a token of no phrase
        places = [i for i, x in enumerate(text) if x >= 0]
        got = Automaton(patterns, 3).find(places, [text[i] for i in places])
        assert got == {n for n, p in enumerate(patterns) if has(text, list(p))}


def test_common_token_gives_one_row_per_message(spark):
    texts = [("the " * 50 + "end") if i % 3 == 0 else "a b" for i in range(60)] + [None, "", "THE\\the"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "original_id int, msg int, text string")
    evals = spark.createDataFrame([("x", "the"), ("y", "the end"), ("z", ""), ("w", None), ("x", "b")], "item string, q string")
    rows = [(r["original_id"], r["item"]) for r in D.phrase_matches(docs, evals, "original_id", "item", ["q"]).collect()]
    assert sorted(rows) == sorted([(i, "x") for i in range(60)] + [(i, "y") for i in range(0, 60, 3)] + [(62, "x")])
    assert D.phrase_matches(docs, evals.limit(0), "original_id", "item", ["q"]).count() == 0
