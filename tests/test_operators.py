"""Literal cases for converters, filters, ordering, mixing, preferences and joins."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import let, token_counts
from chatmill.operators import convert as C
from chatmill.operators import filters as P
from chatmill.operators import joins as J
from chatmill.operators import mixing as M
from chatmill.operators import ordering as O
from chatmill.operators import prefs as R
from chatmill.operators import repetition as REP
from chatmill.operators import rollouts as RO
from chatmill.operators import templates as T

MSG = "array<struct<role:string,content:string>>"


def chats(spark, *convs):
    rows = [(i, [{"role": r, "content": c} for r, c in conv]) for i, conv in enumerate(convs)]
    return spark.createDataFrame(rows, f"id int, messages {MSG}")


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def pairs(x):
    return [(m["role"], m["content"]) for m in x]


def test_whitespace_and_words(spark):
    df = spark.createDataFrame([("  a b\x1f ",), ("",), ("\t\n",)], "t string")
    r = df.select(X.strip(F.col("t")).alias("s"), X.words(F.col("t")).alias("w"), X.is_blank(F.col("t")).alias("b"), X.word_count(F.col("t")).alias("n")).collect()
    assert [x["s"] for x in r] == ["a b", "", ""]
    assert [x["w"] for x in r] == [["a", "b"], [], []]
    assert [x["b"] for x in r] == [False, True, True] and [x["n"] for x in r] == [2, 0, 0]
    for text in ("  a b\x1f ", "x\x85y\x1cz", "a b\tc"):
        one = spark.createDataFrame([(text,)], "t string").select(X.words(F.col("t")).alias("w"), X.strip(F.col("t")).alias("s")).first()
        assert one["w"] == text.split() and one["s"] == text.strip()


def test_token_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>").select(token_counts(F.col("t")).alias("c"), let(F.size("t"), lambda n: n + 1).alias("n"))
    assert [(r["c"], r["n"]) for r in df.collect()] == [({"a": 1, "b": 2}, 4), ({}, 1)]


def test_keyword_filters(spark):
    df = chats(
        spark,
        [("user", "are you chatgpt?"), ("assistant", "no")],
        [("user", "hi"), ("assistant", "I am ChatGPT.")],
        [("user", "hi"), ("assistant", "unopenaid")],
        [("user", "hi"), ("assistant", "As a language model trained well, I like Qwen a lot.")],
        [("user", "hi"), ("assistant", "I'm Claude, an AI assistant.")],
    )
    assert ids(P.drop_keyword_self_reference(df)) == [0, 2, 3, 4]
    assert ids(P.drop_keyword_any_role(df)) == [3]
    assert ids(P.drop_provider_identity(df)) == [0, 2]
    null = chats(spark, [("user", None), ("assistant", "x")], [("assistant", None)], [("tool", None)])
    assert ids(P.drop_provider_identity(null)) == [0, 2]
    assert ids(P.drop_provider_identity(null, include_user=True)) == [2]
    assert ids(P.drop_empty_message(chats(spark, [("user", " ")], [("user", None)], [("user", "a")]))) == [2]


def test_script_and_think_filters(spark):
    df = chats(spark, [("user", "中文"), ("assistant", "ok")], [("user", "x"), ("assistant", "中文字")], [("assistant", "中" + "a" * 50)], [("user", "x")])
    assert ids(P.drop_script_ratio(df)) == [0, 2, 3]
    assert ids(P.drop_script_ratio(df, threshold=None)) == [0, 3]
    assert ids(P.drop_script_ratio(df, include_user=True)) == [2, 3]
    t = chats(
        spark,
        [("assistant", "<think>a\nb</think>c")],
        [("assistant", "<think>a</think><answer>b</answer>")],
        [("assistant", "x<think>a</think>")],
        [("assistant", None)],
    )
    assert ids(P.keep_think_format(t)) == [0, 1] and ids(P.keep_think_format(t, "think_answer")) == [1]


def test_cutoff_filter_drops_duplicate_ids(spark):
    df = spark.createDataFrame(
        [(1, "s", [("assistant", "As of my last update in April 2023, x")]), (1, "s", [("assistant", "fine")]), (2, "s", [("user", "knowledge cutoff 2021")]), (3, "t", [("user", "last year")])],
        f"id int, source string, messages {MSG}",
    )
    assert ids(P.drop_cutoff_mentions(df)) == [3]
    assert [tuple(r) for r in P.cutoff_report(df).collect()] == [("s", 2, 2)]


def test_small_filters(spark):
    df = spark.createDataFrame([(0, True, "EN", ["a"]), (1, None, "en", []), (2, False, "de", ["b", "c"])], "id int, toxic boolean, language string, tags array<string>")
    assert ids(P.drop_flag(df, "toxic")) == [1, 2] and ids(P.keep_language(df, "En")) == [0, 1]
    assert ids(P.drop_tags(df, ["x"], {"x": ["a", "b"]})) == [1] and ids(P.drop_tags(df, ["a"], {})) == [0, 1, 2]
    assert ids(P.length_filter(df, {"tags": 1, "language": None})) == [0, 1]
    with pytest.raises(ValueError):
        P.partition_by_predicate(df, {"en": F.col("language") == "en"})
    with pytest.raises(ValueError):
        P.count_guard(100, 90)
    tools = spark.createDataFrame([(["search"],), (["code", "search"],)], "tools array<string>")
    assert P.validate_tools(tools, ["search", "code", "browser"]) == ["browser"]
    with pytest.raises(ValueError):
        P.validate_tools(tools, ["search"])
    pair = spark.createDataFrame([(0, [("user", "a"), ("assistant", "b")], [("assistant", "c")]), (1, [("user", "a")], [("assistant", "c")]), (2, [("assistant", "")], [("assistant", "c")])], f"id int, chosen {MSG}, rejected {MSG}")
    assert ids(pair.filter(P.valid_pair())) == [0]


REPETITION = [
    ("This line repeats itself over.\n\n" * 12, True),
    ("Paragraph number one is here.\n\nSomething else entirely.\n\n" * 3, False),
    ("zebra quilt fox. " * 5, True),
    ("import os. " * 50, False),
    ("However,\n\n" * 30, False),
    ("ordinary text with no repeats. another sentence follows. third one.", False),
    ("it is so. " * 9, True),
]


def test_repetition_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPETITION)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", REP.repetition_reason(F.col("t")).alias("x")).collect()}
    assert {i: got[i] is not None for i in got} == {i: e for i, (_, e) in enumerate(REPETITION)}
    assert got[0] == "paragraph_repeated_12x" and got[6] == "line_repeated_9x_consecutive_short_phrase"


def test_repetition_helpers(spark):
    def flag(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]

    assert flag(REP.is_code_line, "for x in y") and flag(REP.is_code_line, "foo(") and not flag(REP.is_code_line, "plain words (ok)")
    assert flag(REP.is_complex_math, "3 + 4") and flag(REP.is_structured_list, "1. a\n2. b") and not flag(REP.is_structured_list, "1. a")
    assert flag(REP.is_short_phrase, "a < b") and flag(lambda c: REP.is_short_phrase(c, "exact"), "maybe") and not flag(lambda c: REP.is_short_phrase(c, "exact"), "this zebra")


def test_converters(spark):
    df = spark.createDataFrame([Row(instruction="do", input="this", output="done", id=1)])
    m = pairs(C.to_messages(df).first()["messages"])
    assert m[0][1].endswith("### Instruction:\ndo\n\n### Input:\nthis\n\n### Response:") and m[1] == ("assistant", "done")
    for cols, n in ((dict(prompt="a", completion="b"), 2), (dict(query="a", answer="b"), 2), (dict(query="a", response="b"), 2), (dict(system_prompt="s", question="a", response="b"), 3)):
        assert len(C.to_messages(spark.createDataFrame([Row(**cols)])).first()["messages"]) == n
    with pytest.raises(ValueError):
        C.to_messages(spark.createDataFrame([Row(x=1)]))
    conv = spark.createDataFrame([([{"from": "human", "value": "a"}, {"from": "bing", "value": "b"}],)], "conversations array<struct<`from`:string,value:string>>")
    with pytest.raises(Exception, match="unknown sender"):
        C.to_messages(conv).collect()
    t = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d", "x[|Human|] a [|AI|] b[|Human|] c")], "t string, u string")
    r = t.select(C.from_transcript("t").alias("t"), C.from_marked_rounds("u").alias("u")).first()
    assert pairs(r["t"]) == [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")] and pairs(r["u"]) == [("user", "a"), ("assistant", "b")]


def test_thinking_edits(spark):
    df = chats(spark, [("user", "q"), ("assistant", "<think>a</think>b")])
    content = lambda e: df.select(e.alias("m")).first()["m"][-1]["content"]
    assert content(C.add_answer()) == "<think>a</think>\n<answer>\nb\n</answer>"
    assert content(C.remove_answer()) == "<think>a</think>\nb"
    raw = chats(spark, [("assistant", "<|reserved_special_token_246|>r<|reserved_special_token_247|>a")])
    out = raw.withColumn("m", C.think_format("messages")).select(F.col("m"), C.answer_after_think("m").alias("g")).first()
    assert out["m"][0]["content"] == "<think>r</think><answer>a</answer>" and out["g"] == "a"


def test_tools_and_env(spark):
    defs = F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name")))
    df = spark.createDataFrame([(["b"],), (None,), (["z"],)], "tools array<string>")
    assert [r["x"] and [t["name"] for t in r["x"]] for r in df.select(C.resolve_tools(defs, "tools").alias("x")).collect()] == [["b"], ["a", "b"], None]
    e = spark.createDataFrame([({"k": "row"},), (None,)], "c map<string,string>")
    assert [r["x"] for r in e.select(C.merge_env_config({"env_name": "e", "k": "base"}, "c").alias("x")).collect()] == [{"env_name": "e", "k": "row"}, {"env_name": "e", "k": "base"}]
    assert e.select(C.merge_env_config({"k": "base"}, "c").alias("x")).first()["x"] == {"k": "row"}


def test_templates(spark):
    df = chats(spark, [("user", "q"), ("assistant", "<think>t</think>a"), ("user", "r"), ("assistant", "<think>u</think>b")])
    show = lambda name, **kw: df.select(T.render_chat(F.col("messages"), name, "<e>", **kw).alias("x")).first()["x"]
    assert show("concat_space").endswith("b<e>") and show("assistant_only") == "<think>t</think>a<think>u</think>b"
    assert show("tags") == "<|user|>\nq\n<|assistant|>\n<think>t</think>a<e>\n<|user|>\nr\n<|assistant|>\n<think>u</think>b<e>"
    assert show("tags_eos", add_generation_prompt=True).endswith("<think>u</think>b<e>\n<|assistant|>\n")
    assert "<|assistant|>\na<e>\n" in show("tags_reasoning") and show("tags_reasoning").startswith("A conversation between")
    mid = show("im_drop_earlier_thinking")
    assert "<|im_start|>assistant\na<|im_end|>" in mid and mid.endswith("<think>u</think>b<e>")
    assert show("reasoning_think", add_generation_prompt=True).endswith("Assistant: <think>")
    f = spark.createDataFrame([([("user", "q", "f()", None), ("assistant", "a", None, "g()")],)], "messages array<struct<role:string,content:string,functions:string,function_calls:string>>")
    x = f.select(T.render_chat(F.col("messages"), "im", "<e>", fields=("role", "content", "functions", "function_calls")).alias("x")).first()["x"]
    assert x.endswith("<|im_start|>user\nq\n<functions>f()</functions><|im_end|>\n<|im_start|>assistant\na<function_calls>g()</function_calls><e>")


def test_ordering(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise("cold")).repartition(9)
    assert [r["index"] for r in O.dense_index(df, "id").orderBy("id").collect()] == list(range(1000))
    rank = O.hash_rank(df, 1, "id", ["g"]).groupBy("g").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m")).collect()
    assert {r["g"]: (r["n"], r["m"]) for r in rank} == {"hot": (700, 699), "cold": (300, 299)}
    assert O.sample_exact(df, 37, 3, "id").count() == 37 and O.sample_exact(df, 5000, 3, "id").count() == 1000 and O.sample_exact(df, 0, 3, "id").count() == 0
    s = df.withColumn("n", F.lit(3)).withColumn("d", F.lit(4) * F.col("n"))
    p = O.prefix_sum(s, "id", "d").orderBy("id").collect()
    assert all(r["start"] == 12 * r["id"] and r["end"] == 12 * r["id"] + 12 for r in p)
    null = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, g string")
    assert O.sample_exact(null, 1, 0, "id", ["g"]).count() == 2


def test_join_stats_hot_and_cold(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") < 80, 0).otherwise(F.col("id")))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    threshold, given = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size, kind in ((given, "BroadcastHashJoin"), ("-1", "SortMergeJoin")):
        spark.conf.set(threshold, size)
        try:
            a = O.join_stats(df, stats, "k")
            assert a.count() == 100 and sorted(r["n"] for r in a.collect()) == [1] * 20 + [80] * 80
            plan = a._jdf.queryExecution().sparkPlan().toString()
        finally:
            spark.conf.set(threshold, given)
        assert plan.count("Join") == plan.count(kind) == 1 and "Aggregate" not in plan  # one join with what was written


def test_mixing_rules(spark):
    a, b = spark.range(100).withColumnRenamed("id", "i"), spark.range(1000, 1050).withColumnRenamed("id", "i")
    src = {"a": a, "b": b}
    count = lambda items: {r["source"]: r["count"] for r in M.mix(src, items, "i")[0].groupBy("source").count().collect()}
    both = a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b")))
    for items in (["a", "0.5", "b", "10"], ["b", "130", "a", "2.25"]):
        (x, s), (y, t) = M.mix(src, items, "i"), M.mix_table(both, items, "i")
        assert s == t and sorted((r["i"], r["source"], r["copy"]) for r in x.collect()) == sorted((r["i"], r["source"], r["copy"]) for r in y.collect())
    with pytest.raises(ValueError, match="named twice"):
        M.mix_table(both, ["a", "1", "a", "2"], "i")
    assert count(["a", "0.5", "b", "10"]) == {"a": 50, "b": 10}
    assert count(["a", "2.25", "b", "130"]) == {"a": 225, "b": 130}
    out, sizes = M.mix(src, ["a", "1.0", "b", "1"], "i")
    assert out.count() == 101 and [s["is_upsampled"] for s in sizes] == [False, False]
    with pytest.raises(ValueError):
        M.parse_mix(["a"])
    with pytest.raises(ValueError):
        M.mix_fixed(src, {"a": -1}, "i")
    with pytest.raises(NotImplementedError):
        M.mix_fixed(src, {"a": 0.5, "b": 10}, "i")
    assert M.mix_fixed(src, {"a": 3, "b": 10}, "i").count() == 13
    assert [r["i"] for r in M.mix(src, ["a", "7"], "i")[0].orderBy("i").collect()] == [r["i"] for r in M.mix(src, ["a", "7"], "i")[0].orderBy("i").collect()]
    with pytest.raises(ValueError):
        M.stratified_portions(a, {"x": 0.5}, 10, "i", 1, "i")


def test_preference_ties(spark):
    df = spark.createDataFrame([("p", 0, 5.0), ("p", 1, 5.0), ("p", 2, 1.0), ("p", 3, 1.0), ("q", 0, 2.0), ("r", 0, 3.0), ("r", 1, 3.0)], "p string, i int, s double")
    got = R.binarize_by_score(df, "p", F.col("s"), ["i"], ["i"]).collect()
    assert [(r["p"], r["chosen_i"], r["rejected_i"]) for r in got] == [("p", 0, 3)]
    assert R.binarize_by_score(df, "p", F.col("s"), ["i"], ["i"], margin=5).count() == 0
    votes = spark.createDataFrame([(1, "m1", 4), (1, "m2", 4), (1, "m3", 9), (2, "m1", 1), (2, "m2", 2), (3, "m1", 7)], "p int, m string, v int")
    got = {r["p"]: r["v"] for r in R.majority_vote(votes, "p", "m", "v", 1).collect()}
    assert got[1] == 4 and got[2] in (1, 2) and got[3] == 7
    ratings = spark.createDataFrame([([4.0, float("nan"), 1.0], [2.0, 3.0])], "a array<double>, b array<double>")
    assert ratings.select(R.mean_ratings(["a", "b"]).alias("x")).first()["x"] == [3.0, 3.0, 1.0]


def test_zero_spread_classes(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 0.5), ("c", 0.5), ("d", 0.0), ("d", 1.0)], "prompt_id string, reward double")
    r = RO.batch_statistics(df, 1.0, no_resample_rate=1.0).first()
    assert (r["filtered_prompts"], r["filtered_prompts_zero"], r["filtered_prompts_solved"], r["filtered_prompts_nonzero"], r["no_resampled_prompts"]) == (3, 1, 1, 1, 1)
    adv = {x["reward"]: x["advantage"] for x in RO.grpo_advantage(df.filter("prompt_id = 'd'")).collect()}
    assert adv[1.0] == pytest.approx(1.0, abs=1e-6) and adv[0.0] == pytest.approx(-1.0, abs=1e-6)


def test_tree_paths(spark):
    rows = [
        ("r", None, "prompter", "q", False, 0.0), ("a", "r", "assistant", "a1", False, 0.9), ("b", "r", "assistant", "a2", False, 0.5), ("c", "r", "assistant", "a3", True, 1.0),
        ("d", "a", "prompter", "q2", False, None), ("e", "d", "assistant", "a4", False, None), ("f", "b", "prompter", "q3", False, 0.1), ("g", "c", "assistant", "x", False, 0.1),
    ]
    nodes = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, deleted boolean, quality double")
    paths = {r["leaf"]: [m["content"] for m in r["messages"]] for r in J.tree_paths(nodes).collect()}
    assert paths == {"e": ["q", "a1", "q2", "a4"]}  # b ends in a prompter's question, c is deleted
    assert {r["leaf"] for r in J.tree_paths(nodes, top_k=1).collect()} == {"e"}


def test_baseline_and_coverage(spark):
    r = spark.createDataFrame([(i, "p" if i < 5 else "q", float(-i), 0) for i in range(6)], "id int, prompt string, proj double, pack int")
    base = spark.createDataFrame([("p", 0.0)], "prompt string, baseline double")
    out = {x["id"]: x for x in J.baseline_filter(r, base, "prompt", "proj", "pack", "id", -1.0, 0.34).collect()}
    assert [i for i in out if out[i]["removed"]] == [4, 3] or sorted(i for i in out if out[i]["removed"]) == [3, 4]
    assert out[5]["missing_baseline"]
    with pytest.raises(ValueError, match="missing indices"):
        J.coverage_check(spark.range(5).withColumnRenamed("id", "i"), spark.createDataFrame([(1, 2.0)], "i long, v double"), "i", "v")


def test_lookup_and_tests(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, ["a", "b"])], "id int, tests array<string>")
    res = spark.createDataFrame([(1, [1, 1, 0, 1, 1]), (2, [1, 0])], "id int, passed array<int>")
    got = J.keep_passed_tests(df, res, "id").collect()
    assert [(r["id"], r["tests"]) for r in got] == [(1, ["a", "b", "d", "e"])]


def test_tree_paths_deeper_than_any_fixed_bound(spark):
    rows = [(str(i), str(i - 1) if i else None, "assistant" if i % 2 else "user", "t", False, 0.0) for i in range(70)]
    nodes = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, deleted boolean, quality double")
    assert [(r["leaf"], len(r["messages"])) for r in J.tree_paths(nodes).collect()] == [("69", 70)]


def test_tree_paths_of_every_length_and_shape(spark):
    rng, parent = random.Random(5), {}
    for length in (*range(1, 41), 300, 500, 900):  # chains
        parent.update({1000 * length + i: 1000 * length + i - 1 if i else None for i in range(length)})
    parent.update({1_000_000 + i: 1_000_000 + rng.randrange(max(0, i - 6), i) if i else None for i in range(600)})  # deep tree
    parent.update({2_000_000 + i: 2_000_000 if i else None for i in range(300)})  # one parent of many
    parent.update({3_000_000 + i: 3_000_000 + (i + 1) % 7 for i in range(7)} | {3_000_010: 3_000_000, 3_000_020: 3_000_020, 3_000_021: 3_000_020})  # cycles
    parent.update({4_000_000 + i: 4_000_000 + i - 1 for i in range(30)})  # under a missing parent
    inner = set(parent.values())
    role = {i: "assistant" if i in inner or i % 3 else "user" for i in parent}
    want = {}
    for leaf in parent.keys() - inner:
        path, at = [], leaf
        while at in parent and len(path) <= len(parent):
            path.append(at)
            at = parent[at]
        if at is None and role[leaf] == "assistant":
            want[leaf] = path[::-1]
    nodes = spark.createDataFrame([(i, p, role[i], str(i), False, 0.0) for i, p in parent.items()], "message_id long, parent_id long, role string, text string, deleted boolean, quality double")
    for ids in (nodes.withColumn("parent_id", F.col("parent_id").cast("int")), nodes.withColumns({c: F.col(c).cast("string") for c in ("message_id", "parent_id")})):
        got = J.tree_paths(ids.repartition(5)).collect()
        assert len(got) == len(want) and {int(r["leaf"]): [int(m["content"]) for m in r["messages"]] for r in got} == want


def test_rounds_of_tree_paths_write_a_few_times_the_table(spark, monkeypatch):
    from chatmill import session

    n, written, write = 1024, {}, session.materialise

    def counted(df, name="stage"):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(session, "materialise", counted)
    nodes = spark.range(n).select(
        F.col("id").alias("message_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("assistant").alias("role"),
        F.lit("t").alias("text"), F.lit(False).alias("deleted"), F.lit(0.0).alias("quality"),
    )
    assert [(r["leaf"], len(r["messages"])) for r in J.tree_paths(nodes).collect()] == [(n - 1, n)]
    assert sum(map(sum, written.values())) < 6 * n, written  # doubled pointers of all nodes alone: 11 n


def test_join_stats_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    assert O.join_stats(df, stats, "k").count() == 3


def test_rank_in_key_and_segmented_lists(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, "a", "a", "a", "b", "c"]), i, rng.randrange(5)) for i in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    want = {}
    for k, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        want.setdefault(k, []).append((v, i))
    got = O.rank_in_key(df, "k", ["v", "i"]).collect()
    assert len(got) == 3000 and all(want[r["k"]][r["rank"]] == (r["v"], r["i"]) for r in got)
    parts = O.segmented_lists(df, "k", ["v", "i"], {"v": F.col("v"), "i": F.col("i")}, 100).collect()
    assert len(parts) == sum(-(-len(x) // 100) for x in want.values())
    for r in parts:
        assert list(zip(r["v"], r["i"])) == want[r["k"]][100 * r["part"] : 100 * r["part"] + 100]
    assert O.segmented_lists(df.limit(0), "k", "i", {"v": F.col("v")}, 10).count() == 0


def test_lists_of_metrics_in_parts(spark):
    df = spark.createDataFrame([("m", 2, [3, 4]), ("m", 1, [1, 2]), ("m", 3, []), ("n", 1, None), ("o", 1, [9])], "key string, step int, v array<int>")
    got = sorted((r["key"], r["part"], r["v"]) for r in RO.merge_metric_lists(df, "key", "step", "v", 3).collect())
    assert got == [("m", 0, [1, 2, 3]), ("m", 1, [4]), ("o", 0, [9])]
