import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from chatmill import schema as SC
from chatmill.operators import pack as K
from chatmill.plans import cache, transforms
from chatmill.sources import readers, writers
from chatmill.streaming import rollouts as ST
from chatmill.streaming import rubrics as RB

SCHEMA = "prompt_id string, rollout_id long, reward double, ts timestamp"


def feed(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_groups_across_batches_and_timeout(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, src, "1", [("a", 1, 0.0, at(0)), ("a", 2, 1.0, at(1)), ("b", 3, 0.5, at(1))])
    run = lambda: ST.run_available(ST.assemble_groups(readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), 3, "centered", "5 minutes"), ck, out)
    run()
    assert spark.read.parquet(out).filter("complete").count() == 0 if os.path.exists(out + "/_spark_metadata") else True
    feed(spark, src, "2", [("a", 4, 2.0, at(2)), ("a", 5, 9.0, at(2))])
    run()
    done = spark.read.parquet(out).filter("complete").orderBy("rollout_id").collect()
    assert [(r["rollout_id"], r["advantage"]) for r in done] == [(1, -1.0), (2, 0.0), (4, 1.0)]
    feed(spark, src, "3", [("c", 6, 0.0, at(59))])
    run()
    feed(spark, src, "4", [("c", 7, 0.0, at(59))])
    run()
    late = {(r["prompt_id"], r["rollout_id"]) for r in spark.read.parquet(out).filter("not complete").collect()}
    assert late == {("a", 5), ("b", 3)}


def test_zero_spread_groups_are_dropped(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, src, "1", [("a", 1, 1.0, at(0)), ("a", 2, 1.0, at(0)), ("b", 3, 0.0, at(0)), ("b", 4, 1.0, at(0))])
    s = readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    ST.run_available(ST.assemble_groups(s, 2, drop_zero_std=True), ck, out)
    assert {r["prompt_id"] for r in spark.read.parquet(out).collect()} == {"b"}


def test_salted_groups_hold_one_prompt_each(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    feed(spark, src, "1", [("hot", i, float(i), at(0)) for i in range(60)] + [("b", 100, 0.0, at(0))])
    s = readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
    ST.run_available(ST.assemble_groups(s, 4, salts=3), ck, out)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("prompt_id", "group_no").count().collect()]
    assert set(sizes) == {4} and 60 - 3 * 3 <= sum(sizes) <= 60


GROUPS = "prompt_id string, group_no long, complete boolean, rollout_id long, reward double"


def groups(spark, *rewards, prompt="p", start=0):
    rows = [(prompt, start + 10 * g, True, start + 10 * g + i, float(r)) for g, rs in enumerate(rewards) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, GROUPS)


def test_solved_prompts_are_judged_by_whole_groups(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    s = lambda: ST.assemble_groups(readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), 2)
    for i, rows in enumerate([[("a", 1, 1.0, at(0)), ("b", 2, 1.0, at(0))], [("a", 3, 0.0, at(1)), ("b", 4, 1.0, at(1))], [("c", 5, 1.0, at(2))]]):
        feed(spark, src, str(i), rows)
        ST.run_available(s(), ck, sink=ST.solved_sink(out, 0.9, 1.0))
    assert [r["prompt_id"] for r in spark.read.parquet(out).collect()] == ["b"]


def test_quota_runs_through_batches(spark, tmp_path):
    path = str(tmp_path / "quota")
    sink = ST.quota_sink(path, 3, True)
    sink(groups(spark, (0, 1), (1, 1), (0, 1)), 0)
    second = groups(spark, (0, 1), (0, 1), start=100).unionByName(groups(spark, (0, 1), prompt=None, start=200))
    sink(second, 1)
    sink(second, 1)  # a repeated batch replaces itself
    p = {r["step"]: (r["counted"], r["kept"], r["filtered"], r["full"]) for r in spark.read.parquet(path + "/progress").collect()}
    assert p == {0: (2, 2, 1, False), 1: (5, 5, 1, True)}
    steps = spark.read.parquet(path + "/rollouts").groupBy("train_step").count().collect()
    assert {r["train_step"]: r["count"] for r in steps} == {0: 6, 1: 4}
    every = str(tmp_path / "every")
    ST.quota_sink(every, 3, False)(groups(spark, (0, 1), (1, 1), (0, 1), (0, 1)), 0)
    assert spark.read.parquet(every + "/progress").first()["counted"] == 4


def test_group_numbers_stay_unique_after_a_timeout(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    run = lambda: ST.run_available(ST.assemble_groups(readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), 2, watermark="5 minutes"), ck, out)
    for i, rows in enumerate([[("a", 1, 0.0, at(0)), ("a", 2, 1.0, at(0)), ("a", 3, 1.0, at(0))], [("z", 4, 0.0, at(30))], [("z", 5, 0.0, at(30))], [("a", 6, 0.0, at(31)), ("a", 7, 1.0, at(31))]]):
        feed(spark, src, str(i), rows)
        run()
    sizes = {(r["group_no"], r["complete"]): r["count"] for r in spark.read.parquet(out).filter("prompt_id = 'a'").groupBy("group_no", "complete").count().collect()}
    assert sizes == {(1, True): 2, (3, False): 1, (6, True): 2}


def test_trace_shards_continue(spark, tmp_path):
    path = str(tmp_path / "trace")
    sink = ST.trace_sink(path, "id", 10)
    sink(spark.range(7), 0)
    sink(spark.range(7, 15), 1)
    sink(spark.range(7, 15), 1)  # a repeated batch replaces itself
    got = {r["id"]: r["shard"] for r in spark.read.parquet(path + "/rows").collect()}
    assert got == {i: i // 10 for i in range(15)}


R = f"array<{SC.RUBRIC.simpleString()}>"


def rub(*titles, w=1.0):
    return [{"title": t, "description": "d", "weight": w} for t in titles]


def test_rubric_buffer(spark, tmp_path):
    buf = spark.createDataFrame([("q", rub("a", "b"), [], rub("p")), ("z", rub("k"), [], [])], RB.BUFFER_SCHEMA)
    t = "array<struct<title:string,description:string>>"
    new = spark.createDataFrame(
        [("q", 0, None, None), ("q", 1, [("n", "d")], [("m", "d")]), ("q", 2, [("late", "d")], []), ("other", 0, [("n", "d")], [])], f"query string, position int, positive {t}, negative {t}"
    )
    added = RB.add_rubrics(buf, new)
    row = added.filter("query = 'q'").first()
    assert [(r["title"], r["weight"]) for r in row["active"]] == [("a", 1.0), ("b", 1.0), ("n", 1.0), ("m", -1.0)]
    stats = spark.createDataFrame([("q", "q::a", 0.0), ("q", "q::b", 0.1), ("q", "q::n", 0.5)], "query string, key string, std double")
    out = RB.prune_rubrics(added, stats, 1).filter("query = 'q'").first()
    assert [r["title"] for r in out["active"]] == ["n", "m"] and [r["title"] for r in out["inactive"]] == ["a", "b"]
    answers = new.withColumn("rubrics", F.array(*[F.struct(F.lit("g").alias("title"), F.lit("d").alias("description"), F.lit(1.0).alias("weight"))]))
    g = {(r["query"], r["position"]): ([x["title"] for x in r["rubrics"]], r["rubric_types"]) for r in RB.ground_truth(answers, buf).collect()}
    assert g["q", 1] == (["p", "a", "b"], ["persistent", "evolving", "evolving"])
    assert g["other", 0] == (["g", "n"], ["persistent", "evolving"]) and g["q", 0][0] == ["g"]
    path = str(tmp_path / "buf")
    buf.write.parquet(path + "/v=0")
    batch = new.withColumns({"key": F.when(F.col("position") == 1, F.lit("q::a")), "std": F.lit(0.0)})
    RB.buffer_sink(path, 5)(batch, 0)
    RB.buffer_sink(path, 5)(batch, 0)
    v1 = spark.read.parquet(path + "/v=1").filter("query = 'q'").first()
    assert [r["title"] for r in v1["active"]] == ["b", "n", "m"] and [r["title"] for r in v1["inactive"]] == ["a"]


def test_batch_files(spark, tmp_path):
    ok = {"custom_id": "ts_7_hon_1", "response": {"body": {"choices": [{"finish_reason": "stop", "message": {"role": "assistant", "content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}}}
    blocked = json.loads(json.dumps(ok))
    blocked["response"]["body"]["choices"][0]["finish_reason"] = "content_filter"
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join([json.dumps(ok), "", "{broken", json.dumps(blocked)]))
    r = readers.read_batch_results(spark, str(p))
    assert [tuple(x) for x in r.collect()] == [("7_hon_1", "hi", "stop", 3, 1)]
    assert [tuple(x) for x in readers.read_aspect_outputs(r, {"hon": "honesty"}).collect()] == [("7", "honesty", "hi")]
    d = tmp_path / "many"
    (d / "m___x").mkdir(parents=True)
    (d / "m___x" / "one.jsonl").write_text('{"id": "1", "text": "t", "outputs": [{"text": "o"}]}\n')
    assert readers.read_many_with_tag(spark, str(d), SC.MODEL_OUTPUT, "model", level="folder").first()["model"] == "m/x"
    assert readers.read_many_with_tag(spark, str(d), SC.MODEL_OUTPUT, "aspect").first()["aspect"] == "one"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "e1", 0.5), ("a", "e2", 1.0), ("b", "e1", 0.25)], "t string, e string, s double")
    writers.write_tsv_matrix(df, str(tmp_path / "tsv"), "t", "e", "s", ["e1", "e2"])
    text = next((tmp_path / "tsv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "t\te1\te2" and "a\t0.5000\t1.0000" in text
    writers.write_stats(df, str(tmp_path / "st"), "t", as_text=True)
    assert next((tmp_path / "st").glob("*.txt")).read_text().startswith("t: a, ")
    writers.write_sharded(spark.range(10).withColumn("p", F.lit("x")), str(tmp_path / "sh"), 3, "p")
    assert all(len(f.read_text().splitlines()) <= 3 for f in (tmp_path / "sh" / "p=x").glob("*.json"))
    s = K.token_stream(spark.createDataFrame([(0, [1, 2, 3], [1, -100, 3]), (1, [4, 5], [4, 5])], "i int, input_ids array<int>, labels array<int>"), "i", 2)
    writers.write_chunks(s, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks")).orderBy("chunk", "start").collect()
    assert [(r["chunk"], r["start"], r["end"], r["ids"], r["mask"]) for r in back] == [(0, 0, 2, [1, 2], [1, 0]), (1, 0, 1, [3], [1]), (1, 1, 2, [4], [1]), (2, 0, 1, [5], [1])]


def test_cache_and_mix(spark, tmp_path):
    assert cache.config_hash({"a": 1, "b": None}) == cache.config_hash({"a": 1}) != cache.config_hash({"a": 2})
    msgs = lambda n: spark.range(n).select(
        F.concat(F.lit(f"{n}_"), F.col("id")).alias("id"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("yo "), F.col("id")).alias("content"))).alias("messages"),
    )
    src = {"x": msgs(20), "y": msgs(5)}
    vocab = K.build_vocab(spark.createDataFrame([("hi yo user assistant",)], "t string"), K.tokens(F.col("t")), 10)
    spec = transforms.MixSpec(("x", "0.5", "y", "2.0"), steps=(("encode_chat", {"max_len": 64}), ("max_length", {"input_ids": 64}), ("has_label", {})), keep=("input_ids", "labels"))
    calls = {"encode_chat": {"encode": K.encoder(vocab)}}
    rows, stats = transforms.build_mix(spark, spec, src, calls, root=str(tmp_path / "c"))
    assert sorted(r["index"] for r in rows.collect()) == list(range(20))
    assert set(rows.columns) == {"id", "source", "input_ids", "labels", "copy", "index"}
    assert {r["source"]: (r["final_instances"], r["is_upsampled"]) for r in stats.collect()} == {"x": (10, False), "y": (10, True)}
    again, _ = transforms.build_mix(spark, spec, {}, calls, root=str(tmp_path / "c"))  # sources are not needed any more
    assert again.count() == 20
    part_files = lambda: {f for f in (tmp_path / "c").glob("*/parts/*/data/part-*")}
    before = part_files()
    transforms.build_mix(spark, spec, {k: v.repartition(3) for k, v in src.items()}, calls, root=str(tmp_path / "c"))
    assert part_files() == before  # the same rows in another order are the same data
    changed = {"x": src["x"], "y": src["y"].withColumn("messages", F.reverse("messages"))}
    new, _ = transforms.build_mix(spark, spec, changed, calls, root=str(tmp_path / "c"))
    built = {f.parts[-3] for f in part_files() - before}
    assert len(built) == 1 and before <= part_files() and new.count() == 20  # only the part of the changed source
    both, _ = transforms.build_mix(spark, spec, changed, calls)
    order = lambda df: sorted((r["index"], r["id"], r["source"], r["copy"], r["input_ids"]) for r in df.collect())
    assert order(new) == order(both) == order(transforms.build_mix(spark, spec, {}, calls, root=str(tmp_path / "c"))[0]) != order(rows)
    m = spark.createDataFrame([({"a": 1, "b": 2}, 1), (None, 2), (None, 2)], "m map<string,int>, v int")
    assert cache.fingerprint(m) == cache.fingerprint(m.repartition(2)) != cache.fingerprint(m.limit(2))
    with pytest.raises(ValueError, match="unknown transform"):
        transforms.apply_transforms(src["x"], [("nope", {})])
    with pytest.raises(ValueError, match="no rows"):
        transforms.apply_transforms(K.encode_chat(src["x"], K.encoder(vocab)), [("max_length", {"input_ids": 1})])


def test_fixed_checkpoint_dir(spark):
    from chatmill.session import CHECKPOINT_CONF, materialise, shared_dir

    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_CONF)
    m = materialise(spark.range(5))
    assert m.count() == 5 and all(shared_dir(spark) in f for f in m.inputFiles())


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from chatmill.catalog import queries

    for kind, files in (("one", 1), ("many", 3)):
        d = tmp_path / kind
        d.mkdir()
        docs = spark.createDataFrame([(i, 500 * i) for i in range(9)], "doc_id long, n_chars long")
        docs.repartition(files).write.parquet(f"{d}/documents.parquet" if files > 1 else f"{d}/written")
        if files == 1:
            next((d / "written").glob("part-*.parquet")).rename(d / "documents.parquet")
        got = queries()["stream_length_filter"](spark, str(d)).collect()
        assert sorted((r["doc_id"], r["n_chars"]) for r in got) == [(i, 500 * i) for i in range(5)]


def test_a_call_of_the_stream_serves_many_prompts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    s = lambda: ST.assemble_groups(readers.read_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), 3, "centered", buckets=2)
    rows = [(None if p == 7 else f"p{p}", 100 * p + i, float(i * i), at(i)) for p in range(40) for i in range(5)]
    for part in (rows[::2], rows[1::2]):
        feed(spark, src, "", part)
        ST.run_available(s(), ck, out)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault((r["prompt_id"], r["group_no"]), []).append(r)
    assert len(got) == 40 and {k[0] for k in got} == {r[0] for r in rows}
    for group in got.values():
        mean = sum(r["reward"] for r in group) / 3
        assert len({r["rollout_id"] for r in group}) == 3 and all(r["complete"] and abs(r["advantage"] - r["reward"] + mean) < 1e-9 for r in group)
    states = spark.read.format("statestore").load(ck).collect()
    assert len(states) == 2 and sum(ST._unpacked(r["value"]["groupState"]["waiting"]).shape[0] for r in states) == 80
