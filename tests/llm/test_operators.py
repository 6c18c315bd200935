"""The dealt operators against brute force, on a small table with nulls, ties, copies, long texts and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatmill.llm import binary_codes, decontamination, mixing, near_duplicates, quality, sentence_spans, sharding, suffix_buckets, toxicity, url_reputation
from chatmill.llm.url_reputation import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def hostile():
    rng = random.Random(7)
    base, shared = prose(rng, 120), prose(rng, 60, 10**6)
    texts = [None, "", "   \n", "One", "one", "É é", base, base, base.upper(), "x" * 5000, "ab " * 3000]
    for _ in range(12):
        words = base.split()
        for i in rng.sample(range(len(words)), rng.randrange(1, 12)):
            words[i] = f"z{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [prose(rng, 30) + " " + shared + ". " + prose(rng, 30) for _ in range(4)] + [prose(rng, rng.randrange(1, 80)) for _ in range(20)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1, 2, 0.5, 9) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[6], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("size", [2])
def test_near_duplicates(spark, docs, empty, size):
    assert near_duplicates.components_of(empty, size).count() == 0
    nodes = sorted({(r[0], r[1]) for r in hostile() if r[0] is not None}, key=lambda r: r[0])
    sets = []
    for _, t in nodes:
        w = words_of(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    group = list(range(len(nodes)))
    for a, b in itertools.combinations(range(len(nodes)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    want = {d: (len(sets[i]), nodes[group[i]][0]) for i, (d, _) in enumerate(nodes)}
    rows = near_duplicates.components_of(docs, size).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_repeated_substrings(spark, docs, empty):
    assert suffix_buckets.remove_repeats(empty).count() == 0
    rows = sorted(((r[0] if r[0] is not None else 1 << 62, (r[1] or "").encode()) for r in hostile()), key=lambda r: (r[0], r[1]))
    rows[-2:] = sorted(rows[-2:], key=lambda r: r[1])
    got = suffix_buckets.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    known = [r for r in rows if r[0] != 1 << 62]
    seen, want = set(), []
    for d, raw in known:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    assert sorted(tuple(r)[:5] + (bytes(r["kept"]),) for r in got if r["doc_id"] is not None) == sorted(want)


def test_minimal_differences_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 999, dtype=np.uint64))
    assert (suffix_buckets.unpack(suffix_buckets.pack(keys)) == keys).all()
    counts = np.array([1, 5, 1, 1, 9])
    assert (suffix_buckets.unpack_counts(suffix_buckets.pack_counts(counts), 5) == counts).all()


def test_sentence_spans(spark, docs, empty):
    assert sentence_spans.remove(empty).count() == 0
    rows = {r["doc_id"]: r for r in sentence_spans.remove(docs).collect() if r["doc_id"] is not None}
    assert sentence_spans.remove(docs).count() == docs.count()
    assert rows[7]["n_removed"] == rows[7]["n_sentences"] > 0 and rows[7]["kept_text"] == "" and rows[8]["n_removed"] == rows[8]["n_sentences"]
    assert rows[6]["n_removed"] == 0 and rows[6]["kept_text"] == rows[6]["text"] and rows[0]["kept_text"] is None
    a = "Here is one long sentence of eight plain words. Another sentence follows it with some more words! "
    two = spark.createDataFrame([(1, "Start.\n" + a + "Own end."), (2, "Other start. " + a + "Tail.")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in sentence_spans.remove(two).collect()}
    assert got == {1: "Start.\n" + a + "Own end.", 2: "Other start. Tail."}


def brute_spans(texts, run=2, least=8, alone=25):
    """Sentences of each text and which of them stay, run by run over word lists."""
    split = [[words_of(x) for x in re.split(r"\n|(?<=[.!?])[\x20\x09-\x0D]+", lower(t)) if words_of(x)] for t in texts]
    seen, stay = {}, []
    for d, sents in enumerate(split):
        every = {(i, j) for i in range(len(sents)) for j in range(i + 1, len(sents) + 1)}
        enough = lambda i, j: j - i >= run and sum(map(len, sents[i:j])) >= least
        cuts = {(i, j) for i, j in every if enough(i, j) and (not enough(i, j - 1) or not enough(i + 1, j))}
        cuts |= {(i, i + 1) for i, s in enumerate(sents) if len(s) >= alone}
        if sents and not enough(0, len(sents)):
            cuts.add((0, len(sents)))
        gone = set()
        for i, j in sorted(cuts):
            if seen.setdefault(tuple(map(tuple, sents[i:j])), (d, i)) != (d, i):
                gone.update(range(i, j))
        stay.append([i not in gone for i in range(len(sents))])
    return split, stay


def test_sentence_spans_of_any_length(spark):
    rng = random.Random(3)
    long = " ".join(f"l{i}" for i in range(40))
    one, short = " ".join(f"s{i}" for i in range(12)), "Two words. Yes."
    single = "".join(f"q{i}.\n" for i in range(160))
    copied = [long, one, "One", short, single, "Only seven words are in here. Now.", "a. b. " * 30, "same line\n" * 9]
    texts = copied + ["Head.\n" + long + "\nTail.", "x y. " + single + "z.", "Go. " + "".join(f"q{i}. " for i in range(20, 27)) + "End.", "Other. Yes."]
    texts += [" ".join(f"w{rng.randrange(3)}" + rng.choice([".", "", "", "!"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + copied
    rows = sentence_spans.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    split, stay = brute_spans(texts)
    for r, sents, left in zip(rows, split, stay, strict=True):
        assert (r["n_sentences"], r["n_removed"]) == (len(sents), left.count(False)), r
        assert r["n_removed_words"] == sum(len(s) for s, k in zip(sents, left, strict=True) if not k)
        assert words_of(lower(r["kept_text"])) == [w for s, k in zip(sents, left, strict=True) if k for w in s]
    assert all(r["kept_text"] == "" for r in rows[-len(copied) :])
    assert rows[8]["kept_text"].split() == ["Head.", "Tail."] and rows[9]["kept_text"].split() == ["x", "y.", "z."]


def test_decontamination(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    base = hostile()[6][1]
    items = [(1, base[40:300]), (2, None), (3, "!!"), (4, "One"), (5, base[40:300]), (10, "é"), (None, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.find_hits(empty, bench).count() == 0
    clean = decontamination.digest(decontamination.find_hits(docs, bench.limit(0)), "n_words", "spans", "items")
    assert clean.filter("contaminated or n_hit > 0").count() == 0
    rows = decontamination.digest(decontamination.find_hits(docs, bench), "n_words", "spans", "items").collect()
    assert len(rows) == docs.count()
    for r in rows:
        w, hit, found = words(r["text"]), set(), set()
        for name, text in items:
            x = words(text)
            for win in {tuple(x[i : i + 13]) for i in range(max(len(x) - 12, min(len(x), 1)))}:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        found.add(str(name))
        found.discard("None")
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(found), decontamination.hashed_items(list(found)))
        assert r["contaminated"] == bool(hit and 20 * len(hit) >= len(w))
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_mixing(spark, docs, empty):
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count() and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken(docs).collect()), key=str)
    total, goals = {}, {}
    for r in rows:
        assert r["size"] == len(words_of(next(x[1] for x in hostile() if x[0] == r["doc_id"]))) or r["doc_id"] is None
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        goals[r["source"]] = (r["target"], r["source_size"])
    assert abs(sum(t for t, _ in goals.values()) - 1.5 * sum(s for _, s in goals.values())) < 1e-6
    for source, (target, size) in goals.items():
        largest = max(r["size"] for r in rows if r["source"] == source)
        assert target <= 2 * size and abs(total[source] - target) <= 2 * largest
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_targets_by_water_filling():
    from fractions import Fraction

    assert mixing.share_out([100, 100, 10], [3, 1, 2], Fraction(3, 2), Fraction(2)) == [Fraction(200), Fraction(95), Fraction(20)]
    assert mixing.share_out([0, 0], [3, 1], Fraction(3, 2), Fraction(2)) == [0, 0]


def test_sharding(spark, docs, empty):
    assert sharding.shard(empty, 4).count() == 0
    rows = sharding.shard(docs.withColumn("slot", F.lit("kept")), 7, names=("to", "at")).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["to"], []).append(r["at"])
    assert len(rows) == docs.count() and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    matrix = sharding.communication_matrix([5, 0, 11], [6, 5, 5], 1)
    assert matrix.sum(axis=1).tolist() == [5, 0, 11] and matrix.sum(axis=0).tolist() == [6, 5, 5]
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 10**12, 3 * 10**12, 1000) for _ in range(300)]
    assert 245 < np.mean(draws) < 255


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 24)).astype(np.float32)
    v[7], v[9] = v[8], 0
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(500, None), (501, [1.0] * 3), (502, [float("nan")] * 24), (503, [None] * 24), (None, [1.0] * 24), (550, [2.0] * 3), (504, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert binary_codes.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    got = {}
    for r in binary_codes.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [x[1] for x in sorted(got[550])] == [501, 504]
    u = v.astype(np.float64)
    n = np.sqrt((u * u).sum(axis=1))
    hits = 0
    for q in range(0, 400, 50):
        score = (u * u[q]).sum(axis=1) / np.where(n > 0, n * n[q], 1)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i not in (q, 9)][:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(order))
    assert hits >= 0.9 * 40


def test_url_reputation(spark):
    rules = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block")]
    rows = [(1, "https://WWW.Example.com/en/x?y", None), (2, "http://a.example.com/en/#z", None), (3, "http://notexample.com/en/", None), (4, "http://net/es/1", 0), (5, None, None), (6, "no scheme", 1), (7, "http://com", None), (8, "x://h.net?q=/es/", None), (9, "http://a.b://c.net/es/", None)]
    rows += [(100 + i, f"http://bad.org/{i}", 1) for i in range(60)] + [(200 + i, f"http://fine.org/{i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, outcome int").withColumn("mean", F.lit("own"))
    got = {r["page_id"]: r for r in url_reputation.judge(df, rules, "outcome").collect()}
    assert len(got) == len(rows) and got[1]["mean"] == "own"
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 10)] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("notexample.com", "/en/", "com/"), ("net", "/es/1", "net/es/"), ("", "", None), ("", "", None),
        ("com", "", None), ("h.net", "", None), ("a.b:", "//c.net/es/", None),
    ]
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "block" and got[100]["verdict"] == "block" and got[200]["verdict"] == "allow"
    assert url_reputation.judge(df.limit(0), rules, "outcome").count() == 0


def labelled(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        w = prose(rng, rng.randrange(20, 120)).split()
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["vileness", "vilest", "rotten"])
        rows.append((i, " ".join(f"{x}###" for x in w) if poor else " ".join(w), "en", "s", 1, 2, 0.5, 9))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_classifiers_on_held_out_rows(spark, docs, empty):
    rows, labels = labelled()
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    train = marks.filter("doc_id % 3 <> 1")
    truth = {d: (q, t) for d, q, t in labels}
    model = toxicity.fit(df, train, "toxic")
    got = toxicity.score(df, model, names=("p", "passages")).select("doc_id", "p", "passages", "text").collect()
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert sum((r["p"] >= 0.7) == truth[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    marked = next(r for r in got if r["passages"])
    assert re.search("vil|rotten", marked["text"].encode()[marked["passages"][0]["start"] : marked["passages"][0]["end"]].decode())
    scores = toxicity.score(docs, model, names=("p", "passages")).collect()
    assert len(scores) == docs.count() and all(0 <= r["p"] <= 1 for r in scores)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(empty, marks.limit(0), "toxic"), names=("p", "q")).filter("p > 0.01").count() == 0
    good = quality.fit(df, train, "quality")
    got = quality.score(df, good, name="p").select("doc_id", "p").collect()
    held = [r for r in got if r["doc_id"] % 3 == 1]
    assert sum((r["p"] >= 0.7) == truth[r["doc_id"]][0] for r in held) >= 0.97 * len(held)
    assert quality.score(docs, good, name="p").filter("p between 0 and 1").count() == docs.count()


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    weights = np.random.default_rng(1).normal(size=1 << quality.BUCKET_BITS)
    texts = ["spam", "spam", None, "spam", "more spam", "spam spam", "", "spam"]
    together = quality.SubwordModel(weights, 0.1).score(pa.array(texts))
    alone = [quality.SubwordModel(weights, 0.1).score(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(together, alone, rtol=0, atol=1e-12) and together[5] != together[0]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 14)
        scores = [round(rng.uniform(-2, 2), 3) for _ in range(n)]
        got = {(a, b) for a, b, _ in toxicity.maximal_segments(list(range(n)), scores, 0.1)}
        values, want = [s - 0.1 for s in scores], set()

        def search(a, b):
            """The best segment, then the same on either side of it: the definition of all maximal scoring segments."""
            best = max(((sum(values[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0, 0))
            if best[0] > 0:
                want.add((best[3], best[4]))
                search(a, best[3])
                search(best[4], b)

        search(0, n)
        assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        last, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept, ids = [r["doc_id"] for r in docs.select("doc_id").collect()], {r["doc_id"] for r in last.select("doc_id").collect()}
        assert set(kept) <= ids and (name in ("mixing", "sharding") or len(kept) == len(set(kept)) > 0.5 * len(ids))
    assert docs.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert zlib.crc32(b"7") % 3 == spark.sql("select crc32(cast('7' as binary)) % 3 as x").first()["x"]


def test_nearest_of_huge_numbers_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((120, 6))
    rows = [(i % 60, [float(x) for x in v[i] * s]) for i, s in zip(range(120), [1e200, 1e-200, 1.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = binary_codes.nearest(df, F.col("vec_id") % 20 == 0, 3).collect()
    u = v / np.sqrt((v * v).sum(axis=1))[:, None]
    want = []
    for q in (i for i in range(120) if i % 60 % 20 == 0):
        order = sorted((-(u[q] @ u[j]), j % 60) for j in range(120) if j != q)[:3]
        want += [(q % 60, k + 1, j, round(-s, 12)) for k, (s, j) in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got) == sorted(want) and len(got) == 18


def test_dropping_near_duplicates_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60, 10**6), prose(rng, 60, 10**6)
    near = a.replace(a.split()[30], "zz")
    rows = [(1, a), (1, b), (1, a), (2, near), (3, b.upper()), (4, None), (4, None), (4, ""), (None, a), (None, a), (5, "own text"), (6, b), (6, prose(rng, 50, 10**6))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 0.5, 9) for i, t in rows], DOCS).repartition(4)
    got = near_duplicates.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert left == sorted([(1, a), (1, b), (4, None), (4, None), (4, ""), (None, a), (None, a), (5, "own text"), rows[-1]], key=str)
    assert near_duplicates.drop_near_duplicates(docs.limit(0)).count() == 0


def test_mixing_deals_repeated_rows(spark):
    rows = [(i, f"t{i} x", "big") for i in range(600)] + [(None, f"n{i} x", "big") for i in range(300)] + [(7, "t7 x", "big")] * 100 + [(10_000 + i, "y z", "other") for i in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 2, 0.5, 9) for i, t, s in rows], DOCS).repartition(5)
    got = mixing.taken(docs).collect()
    target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(rows)
    for source in target:
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target[source]) <= 2
    out = mixing.mix(docs).collect()
    words = lambda s: sum(len(r["text"].split()) for r in out if r["source"] == s)
    assert {s: words(s) for s in target} == {s: sum(r["taken"] for r in got if r["source"] == s) for s in target}
    times = {}
    for r in out:
        if r["doc_id"] is None:
            times[r["text"]] = times.get(r["text"], 0) + 1
    assert max(times.values()) <= 2 and max(times.values()) - min([times.get(f"n{i} x", 0) for i in range(300)]) <= 1


def test_clashing_names(spark, docs):
    clash = docs.withColumns({c: F.lit("own") for c in ("passages", "n_words", "spans", "items", "n_hit", "items_sha256", "kept_text", "n_removed", "_rep_host", "_row", "_n", "_copies")})
    rows, labels = labelled(200)
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    outs = [
        toxicity.score(clash, toxicity.fit(df, marks, "toxic")), quality.score(clash, quality.fit(df, marks, "quality")), sentence_spans.remove(clash), mixing.mix(clash),
        decontamination.digest(decontamination.find_hits(clash, bench), "_n_words", "_spans", "_items"), url_reputation.judge(clash.withColumnsRenamed({"text": "url", "size": "outcome"}), [], "outcome"),
        near_duplicates.drop_near_duplicates(clash),
    ]
    for out in outs:
        assert len(set(out.columns)) == len(out.columns) and all(r["passages"] == r["_copies"] == "own" for r in out.collect())


def test_samples_hold_one_row_for_each_id(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(500)], "doc_id long, text string")
    from chatmill.llm.common import one_text_each

    assert one_text_each(docs.withColumn("label", F.col("doc_id") % 2), "text").count() == 10
