"""Importance resampling, secret scan and tokenizer alignment against brute force, on small hostile tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatmill.llm import alignment, importance, secrets, token_spans, trigrams

DOCS = "doc_id long, text string, score long, rank long, secrets string, n_a long, words long, _row long"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1, 2, "x", 3, 4, 5) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


# -- importance resampling ------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_importance(rows, target, n, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in runs(x, n)) for texts in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in runs(x, n))
        out.append((i, len(runs(x, n)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def hostile_texts():
    rng = random.Random(3)
    long = prose(rng, 4000)
    return [None, "", "   ", "One", "É é É", "word " * 30, "x" * 3000, long, "K" * 200 + " kk " + "é" * 90] + [prose(rng, rng.randrange(1, 90)) for _ in range(40)] + ["same text here"] * 5


@pytest.mark.parametrize("n", [1, 2, 3])
def test_importance_scores(spark, n):
    texts, rng = hostile_texts(), random.Random(5)
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(texts))]
    target = [prose(rng, 50, 60), None, "w1 w2 w3"]
    got = importance.score(table(spark, texts, ids), table(spark, target), n, 500, names=("f", "weight", "noisy")).select("doc_id", "f", "weight", "noisy").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_importance(list(zip(ids, texts)), target, n, 500))
    words = importance.score(table(spark, texts), table(spark, target), n, 500, names=("f", "weight", "noisy")).select("doc_id", importance.word_count(F.col("f"), n).alias("w")).collect()
    assert {r[0]: r[1] for r in words} == {i: len(words_of(t)) for i, t in enumerate(texts)}


def test_importance_draw(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(8)]), rng.randrange(3), rng.randrange(-3, 3)) for _ in range(500)] + [(7, 2, 2)] * 300  # many ties, one hot row
    df = spark.createDataFrame(rows, "doc_id long, n_features long, score long").repartition(7)
    for share, least in (((10, 100), 0), ((40, 100), 1), ((100, 100), 2), ((1, 100000), 0), ((10, 100), 9)):
        fit = [r for r in rows if r[1] >= least]
        key = lambda r: (-r[2], r[0] is None, r[0] or 0, r[1])
        want = [(*r, k + 1) for k, r in enumerate(sorted(fit, key=key)[: share[0] * len(fit) // share[1]])]
        got = importance.draw(df, share, least, names=("n_features", "n_features", "score", "rank")).collect()
        assert len(got) == len(rows)
        drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [(r["doc_id"], r["n_features"], r["score"], r["rank"]) for r in drawn] == want


def test_importance_draws_like_the_target(spark):
    rng = random.Random(1)
    texts = [prose(rng, 40, 30) if i % 4 == 0 else " ".join(f"z{rng.randrange(30)}" for _ in range(40)) for i in range(400)]
    docs, target = table(spark, texts), table(spark, [prose(rng, 200, 30)])
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns
    rows = drawn.collect()
    assert len(rows) == 40 and all(r["doc_id"] % 4 == 0 for r in rows)
    assert importance.resample(table(spark, [None, "", "a b"]), target).count() == 0
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == 40


def test_crc_matches_zlib():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 300)
    lens = rng.integers(0, 200, 300)
    crc = importance.crc_on(np.zeros(300, dtype=np.uint32), data, starts, lens)
    assert crc.tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lens)]


# -- secrets --------------------------------------------------------------------------------------------------------------


def brute_spans(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, r.kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def secret_texts():
    rng = random.Random(4)
    parts = [
        "password=abc", "PassWord: 'abcdef", 'api_key = "x1234567"', "APIKEY:=aaaaaa", "token=token=abcdef", "secret   :   ====", "tokens=abcdef", "passwd=é12345",
        "AKIA" + "A" * 15, "AKIA" + "B7" * 8, "AKIAAKIA" + "C" * 13, "a" * 23, "a" * 24, "0123456789abcdef" * 2, "DEADBEEF" * 4, "ghp_" + "a" * 36, "ghx_" + "a" * 36,
        "xoxb-1234567890-ab", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "https://me:pw@host/x", "éé", "日本", "Key",
    ]
    texts = [None, "", " ", "toke", "n=abcdef", "A" * 9000 + "password=zzzzzz", "eyJ" * 3000, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " token=abcdefg"]
    return texts + parts + [rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(150)]


def test_secrets(spark):
    texts = secret_texts()
    texts += texts[5:9]
    docs = table(spark, texts)
    found = secrets.find(docs)
    assert found.columns == [*docs.columns, "_secrets"]  # the name was taken
    got = {r["doc_id"]: [tuple(s) for s in r["_secrets"]] for r in found.collect()}
    assert got == {i: brute_spans(t, secrets.RULES) for i, t in enumerate(texts)}
    assert secrets.find(docs.limit(0)).count() == 0
    kinds = {k for s in got.values() for k, _, _ in s}
    assert kinds == {r.kind for r in secrets.RULES}


def test_mask(spark):
    def brute(text):
        chars = list(text or "")
        for _, a, b in brute_spans(text, secrets.RULES):
            chars[a:b] = "*" * (b - a)
        return None if text is None else "".join(chars)

    texts = secret_texts()
    docs = table(spark, texts)
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_trigram_queries_lose_nothing():
    rng = random.Random(8)
    patterns = ["abc", "ab?c+d", "(foo|bar)baz", "[ab]{2}cd", "x(yz){2,}", "(?i:HeLLo)", "a.c", "abc|", "(?:ab|cd)(?:ef|gh)?ij", "^abc$", "[^a]bcd", r"\dabc", "a{3}b{0,2}ccc", "(a|b|c)(d|e)(f|g)", "é+abc", "(?=abc)abcd", "ab{2,3}c"]
    assert trigrams.query_of("[0-9a-f]{24,}") is True and trigrams.query_of("ab") is True
    assert trigrams.query_of("AKIA[A-Z0-9]+") == ("and", frozenset({b"aki", b"kia"}))
    texts = ["".join(rng.choice("abcdefghijxyzHhEeLlOof1é") for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += ["foobaz", "barbaz", "xyzyz", "hello", "HELLO", "abefij", "cdij", "aaabbccc", "éabc", "abbbc", "abcd", "1abc"]
    data, offsets = token_blocks(texts)
    queries = [trigrams.query_of(p) for p in patterns]
    posts = trigrams.Vocabulary(queries).postings(data, offsets)
    for p, q in zip(patterns, queries):
        chosen = set(trigrams.candidates(q, posts, len(texts)).tolist())
        hits = {i for i, t in enumerate(texts) if re.search(p, t, re.ASCII)}
        assert hits <= chosen, p
        assert q is True or len(chosen) < len(texts) / 2, p


def token_blocks(texts):
    from chatmill.llm.common import LOWER, blocks

    ((_, _, data, offsets),) = blocks(pa.array(texts), 1 << 30)
    return LOWER[data], offsets


# -- tokenizer alignment --------------------------------------------------------------------------------------------------

FILES = [f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"]
needs_files = pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="no vocabulary files")


def whole(pair, text):
    """Tokens of the whole text and their byte ends, from decoded bytes only."""
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    want = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
        return None
    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    groups, links, i, j = [], [], 0, 0
    for c in sorted(set(ea) & set(eb)):
        k, m = ea.index(c) + 1, eb.index(c) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        links.append((a[k - 1], b[m - 1]))
        i, j = k, m
    return len(a), len(b), groups, links


def brute_alignment(pair, texts):
    made = [whole(pair, t) if t else None for t in texts]
    count = collections.Counter(x for d in made if d for x in d[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest(), ";".join(d[2]))
        if d else (0, 0, 0, 0, 0, 0, "", "")
        for d in made
    ]


def token_texts():
    rng = random.Random(2)
    signs = ["a", "é", "日", "☃", "\U0001f600", "\U00013000", "\U00013001", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "▁", "\x00", "\x1c", "́", "ﬁ", ".", ",", "!?", "'s", "'", "1", "42", "<s>", "<|endoftext|>", "<0x0A>", "·", "÷.", "é.", "ж.", "日.", "_.", "x.y", "don't", "foo", "Bar", "...", "_", "é."]
    texts = [None, "", " ", "\n", ".", " .", "a", "é", "▁", "x▁y", "<|endoftext|>", "  lead", "trail  ", "a  b", "a \n b", "a\n\nb", "x" * 5000, "ab " * 900, "\U00013000" * 30, "日本語 テキスト" * 40]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return texts + [" ".join(rng.choice(["foo", "bar.", "é,", "the", "Über!", "naïve"]) for _ in range(300)) for _ in range(5)]


@needs_files
@pytest.mark.parametrize("heavy", [500_000, 40])
def test_alignment(spark, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)  # with few pairs called heavy, most go through the join
    pair = token_spans.tokenizer_pair(*alignment.read_files(*FILES))
    texts = token_texts()
    texts += texts[15:40]
    got = alignment.align(table(spark, texts), with_groups=True)
    assert "_n_a" in got.columns and "n_a" in got.columns  # the name was taken
    got = {r["doc_id"]: (r["_n_a"], *[r[c] for c in alignment.NUMBERS[1:]], r["groups"]) for r in got.collect()}
    want = dict(enumerate(brute_alignment(pair, texts)))
    assert [(texts[i], got[i], want[i]) for i in want if got[i] != want[i]][:1] == [] and len(got) == len(want)
    assert alignment.align(table(spark, texts).limit(0)).count() == 0


@needs_files
def test_alignment_cuts_long_texts(monkeypatch):
    pair = token_spans.tokenizer_pair(*alignment.read_files(*FILES))
    monkeypatch.setattr(token_spans, "BLOCK_BYTES", 64)
    texts = [t for t in token_texts() if t]
    for t in texts:
        parts = list(pair.segments(t.encode()))
        assert b"".join(parts) == (" " + t).encode()
    rows: dict = {}
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    for block in alignment._blocks(pair, [t.encode() for t in texts]):
        alignment._align_block(pair, block, rows, True)
    for i, t in enumerate(texts):
        d = whole(pair, t)
        assert rows[i].fits == (d is not None)
        if d:
            assert b"".join(rows[i].groups).decode() == ";".join(d[2]) and (rows[i].n_a, rows[i].n_b) == d[:2]


@needs_files
@pytest.mark.parametrize(("mask", "limit"), [(3, 100), (~0, 6), (63, 6)])
def test_chunks_are_told_apart_by_bytes(monkeypatch, mask, limit):
    """Hashes that collide inside a block, and with stored chunks, of which few are kept."""
    pair = token_spans.TokenizerPair(*alignment.read_files(*FILES))
    pair.store = token_spans.ChunkStore(limit)
    mix = token_spans.mix64
    monkeypatch.setattr(token_spans, "mix64", lambda x: mix(x) & np.uint64(mask & (2**64 - 1)))
    rng = random.Random(mask & 255)
    for _ in range(30):
        texts = [" ".join(rng.choice(["a", "bb", "cat", "dog.", "é", "xyzzy", "Hello"]) for _ in range(rng.randrange(1, 5))) for _ in range(2)]
        found, number, part = pair.distinct([(" " + t).encode() for t in texts])
        for k, t in enumerate(texts):
            mine = [found.take(np.array([i])) for i in number[part == k]]
            assert ";".join(m.groups.tobytes().decode() for m in mine) == ";".join(whole(pair, t)[2])
            assert (sum(int(m.n_a[0]) for m in mine), sum(int(m.n_b[0]) for m in mine)) == whole(pair, t)[:2]
            assert [(x // pair.b_size, x % pair.b_size) for m in mine for x in m.links.tolist()] == whole(pair, t)[3]
        assert len(pair.store.hashes) <= limit + 10
