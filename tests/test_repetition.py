import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatmill.operators import repetition as R


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_equal_runs_equal_brute_force(n, monkeypatch):
    for mask in (None, 7):  # also with hashes that collide
        if mask:
            mix = R.mix64
            monkeypatch.setattr(R, "mix64", lambda x, mix=mix: mix(x) & np.uint64(7))
        rng = random.Random(n)
        rows = np.sort(np.array([rng.randrange(6) for _ in range(160)]))
        codes = np.array([rng.randrange(2) for _ in rows])
        places, cuts = R.equal_runs(codes, rows, n)
        want = {}
        for i in range(len(rows) - n + 1):
            if rows[i] == rows[i + n - 1]:
                want.setdefault((rows[i], tuple(codes[i : i + n])), []).append(i)
        got = [places[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert sorted(got) == sorted(want.values())
    none = np.zeros(0, dtype=np.int64)
    assert len(R.equal_runs(none, none, n)[0]) == 0


def test_ngrams_of_long_and_hostile_texts(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(["a", "b", "C", "d"]) for _ in range(20_000))
    texts = [None, "", "one", "x x x x", long, "É é É é É é", "a b c a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "q q q q")], "id int, text string")
    got = {}
    for r in R.repeated_ngrams(df, "id", F.col("text"), 3, 2).collect():
        got.setdefault(r["id"], {})[r["ngram"]] = r["positions"]
        assert r["occurrences"] == len(r["positions"]) and r["first"] == r["positions"][0]
    for i, t in [*enumerate(texts), (None, "q q q q")]:
        w, want = (t or "").lower().split(), {}
        for k in range(len(w) - 2):
            want.setdefault(" ".join(w[k : k + 3]), []).append(k)
        assert got.get(i, {}) == {g: p for g, p in want.items() if len(p) > 1}


def test_a_batch_is_read_in_slices_of_bounded_words(spark, monkeypatch):
    assert list(R.row_slices(np.array([7, 7, 9, 12, 40, 41, 42]), 5)) == [(0, 3), (3, 4), (4, 6)]
    assert list(R.row_slices(np.array([0]), 5)) == []
    df = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(60)], "id int, text string").coalesce(1)
    rows = lambda: sorted(map(str, R.repeated_ngrams(df, "id", F.col("text"), 3, 2).collect()))
    whole, seen = rows(), []
    assert len(whole) == sum(1 if i % 7 == 2 else 3 for i in range(60) if i % 7 > 1)
    equal_runs = R.equal_runs
    monkeypatch.setattr(R, "SLICE_WORDS", 20)
    monkeypatch.setattr(R, "equal_runs", lambda codes, r, n: equal_runs(codes, r, n) if len(codes) <= 20 else 1 / 0)
    assert rows() == whole
