import math
import random

import pytest
from pyspark.sql import functions as F

from chatmill.operators import sketches as K


def values(seed, n=4000):
    rng = random.Random(seed)
    out = [rng.choice([rng.gauss(0, 1e6), rng.expovariate(1e3), float(rng.randrange(300)), -float(rng.randrange(1 << 40)), 0.0]) for _ in range(n)]
    return out + [5e-324, 1.7e308, -1.7e308, 2.0**-1022, 1.0, 2.0, 256.0, 255.0, 257.0, float("inf"), float("-inf")]


@pytest.mark.parametrize("bits", [4, 7])
def test_error_of_values_and_ranks(spark, bits):
    xs = sorted(values(1))
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("nan")]], "x double").repartition(5)
    asked = [0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = K.quantiles(K.cells(df, {"x": F.col("x")}, bits=bits), asked, bits=bits).collect()
    assert len(got) == len(asked)
    for r in got:
        x = xs[max(math.ceil(r["p"] * len(xs)), 1) - 1]
        assert r["n"] == len(xs) and r["rank"] == max(math.ceil(r["p"] * len(xs)), 1) and r["rank_low"] <= r["rank"] <= r["rank_high"]
        a = r["value"]
        assert a == x or (abs(a) <= abs(x) < abs(a) * (1 + 2.0**-bits) and a * x > 0)
        inside = xs[r["rank_low"] - 1 : r["rank_high"]]  # the rank error: these ranks share the answer
        assert all(y == a or abs(a) <= abs(y) <= abs(a) * (1 + 2.0**-bits) for y in inside if math.isfinite(y))


def test_whole_numbers_are_exact(spark):
    df = spark.range(1, 257).select(F.col("id").alias("x"))
    got = K.quantiles(K.cells(df, {"x": F.col("x")}), [i / 256 for i in range(1, 257)]).collect()
    assert all(r["value"] == r["rank"] == r["rank_low"] == r["rank_high"] for r in got) and len(got) == 256


def test_merging_order_does_not_matter(spark):
    parts = [spark.createDataFrame([(f"g{i % 2}", x) for i, x in enumerate(values(s, 600))], "g string, x double") for s in range(4)]
    single = [K.cells(p, {"x": F.col("x")}, ["g"]) for p in parts]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    ask = lambda s: sorted(map(tuple, K.quantiles(s, [0.1, 0.5, 0.9], ["g"]).collect()))
    want = ask(K.cells(whole, {"x": F.col("x")}, ["g"]))
    assert ask(K.merge(single, ["g"])) == ask(K.merge(single[::-1], ["g"])) == want
    left = K.merge([K.merge(single[:2], ["g"]), single[2]], ["g"])
    right = K.merge([single[3], left], ["g"])
    assert ask(right) == want
    packed = K.pack(right, ["g"])
    assert packed.count() == 2 and ask(K.unpack(packed, ["g"])) == want
    assert len(K.quantiles(K.merge(single)).collect()) == 3  # all groups together


def test_summary_and_empty(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = {r["g"]: r for r in K.summary(K.cells(df, {"x": F.col("x")}, ["g"]), ["g"]).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    assert set(got) == set(want)
    for g, w in want.items():
        r, xs = got[g], sorted(x for k, x in rows if k == g)
        assert (r["count"], r["min"], r["max"]) == (w["n"], w["lo"], w["hi"]) and r["mean"] == pytest.approx(w["m"]) and r["std"] == pytest.approx(w["s"])
        assert [r["p25"], r["p50"], r["p75"]] == [xs[math.ceil(p * len(xs)) - 1] for p in (0.25, 0.5, 0.75)]
    assert K.summary(K.cells(df.limit(0), {"x": F.col("x")})).count() == 0
