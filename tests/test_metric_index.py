import numpy as np
import pytest

from chatmill.operators import decontam as D
from chatmill.operators import metric_index as M
from chatmill.operators.metric_index import MetricIndex


def cloud(seed, clusters=12, each=40, size=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    v = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(clusters * each, size))
    return v * rng.uniform(0.1, 50, size=(len(v), 1))


def hostile(seed):
    v = [list(map(float, x)) for x in cloud(seed)]
    v += [v[7]] * 150  # copies of one vector
    v += [[0.0] * 8, [0.0] * 8, [1e200] * 8, [1e-200] + [0.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, None, [1.0] * 3, [1.0] * 7 + [None]]
    return list(enumerate(v))


def unit(x):
    if x is None or len(x) != 8 or None in x or not np.isfinite(x).all():
        return None
    x = np.array(x)
    top = np.abs(x).max()
    x = x / top if top else x
    return x / np.linalg.norm(x) if top else x


def brute(train, queries, k):
    t = [(i, unit(x)) for i, x in train if i is not None and unit(x) is not None]
    out = {}
    for i, x in queries:
        if (u := unit(x)) is not None:
            scored = sorted(((-round(float(u @ v), 9), j) for j, v in t))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def rounded(hits, item="item", ids="vec_id"):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r[item], r["rank"])):
        out.setdefault(r[item], []).append((r[ids], round(r["score"], 9)))
    return out


@pytest.mark.parametrize(("block_rows", "query_rows", "pivots"), [(20_000, 20_000, None), (16, 9, 7), (50, 1000, 1)])
def test_search_equals_brute_force(spark, block_rows, query_rows, pivots):
    train, queries = hostile(1), hostile(2)[::5] + [(10_000, [0.0] * 8), (10_001, None), (10_002, [2e200] * 8)]
    index = MetricIndex(spark.createDataFrame([*train, (None, [1.0] * 8)], "vec_id int, embedding array<double>").repartition(3), block_rows=block_rows, query_rows=query_rows, pivots=pivots)
    hits, reads = index.search(spark.createDataFrame(queries, "item int, embedding array<double>"), 4)
    assert rounded(hits) == brute(train, queries, 4)
    assert {r["item"] for r in reads.collect()} == set(brute(train, queries, 4))


def test_far_cells_are_not_read(spark):
    train, queries = list(enumerate(cloud(3, 30, 60).tolist())), list(enumerate(cloud(3, 30, 60)[::9].tolist()))
    index = MetricIndex(spark.createDataFrame(train, "vec_id int, embedding array<double>"))
    hits, reads = index.search(spark.createDataFrame(queries, "item int, embedding array<double>"), 5)
    assert rounded(hits) == brute(train, queries, 5)
    rows = [r["rows_read"] for r in reads.collect()]
    assert len(rows) == len(queries) and np.mean(rows) < len(train) / 10


def test_small_and_empty_sides(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 1.0])], "item int, embedding array<double>")
    assert rounded(MetricIndex(few).search(asked, 5)[0]) == {9: [(1, round(0.5**0.5, 9)), (2, round(0.5**0.5, 9))]}
    assert MetricIndex(few.limit(0)).search(asked, 5)[0].count() == 0
    assert MetricIndex(few).search(asked.limit(0), 5)[0].count() == 0


def test_nearest_uses_the_index_over_the_limit(spark):
    train = spark.createDataFrame(list(enumerate(cloud(4).tolist())), "vec_id int, embedding array<double>")
    queries = spark.createDataFrame(list(enumerate(cloud(5)[::20].tolist())), "item int, embedding array<double>")
    small, large = (rounded(D.nearest(train, queries, 3, half_open=True, broadcast_bytes=n)) for n in (1 << 30, 0))
    assert small == large and len(small) == 24


def test_a_query_is_copied_for_blocks_not_for_rings(spark, monkeypatch):
    rng = np.random.default_rng(6)  # no clusters: the bounds exclude little
    train = list(enumerate(rng.normal(size=(600, 8)).tolist()))
    vectors = spark.createDataFrame(train, "vec_id int, embedding array<double>")
    written = {}
    kept = M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, name: written.setdefault(name, []).append(kept(df, name)) or written[name][-1])
    index = MetricIndex(vectors, block_rows=200)
    hits, reads = index.search(vectors.withColumnRenamed("vec_id", "item"), 5)
    assert rounded(hits) == brute(train, train, 5)
    assert np.mean([r["rings_read"] for r in reads.collect()]) > 2 * sum(index.run_salts)
    assert sum(d.count() for d in written["metric-visits"]) == len(train)  # one row a query
    assert sum(index.run_salts) <= 6


def test_best_of_tile_equals_a_full_sort(monkeypatch):
    monkeypatch.setattr(M, "HEAD", 8)
    monkeypatch.setattr(M, "FEW", 20)
    rng = np.random.default_rng(7)
    t = np.round(rng.normal(size=(90, 3)), 1)
    t[30:] = t[rng.integers(0, 6, 60)]  # many equal vectors
    q, ids, floor = np.round(rng.normal(size=(40, 3)), 1), rng.permutation(90), np.repeat([-9.0, 0.5], 20)
    who, which, score = M.best_of_tile(q @ t.T, floor, q, t, ids, 4)
    for i in range(40):
        exact = (t * q[i]).sum(axis=1)
        want = [j for j in np.lexsort((ids, -exact))[:4] if exact[j] >= floor[i] - 1e-9]
        assert which[who == i].tolist() == want and np.array_equal(score[who == i], exact[want])
    worst = np.array([[3.0, 1.0, 1.0, 0.5, 1.0], [2.0, 2.0, 2.0, 2.0, 2.0]])
    assert M.nearest_rings(worst, 3).tolist() == np.argsort(worst, axis=1, kind="stable")[:, :3].tolist()
