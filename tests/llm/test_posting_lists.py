"""Posting lists: scores and order exactly, recall against brute force, and the graph."""

import numpy as np
import pytest

from marginkit.llm import posting_lists, queries
from marginkit.llm.centroids import CentroidGraph, balanced_centroids, squared
from helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, data, k=20, every=20, schema=SCHEMA, ratio=posting_lists.RATIO):
    v = posting_lists.vectors(spark.createDataFrame(data, schema))
    found = posting_lists.nearest(v, v.where(v.vec_id % every == 0), k, ratio)
    return v, rows(found, ["query_id", "rank"])


def brute(ids, x, query, k):
    s = (x * x[ids.index(query)]).sum(axis=1)
    order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != query)[:k]
    return [(i, -v) for v, i in order]


def clustered(seed, n, d=24, centres=40, norms=False):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, d))
    x = x / np.linalg.norm(x, axis=1)[:, None]
    if norms:
        x = x * np.exp(rng.normal(size=n) * 1.5)[:, None]
    return x.astype(np.float32)


def test_all_rows_of_a_small_table_are_found_in_order(spark):
    x = clustered(1, 90)
    x[40] = x[3]
    x[41] = x[3]
    data = [(i, [float(v) for v in x[i]], 0) for i in range(90)]
    _, got = run(spark, data)
    ids = list(range(90))
    for q in range(0, 90, 20):
        mine = [r for r in got if r["query_id"] == q]
        want = brute(ids, x.astype(np.float64), q, 20)
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [r["vec_id"] for r in mine] == [i for i, _ in want]
        assert np.allclose([r["score"] for r in mine], [s for _, s in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    x = clustered(2, 6000, norms=norms)
    data = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    v, got = run(spark, data, every=40)
    asked = v.where(v.vec_id % 40 == 0)
    found = spark.createDataFrame([tuple(r.values()) for r in got], "query_id long, rank int, vec_id long, score double")
    assert posting_lists.recall(v, asked, found, 20) >= 0.95
    for r in got[:200]:
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(np.float64) @ x[r["vec_id"]].astype(np.float64)), rel=1e-12)


def test_recall_on_vectors_without_clusters(spark):
    x = np.random.default_rng(3).normal(size=(4000, 64)).astype(np.float32)
    data = [(i, [float(v) for v in x[i] / np.linalg.norm(x[i])], 0) for i in range(len(x))]
    v, got = run(spark, data, every=40)
    found = spark.createDataFrame([tuple(r.values()) for r in got], "query_id long, rank int, vec_id long, score double")
    assert posting_lists.recall(v, v.where(v.vec_id % 40 == 0), found, 20) >= 0.9


def test_copies_of_one_vector_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "BLOCK_ROWS", 16)
    x = clustered(4, 600)
    x[100:400] = x[7]
    data = [(i, [float(v) for v in x[i]], 0) for i in range(600)]
    _, got = run(spark, data, every=20, ratio=9.0)
    ids, wide = list(range(600)), x.astype(np.float64)
    for q in (100, 120, 380, 0, 580):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [i for i, _ in brute(ids, wide, q, 20)]


def test_what_takes_no_part(spark):
    good = [float(v) for v in clustered(5, 1)[0]]
    far = [1e300] * 24
    data = [(0, good, 1), (20, [0.0] * 24, 1), (40, None, 1), (60, [], 1), (80, good[:-1] + [float("nan")], 1), (100, good[:-1] + [float("inf")], 1),
            (120, good[:-1] + [None], 1), (None, good, 1), (140, good[:5], 1), (1, good, 1), (1, good, 2), (2, [-v for v in good], 1), (160, [-0.0] * 23 + [1.0], 1)]
    _, got = run(spark, data)
    assert {r["query_id"] for r in got} == {0, 160}
    assert [r["vec_id"] for r in got if r["query_id"] == 0 and r["score"] > 0.9] == [1]
    assert {r["vec_id"] for r in got if r["query_id"] == 0} == {1, 2, 160}
    assert run(spark, data[:0])[1] == []
    wide = "vec_id long, embedding array<double>, band int, query string, list int"
    got = run(spark, [(0, far, 1, "a", 1), (1, good, 1, "b", 2), (2, [-v for v in far], 1, "c", 3)], schema=wide)[1]
    assert [r["vec_id"] for r in got][0] == 1 or len(got) == 2


def test_graph_finds_the_nearest_centroids():
    x = clustered(6, 5000).astype(np.float32)
    c = balanced_centroids(x, 200)
    assert 150 <= len(c) <= 600
    near = squared(x, c).argmin(axis=1)
    assert np.bincount(near).max() <= 4 * 5000 / 200
    graph = CentroidGraph(c)
    who, far = graph._nearest(x[:700], 32)
    true = np.sort(squared(x[:700], c), axis=1)[:, :32]
    assert (far <= true[:, -1:] + 1e-5).mean() >= 0.99
    r, _ = graph.within(x[:300], 1.5, 4, beam=8)
    d = squared(x[:300], c)
    want = np.maximum((d <= 2.25 * d.min(axis=1)[:, None]).sum(axis=1), 4)
    assert abs(np.bincount(r) - want).mean() <= 0.02 * want.mean()
    assert len(CentroidGraph(c[:1]).within(x[:3], 1.1, 4)[0]) == 3


def test_query(spark):
    df = queries.op13_neighbours(spark, "/root/testdata/sf0.001")
    got = rows(df, ["query_id", "rank"])
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and len(got) == 25 * 20
