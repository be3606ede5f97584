"""The pivot index: exact on awkward data, and cells and blocks that are skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbors


def frame(spark, pts, at=0, label=True):
    rows = [(at + i, [float(x) for x in p], i % 2) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "key BIGINT, vec ARRAY<DOUBLE>, label INT")
    return df if label else df.drop("label")


def brute(train, queries, k, metric, p=2.0):
    D = neighbors._np_dist(metric, p, np.asarray(queries, float), np.asarray(train, float))
    return [sorted((round(d, 9), i) for i, d in enumerate(row))[:k] for row in D]


def found(df, n, at):
    out = [[] for _ in range(n)]
    for r in sorted(df.collect(), key=lambda r: (r["q_key"], r["rank"])):
        out[r["q_key"] - at].append((round(r["distance"], 9), r["n_key"]))
    return out


@pytest.mark.parametrize("metric,p", [("euclidean", 2.0), ("cosine", 2.0), ("minkowski", 3.0), ("minkowski", 0.5), ("manhattan", 2.0), ("chebyshev", 2.0)])
def test_many_cells_and_a_hot_cell(spark, metric, p):
    """A third of the rows at one point, clusters of unequal size, a zero vector, queries far outside."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5)) * 20
    pts = np.concatenate([centres[i % 12] + rng.normal(size=5) for i in range(600)]).reshape(-1, 5).round(3)
    pts[:200], pts[400] = pts[0], 0
    queries = np.concatenate([pts[::40] + 0.01, rng.normal(size=(4, 5)) * 500, np.zeros((1, 5))]).round(3)
    index = neighbors.PivotIndex(frame(spark, pts), metric, p, block_rows=32)
    assert len(index.pivots) > 1 and index.blocks.agg(F.max("n")).first()[0] <= 32
    assert found(index.search(frame(spark, queries, 9000, False), 9), len(queries), 9000) == brute(pts, queries, 9, metric, p)


def test_cells_are_skipped_in_64_dimensions_with_structure(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64)) * 10
    pts = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 64))
    queries = centres[rng.integers(30, size=60)] + rng.normal(size=(60, 64))
    index = neighbors.PivotIndex(frame(spark, pts), "euclidean", block_rows=64)
    q = frame(spark, queries, 9000, False)
    cells = index.cells(q, 5, bounded=False).count()
    blocks = index.blocks.count()
    seen = index.visits(q, 5).count()
    assert cells < 0.3 * 60 * len(index.pivots) and seen < 0.3 * 60 * blocks
    assert found(index.search(q, 5), 60, 9000) == brute(pts, queries, 5, "euclidean")


def test_more_neighbours_than_rows_and_no_rows(spark):
    pts = [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]]
    q = frame(spark, [[1.0, 1.0]], 9, False)
    assert [n for _, n in found(neighbors.knn(frame(spark, pts), q, 10, "euclidean"), 1, 9)[0]] == [0, 1, 2]
    assert neighbors.knn(frame(spark, pts).limit(0), q, 3).count() == 0
    assert neighbors.knn(frame(spark, pts), q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        neighbors.knn(frame(spark, pts).union(frame(spark, [[1.0]])), q, 3)


def test_farthest_first_spreads():
    gauge = neighbors.Gauge("euclidean", 2.0)
    pts = np.array([[0.0], [0.1], [10.0], [10.1], [5.0], [5.0]])
    assert neighbors.farthest_first(pts, 3, gauge).ravel().tolist() == [0.0, 10.1, 5.0]
    assert len(neighbors.farthest_first(np.ones((9, 2)), 4, gauge)) == 1


def test_string_keys(spark):
    train = spark.createDataFrame([("b", [0.0], 1), ("a", [0.0], 0), ("c", [1.0], 1)], "key STRING, vec ARRAY<DOUBLE>, label INT")
    got = neighbors.knn(train, spark.createDataFrame([("q", [0.0])], "key STRING, vec ARRAY<DOUBLE>"), 2).collect()
    assert sorted((r["rank"], r["n_key"]) for r in got) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("metric,p", [("chebyshev", 2.0), ("euclidean", 2.0)])
def test_structureless_rows_are_streamed_past_groups(spark, metric, p):
    """Every query needs nearly every block: blocks go once to a group, and each query leaves k rows, not k a block."""
    rng = np.random.default_rng(3)
    pts = rng.integers(-24, 24, size=(900, 16)) / 8      # exact in binary: ties are ties
    pts[700:740] = pts[0]
    index = neighbors.PivotIndex(frame(spark, pts), metric, p, block_rows=100)
    q = frame(spark, pts[:400], 9000, False)
    rows, groups = index.grouped(q, 7)
    assert groups <= 4 and rows.count() == 400
    assert index.wanted(rows).count() <= groups * index.blocks.count()
    met = index.meet(rows, groups, 7)
    assert met.count() == 400 * 7
    assert found(index.search(q, 7), 400, 9000) == brute(pts, pts[:400], 7, metric, p)


def test_box_screen_finds_every_pair_within_its_bound():
    rng = np.random.default_rng(4)
    gauge = neighbors.Gauge("chebyshev", 2.0)
    T, Q = rng.integers(-9, 9, size=(700, 5)) / 7, rng.integers(-9, 9, size=(80, 5)) / 7
    r = rng.choice([0.0, 1 / 7, 3 / 7, 1.0, np.inf], size=80)
    screen = neighbors._Screen(gauge, T, len(Q))
    q, t, d = screen.within(Q, r)
    D = gauge.distance(Q, T)
    want = {(i, j) for i, j in zip(*np.nonzero(D <= r[:, None] * (1 + 1e-9) + 1e-12))}
    assert screen.box and set(zip(q.tolist(), t.tolist())) == want and (d == D[q, t]).all()


@pytest.mark.parametrize("p", [3.0, 4.0, 5.0])
@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e30])
def test_moments_keep_every_pair_within_its_bound(p, scale, monkeypatch):
    rng = np.random.default_rng(5)
    gauge = neighbors.Gauge("minkowski", p)
    T, Q = rng.normal(size=(2100, 24)) * scale, rng.normal(size=(150, 24)) * scale
    T[:40], T[50:60] = Q[:40], Q[40] * (1 + 1e-7)            # equal and all but equal rows
    T[60], Q[149] = 0.0, 0.0
    D = gauge.distance(Q, T)
    r = np.sort(D, axis=1)[np.arange(150), rng.integers(0, 60, 150)]
    r[7] = np.inf
    checked, pairs = [], neighbors._pairs
    monkeypatch.setattr(neighbors, "_pairs", lambda g, a, b: (checked.append(len(a)), pairs(g, a, b))[1])
    q, t, d = neighbors._Screen(gauge, T, len(Q)).within(Q, r)
    want = {(i, j) for i, j in zip(*np.nonzero(D <= r[:, None] * (1 + 1e-9) + 1e-12))}
    assert set(zip(q.tolist(), t.tolist())) == want and (d == D[q, t]).all()
    if scale >= 1:                                           # limits have an absolute slack of 1e-12
        assert 0 < sum(checked) < 0.2 * D.size
