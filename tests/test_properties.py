"""Property-based checks (hypothesis)."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import split
from tessera.operators.quantiles import exact_quantiles


@given(st.dictionaries(st.integers(0, 20), st.integers(1, 10_000), min_size=1, max_size=8),
       st.floats(0.0, 1.0))
@settings(max_examples=300, deadline=None)
def test_stratified_quotas_properties(counts, frac):
    q = split.stratified_quotas(counts, frac)
    n = sum(counts.values())
    assert sum(q.values()) == math.ceil(frac * n)
    train = {c: counts[c] - q[c] for c in counts}
    for c, v in counts.items():
        exact = (n - math.ceil(frac * n)) * v / n
        assert math.floor(exact) <= train[c] <= math.floor(exact) + 1
        assert 0 <= q[c] <= v


@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=300),
       st.sampled_from([50_000, 3]))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_exact_quantiles_property(spark, values, max_exact):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "key BIGINT, x DOUBLE")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x"], probs, max_exact=max_exact)["x"]
    for q in probs:
        assert got[q] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-9)


def _brute(train, queries, k, metric):
    out = {}
    for qk, qv in queries:
        ds = []
        for tk, tv in train:
            a, b = np.asarray(qv, float), np.asarray(tv, float)
            if metric == "chebyshev":
                d = np.abs(a - b).max()
            elif metric == "manhattan":
                d = np.abs(a - b).sum()
            else:
                d = np.sqrt(((a - b) ** 2).sum())
            ds.append((d, tk))
        ds.sort()
        out[qk] = [t for _, t in ds[:k]]
    return out


@given(st.integers(5, 120), st.integers(1, 4), st.integers(1, 9), st.sampled_from(["chebyshev", "manhattan",
                                                                                     "euclidean"]),
       st.integers(4, 64), st.integers(0, 10_000))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_knn_exact_property(spark, n, dim, k, metric, block_rows, seed):
    from tessera.operators import neighbors
    rnd = np.random.default_rng(seed)
    pts = np.round(rnd.normal(size=(n, dim)) * 3) / 2          # coarse grid: many distance ties
    train = [(i, pts[i].tolist()) for i in range(n)]
    queries = [(10_000 + i, (pts[rnd.integers(n)] + rnd.normal(size=dim) * 0.3).tolist()) for i in range(15)]
    tdf = spark.createDataFrame([(kk, v, kk % 2) for kk, v in train], "key BIGINT, vec ARRAY<DOUBLE>, label INT")
    qdf = spark.createDataFrame(queries, "key BIGINT, vec ARRAY<DOUBLE>")
    got = {}
    for r in sorted(neighbors.knn(tdf, qdf, k, metric, block_rows=block_rows).collect(),
                    key=lambda r: (r["q_key"], r["rank"])):
        got.setdefault(r["q_key"], []).append(r["n_key"])
    assert got == _brute(train, queries, k, metric)
