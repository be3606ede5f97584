"""Edge cases of neighbours, quantiles, class copies and chained imputers against plain Python."""

from __future__ import annotations

import decimal
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import impute, learners, neighbors, quantiles, split


def test_cosine_keeps_zero_vectors_on_a_grid_of_many_cells(spark):
    rng = random.Random(5)
    train = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(600)] + [(600, [0.0, 0.0, 0.0])]
    queries = [(0, [0.0, 0.0, 0.0]), (1, [0.3, -0.2, 0.9]), (2, [-1.0, 0.1, 0.0])]
    got = neighbors.knn(spark.createDataFrame(train, "key long, vec array<double>"), spark.createDataFrame(queries, "key long, vec array<double>"), 5, "cosine").collect()

    def dist(a, b):
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return 1 - sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 1.0

    for q, v in queries:
        want = sorted((round(dist(v, t), 9), i) for i, t in train)[:5]
        assert [(round(r.distance, 9), r.n_key) for r in sorted((r for r in got if r.q_key == q), key=lambda r: r.rank)] == want


def test_quantiles_of_values_that_a_sketch_can_not_split(spark):
    """Tight clusters far apart, and a bound of few exact values: brackets are halved by value, the bound holds."""
    rng = random.Random(6)
    xs = [s * 10.0 ** e * (1 + rng.random() * 1e-12) for e in range(-300, 300, 60) for s in (1, -1) for _ in range(200)] + [0.0] * 500
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = quantiles.exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], max_exact=32)["x"]
    assert [got[q] for q in (0.1, 0.25, 0.5, 0.9)] == pytest.approx([float(np.quantile(xs, q)) for q in (0.1, 0.25, 0.5, 0.9)], rel=1e-12)
    few = quantiles.exact_quantiles(df, ["x"], [0.25, 0.9], max_exact=1)["x"]
    assert [few[0.25], few[0.9]] == [got[0.25], got[0.9]]


def test_halved_brackets(spark):
    """Halving alone finds the rank."""
    t = quantiles._Target(0, "x", 4, -1e308, 1e308, 0, 10, 10, halve=True)
    long = quantiles.to_long(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), ["x"])
    for _ in range(2200):
        if t.value is not None or t.inside <= 2:
            break
        quantiles._narrow(long, spark, [t])
        assert t.value is not None or (t.below <= 4 < t.below + t.inside and t.halve)
        if t.hi <= 1e300:
            t.lo, t.hi = max(t.lo, -16.0), min(t.hi, 16.0)       # the same rows, without 1,000 more passes
    assert t.value == 4.0 or t.lo <= 4.0 <= t.hi


def test_balanced_copies(spark):
    of = lambda *n: spark.createDataFrame([(c,) for c, k in enumerate(n) for _ in range(k)] + [(None,)], "y int")
    assert learners.balanced_copies(of(58, 341), "y") == {0: 6, 1: 1}
    assert learners.balanced_copies(of(100, 100), "y") == {0: 1, 1: 1}
    assert learners.balanced_copies(of(90, 60), "y") == {0: 2, 1: 3}
    assert learners.balanced_copies(of(), "y") == {}


def test_second_imputer_learns_from_given_rows_only(spark, monkeypatch):
    seen = {}
    fit = impute.fit_imputer

    def spy(df, target, features, **kw):
        seen[target] = {r.k for r in df.where(F.col(target).isNotNull()).collect()}
        return fit(df, target, features, **kw)

    monkeypatch.setattr(impute, "fit_imputer", spy)
    rows = [(i, float(i), None if i % 4 == 0 else 2.0 * i, None if i % 3 == 0 else 3.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x double, a double, b double")
    out, _ = impute.chained_impute(df, [dict(target="a", features=["x"], max_iter=2), dict(target="b", features=["x", "a"], max_iter=2)])
    assert seen == {"a": {i for i in range(40) if i % 4}, "b": {i for i in range(40) if i % 4 and i % 3}}
    assert out.where("a is null or b is null").count() == 0


@pytest.mark.parametrize("kind, labels", [("double", [1e10, 0.5, float("nan"), None, -1e300]), ("string", ["a", None, "null", ""]),
                                          ("decimal(5,2)", None), ("boolean", [True, False, None])])
def test_stratified_split_keeps_null_and_typed_labels(spark, kind, labels):
    labels = labels or [decimal.Decimal("1.50"), None, decimal.Decimal("-2.25")]
    rows = [(i, labels[min(i % 9, len(labels) - 1)]) for i in range(700)]
    df = spark.createDataFrame(rows, f"key long, y {kind}")
    out = split.stratified_split(df, "key", "y", 0.3, 3).collect()
    name = {r["key"]: repr(r["y"]) for r in out}
    assert name == {k: repr(y) for k, y in rows}
    sizes = {y: sum(1 for k in name if name[k] == y) for y in set(name.values())}
    tests = [r["key"] for r in out if r["split"] == "test"]
    assert len(tests) == 210
    for y, n in sizes.items():
        ordered = sorted((hashlib.md5(f"{k}3".encode()).hexdigest(), k) for k in name if name[k] == y)
        got = {k for k in tests if name[k] == y}
        assert abs(len(got) - 0.3 * n) < 1.0 + 1e-9 and got == {k for _, k in ordered[:len(got)]}


def test_class_quotas_equal_largest_remainder(spark):
    rng = random.Random(9)
    for counts in ({i: rng.choice([1, 1, 1, 2, 7, 300]) for i in range(400)}, {0: 10 ** 12 + 1, 1: 3, 2: 10 ** 12}, {5: 1}, {}):
        df = spark.createDataFrame([(c, n) for c, n in counts.items()], "g int, n long").repartition(5)
        for f in (0.2, 0.35, 0.0, 1.0):
            got = {r["g"]: r["q"] for r in split.class_quotas(df, f).collect()}
            assert got == split.stratified_quotas(counts, f)


def test_thresholds_by_joins_equal_thresholds_by_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(900)], "key long, y int")
    a = {tuple(r) for r in split.stratified_split(df, "key", "y", 0.25, 1).collect()}
    monkeypatch.setattr(split, "_BROADCAST_CLASSES", 0)
    assert {tuple(r) for r in split.stratified_split(df, "key", "y", 0.25, 1).collect()} == a
    empty = split.stratified_split(df.where("key < 0"), "key", "y")
    assert empty.count() == 0 and empty.columns == ["key", "y", "split"]


def test_group_mean_fill_fills_the_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 4.0), (4, None, None), (5, "b", None)], "key long, g string, t double")
    got = {r["key"]: (r["t"], r["t_imputed"]) for r in impute.group_mean_fill(df, ["t"], "g").collect()}
    assert got == {1: (1.0, False), 2: (1.0, True), 3: (4.0, False), 4: (4.0, True), 5: (None, True)}


def test_activations(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "x double")
    got = df.select(numeric.relu("x"), numeric.tanh("x")).collect()
    assert [r[0] for r in got] == [0.0, 0.0, 3.0, None]
    assert [r[1] for r in got][:3] == pytest.approx([math.tanh(v) for v in (-2.0, 0.0, 3.0)]) and got[3][1] is None
