"""Search helpers, sources / sinks, imputer contracts."""

import json
import math
import random
import tempfile

import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.operators import clean, impute, learners, outliers, search, split
from tessera.sources import bounds_from_json, bounds_to_json, read_table, single_row, write_table


@pytest.fixture(scope="module")
def toy(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        x1, x2 = rnd.random(), rnd.random()
        rows.append((i, x1, x2, int(x1 + 0.3 * x2 + rnd.gauss(0, 0.1) > 0.65)))
    df = spark.createDataFrame(rows, "key BIGINT, x1 DOUBLE, x2 DOUBLE, label INT")
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df).cache()


def test_param_search_and_top(toy):
    h = split.hash_split(toy, "key", 0.5, names=("train", "val"))
    train, val = h.where("split = 'train'"), h.where("split = 'val'")
    g = search.grid(regParam=[0.0, 0.01, 1.0], maxIter=[50])
    res = search.param_search(LinearSVC(labelCol="label"), g, train, val, "label")
    rows = res.collect()
    assert len(rows) == 3 and all(0 <= r["accuracy"] <= 1 for r in rows)
    top = search.top_params(res, "accuracy", 2).collect()
    assert len(top) == 2 and top[0]["accuracy"] >= top[1]["accuracy"]
    rep = {r["split"]: r for r in search.refit_report(LinearSVC(labelCol="label").fit, train, val, "label").collect()}
    assert set(rep) == {"train", "val"} and rep["train"]["accuracy"] > 0.6


def test_cv_search_on_hash_folds(toy):
    f = split.hash_folds(toy, "key", 3).withColumn("y", F.col("x1") * 2.0)
    best, avg = search.cv_search(LinearRegression(labelCol="y"), [{"regParam": 0.0}, {"regParam": 10.0}], f,
                                 "fold", RegressionEvaluator(labelCol="y", metricName="mse"))
    assert len(avg) == 2 and avg[0] < avg[1]


def test_random_grid_is_seeded():
    space = {"layers": [[8], [16, 8]], "stepSize": [0.01, 0.03]}
    assert search.random_grid(space, 5, 1) == search.random_grid(space, 5, 1)
    assert len(search.random_grid(space, 5, 1)) == 5


def test_write_read_roundtrip_and_bounds_json(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "key BIGINT, x DOUBLE")
    d = tempfile.mkdtemp(prefix="tessera-io-")
    write_table(df, f"{d}/t.csv", "csv")
    back = read_table(spark, f"{d}/t.csv", "csv", "key BIGINT, x DOUBLE")
    assert sorted(back.collect(), key=lambda r: r["key"]) == sorted(df.collect(), key=lambda r: r["key"])
    b = outliers.iqr_bounds(df, ["x"])
    text = bounds_to_json(b)
    assert json.loads(text)["x"]["Q1"] == 1.5
    assert bounds_from_json(text)["x"] == (b.collect()[0]["lower_bound"], b.collect()[0]["upper_bound"])
    one = single_row(spark, {"x": 2.0})
    assert one.collect()[0]["x"] == 2.0


def test_imputer_rejects_null_features(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 2.0, None), (4, 3.0, 4.0)],
                               "key BIGINT, f DOUBLE, t DOUBLE")
    m = impute.fit_imputer(df.where("f is not null"), "t", ["f"], max_iter=2)
    with pytest.raises(Exception):
        impute.apply_imputer(df, m, "t").collect()
    ok = impute.apply_imputer(df.where("f is not null"), m, "t").collect()
    known = {r["key"]: (r["t"], r["t_imputed"]) for r in ok}
    assert known[1] == (2.0, False) and known[3][1] is True and known[3][0] is not None


def test_required_columns_and_domains(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "key BIGINT, a DOUBLE")
    with pytest.raises(ValueError):
        clean.require_columns(df, ["a", "b"])
    v = {r["key"]: r["violations"] for r in clean.domain_violations(df, "key", {"a": (0.0, 10.0)}).collect()}
    assert v == {1: [], 2: ["a"], 3: []}
    u = clean.unknown_as_missing(df.withColumn("unk", F.col("key") == 1), {"a": "unk"})
    assert u.where("key = 1").collect()[0]["a"] is None


def test_log_axis():
    assert search.log_axis(0.01, 100.0, 5) == pytest.approx([0.01, 0.1, 1.0, 10.0, 100.0])
    assert search.log_axis(3.0, 9.0, 1) == [3.0]
    with pytest.raises(ValueError):
        search.log_axis(0.0, 1.0, 3)


def test_learner_search_finds_the_kernel_that_separates_a_ring(spark):
    rows = [(i, 2.0 * math.cos(i) * (i % 2 + 0.25), 2.0 * math.sin(i) * (i % 2 + 0.25), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, a double, b double, label int").repartition(3)
    train, val = df.where("key % 4 > 0"), df.where("key % 4 = 0 or key % 8 = 1")
    points = search.grid(C=[1.0, 50.0], gamma=search.log_axis(1e-6, 1.0, 2))
    res = search.learner_search(learners.fit_rbf_svm, points, train, val, ["a", "b"], "label", "key").collect()
    got = {r["params"]: r for r in res}
    assert set(got) == {str(p) for p in points} and all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == val.count() for r in res)
    assert got[str({"C": 50.0, "gamma": 1.0})]["accuracy"] == 1.0
    linear = search.learner_search(learners.fit_linear_svm, [{"C": 1.0}], train, val, ["a", "b"], "label", "key").first()
    assert linear["accuracy"] < 0.9


def test_imputer_search_prefers_enough_trees(spark):
    df = spark.createDataFrame([(i, float(i % 30), None if i % 11 == 0 else 2.0 * (i % 30)) for i in range(300)], "key long, x double, y double")
    best, r2 = search.imputer_search([dict(maxIter=1, maxDepth=1), dict(maxIter=3, maxDepth=5)], df, "y", ["x"], "key", folds=2)
    assert r2[1] > r2[0] and r2[1] > 0.95 and best.getNumTrees == 3
