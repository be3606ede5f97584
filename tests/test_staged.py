"""Staged tree ensembles against refits with fewer trees."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import learners, search, split, staged


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.4, size=400) > 0).astype(int)
    rows = [(i, *map(float, r), int(c), float(r[0] * 2 + r[1])) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key LONG, `a` DOUBLE, b DOUBLE, c DOUBLE, label INT, t DOUBLE").repartition(3).cache()


NAMES = ["a", "b", "c"]
SETTING = dict(max_depth=3, step_size=0.2, min_instances=2, subsampling=0.8)


def test_every_stage_equals_a_refit(spark, data):
    most = learners.fit_gbt(data, NAMES, "label", "key", max_iter=12, **SETTING)
    trees = staged.ensemble(spark, most.model.stages[-1])
    counts = [1, 5, 12]
    got = {r.key: r.s for r in data.select("key", trees.staged(NAMES, counts).alias("s")).collect()}
    for j, n in enumerate(counts):
        alone = learners.fit_gbt(data, NAMES, "label", "key", max_iter=n, **SETTING)
        for r in alone.score(data).collect():
            assert r[alone.name] == pytest.approx(1 / (1 + np.exp(-2 * got[r.key][j])), abs=1e-9)


def test_tree_search_equals_refits(data):
    halves = split.hash_split(data, "key", 0.5, names=("train", "val"))
    train, val = halves.where("split = 'train'"), halves.where("split = 'val'")
    res = search.tree_search([SETTING, dict(SETTING, max_depth=1)], [3, 8], train, val, NAMES, "label", "key").collect()
    assert len(res) == 8
    for r in res:
        if r["split"] == "val":
            alone = learners.fit_gbt(train, NAMES, "label", "key", max_iter=r["trees"], **[SETTING, dict(SETTING, max_depth=1)][r["setting"]])
            right = alone.predict(val, "p").agg(F.avg((F.col("p") == F.col("label")).cast("double"))).first()[0]
            assert r["accuracy"] == pytest.approx(right, abs=1e-6)


def test_imputer_search_equals_refits(data):
    some = data.withColumn("t", F.when(F.col("key") % 7 == 0, None).otherwise(F.col("t")))
    res = {r["trees"]: r for r in search.imputer_tree_search([dict(maxDepth=2, stepSize=0.3)], [2, 6], some, "t", NAMES, "key", 2).collect()}
    known = split.hash_folds(some.where("t IS NOT NULL"), "key", 2, 42)
    x = VectorAssembler(inputCols=NAMES, outputCol="__x").transform(known).cache()
    for n, r in res.items():
        errors = []
        for fold in (0, 1):
            m = GBTRegressor(featuresCol="__x", labelCol="t", seed=42, maxIter=n, maxDepth=2, stepSize=0.3).fit(x.where(F.col("fold") != fold))
            errors.append(m.transform(x.where(F.col("fold") == fold)).agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2))).first()[0])
        assert r["mse"] == pytest.approx(np.mean(errors), rel=1e-9) and r["n"] == known.count()
    assert res[6]["mse"] < res[2]["mse"]


def test_cases(spark, data):
    flat = GBTRegressor(featuresCol="__x", labelCol="k", maxIter=2).fit(
        VectorAssembler(inputCols=NAMES, outputCol="__x").transform(data.withColumn("k", F.lit(3.0))))
    trees = staged.ensemble(spark, flat)
    assert {r[0][0] for r in data.select(trees.staged(NAMES, [1])).collect()} == {3.0}
    for bad in ([], [0], [3]):
        with pytest.raises(ValueError):
            trees.staged(NAMES, bad)
    with pytest.raises(ValueError):
        trees.sums(np.array([[np.nan, 0.0, 0.0]]), [1])
