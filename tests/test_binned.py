"""Boosted trees over cells of bins against ``GBTRegressor`` on the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import binned, impute, search, split

SETTING = dict(maxDepth=3, stepSize=0.3, minInstancesPerNode=5, subsamplingRate=0.8)


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than the learner samples its candidate splits from, in three partitions; every ninth target is unknown."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(1, 51, 12000).astype(float), rng.lognormal(3, 1, 12000)
    t = np.round(np.sin(a / 9) + np.log(b) / 5 + rng.normal(scale=0.2, size=12000), 2)
    data = [(i, float(x), float(y), None if i % 9 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(a, b, t))]
    return spark.createDataFrame(data, "key LONG, a DOUBLE, b DOUBLE, t DOUBLE").repartition(3).cache()


def test_cells_give_the_row_trees(spark, rows, monkeypatch):
    fitted = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: (fitted.append(self.getMaxIter()), fit(self, df, *a))[1])
    model = impute.fit_imputer(rows, "t", ["a", "b"], max_iter=6, max_depth=3, step_size=0.3, min_instances=5, subsampling=0.8)
    assert set(fitted) == {1}                # only the edges are read from the rows; no tree after tree over all of them
    x = VectorAssembler(inputCols=["a", "b"], outputCol="__v").transform(rows)
    right = GBTRegressor(featuresCol="__v", labelCol="t", predictionCol="__right", maxIter=6, seed=42, **SETTING).fit(x.where("t IS NOT NULL"))
    worst = right.transform(model.transform(x)).agg(F.max(F.abs(F.col("__pred") - F.col("__right")))).first()[0]
    assert worst < 1e-9
    out = impute.apply_imputer(rows, model, "t")
    assert out.columns == ["key", "a", "b", "t", "t_imputed"]
    assert out.where("t IS NULL").count() == 0


def test_search_over_cells_equals_row_fits(spark, rows, monkeypatch):
    fitted = []
    fit = GBTRegressor.fit
    with monkeypatch.context() as m:
        m.setattr(GBTRegressor, "fit", lambda self, df, *a: (fitted.append(self.getMaxIter()), fit(self, df, *a))[1])
        got = search.imputer_tree_search([SETTING, dict(SETTING, maxDepth=2)], [2, 4], rows, "t", ["a", "b"], "key", 2).collect()
    assert fitted == [1] * 4                 # the edges of two features and folds, shared by both settings
    got = [r for r in got if r["setting"] == 0]
    known = split.hash_folds(rows.where("t IS NOT NULL"), "key", 2, 42)
    x = VectorAssembler(inputCols=["a", "b"], outputCol="__x").transform(known).cache()
    for r in got:
        errors = []
        for fold in (0, 1):
            m = GBTRegressor(featuresCol="__x", labelCol="t", seed=42, maxIter=r["trees"], **SETTING).fit(x.where(F.col("fold") != fold))
            errors.append(m.transform(x.where(F.col("fold") == fold)).agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2))).first()[0])
        assert r["mse"] == pytest.approx(np.mean(errors), rel=1e-9) and r["n"] == known.count()


def test_value_on_an_edge_lies_below_it(spark):
    b = binned.bucketizer(["a"], [[1.5, 2.0]])
    df = spark.createDataFrame([(1.5,), (1.6,), (2.0,), (2.1,)], "a DOUBLE")
    assert [r["__b0"] for r in b.transform(df).orderBy("a").collect()] == [1.0, 2.0, 2.0, 3.0]
