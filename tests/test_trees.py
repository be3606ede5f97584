"""Trees grown in one task (nodes of so many rows that no two splits gain the same) against Spark ML's own, and the clustering in one task against its loop of jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import fuzzy, impute, learners, trees

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than the learner samples its candidate splits from, in three partitions."""
    rng = np.random.default_rng(1)
    a, b, c, d = rng.integers(1, 51, 12000).astype(float), rng.lognormal(3, 1, 12000), rng.normal(size=12000), rng.integers(0, 4, 12000).astype(float)
    t = np.sin(a / 9) + np.log(b) / 5 + c * d / 3 + rng.normal(scale=0.3, size=12000)
    data = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, d, t, t > 1))]
    return spark.createDataFrame(data, "key LONG, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, t DOUBLE, y DOUBLE").repartition(3).cache()


def watched(monkeypatch, kind) -> list:
    fitted, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df, *a: (fitted.append(self.getMaxIter()), fit(self, df, *a))[1])
    return fitted


def test_draws_are_those_of_rand(spark):
    want = spark.range(0, 9000, 1, 2).select(F.spark_partition_id().alias("p"), (F.rand(43) < 0.7).alias("a"), (F.rand(-5) < 0.7).alias("b")).toPandas()
    for p in (0, 1):
        w = want[want.p == p]
        draws = trees.Draws([43, -5], 0.7, p)
        got = np.concatenate([draws.take(n) for n in (1, 0, 777, len(w) - 778)])
        assert (got == w[["a", "b"]].to_numpy()).all()


@pytest.mark.parametrize("rate", [0.7, 1.0])
def test_classifier_is_grown_without_a_job_a_tree(rows, monkeypatch, tmp_path, rate):
    with monkeypatch.context() as m:
        fitted = watched(m, GBTClassifier)
        got = learners.fit_gbt(rows, FEATURES, "y", "key", max_iter=6, max_depth=5, step_size=0.3, min_instances=100, subsampling=rate)
        assert set(fitted) == {1}
    x = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(rows)
    right = GBTClassifier(featuresCol="__x", labelCol="y", maxIter=6, maxDepth=5, stepSize=0.3, minInstancesPerNode=100, subsamplingRate=rate, seed=42).fit(x)
    both = got.score(rows).join(right.transform(x).select("key", vector_to_array("probability")[1].alias("right")), "key")
    assert both.agg(F.max(F.abs(F.col("LightGBM") - F.col("right")))).first()[0] < 1e-9
    model = got.model.stages[-1]
    assert (model.getNumTrees, model.numFeatures, model.getMaxIter(), model.getMaxDepth(), model.treeWeights[:2]) == (6, 4, 6, 5, [1.0, 0.3])
    model.write().save(str(tmp_path / "m"))
    assert GBTClassificationModel.load(str(tmp_path / "m")).toDebugString == model.toDebugString


def test_imputer_of_many_features_is_grown_without_a_job_a_tree(rows, monkeypatch):
    with monkeypatch.context() as m:
        fitted = watched(m, GBTRegressor)
        got = impute.fit_imputer(rows, "t", FEATURES, max_iter=5, max_depth=4, step_size=0.3, min_instances=100, subsampling=0.9)
        assert set(fitted) == {1}
        m.setattr(trees, "PACKED_BYTES", 1000)           # more than a task holds: the learner itself
        whole = impute.fit_imputer(rows, "t", FEATURES, max_iter=5, max_depth=4, step_size=0.3, min_instances=100, subsampling=0.9)
        assert 5 in fitted
    x = got.transform(rows).select("key", "__pred").join(whole.transform(rows).select("key", F.col("__pred").alias("right")), "key")
    assert x.agg(F.max(F.abs(F.col("__pred") - F.col("right")))).first()[0] < 1e-9


def test_odd_rows(spark):
    df = spark.createDataFrame([(float(i % 2), 1.0, float(i % 2)) for i in range(20)], "a DOUBLE, b DOUBLE, y DOUBLE")
    got = learners.fit_gbt(df, ["a", "b"], "y", "a", max_iter=3, subsampling=1.0)
    assert {(r["a"], r["LightGBM"] > 0.5) for r in got.score(df).collect()} == {(0.0, False), (1.0, True)}
    for bad in ((None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (1.0, 1.0, None), (1.0, 1.0, 2.0)):
        with pytest.raises(Exception):
            learners.fit_gbt(df.union(spark.createDataFrame([bad], df.schema)), ["a", "b"], "y", "a", max_iter=3)


def test_clustering_in_one_task_is_the_loop(rows, monkeypatch):
    gap = F.when(F.col("key") % 7 > 0, F.col("c"))                       # NULL cells
    df = rows.withColumn("w", F.when(F.col("key") % 11 > 0, 2.0)).withColumn("c", gap)
    seen = []
    packed = fuzzy._fit_packed
    monkeypatch.setattr(fuzzy, "_fit_packed", lambda *a: (seen.append(a), packed(*a))[1])
    got = fuzzy.fcm_fit(df, ["c", "d"], "key", error=1e-6, maxiter=12, weight="w")
    monkeypatch.setattr(fuzzy, "PACKED_BYTES", 0)
    want = fuzzy.fcm_fit(df, ["c", "d"], "key", error=1e-6, maxiter=12, weight="w")
    assert len(seen) == 1 and got[1] == want[1] and got[2] == pytest.approx(want[2], rel=1e-6)
    assert np.allclose(got[0], want[0], rtol=1e-9)
