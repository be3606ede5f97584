"""Model-based imputation with per-row flags.

* ``fit_imputer`` / ``apply_imputer`` -- boosted regression trees
  (those of ``pyspark.ml`` ``GBTRegressor``; with few features grown over the
  cells of their bins, ``tessera.operators.binned``, with more over packed rows,
  ``tessera.operators.trees``, and by ``GBTRegressor`` itself where these pass a
  task's bound) fitted on rows where the target is known, applied with ``coalesce(target, prediction)`` so known cells never change.
* ``chained_impute`` -- several targets in order, each later imputer seeing
  the earlier filled columns (the second target's model uses the first
  target as a feature).
* ``group_mean_fill`` -- the same fill/flag contract with a grouped mean as
  predictor (the group table is joined, Catalyst / AQE choose broadcast or
  shuffle by its real size).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import binned, trees
from tessera.operators.learners import linear
from tessera.session import checkpoint_dir


def flag_name(target: str) -> str:
    return f"{target}_imputed"


def fit_imputer(df: DataFrame, target: str, features: list[str], *, max_iter: int = 100, max_depth: int = 3,
                step_size: float = 0.05, min_instances: int = 1, subsampling: float = 1.0,
                seed: int = 42) -> PipelineModel:
    """Boosted-tree regressor for ``target`` on rows where it is known.

    Features must be complete (``handleInvalid="error"``): a NULL feature is an
    error, not a silent zero.
    """
    checkpoint_dir(df.sparkSession)          # the trees' periodic checkpoints need the shared folder
    known = df.where(F.col(target).isNotNull())
    cells = binned.fit_cells(known, target, features, max_iter, subsampling, seed)
    if cells is not None:
        return binned.pipeline(cells, max_iter, max_depth, step_size, min_instances)
    va = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error")
    gbt = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="__pred", maxIter=max_iter,
                       maxDepth=max_depth, stepSize=step_size, minInstancesPerNode=min_instances,
                       subsamplingRate=subsampling, seed=seed)
    found = trees.grow_rows(known, target, features, max_iter, max_depth, step_size, min_instances, subsampling, seed)
    if found is not None:
        return PipelineModel([va, trees.spark_model(*found, max_iter, step_size, gbt)])
    return Pipeline(stages=[va, gbt]).fit(known)


def apply_imputer(df: DataFrame, model: PipelineModel, target: str) -> DataFrame:
    """target := coalesce(target, prediction); adds ``<target>_imputed``."""
    out = model.transform(df)
    made = [c for c in out.columns if c.startswith("__") and c not in df.columns]
    return (out.withColumn(flag_name(target), F.col(target).isNull())
            .withColumn(target, F.coalesce(F.col(target), F.col("__pred")))
            .drop(*made))


@dataclass
class LinearImputer:
    """A predictor with given weights, applied like a fitted one."""

    features: list[str]
    weights: list[float]
    bias: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__pred", linear(self.features, self.weights, self.bias))


def chained_impute(df: DataFrame, specs: list[dict]) -> tuple[DataFrame, dict]:
    """Fit and apply imputers in order; spec = {target, features, **gbt params}.

    Each imputer is fitted on the rows as they were given, before any fill (a
    row that misses an earlier target which this imputer takes as a feature is
    not learned from), and applied to the frame in which earlier targets are
    already filled.
    """
    models = {}
    cur = df
    for spec in specs:
        spec = dict(spec)
        target, feats = spec.pop("target"), spec.pop("features")
        earlier = [c for c in feats if c in models]
        m = fit_imputer(df.na.drop(subset=earlier) if earlier else df, target, feats, **spec)
        models[target] = m
        cur = apply_imputer(cur, m, target)
    return cur, models


def group_mean_fill(df: DataFrame, targets: list[str], by: str) -> DataFrame:
    """Fill each target with the mean of its known values in the row's group; the rows without a group are one group."""
    means = df.groupBy(F.col(by).alias("__by")).agg(*[F.avg(t).alias(f"__m_{t}") for t in targets])
    out = df.join(means, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    for t in targets:
        out = (out.withColumn(flag_name(t), F.col(t).isNull())
               .withColumn(t, F.coalesce(F.col(t), F.col(f"__m_{t}"))))
    return out.drop(*[f"__m_{t}" for t in targets])


def imputation_summary(df: DataFrame, targets: list[str]) -> DataFrame:
    """(column_name, n_imputed, any_imputed) from the per-row flags, one scan."""
    aggs = []
    for i, t in enumerate(targets):
        f = F.col(flag_name(t))
        aggs += [F.count_if(f).alias(f"n{i}"), F.bool_or(f).alias(f"a{i}")]
    row = df.agg(*aggs)
    stack = [F.struct(F.lit(t).alias("column_name"), F.col(f"n{i}").alias("n_imputed"),
                      F.col(f"a{i}").alias("any_imputed")) for i, t in enumerate(targets)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")
