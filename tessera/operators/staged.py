"""Staged evaluation of one boosted ensemble: a fit with the most trees answers for every smaller number of trees.

Boosting adds trees one after another, so the ensemble of the first ``m`` trees
is what a fit with ``m`` iterations (and the same seed) gives.  A search axis
over the number of trees therefore needs one fit, and one pass over the rows
in which every tree is walked once and its weighted values are summed up tree
by tree; the sums at the wanted numbers are the scores.

The trees are read from the saved model, as rows of nodes: a table as large as
the model, which the driver holds anyway.  Rows are scored in Arrow batches,
all trees of a batch level by level.

Cases: a wanted number of 0 or of more trees than were fitted is refused, as
are categorical splits (no learner here makes any) and features that are
NULL or NaN; an ensemble whose trees are single leaves is a constant.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.session import checkpoint_dir

ROWS = 1024


@dataclass
class Ensemble:
    """Trees as matrices (tree x node); node 0 is the root and a leaf has feature -1."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.weights)

    def sums(self, x: np.ndarray, counts: list[int]) -> np.ndarray:
        """(row, count): the weighted sum of each row's first ``count`` trees."""
        if np.isnan(x).any():
            raise ValueError("features must not be NULL or NaN")
        tree = np.arange(self.trees)[None, :]
        at = np.zeros((len(x), self.trees), dtype=np.int32)
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                break
            go = np.take_along_axis(x, np.maximum(f, 0), axis=1) <= self.threshold[tree, at]
            at = np.where(inner, np.where(go, self.left[tree, at], self.right[tree, at]), at)
        return np.cumsum(self.value[tree, at] * self.weights, axis=1)[:, np.asarray(counts) - 1]

    def staged(self, features: list[str], counts: list[int]) -> Column:
        """An array column: the sums at each wanted number of trees."""
        if not counts or min(counts) < 1 or max(counts) > self.trees:
            raise ValueError(f"numbers of trees must lie between 1 and {self.trees}")

        @F.pandas_udf(ArrayType(DoubleType()))
        def of(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            parts = [self.sums(x[lo:lo + ROWS], counts) for lo in range(0, len(x), ROWS)]
            return pd.Series([row for part in parts for row in part])

        return of(*[F.col(f"`{c}`").cast("double") for c in features])


def ensemble(spark: SparkSession, model) -> Ensemble:
    """The trees of a fitted ``GBTClassificationModel`` or ``GBTRegressionModel``, by way of its saved form."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["numCategories"].alias("kinds"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold")).toPandas()
    if (rows["kinds"] >= 0).any():
        raise ValueError("categorical splits are not read")
    shape = (int(rows["treeID"].max()) + 1, int(rows["id"].max()) + 1)
    at = (rows["treeID"].to_numpy(), rows["id"].to_numpy())

    def matrix(name: str, kind: type) -> np.ndarray:
        out = np.full(shape, -1, dtype=kind)
        out[at] = rows[name].fillna(0).to_numpy()
        return out

    return Ensemble(matrix("feature", np.int64), matrix("threshold", np.float64), matrix("left", np.int32), matrix("right", np.int32),
                    matrix("value", np.float64), np.array(model.treeWeights, dtype=np.float64))
