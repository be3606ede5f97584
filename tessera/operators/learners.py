"""Base learners as ``pyspark.ml`` estimators behind one small interface.

``fit(df) -> Fitted``; ``Fitted.score(df) -> df + <name>`` (a probability, or
a raw decision value when ``kind == "decision"``; the stack normalises those).

* boosted trees   -- ``GBTClassifier`` (depth-wise trees; no leaf cap, no L1/L2),
  its trees grown in one task while the packed rows fit one (``tessera.operators.trees``)
* linear margin   -- ``LinearSVC`` with ``regParam = 1 / (C * n)``
* kernel margin   -- random Fourier features ``sqrt(2/D) cos(Wx + b)``,
  ``W ~ N(0, 2*gamma)``, ``b ~ U[0, 2pi)`` (Rahimi & Recht), then ``LinearSVC``;
  the map is one matrix product an Arrow batch; grids of C and gamma in one
  scan a step are ``tessera.operators.margins``
* neural          -- ``MultilayerPerceptronClassifier``; class weights by row
  replication (it has no weight column)
* nearest neighbours -- the exact grid KNN of ``tessera.operators.neighbors``
* given linear     -- ``bias + w . x`` with weights from elsewhere, as a column
  expression; a probability is its sigmoid
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.functions.numeric import sigmoid
from tessera.operators import margins, neighbors, profile, trees
from tessera.operators.stack import replicate_by_weight
from tessera.session import checkpoint_dir

TASK_ROWS = 1 << 16             # rows of a task of the linear margin


def positive_probability(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


@dataclass
class Fitted:
    name: str
    kind: str                       # "probability" | "decision"
    features: list[str]
    key: str
    model: object = None
    extra: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        if self.name_kind == "knn":
            return _knn_score(self, df)
        if self.name_kind == "given":
            margin = linear(self.features, self.extra["weights"], self.extra["bias"])
            return df.withColumn(self.name, sigmoid(margin) if self.kind == "probability" else margin)
        out = self.model.transform(_prep(self, df))
        val = positive_probability() if self.kind == "probability" else vector_to_array(F.col("rawPrediction"))[1]
        keep = [c for c in df.columns]
        return out.select(*keep, val.alias(self.name))

    @property
    def name_kind(self) -> str:
        return self.extra.get("family", "")

    def predict(self, df: DataFrame, col: str | None = None) -> DataFrame:
        """Class prediction of the learner itself (decision sign for margins)."""
        if self.name_kind == "knn":
            s = _knn_score(self, df)
            return s.withColumn(col or f"{self.name}_pred", (F.col(self.name) > 0.5).cast("int"))
        if self.name_kind == "given":
            margin = linear(self.features, self.extra["weights"], self.extra["bias"])
            return df.withColumn(col or f"{self.name}_pred", (margin > 0).cast("int"))
        out = self.model.transform(_prep(self, df))
        return out.select(*df.columns, F.col("prediction").cast("int").alias(col or f"{self.name}_pred"))


def linear(features: list[str], weights: list[float], bias: float) -> Column:
    """``bias + w . x``, summed from left to right."""
    out = F.lit(float(bias))
    for c, w in zip(features, weights, strict=True):
        out = out + F.col(c) * F.lit(float(w))
    return out


def given_linear(name: str, kind: str, features: list[str], weights: list[float], bias: float, key: str) -> Fitted:
    return Fitted(name, kind, features, key, None, {"family": "given", "weights": list(weights), "bias": bias})


def _prep(f: Fitted, df: DataFrame) -> DataFrame:
    if f.extra.get("family") == "rff":
        return rff_transform(df, f.features, f.extra["W"], f.extra["b"], "__rff")
    return df


def _assembler(features: list[str], out: str = "__x") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error")


def fit_gbt(df: DataFrame, features: list[str], label: str, key: str, name: str = "LightGBM",
            max_iter: int = 400, step_size: float = 0.01, max_depth: int = 7, min_instances: int = 3,
            subsampling: float = 0.7, seed: int = 42) -> Fitted:
    checkpoint_dir(df.sparkSession)          # the trees' periodic checkpoints need the shared folder
    gbt = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=max_iter, stepSize=step_size,
                        maxDepth=max_depth, minInstancesPerNode=min_instances, subsamplingRate=subsampling,
                        seed=seed)
    found = trees.grow_rows(df, label, features, max_iter, max_depth, step_size, min_instances, subsampling, seed, classes=True)
    if found is not None:
        m = PipelineModel([_assembler(features), trees.spark_model(*found, max_iter, step_size, gbt)])
    else:
        m = Pipeline(stages=[_assembler(features), gbt]).fit(df)
    return Fitted(name, "probability", features, key, m, {"family": "gbt"})


def _dense(df: DataFrame, n: int) -> DataFrame:
    """Rows in no more partitions than they are worth: an iteration over few rows is the start of its tasks."""
    return df.coalesce(max(1, math.ceil(n / TASK_ROWS)))


def fit_linear_svm(df: DataFrame, features: list[str], label: str, key: str, name: str = "LinearSVM",
                   C: float = 2.0, max_iter: int = 200, weight: str | None = None) -> Fitted:
    n = df.count()
    df = _dense(df, n)
    svc = LinearSVC(featuresCol="__x", labelCol=label, regParam=1.0 / (C * max(n, 1)), maxIter=max_iter,
                    **({"weightCol": weight} if weight else {}))
    m = Pipeline(stages=[_assembler(features), svc]).fit(df)
    return Fitted(name, "decision", features, key, m, {"family": "svm"})


def rff_params(d: int, D: int, gamma: float, seed: int = 42) -> tuple[list[list[float]], list[float]]:
    W, b = margins.frequencies(d, D, seed)
    return (math.sqrt(gamma) * W).tolist(), b.tolist()


def rff_transform(df: DataFrame, features: list[str], W, b, out: str) -> DataFrame:
    """z = sqrt(2/D) cos(W x + b) as a vector column: one matrix product an Arrow batch."""
    W, b = np.asarray(W), np.asarray(b)

    @F.pandas_udf(ArrayType(DoubleType()))
    def mapped(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
        return pd.Series(list(math.sqrt(2.0 / len(b)) * np.cos(x @ W.T + b)))

    return df.withColumn(out, array_to_vector(mapped(*[F.col(c).cast("double") for c in features])))


def fit_rbf_svm(df: DataFrame, features: list[str], label: str, key: str, name: str = "RSVM",
                C: float = 8.5317, gamma: float = 0.6952, D: int = 256, max_iter: int = 500,
                tol: float = 0.1, seed: int = 42) -> Fitted:
    W, b = rff_params(len(features), D, gamma, seed)
    z = rff_transform(df, features, W, b, "__rff")
    n = df.count()
    svc = LinearSVC(featuresCol="__rff", labelCol=label, regParam=1.0 / (C * max(n, 1)), maxIter=max_iter,
                    tol=min(tol, 1e-3))
    m = svc.fit(z)
    return Fitted(name, "decision", features, key, m, {"family": "rff", "W": W, "b": b})


def class_replication(df: DataFrame, label: str, weights: dict[int, int]) -> DataFrame:
    """Replicate rows per class (integer copies), e.g. {0: 4, 1: 11}."""
    w = F.lit(1)
    for cls, k in weights.items():
        w = F.when(F.col(label) == cls, F.lit(int(k))).otherwise(w)
    return replicate_by_weight(df.withColumn("__w", w), "__w").drop("__w")


def balanced_copies(df: DataFrame, label: str, positive_boost: float = 1.0, tolerance: float = 0.05, most: int = 8) -> dict[int, int]:
    """Whole copies per class in the ratio of ``profile.class_weights``.

    The rarest weight gets the fewest copies ``m`` in 1..``most`` with which every
    class is within ``tolerance`` of its weight (else the ``m`` that comes closest).
    Rows without a label have no class.  For labels of few classes.
    """
    rows = profile.class_weights(df.where(F.col(label).isNotNull()), label, positive_boost, digits=None).collect()
    if not rows:
        return {}
    least = min(r["weight"] for r in rows)
    ratio = {r["label"]: r["weight"] / least for r in rows}
    error = {m: max(abs(round(x * m) / m - x) / x for x in ratio.values()) for m in range(1, most + 1)}
    m = next((m for m, e in error.items() if e <= tolerance), min(error, key=error.get))
    return {c: round(x * m) for c, x in ratio.items()}


def fit_mlp(df: DataFrame, features: list[str], label: str, key: str, name: str = "ANN",
            hidden: list[int] = (32,), max_iter: int = 100, seed: int = 42,
            class_copies: dict[int, int] | str | None = None, initial_weights=None, block_size: int = 128) -> Fitted:
    if class_copies == "balanced":
        class_copies = balanced_copies(df, label)
    data = class_replication(df, label, class_copies) if class_copies else df
    # rows of equal cost, dealt evenly: an iteration takes as long as its largest task
    data = data.repartition(df.sparkSession.sparkContext.defaultParallelism)
    layers = [len(features), *hidden, 2]
    kw = {"initialWeights": initial_weights} if initial_weights is not None else {}
    mlp = MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=layers, maxIter=max_iter,
                                         seed=seed, blockSize=block_size, **kw)
    m = Pipeline(stages=[_assembler(features), mlp]).fit(data)
    return Fitted(name, "probability", features, key, m, {"family": "mlp", "layers": layers})


def mlp_weights(f: Fitted):
    return f.model.stages[-1].weights


def fit_knn(df: DataFrame, features: list[str], label: str, key: str, name: str = "KNN", k: int = 22,
            metric: str = "chebyshev") -> Fitted:
    """The 'model' is the training frame itself (vectors + labels)."""
    train = neighbors.as_vector(df, key, features, label)
    return Fitted(name, "probability", features, key, train, {"family": "knn", "k": k, "metric": metric})


def _knn_score(f: Fitted, df: DataFrame) -> DataFrame:
    q = neighbors.as_vector(df, f.key, f.features).select("key", "vec")
    p = neighbors.knn_classify(f.model, q, f.extra["k"], f.extra["metric"])
    p = p.select(F.col("key").alias(f.key), F.col("p_pos").alias(f.name))
    return df.join(p, f.key, "left")
