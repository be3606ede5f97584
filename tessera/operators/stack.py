"""Score stack: normalisation of base scores, weighted unions, scored export.

Batch normalisation ``(s - min) / (max - min + 1e-8)`` needs the min and max
over the scored frame: they come from one aggregate (one row, partial
aggregation per task) and enter the projection as literals -- no global
window, no join.  ``mode="fitted"`` uses stored training min/max and clamps
to [0, 1], which makes scoring row-local (single rows, streams).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import clamp01, decode_label, threshold

NORM_EPS = 1e-8


def score_range(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(columns)}


def normalize_scores(df: DataFrame, columns: list[str], mode: str = "batch",
                     fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Decision values -> [0, 1]-ish scores.

    batch: min/max of this frame (a one-row frame gives 0 for every score);
    fitted: the given training min/max, result clamped to [0, 1].
    """
    if mode == "batch":
        rng = score_range(df, columns)
        exprs = {c: (F.col(c) - F.lit(mn)) / F.lit((mx - mn) + NORM_EPS) for c, (mn, mx) in rng.items()
                 if mn is not None}
    elif mode == "fitted":
        if fitted is None:
            raise ValueError("mode='fitted' needs the training min/max")
        exprs = {c: clamp01((F.col(c) - F.lit(mn)) / F.lit((mx - mn) + NORM_EPS)) for c, (mn, mx) in fitted.items()}
    else:
        raise ValueError(mode)
    return df.withColumns(exprs)


def weighted_union(parts: list[tuple[DataFrame, float]], weight_col: str = "w") -> DataFrame:
    """Vertical union by column name with a per-part sample weight.

    A weight of 2 is the same as listing the rows twice (in every weighted sum).
    """
    tagged = [p.withColumn(weight_col, F.lit(float(w))) for p, w in parts]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def replicate_by_weight(df: DataFrame, weight_col: str) -> DataFrame:
    """Whole weights as row copies (for learners without a weight column).

    Fractions are cut off; rows of a weight below 1 or NULL have no copy.
    """
    return (df.where(F.col(weight_col) >= 1).withColumn("__rep", F.explode(F.sequence(F.lit(1), F.col(weight_col).cast("int"))))
            .drop("__rep"))


def scored_export(df: DataFrame, prob: str, label: str | None = None, t: float = 0.5,
                  positive_text: str = "Positive", negative_text: str = "Negative") -> DataFrame:
    """Input columns + predicted_probability + predicted_outcome (+ text, correct flag)."""
    out = df.withColumn("predicted_probability", F.col(prob)) \
            .withColumn("predicted_outcome", threshold(prob, t)) \
            .withColumn("outcome_text", decode_label("predicted_outcome", positive_text, negative_text))
    if label is not None:
        out = out.withColumn("correct", F.col(label) == F.col("predicted_outcome"))
    return out
