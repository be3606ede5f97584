"""Structured Streaming paths.

The reference reads complete files only; these are the streaming forms of
its row-local steps.  Zero-as-missing, outlier flags, min-max scaling with
training statistics, fuzzy memberships with fixed centres and boosted-tree
imputation (``model.transform``) are per-row, so they run directly on a
streaming DataFrame.  Steps that need the whole scored batch (KNN top-k,
batch score normalisation) run per micro-batch in ``foreachBatch``, with
``mode="fitted"`` normalisation so a row's score does not depend on which
micro-batch it lands in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import clean, fuzzy, outliers, scale


def row_local_chain(stream: DataFrame, *, zero_missing: list[str] = (), bounds: dict | None = None,
                    scaler: dict | None = None, centers: list[list[float]] | None = None,
                    features: list[str] | None = None, imputers: list[tuple[str, object]] = ()) -> DataFrame:
    """zero-as-missing -> impute (fitted models) -> outlier flag -> scale -> memberships."""
    out = clean.zero_as_missing(stream, list(zero_missing))
    from tessera.operators.impute import apply_imputer
    for target, model in imputers:
        out = apply_imputer(out, model, target)
    if bounds:
        out = out.withColumn("is_outlier", outliers.outlier_predicate(out, bounds))
    if scaler:
        out = scale.minmax_transform(out, scaler, features or list(scaler))
    if centers:
        out = fuzzy.memberships(out, features or list(scaler), centers, 2.0)
    return out


def running_missing_profile(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Running (column_name, n_rows, missing) totals; use outputMode('complete')."""
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = stream.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.col(c).alias("missing"))
        for c in columns])).alias("s")).select("s.*")


def batch_scorer(score: Callable[[DataFrame], DataFrame], sink_path: str, fmt: str = "parquet"):
    """``foreachBatch`` function: score the micro-batch, write it under
    ``sink_path/batch_id=N`` (overwrite of that one folder), so a replayed
    batch after a failure replaces its own output instead of duplicating it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        out = score(batch)
        out.write.mode("overwrite").format(fmt).save(f"{sink_path}/batch_id={batch_id}")
    return run


def start_scoring_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink_path: str,
                         checkpoint: str, available_now: bool = True):
    """Start a foreachBatch scoring query with its own checkpoint folder."""
    w = stream.writeStream.foreachBatch(batch_scorer(score, sink_path)).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
