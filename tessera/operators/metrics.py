"""Classification and regression metrics as single-pass aggregates.

Every metric table is computed from a handful of ``count_if`` / ``sum``
aggregates (partial aggregation per task, one tiny final merge); grouping
columns (model, split, ...) turn the same code into a comparison table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def confusion_counts(df: DataFrame, label: str, pred: str, group: list[str] = (), positive=1) -> DataFrame:
    """(group..., tp, fp, fn, tn) -- one aggregate."""
    y, p = F.col(label) == positive, F.col(pred) == positive
    aggs = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(actual, predicted, count) for every observed pair."""
    return (df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("count")))


def binary_metrics(df: DataFrame, label: str, pred: str, group: list[str] = (), positive=1,
                   digits: int | None = 6) -> DataFrame:
    """accuracy, precision, recall, f1 of the positive class; 0 on zero denominators."""
    c = confusion_counts(df, label, pred, group, positive)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    cols = {
        "accuracy": _div(tp + tn, tp + fp + fn + tn),
        "precision": _div(tp, tp + fp),
        "recall": _div(tp, tp + fn),
        "f1": _div(2 * tp, 2 * tp + fp + fn),
    }
    if digits is not None:
        cols = {k: F.round(v, digits) for k, v in cols.items()}
    return c.select(*group, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in cols.items()])


def f1_stabilised(precision: Column, recall: Column, eps: float = 1e-7) -> Column:
    return 2 * precision * recall / (precision + recall + F.lit(eps))


def classification_report(df: DataFrame, label: str, pred: str, digits: int | None = 6) -> DataFrame:
    """Per-class precision/recall/f1/support, then accuracy, macro avg, weighted avg.

    Output (row_name, precision, recall, f1, support).  Per-class counts come
    from one grouped aggregate over (label, pred) pairs; the rest is over that
    tiny table.
    """
    pairs = confusion_matrix(df, label, pred)
    # each observed (actual, predicted) pair feeds its actual class (support,
    # hits) and its predicted class (predicted positives): no join needed
    fed = pairs.select(F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), F.col("count").alias("support"), F.lit(0).cast("long").alias("pp"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("count").alias("pp"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = fed.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("support").alias("support"))
    per = per.select(F.col("cls").cast("string").alias("row_name"),
                     _div(F.col("tp"), F.col("pp")).alias("precision"),
                     _div(F.col("tp"), F.col("support")).alias("recall"),
                     _div(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"),
                     F.col("support").cast("long").alias("support"), "tp")
    summ = per.agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("long").alias("sup"))
    rows = summ.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("row_name"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("sup").alias("support")),
        F.struct(F.lit("macro avg").alias("row_name"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("sup").alias("support")),
        F.struct(F.lit("weighted avg").alias("row_name"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("sup").alias("support")),
    )).alias("s")).select("s.*")
    out = per.select("row_name", "precision", "recall", "f1", "support").unionByName(rows)
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})
    return out


def regression_metrics(df: DataFrame, y: str, p: str, group: list[str] = (), digits: int | None = 6) -> DataFrame:
    """(group..., n, mse, r2) with r2 = 1 - SSE / SST (not squared correlation).

    SST = n * var_pop(y); computed from sums in one pass.
    """
    e = F.col(y).cast("double") - F.col(p).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"),
            F.sum(e * e).alias("sse"), F.var_pop(F.col(y).cast("double")).alias("vp")]
    base = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    r2 = F.when(F.col("vp") == 0, F.lit(None)).otherwise(1 - F.col("sse") / (F.col("vp") * F.col("n")))
    out = base.select(*group, "n", "mse", r2.alias("r2"))
    if digits is not None:
        out = out.withColumns({"mse": F.round("mse", digits), "r2": F.round("r2", digits)})
    return out


def overfit_bucket(gap: Column) -> Column:
    """R^2 gap (train - validation): > 0.3 significant, > 0.1 moderate, else minimal."""
    return (F.when(gap > 0.3, F.lit("significant"))
            .when(gap > 0.1, F.lit("moderate")).otherwise(F.lit("minimal")))


def log_loss(df: DataFrame, y: str, p: str, group: list[str] = (), eps: float = 1e-7,
             digits: int | None = 6) -> DataFrame:
    """Mean binary cross-entropy with p clipped to [eps, 1-eps]."""
    pc = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - eps)), F.lit(eps))
    yy = F.col(y).cast("double")
    ll = -(yy * F.log(pc) + (1 - yy) * F.log(1 - pc))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(ll).alias("log_loss")]
    out = df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)
    if digits is not None:
        out = out.withColumn("log_loss", F.round("log_loss", digits))
    return out


def best_model_diff(metrics: DataFrame, model_col: str = "model", meta_name: str = "meta",
                    by: str = "accuracy", measures=("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """Best base model by ``by`` (ties: smallest model name) and meta minus best.

    ``metrics`` has one row per model -- a small table.
    Output: (best_model, metric, best_value, meta_value, diff).
    """
    is_meta = F.col(model_col) == meta_name
    # best base: smallest (-score, name) -- one aggregate over the per-model table
    order = F.struct((-F.col(by)).alias("o"), F.col(model_col).alias("n"))
    row = metrics.agg(
        F.min_by(F.struct(F.col(model_col).alias("model"), *[F.col(m).alias(m) for m in measures]),
                 F.when(~is_meta, order)).alias("b"),
        *[F.max(F.when(is_meta, F.col(m))).alias(f"meta_{m}") for m in measures])
    stack = [F.struct(F.col("b.model").alias("best_model"), F.lit(m).alias("metric"),
                      F.col(f"b.{m}").alias("best_value"), F.col(f"meta_{m}").alias("meta_value"),
                      F.round(F.col(f"meta_{m}") - F.col(f"b.{m}"), 6).alias("diff")) for m in measures]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def top_k(df: DataFrame, score: str, k: int, tie: str | list[str]) -> DataFrame:
    """First k rows by score desc, then the tie column(s) asc (a top-k report).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own k best, only k rows per task reach the final merge.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    return df.orderBy(F.desc(score), *[F.asc(t) for t in ties]).limit(k)
