"""Profiling aggregates: counts, missing share, frequencies, correlations.

Each statistic over many columns is one fused aggregate (one scan, map-side
partial aggregation) and is then unpivoted into a long table, instead of one
pass per column or per column pair.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def missing_profile(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(column_name, n_rows, missing, missing_pct) -- one scan for all columns."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = df.agg(*aggs)
    long = wide.unpivot(["__n"], columns, "column_name", "missing")
    return long.select(
        "column_name",
        F.col("__n").alias("n_rows"),
        F.col("missing"),
        F.round(F.when(F.col("__n") == 0, F.lit(0.0))
                .otherwise(F.col("missing") * 100.0 / F.col("__n")), digits).alias("missing_pct"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) ordered by count desc, value asc."""
    return (df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("value")))


def pairwise_corr(a: str, b: str):
    """Pearson correlation over rows where both are non-NULL; NULL (not an
    error) when either side is constant.  Spark's ``corr`` divides by zero on
    a constant column, which raises under ANSI mode."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _with_share(counts: DataFrame, name: str, cnt: str, digits: int) -> DataFrame:
    """Share of each row of a per-group count table, however many groups: the
    total is one number, read first."""
    total = counts.agg(F.sum(cnt)).first()[0]
    return counts.select(name, cnt, F.round(F.col(cnt) / F.lit(total), digits).alias("share"))


def split_proportions(parts: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """(split, rows, share) of named parts; ``share`` = rows / sum(rows)."""
    counted = None
    for name, part in parts.items():
        c = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("split"), "rows")
        counted = c if counted is None else counted.unionByName(c)
    return _with_share(counted, "split", "rows", digits)


def class_proportions(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """(value, count, share) per label value: one grouped count, shares from its total."""
    vc = df.groupBy(F.col(label).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(vc, "value", "count", digits)


def corr_matrix(df: DataFrame, columns: list[str], digits: int | None = 6,
                include_diagonal: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (column_a, column_b, corr).

    Rows where either side is NULL are ignored (pandas' pairwise-complete
    rule); a constant column gives NULL.  All pairs are one aggregate.
    """
    pairs = list(combinations(columns, 2))
    aggs = [pairwise_corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    # diagonal: 1 when the column has two different non-null values (min < max)
    aggs += [(F.min(c) < F.max(c)).alias(f"d{j}") for j, c in enumerate(columns)]
    row = df.agg(*aggs)
    stack = []
    for i, (a, b) in enumerate(pairs):
        stack.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"{i}").alias("corr")))
        stack.append(F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"{i}").alias("corr")))
    if include_diagonal:
        for j, c in enumerate(columns):
            stack.append(F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"),
                                  F.when(F.col(f"d{j}"), F.lit(1.0)).alias("corr")))
    out = row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")
    if digits is not None:
        out = out.withColumn("corr", F.round("corr", digits))
    return out


def corr_with_label(df: DataFrame, columns: list[str], label: str, digits: int | None = 6) -> DataFrame:
    """(column_name, corr) with the label, sorted descending (one aggregate)."""
    row = df.agg(*[pairwise_corr(c, label).alias(c) for c in columns])
    out = row.unpivot([], columns, "column_name", "corr")
    if digits is not None:
        out = out.withColumn("corr", F.round("corr", digits))
    return out.orderBy(F.desc_nulls_last("corr"), "column_name")


def complete_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_a, column_b, n_complete) for all unordered pairs a < b, one scan."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{i}")
                   for i, (a, b) in enumerate(pairs)])
    stack = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                      F.col(f"{i}").alias("n_complete")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def class_weights(df: DataFrame, label: str, positive_boost: float = 1.5, positive=1,
                  digits: int | None = 4) -> DataFrame:
    """(label, n, weight) with weight = N / (n_classes * n_c), positive class x boost.

    One grouped count; the total and the number of classes are two numbers,
    read first: no global window, no join.
    """
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total, k = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    w = F.lit(total) / (F.lit(k) * F.col("n"))
    w = F.when(F.col("label") == F.lit(positive), w * positive_boost).otherwise(w)
    if digits is not None:
        w = F.round(w, digits)
    return counts.select("label", "n", w.alias("weight"))
