"""Interquartile-range outlier bounds and filters.

NULL is never an outlier.  A plain ``between(lo, hi)`` filter would drop NULL
rows (three-valued logic), so the predicate is ``NOT coalesce(any_outside, false)``.
Values equal to a bound stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles

BOUNDS_SCHEMA = "column_name STRING, q1 DOUBLE, q3 DOUBLE, iqr DOUBLE, lower_bound DOUBLE, upper_bound DOUBLE"


def iqr_bounds(df: DataFrame, columns: list[str] | None = None, *, exclude: list[str] = (),
               factor: float = 1.5, method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """One row per column, sorted by column name (the column-difference order).

    ``method="exact"`` uses the bracketing exact quantiles; ``"approx"`` uses
    ``percentile_approx`` (one pass, rank error 1/accuracy).
    """
    spark = df.sparkSession
    cols = sorted(set(columns if columns is not None else df.columns) - set(exclude))
    rows = []
    if method == "exact":
        qs = exact_quantiles(df, cols, [0.25, 0.75])
        for c in cols:
            q1, q3 = qs[c][0.25], qs[c][0.75]
            rows.append(_bound_row(c, q1, q3, factor))
    elif method == "approx":
        r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], accuracy).alias(c)
                     for c in cols]).collect()[0]
        for c in cols:
            q = r[c]
            rows.append(_bound_row(c, q[0] if q else None, q[1] if q else None, factor))
    else:
        raise ValueError(method)
    return spark.createDataFrame(rows, BOUNDS_SCHEMA)


def _bound_row(c, q1, q3, factor):
    if q1 is None or q3 is None:
        return (c, q1, q3, None, None, None)
    iqr = q3 - q1
    return (c, float(q1), float(q3), float(iqr), float(q1 - factor * iqr), float(q3 + factor * iqr))


def bounds_dict(bounds: DataFrame | dict) -> dict[str, tuple[float, float]]:
    """{column: (lower, upper)}; the bounds table has one row per column."""
    if isinstance(bounds, dict):
        out = {}
        for c, b in bounds.items():
            out[c] = (b["lower_bound"], b["upper_bound"]) if isinstance(b, dict) else tuple(b)
        return out
    return {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}


def outside(c: str, lo: float | None, hi: float | None) -> Column:
    """TRUE outside the bounds, FALSE inside, NULL when the value is NULL."""
    col = F.col(c)
    parts = []
    if lo is not None:
        parts.append(col < F.lit(lo))
    if hi is not None:
        parts.append(col > F.lit(hi))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def outlier_predicate(df: DataFrame, bounds: DataFrame | dict) -> Column:
    """TRUE when *any* bounded column present in ``df`` is outside (strict)."""
    b = bounds_dict(bounds)
    parts = [F.coalesce(outside(c, lo, hi), F.lit(False)) for c, (lo, hi) in b.items() if c in df.columns]
    return reduce(lambda a, x: a | x, parts) if parts else F.lit(False)


def outlier_filter(df: DataFrame, bounds: DataFrame | dict) -> DataFrame:
    """Keep rows with no column outside its bounds; absent columns are skipped."""
    return df.where(~outlier_predicate(df, bounds))


def outlier_flags(df: DataFrame, bounds: DataFrame | dict, prefix: str = "out_") -> DataFrame:
    b = bounds_dict(bounds)
    return df.select("*", *[F.coalesce(outside(c, lo, hi), F.lit(False)).alias(prefix + c)
                            for c, (lo, hi) in b.items() if c in df.columns])


def outlier_counts(df: DataFrame, bounds: DataFrame | dict) -> DataFrame:
    """(column_name, n_outliers) per bounded column plus a ``__any__`` row: rows removed.

    One scan; each count is a ``count_if`` of the column's own test.
    """
    b = {c: v for c, v in bounds_dict(bounds).items() if c in df.columns}
    aggs = [F.count_if(F.coalesce(outside(c, lo, hi), F.lit(False))).alias(c) for c, (lo, hi) in b.items()]
    aggs.append(F.count_if(outlier_predicate(df, b)).alias("__any__"))
    row = df.agg(*aggs)
    names = list(b) + ["__any__"]
    return row.unpivot([], names, "column_name", "n_outliers")


def remove_outliers_self(df: DataFrame, columns: list[str], factor: float = 1.5,
                         method: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bounds from the frame itself, then filter. Returns (kept, bounds, counts)."""
    bounds = iqr_bounds(df, columns, factor=factor, method=method)
    b = bounds_dict(bounds)
    return outlier_filter(df, b), bounds, outlier_counts(df, b)
