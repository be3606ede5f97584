"""Min-max scaling with training statistics.

Own expressions rather than ``pyspark.ml.feature.MinMaxScaler``: a constant
column must map to 0 (range treated as 1), and test rows may leave [0, 1]
(no clipping).  The fit is one aggregate; the transform is a projection with
the statistics as literals (no join, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax_fit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min, max) -- one row per column, from one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(F.col(c).cast("double")).alias(f"mn{i}"), F.max(F.col(c).cast("double")).alias(f"mx{i}")]
    row = df.agg(*aggs)
    stack = [F.struct(F.lit(c).alias("column_name"), F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"))
             for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def stats_dict(stats: DataFrame | dict) -> dict[str, tuple[float, float]]:
    if isinstance(stats, dict):
        return {c: tuple(v) for c, v in stats.items()}
    return {r["column_name"]: (r["min"], r["max"]) for r in stats.collect()}      # one row per column


def minmax_transform(df: DataFrame, stats: DataFrame | dict, columns: list[str] | None = None,
                     suffix: str = "") -> DataFrame:
    """x -> (x - min) / (max - min); range 0 -> 1 (constant column maps to 0)."""
    st = stats_dict(stats)
    cols = columns or list(st)
    exprs = {}
    for c in cols:
        mn, mx = st[c]
        if mn is None:
            exprs[c + suffix] = F.lit(None).cast("double")
            continue
        rng = (mx - mn) or 1.0
        exprs[c + suffix] = (F.col(c).cast("double") - F.lit(mn)) / F.lit(rng)
    return df.withColumns(exprs)


def minmax_inverse(df: DataFrame, stats: DataFrame | dict, columns: list[str] | None = None) -> DataFrame:
    st = stats_dict(stats)
    cols = columns or list(st)
    return df.withColumns({c: F.col(c) * F.lit((st[c][1] - st[c][0]) or 1.0) + F.lit(st[c][0]) for c in cols})
