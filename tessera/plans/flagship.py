"""Flagship plan: the training-data quality pass on one table.

zero-as-missing -> exact IQR bounds (from the table itself) -> outlier filter
-> missing profile of the kept rows, with per-column outlier counts.

After the bounds (three small-output passes), the profile of the kept rows
and the outlier counts come from ONE conditional aggregate over the table:
``kept`` is the row-level filter predicate, so no filtered copy is scanned
twice and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import outliers
from tessera.plans.catalog import L, lineitem_features


def quality_report(df: DataFrame, columns: list[str], bounds: dict, digits: int = 2) -> DataFrame:
    """(column_name, n_rows, missing, missing_pct, n_outliers); n_rows / missing
    describe the rows the outlier filter keeps, n_outliers all rows."""
    kept = ~outliers.outlier_predicate(df, bounds)
    aggs = [F.count_if(kept).alias("__n")]
    for i, c in enumerate(columns):
        lo, hi = bounds.get(c, (None, None))
        aggs += [F.count_if(kept & F.col(c).isNull()).alias(f"m{i}"),
                 F.count_if(F.coalesce(outliers.outside(c, lo, hi), F.lit(False))).alias(f"o{i}")]
    row = df.agg(*aggs)
    pct = lambda i: F.round(F.when(F.col("__n") == 0, F.lit(0.0))                       # noqa: E731
                            .otherwise(F.col(f"m{i}") * 100.0 / F.col("__n")), digits)
    stack = [F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.col(f"m{i}").alias("missing"),
                      pct(i).alias("missing_pct"), F.col(f"o{i}").alias("n_outliers"))
             for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem_features(spark, sf_dir)
    bounds = outliers.bounds_dict(outliers.iqr_bounds(df, L))
    return quality_report(df, L, bounds)
