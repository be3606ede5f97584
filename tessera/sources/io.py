"""Sources and sinks: typed CSV / Parquet / JSON reads, validated batches,
literal single rows, table writes, statistics tables and model persistence.

CSV: header row, blank field = missing (NULL), explicit schema (no
inference in production).  Files are read and written by Spark executors, so
paths must be on storage every executor sees.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.clean import require_columns


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None,
               key: str | None = None) -> DataFrame:
    """Read a table; optionally attach a unique row key.

    The key from ``monotonically_increasing_id`` is an identity, not a
    position; operators never rely on it being consecutive.
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)
    elif fmt == "parquet":
        df = r.parquet(path)
    elif fmt == "json":
        df = r.json(path)
    else:
        raise ValueError(fmt)
    if key is not None and key not in df.columns:
        df = df.withColumn(key, F.monotonically_increasing_id())
    return df


def read_batch(spark: SparkSession, path: str, required: list[str], fmt: str = "csv",
               schema: str | T.StructType | None = None, key: str = "row_id") -> DataFrame:
    """User-supplied batch: read, check required columns, keep extra columns."""
    df = read_table(spark, path, fmt, schema, key)
    require_columns(df, required)
    return df


def single_row(spark: SparkSession, values: dict, schema: str | None = None, key: str = "row_id") -> DataFrame:
    """Literal one-row source (manual entry)."""
    row = {key: 0, **values}
    if schema is None:
        cols = ", ".join(f"{k} {'BIGINT' if k == key else 'DOUBLE'}" for k in row)
        schema = cols
    return spark.createDataFrame([tuple(row.values())], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)


def write_stats(stats: DataFrame, path: str) -> None:
    """Fitted statistics (bounds, min/max) as a small JSON table."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def bounds_to_json(bounds: DataFrame) -> str:
    """{column: {Q1, Q3, IQR, lower_bound, upper_bound}} (one row per column)."""
    out = {}
    for r in bounds.orderBy("column_name").collect():
        out[r["column_name"]] = {"Q1": r["q1"], "Q3": r["q3"], "IQR": r["iqr"],
                                 "lower_bound": r["lower_bound"], "upper_bound": r["upper_bound"]}
    return json.dumps(out, indent=4)


def bounds_from_json(text: str) -> dict[str, tuple[float, float]]:
    d = json.loads(text)
    return {c: (v["lower_bound"], v["upper_bound"]) for c, v in d.items()}


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
