"""Row-local cleaning: zero-as-missing, required-column drops, text parsing,
input-domain validation, label decoding.  All are projections / filters that
Catalyst fuses into the scan stage (no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.missing import zero_as_missing as _zam, nan_to_null
from tessera.functions.numeric import decode_label, parse_double, strip_text


def columns_except(df: DataFrame, exclude: list[str]) -> list[str]:
    """Column-list difference, sorted (the order the bounds table uses)."""
    return sorted(set(df.columns) - set(exclude))


def zero_as_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 -> NULL in the listed columns that exist (absent ones are skipped)."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: _zam(c) for c in present})


def nan_as_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or [f.name for f in df.schema.fields
                       if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in cols})


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows missing any of ``subset``."""
    return df.na.drop(how="any", subset=subset)


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Raise when required columns are absent (input validation at the edge)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def parse_inputs(df: DataFrame, key: str, columns: list[str], zero_missing: list[str] = ()) -> DataFrame:
    """Text fields -> doubles: trim, blank -> NULL, non-numeric -> rejected.

    Returns key, parsed columns, ``rejected`` (array of field names that were
    non-blank but not numeric) and ``ok``.
    """
    parsed = {c: parse_double(c) for c in columns}
    for c in zero_missing:
        if c in parsed:
            parsed[c] = F.nullif(parsed[c], F.lit(0.0))
    bad = [F.when(strip_text(c).isNotNull() & parse_double(c).isNull(), F.lit(c)) for c in columns]
    rejected = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return df.select(F.col(key), *[v.alias(c) for c, v in parsed.items()],
                     rejected.alias("rejected"), (F.size(rejected) == 0).alias("ok"))


def domain_violations(df: DataFrame, key: str, domains: dict[str, tuple[float, float]]) -> DataFrame:
    """Per row: which fields are outside their allowed [min, max] (NULL passes)."""
    flags = [F.when(F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)), F.lit(c))
             for c, (lo, hi) in domains.items()]
    bad = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return df.select(F.col(key), bad.alias("violations"), F.size(bad).alias("n_violations"))


def domain_summary(df: DataFrame, domains: dict[str, tuple[float, float]]) -> DataFrame:
    """(column_name, lo, hi, n_below, n_above) in one scan."""
    aggs = []
    for i, (c, (lo, hi)) in enumerate(domains.items()):
        aggs += [F.count_if(F.col(c) < lo).alias(f"b{i}"), F.count_if(F.col(c) > hi).alias(f"a{i}")]
    row = df.agg(*aggs)
    stack = [F.struct(F.lit(c).alias("column_name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                      F.col(f"b{i}").alias("n_below"), F.col(f"a{i}").alias("n_above"))
             for i, (c, (lo, hi)) in enumerate(domains.items())]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


def unknown_as_missing(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Column -> NULL where its 'unknown' flag column is true."""
    return df.withColumns({c: F.when(F.col(f), F.lit(None)).otherwise(F.col(c)) for c, f in flags.items()})


def decode(df: DataFrame, column: str, positive: str, negative: str, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or f"{column}_text", decode_label(column, positive, negative))


def correct_flag(label: str, prediction: str) -> Column:
    """(label = prediction); NULL when there is no label."""
    return F.col(label) == F.col(prediction)


def row_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows by key (no positional identity in Spark).

    ``value`` is one key (a filter pushed to the scan) or a DataFrame of keys
    in column ``key`` (a left-semi join: each matching row once, no
    duplication by repeated keys; AQE broadcasts a small key set)."""
    if isinstance(value, DataFrame):
        return df.join(value.select(key), key, "left_semi")
    return df.where(F.col(key) == F.lit(value))


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
