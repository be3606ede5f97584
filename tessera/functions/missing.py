"""Missing-value expressions.

Missing is always SQL NULL, never NaN: NaN compares greater than every number
in Spark, so a NaN left in a column would be flagged by every ``> bound`` test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL (ingest rule)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def zero_as_missing(c: Column | str) -> Column:
    """0 (and -0.0) -> NULL; NaN -> NULL as well."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(nan_to_null(c), F.lit(0))


def is_missing(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull()
