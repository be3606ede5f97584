"""Small scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: Column | str) -> Column:
    """greatest(least(p, 1), 0)"""
    return F.greatest(F.least(_c(c), F.lit(1.0)), F.lit(0.0))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (metric convention for empty classes)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def threshold(p: Column | str, t: float = 0.5) -> Column:
    """Strict ``p > t`` as 0/1 integer."""
    return (_c(p) > F.lit(t)).cast("int")


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def relu(c: Column | str) -> Column:
    """``max(c, 0)``; NULL stays NULL (``greatest`` alone would give 0)."""
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(0.0)))


def tanh(c: Column | str) -> Column:
    return F.tanh(_c(c))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip_text(c: Column | str) -> Column:
    """The field without white space (tabs and line ends too) around it; blank -> NULL."""
    return F.nullif(F.regexp_replace(_c(c).cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def parse_double(c: Column | str) -> Column:
    """strip, blank -> NULL, decimal number -> double, else NULL (``1.5d``, ``nan``, ``inf``; rejects are detected by the caller)."""
    t = strip_text(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def decode_label(c: Column | str, positive: str, negative: str) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit(None)).when(c == 1, F.lit(positive)).otherwise(F.lit(negative))


def format_percent(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _c(c) * 100)


def format_fixed(c: Column | str, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", _c(c))
