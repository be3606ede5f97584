"""Column-expression helpers (all JVM-side, whole-stage-codegen friendly)."""

from tessera.functions.missing import zero_as_missing, nan_to_null, is_missing
from tessera.functions.numeric import (
    clamp01, safe_div, threshold, parse_double, decode_label, sigmoid, relu, tanh,
    format_percent, format_fixed,
)

__all__ = [
    "zero_as_missing", "nan_to_null", "is_missing",
    "clamp01", "safe_div", "threshold", "parse_double", "decode_label", "sigmoid", "relu", "tanh",
    "format_percent", "format_fixed",
]
