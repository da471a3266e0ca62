"""Border rules: which source coordinate a coordinate outside an image reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .depths import TensorError

MODES = ("CONSTANT", "REPLICATE", "REFLECT", "WRAP", "REFLECT_101")
#: What filters take.
FILTER_MODES = ("CONSTANT", "REPLICATE", "REFLECT", "REFLECT_101")
DEFAULT = "REFLECT_101"


def source(p: Column, n: Column, mode: str) -> Column:
    """The source coordinate of *p* along an axis of length *n*; null where a constant is read."""
    if mode == "CONSTANT":
        return F.when((p >= 0) & (p < n), p)
    if mode == "REPLICATE":
        return F.greatest(F.lit(0), F.least(n - 1, p))
    if mode == "WRAP":
        return F.pmod(p, n)
    if mode == "REFLECT":
        q = F.pmod(p, 2 * n)
        return F.when(q < n, q).otherwise(2 * n - 1 - q)
    if mode == "REFLECT_101":
        return F.when(n == 1, 0).otherwise((n - 1) - F.abs(F.pmod(p, F.greatest(2 * (n - 1), F.lit(1))) - (n - 1)))
    raise TensorError(f"unknown border {mode!r}")


def check_filter(mode: str) -> str:
    if mode not in FILTER_MODES:
        raise TensorError(f"filters do not take border {mode!r}")
    return mode
