"""Element-wise operations of two values of one depth, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .depths import BYTES, INTEGRAL, TensorError, saturate, wrapped

COMPARISONS = ("EQ", "GT", "GE", "LT", "LE", "NE")
#: Operations that take integers only.
INTEGER_ONLY = frozenset(["AND", "OR", "XOR", "NOT", "MOD", "BITSHIFT"])
#: Operations whose results on integers are whole numbers of 64 bits before they are made elements.
_WHOLE = INTEGER_ONLY | {"ADD", "SUB", "MUL", "FMOD"}
ALIASES = {"SUM": "ADD", "EQUAL": "EQ", "GREATER": "GT", "GREATER_EQUAL": "GE", "LESS": "LT", "LESS_EQUAL": "LE"}


def compare(op: str, a: Column, b: Column) -> Column:
    """255 where the comparison holds, else 0; as for IEEE numbers, NaN is unequal to all."""
    if op not in COMPARISONS:
        raise TensorError(f"unknown comparison {op!r}")
    x, y = a.cast("double"), b.cast("double")
    test = {"EQ": x == y, "GT": x > y, "GE": x >= y, "LT": x < y, "LE": x <= y, "NE": x != y}[op]
    nan = F.isnan(x) | F.isnan(y)
    return F.when(test | nan if op == "NE" else test & ~nan, 255).otherwise(0)


def _divide(a: Column, b: Column, depth: str) -> Column:
    if depth in INTEGRAL:
        whole = a.cast("double") / F.when(b == 0, 1).otherwise(b).cast("double")
        return F.when(b == 0, 0.0).otherwise(F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("double"))
    x, y = a.cast("double"), b.cast("double")
    zero = F.lit(0.0) if depth == "16F" else F.when((x == 0) | F.isnan(x), float("nan")).otherwise(F.when(x > 0, float("inf")).otherwise(float("-inf")))
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, 1.0).otherwise(y))


def _shift(a: Column, b: Column, depth: str) -> Column:
    """Left for positive counts; right, without sign, on the lane's width for negative ones; 0 from the width on."""
    width = 8 * BYTES[depth]
    lane = a.cast("bigint").bitwiseAND(F.lit((1 << width) - 1))
    n = F.least(F.abs(b.cast("bigint")), F.lit(width)).cast("int")
    moved = F.when(n >= width, F.lit(0).cast("bigint")).when(b >= 0, F.call_function("shiftleft", lane, n)).otherwise(F.call_function("shiftrightunsigned", lane, n))
    kept = moved.bitwiseAND(F.lit((1 << width) - 1))
    return F.when(kept >= 1 << (width - 1), kept - (1 << width)).otherwise(kept) if depth in ("8S", "16S", "32S") else kept


def _product(i: Column, j: Column, depth: str) -> Column:
    """The product of two bigints; for 32-bit elements modulo 2^32, by halves, so that it stays in 64 bits."""
    if depth not in ("32S", "32U"):
        return i * j
    mask = F.lit((1 << 32) - 1)
    a, b = i.bitwiseAND(mask), j.bitwiseAND(mask)
    high = (F.shiftright(a, 16) * b).bitwiseAND(mask)
    return F.shiftleft(high, 16) + a.bitwiseAND(F.lit(0xFFFF)) * b


def binary(op: str, a: Column, b: Column, depth: str) -> Column:
    """The result of an operation on two values of *depth*, as an element of *depth* (comparisons: 8U)."""
    op = ALIASES.get(op, op)
    if op in COMPARISONS:
        return compare(op, a, b)
    if op in INTEGER_ONLY and depth not in INTEGRAL:
        raise TensorError(f"{op} takes integers, not {depth}")
    if depth in INTEGRAL:
        i, j = a.cast("bigint"), b.cast("bigint")
    else:
        i, j = a.cast("double"), b.cast("double")
    x, y = a.cast("double"), b.cast("double")
    safe = F.when(j == 0, F.lit(1)).otherwise(j)
    nan = F.isnan(x) | F.isnan(y)
    made = {
        "ADD": lambda: i + j, "SUB": lambda: i - j, "MUL": lambda: _product(i, j, depth) if depth in INTEGRAL else i * j, "DIV": lambda: _divide(a, b, depth),
        "AND": lambda: i.bitwiseAND(j), "OR": lambda: i.bitwiseOR(j), "XOR": lambda: i.bitwiseXOR(j), "NOT": lambda: i.bitwiseAND(F.bitwise_not(j)),
        "MOD": lambda: F.when(j == 0, 0).otherwise((i % safe + safe) % safe), "FMOD": lambda: F.when(j == 0, 0).otherwise(i % safe), "BITSHIFT": lambda: _shift(a, b, depth),
        "POW": lambda: F.pow(x, y), "MAX": lambda: F.when(nan, x).otherwise(F.greatest(x, y)), "MIN": lambda: F.when(nan, x).otherwise(F.least(x, y)),
        "ATAN2": lambda: F.atan2(x, y), "HYPOT": lambda: F.hypot(x, y), "MEAN": lambda: (x + y) * 0.5,
    }
    if op not in made:
        raise TensorError(f"unknown operation {op!r}")
    return wrapped(made[op]().cast("bigint"), depth) if depth in ("32S", "32U") and op in _WHOLE else saturate(made[op](), depth)


def add_weighted(a: Column, alpha: float, b: Column, beta: float, depth: str) -> Column:
    """``a * alpha + b * beta`` in double, saturated once."""
    return saturate(a.cast("double") * float(alpha) + b.cast("double") * float(beta), depth)
