"""Element depths, saturating conversion and scalars, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth codes; a type code is depth + (channels - 1) * 32.
CODES = {"8U": 0, "8S": 1, "16U": 2, "16S": 3, "32F": 4, "32S": 5, "32U": 6, "16F": 7, "64F": 8}
BYTES = {"8U": 1, "8S": 1, "16U": 2, "16S": 2, "32F": 4, "32S": 4, "32U": 4, "16F": 2, "64F": 8}
#: Least and greatest values of the depths that clip.
LIMITS = {"8U": (0, 255), "8S": (-128, 127), "16U": (0, 65535), "16S": (-32768, 32767)}
#: Spark's storage of an element.
STORAGE = {"8U": "int", "8S": "int", "16U": "int", "16S": "int", "32S": "int", "32U": "bigint", "16F": "float", "32F": "float", "64F": "double"}
INTEGRAL = frozenset(["8U", "8S", "16U", "16S", "32S", "32U"])
MAX_CHANNELS = 128


class TensorError(ValueError):
    """A parameter that an operator does not take."""


def check_depth(depth: str) -> str:
    if depth not in CODES:
        raise TensorError(f"unknown depth {depth!r}")
    return depth


def type_code(depth: str, channels: int = 1) -> int:
    """The type code of a depth and channel count."""
    if not 1 <= channels <= MAX_CHANNELS:
        raise TensorError(f"channels {channels} not in 1..{MAX_CHANNELS}")
    return CODES[check_depth(depth)] + (channels - 1) * 32


def from_type_code(code: int) -> tuple[str, int]:
    """Depth and channel count of a type code."""
    by = {v: k for k, v in CODES.items()}
    if code < 0 or code % 32 not in by:
        raise TensorError(f"unknown type code {code}")
    return by[code % 32], code // 32 + 1


def half(v: Column) -> Column:
    """A double rounded to the nearest half-precision value, ties to even."""
    x = F.abs(v)
    e = F.greatest(F.floor(F.log2(F.when(x > 0, x).otherwise(1.0))), F.lit(-14))
    # the logarithm may be off by one beside a power of two
    e = F.when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).when((F.pow(F.lit(2.0), e) > x) & (e > -14), e - 1).otherwise(e)
    step = F.pow(F.lit(2.0), e - 10)
    near = F.rint(x / step) * step
    out = F.when(near >= 65520, F.lit(float("inf"))).otherwise(near)
    return F.when(F.isnan(v) | (x == float("inf")), v).otherwise(F.when(v < 0, -out).otherwise(out)).cast("float")


def saturate(v: Column, depth: str) -> Column:
    """*v* as an element of *depth*: rounds half away from zero and clips narrow integers; 32-bit integers wrap.

    What is not a number becomes 0 in integers, and so do infinities in 32-bit ones.
    """
    check_depth(depth)
    x = v.cast("double")
    if depth in LIMITS:
        low, high = LIMITS[depth]
        return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.round(F.nanvl(x, F.lit(0.0))))).cast("int")
    if depth in ("32S", "32U"):
        finite = F.when(F.abs(x) < float("inf"), x).otherwise(0.0)  # false for NaN, which counts as greatest
        if depth == "32S":
            return (F.pmod(F.round(finite) + 2147483648.0, F.lit(4294967296.0)) - 2147483648.0).cast("int")
        return F.pmod(F.round(finite), F.lit(4294967296.0)).cast("bigint")
    if depth == "16F":
        return half(x)
    return v.cast(STORAGE[depth])


def wrapped(v: Column, depth: str) -> Column:
    """A bigint as an element of 32S or 32U, exact modulo 2^32."""
    lane_ = v.bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(lane_ >= 1 << 31, lane_ - (1 << 32)).otherwise(lane_).cast("int") if depth == "32S" else lane_


def lanes(value, channels: int, depth: str) -> list[float]:
    """A number or up to four lanes as one value a channel; missing lanes are 0, integers are clipped to *depth*."""
    if isinstance(value, (int, float)):
        found = [float(value)] * channels
    else:
        if channels > 4 or len(value) > 4:
            raise TensorError("a scalar has at most 4 lanes")
        found = [*map(float, value), 0.0, 0.0, 0.0, 0.0][:channels]
    if depth in LIMITS:
        low, high = LIMITS[depth]
        found = [min(high, max(low, int(abs(x) + 0.5) * (1 if x >= 0 else -1))) for x in found]
    return found


def lane(value, channels: int, depth: str, c: Column) -> Column:
    """The scalar's value for the channel in column *c*."""
    found = lanes(value, channels, depth)
    if len(set(found)) == 1:
        return F.lit(float(found[0]))
    return F.element_at(F.array(*[F.lit(float(x)) for x in found]), (c + 1).cast("int"))
