"""Row-wise normalisations, activations and position rotation, over columns or arrays.

Relational forms take rows of a relation: a state is added up by row, in parts, and goes back to
the rows by a join, so a row may have any number of values.  Array forms keep a whole vector in one row and need
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.depths import TensorError, half

PRECISIONS = {"fp32": "FP32", "float32": "FP32", "fp16": "FP16", "float16": "FP16", "half": "FP16", "int8": "INT8", "i8": "INT8"}


def precision(name: str) -> str:
    """The runtime precision that a name means."""
    if name.lower() not in PRECISIONS:
        raise TensorError(f"unknown precision {name!r}")
    return PRECISIONS[name.lower()]


def shape_to_str(shape: Column) -> Column:
    """A shape as text."""
    return F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), ", "), F.lit("]"))


def align_precision(v: Column, name: str) -> Column:
    """A 32F value, through half precision where the name says so."""
    return half(v.cast("double")) if precision(name) == "FP16" else v.cast("float")


def silu(v: Column) -> Column:
    x = v.cast("double")
    return x / (1 + F.exp(-x))


#: Width of the steps by which exponents are rescaled; exp of a step is far from overflow.
STEP = 64.0


def _beside(frame: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
    """*frame* with the state of its keys, null keys among them; one row of state a key, so a long row is split over tasks."""
    named = state.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    met = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    return frame.join(named, met, "left").drop(*[f"_k{n}" for n in range(len(keys))])


def _softmax(frame: DataFrame, keys: list[str], x: Column, shown: Column) -> DataFrame:
    """*frame* with ``softmax`` over the *shown* rows of each key, and 0 in the others.

    The sum of exponentials is kept by steps of the exponent: each step's sum is rescaled by its own step and is added
    up in any order, in parts, before the shuffle.  The steps of a key then meet at the greatest one.  What is not
    a number, or infinite, makes its key's results so.
    """
    bad = F.isnan(x) | (x == float("inf"))
    step = F.when(~bad & (x > float("-inf")), F.floor(x / STEP).cast("double"))
    parts = frame.filter(shown & x.isNotNull()).groupBy(*keys, step.alias("_step")).agg(F.sum(F.exp(x - F.coalesce(step, F.lit(0.0)) * STEP)).alias("_part"), F.max(bad).alias("_bad"))
    steps = F.collect_list(F.when(F.col("_step").isNotNull(), F.struct("_step", "_part")))
    met = parts.groupBy(*keys).agg(steps.alias("_parts"), F.max("_step").alias("_top"), F.max("_bad").alias("_bad"))
    total = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["_part"] * F.exp((p["_step"] - F.col("_top")) * STEP))
    state = met.select(*keys, "_top", F.when(F.col("_bad"), float("nan")).otherwise(total).alias("_total"))
    made = F.when(F.col("_top").isNull() | F.isnan("_total"), F.lit(float("nan"))).otherwise(F.exp(x - F.col("_top") * STEP) / F.col("_total"))
    return _beside(frame, keys, state).withColumn("softmax", F.when(shown & x.isNull(), None).when(shown, made).otherwise(0.0)).drop("_top", "_total")


def softmax(frame: DataFrame, row: list[str], value: str = "v", scale: float = 1.0) -> DataFrame:
    """Adds ``softmax`` over the rows that share the *row* columns, of any number."""
    return _softmax(frame, row, F.col(value).cast("double") * scale, F.lit(True))


def softmax_array(data: Column) -> Column:
    """Softmax of an array of numbers, first element to last."""
    x = F.transform(data, lambda v: v.cast("double"))
    shifted = F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(F.array_max(x), F.size(x)).alias("m")), lambda s: F.exp(s["v"] - s["m"]))
    return scaled_by_sum(shifted)


def scaled_by_sum(values: Column) -> Column:
    """An array divided by its sum."""
    totals = F.array_repeat(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
    return F.zip_with(values, totals, lambda v, t: v / t)


def causal_softmax(frame: DataFrame, row: list[str], r: str, col: str, value: str = "v", scale: float = 1.0) -> DataFrame:
    """Softmax of the scaled columns up to the row's own index; the others are 0."""
    return _softmax(frame, [*row, r], F.col(value).cast("double") * scale, F.col(col) <= F.col(r))


def rmsnorm(frame: DataFrame, row: list[str], weight: Column, value: str = "v", eps: float = 1e-6, scale: float = 1.0) -> DataFrame:
    """Adds ``rmsnorm``: the value over the root of the row's mean square, times weight (an int8 weight has a *scale*)."""
    x = F.col(value).cast("double")
    held = _beside(frame, row, frame.groupBy(*row).agg(F.avg(x * x).alias("_square")))
    return held.withColumn("rmsnorm", x / F.sqrt(F.col("_square") + eps) * (weight.cast("double") * scale)).drop("_square")


def rope_array(data: Column, position: Column, dim: int, base: float = 10000.0) -> Column:
    """Even and odd elements of every head of *dim* elements rotated by ``position / base ** (2 i / dim)``."""
    if dim % 2:
        raise TensorError("rope takes an even dimension")

    def turned(v: Column, i: Column) -> Column:
        pair = F.floor(i % dim / 2)
        angle = position.cast("double") / F.pow(F.lit(float(base)), 2.0 * pair / dim)
        mate = F.get(data, (i + 1 - 2 * (i % 2)).cast("int")).cast("double")
        x = v.cast("double")
        return F.when(i % 2 == 0, x * F.cos(angle) - mate * F.sin(angle)).otherwise(mate * F.sin(angle) + x * F.cos(angle))

    return F.transform(data, turned)


def argmax(data: Column) -> Column:
    """Place of the first greatest element of an array, from 0."""
    return (F.array_position(data, F.array_max(data)) - 1).cast("int")


def argmax_rows(frame: DataFrame, row: list[str], index: str, value: str = "v") -> DataFrame:
    """The *row* columns and ``token``, the first index of the greatest value; only batch 0 has to be passed in."""
    return frame.groupBy(*row).agg(F.min_by(index, F.struct(-F.col(value).cast("double"), F.col(index))).alias("token"))
