"""Matrix products, norms and their shapes, over ``mat_id, i, j, v`` relations.

A product joins tiles on the inner tile and adds up tiles by output tile
(:mod:`.tiles`).  Batches ride along as keys; a side without a
batch is shared by all.  Sums are double and are rounded to 32F at the end.
Dense one-channel arrays are matrices too, with ``img_id`` as their batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.depths import TensorError
from . import tiles
from .blocks import is_dense

#: Tiles that the right operand may have to be sent to every task (32 MB), and parts that the left side is dealt into where it has more.
PACKED_TILES = 256
PARTS = 32


def gemm_shape(a: tuple[int, ...], b: tuple[int, ...], trans_a: bool = False, trans_b: bool = False) -> tuple[int, ...]:
    """Shape of a product; leading axes broadcast."""
    if len(a) < 2 or len(b) < 2:
        raise TensorError("gemm takes two axes at least")
    (m, k), (k2, n) = (a[-2:][::-1] if trans_a else a[-2:]), (b[-2:][::-1] if trans_b else b[-2:])
    if k != k2:
        raise TensorError(f"inner sizes {k} and {k2} differ")
    lead_a, lead_b = a[:-2], b[:-2]
    size = max(len(lead_a), len(lead_b))
    lead_a, lead_b = (1,) * (size - len(lead_a)) + tuple(lead_a), (1,) * (size - len(lead_b)) + tuple(lead_b)
    if any(x != y and 1 not in (x, y) for x, y in zip(lead_a, lead_b, strict=True)):
        raise TensorError(f"batches {lead_a} and {lead_b} do not broadcast")
    return (*(max(x, y) for x, y in zip(lead_a, lead_b, strict=True)), m, n)


def _left(a: DataFrame, keys: list[str], trans: bool) -> DataFrame:
    found = tiles.of_dense(a, trans) if is_dense(a) else tiles.of_elements(a, keys, trans)
    return found.withColumnRenamed("tj", "k")


def _right(b: DataFrame, keys: list[str], trans: bool) -> DataFrame:
    found = tiles.of_dense(b, trans) if is_dense(b) else tiles.of_elements(b, keys, trans)
    return found.withColumnRenamed("ti", "k")


def pack_b(b: DataFrame, trans_b: bool = False) -> DataFrame:
    """A right operand without a batch as tiles, ready for many products; broadcast if its tiles are few, which is counted."""
    packed = _right(b, [], trans_b).select("k", "tj", "rows", "cols", "data")
    if packed.limit(PACKED_TILES + 1).count() <= PACKED_TILES:
        return F.broadcast(packed)
    # more tasks than inner tiles: each part of the left side's tiles meets its own copy
    return packed.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)])))


def gemm(a: DataFrame, b: DataFrame, trans_a: bool = False, trans_b: bool = False, shared_b: bool = False, is_packed: bool = False, scales: DataFrame | None = None) -> DataFrame:
    """``mat_id, i, j, v`` of ``a @ b``, or dense arrays of dense ones.  *scales* (``j, scale``) multiply the columns of an integer right operand."""
    left = _left(a, ["mat_id"], trans_a)
    if shared_b and not is_packed:
        b, is_packed = pack_b(b, trans_b), True
    met = ["k"] if is_packed else ["mat_id", "k"]
    if is_packed and "part" in b.columns:
        left, met = left.withColumn("part", F.pmod(F.xxhash64("mat_id", "ti"), F.lit(PARTS)).cast("int")), ["k", "part"]
    found = tiles.multiply(left, b if is_packed else _right(b, ["mat_id"], trans_b), met, {"mat_id": "mat_id"})
    if is_dense(a) and scales is None:
        return tiles.dense(found)
    if scales is None:
        return tiles.elements(found, ["mat_id"])
    out = tiles.elements(found, ["mat_id"], kind="double").join(scales, "j").withColumn("v", (F.col("v") * F.col("scale").cast("double")).cast("float"))
    return out.select("mat_id", "i", "j", "v")


def gemm_batched(a: DataFrame, b: DataFrame, lead_a: tuple[int, ...], lead_b: tuple[int, ...], trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """Products over leading axes that broadcast.

    *a* and *b* have a column ``n0``, ``n1``, ... for each leading axis, whose sizes are *lead_a* and *lead_b*, and ``i, j, v``.
    The result has the longer list of axes; an axis of size 1 on one side is not a join key, so nothing is copied for it.
    """
    gemm_shape((*lead_a, 1, 1), (*lead_b, 1, 1))  # fails on axes that do not broadcast
    size = max(len(lead_a), len(lead_b))

    def side(found: DataFrame, lead: tuple[int, ...], name: str, inner: str) -> DataFrame:
        return found.withColumnsRenamed({f"n{k}": f"{name}{k + size - len(lead)}" for k in range(len(lead))} | {"k": inner})

    left = side(_left(a, [f"n{k}" for k in range(len(lead_a))], trans_a), lead_a, "a", "k")
    right = side(_right(b, [f"n{k}" for k in range(len(lead_b))], trans_b), lead_b, "b", "k2")
    met, keys = [F.col("k") == F.col("k2")], {}
    for n in range(size):
        x, y = ((lead[n - size + len(lead)] if n >= size - len(lead) else 1) for lead in (lead_a, lead_b))
        if x > 1 and y > 1:
            met.append(F.col(f"a{n}") == F.col(f"b{n}"))
        keys[f"n{n}"] = f"a{n}" if x >= y and n >= size - len(lead_a) else f"b{n}"
    return tiles.elements(tiles.multiply(left, right, met, keys), list(keys))


def norm(kind: str, v: Column) -> Column:
    """An aggregate: L1 sums magnitudes, L2 sums squares (no root), INF is the largest magnitude."""
    x = v.cast("double")
    made = {"L1": lambda: F.sum(F.abs(x)), "L2": lambda: F.sum(x * x), "INF": lambda: F.max(F.abs(x))}
    if kind not in made:
        raise TensorError(f"unknown norm {kind!r}")
    return made[kind]()


def norms(px: DataFrame, other: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """``img_id`` and the three norms, of elements or of their difference from *other*'s."""
    if other is not None:
        keys = keys or ["img_id", "y", "x", "c"]
        px = px.join(other.select(*keys, F.col("v").alias("_o")), keys).withColumn("v", F.col("v").cast("double") - F.col("_o").cast("double"))
    return px.groupBy("img_id").agg(norm("L1", F.col("v")).alias("l1"), norm("L2", F.col("v")).alias("l2"), norm("INF", F.col("v")).alias("inf"))
