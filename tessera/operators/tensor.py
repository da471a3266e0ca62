"""Array expressions: Python operators over elements, composed into one projection.

``+ - * /`` between tensors, numbers and scalars of up to four lanes; comparisons give masks
of 255 and 0.  Every step saturates to the depth, but a product with a number stays open
until it is used, so ``a * 2 + b * 3`` is one weighted sum and saturates once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.depths import TensorError, lane, saturate
from ..functions.elementwise import binary, compare
from .arrays import KEY


class Tensor:
    """Elements of one depth: a pixel frame and a value column over it, times an open factor."""

    def __init__(self, px: DataFrame, depth: str, channels: int = 1, value: Column | None = None, factor: float = 1.0, keys: list[str] | None = None):
        self.px, self.depth, self.channels, self.factor = px, depth, channels, factor
        self.keys = keys or KEY
        self.value = F.col("v") if value is None else value

    @property
    def column(self) -> Column:
        """The value, saturated."""
        return self.value if self.factor == 1.0 else saturate(self.value.cast("double") * self.factor, self.depth)

    def frame(self) -> DataFrame:
        """The elements as pixels."""
        return self.px.select(*self.keys, self.column.alias("v"))

    def _like(self, value: Column, depth: str | None = None, factor: float = 1.0) -> Tensor:
        return Tensor(self.px, depth or self.depth, self.channels, value, factor, self.keys)

    def together(self, other: Tensor) -> tuple[Tensor, Tensor]:
        """Both tensors over one frame; different frames are joined by their keys."""
        if other.depth != self.depth or other.channels != self.channels:
            raise TensorError(f"{self.depth} C{self.channels} and {other.depth} C{other.channels} differ")
        if other.px is self.px:
            return self, other
        left = self.px.select(*self.keys, self.value.alias("_a"))
        both = left.join(other.px.select(*other.keys, other.value.alias("_b")), self.keys)
        make = lambda name, t: Tensor(both, t.depth, t.channels, F.col(name), t.factor, t.keys)
        return make("_a", self), make("_b", other)

    def _scalar(self, other) -> Column:
        c = F.col("c") if "c" in self.keys else F.lit(0)
        return lane(other, self.channels, self.depth, c)

    def _sum(self, other, sign: int) -> Tensor:
        if isinstance(other, Tensor):
            a, b = self.together(other)
            if a.factor == b.factor == 1.0:
                return a._like(binary("ADD" if sign > 0 else "SUB", a.value, b.value, a.depth))
            return a._like(saturate(a.value.cast("double") * a.factor + b.value.cast("double") * (sign * b.factor), a.depth))
        return self._like(binary("ADD" if sign > 0 else "SUB", self.column, self._scalar(other), self.depth))

    def __add__(self, other) -> Tensor:
        return self._sum(other, 1)

    __radd__ = __add__

    def __sub__(self, other) -> Tensor:
        return self._sum(other, -1)

    def __rsub__(self, other) -> Tensor:
        return self._like(binary("SUB", self._scalar(other), self.column, self.depth))

    def __neg__(self) -> Tensor:
        return self._like(self.value, factor=-self.factor)

    def __mul__(self, other) -> Tensor:
        if isinstance(other, Tensor):
            a, b = self.together(other)
            return a._like(binary("MUL", a.column, b.column, a.depth))
        if isinstance(other, (int, float)):
            return self._like(self.value, factor=self.factor * other)
        return self._like(binary("MUL", self.column, self._scalar(other), self.depth))

    __rmul__ = __mul__

    def __truediv__(self, other) -> Tensor:
        if isinstance(other, Tensor):
            a, b = self.together(other)
            return a._like(binary("DIV", a.column, b.column, a.depth))
        return self._like(binary("DIV", self.column, self._scalar(other), self.depth))

    def __rtruediv__(self, other) -> Tensor:
        return self._like(binary("DIV", self._scalar(other), self.column, self.depth))

    def apply(self, op: str, other) -> Tensor:
        """An operation of :mod:`tessera.functions.elementwise` by name."""
        if isinstance(other, Tensor):
            a, b = self.together(other)
            return a._like(binary(op, a.column, b.column, a.depth))
        return self._like(binary(op, self.column, self._scalar(other), self.depth))

    def compare(self, op: str, other) -> Tensor:
        """A mask of 255 and 0, as 8U."""
        if isinstance(other, Tensor):
            a, b = self.together(other)
            return a._like(compare(op, a.column, b.column), "8U")
        return self._like(compare(op, self.column, self._scalar(other)), "8U")

    def __eq__(self, other):
        return self.compare("EQ", other)

    def __ne__(self, other):
        return self.compare("NE", other)

    def __lt__(self, other):
        return self.compare("LT", other)

    def __le__(self, other):
        return self.compare("LE", other)

    def __gt__(self, other):
        return self.compare("GT", other)

    def __ge__(self, other):
        return self.compare("GE", other)

    __hash__ = None


def weighted(a: Tensor, alpha: float, b: Tensor, beta: float) -> Tensor:
    """``a * alpha + b * beta``, saturated once."""
    return a * alpha + b * beta if (alpha, beta) != (1.0, 1.0) else a + b


def broadcast_binary(op: str, a: DataFrame, b: DataFrame, depth: str, on: list[str], keys: list[str]) -> DataFrame:
    """An operation with shape broadcasting: *on* are the axes that both sides have at full length."""
    other = b.select(*on, F.col("v").alias("_b"))
    return a.join(other, on).select(*keys, binary(op, F.col("v"), F.col("_b"), depth).alias("v"))
