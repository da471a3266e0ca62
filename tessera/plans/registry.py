"""Implementations of operators that have more than one, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.depths import TensorError
from ..operators import arrays, color, geometry, stencils

_KNOWN: dict[str, dict[str, Callable]] = {}


def register(op: str, impl: str, f: Callable) -> None:
    """Adds an implementation, which takes and gives dense arrays."""
    _KNOWN.setdefault(op, {})[impl] = f


def implementations(op: str) -> list[str]:
    return sorted(_KNOWN.get(op, {}))


def run(op: str, arrays_: DataFrame, *args, impl: str = "arrow", **options) -> DataFrame:
    """An operator over dense arrays by a named implementation."""
    try:
        return _KNOWN[op][impl](arrays_, *args, **options)
    except KeyError:
        raise TensorError(f"no {impl!r} implementation of {op!r}") from None


def _by_elements(f: Callable) -> Callable:
    """The element form of an operator, between dense arrays."""
    return lambda a, *args, **options: arrays.packed(f(arrays.pixels(a, colocate=False), *args, **options))


for _f in (
    stencils.box_filter, stencils.blur, stencils.gaussian_blur, stencils.filter2d, stencils.sep_filter2d, stencils.sobel, stencils.canny, stencils.erode, stencils.dilate,
    stencils.morphology, stencils.hit_or_miss, geometry.resize, geometry.warp_affine, geometry.copy_make_border, geometry.letterbox, color.cvt_color,
):
    register(_f.__name__, "arrow", _f)
    register(_f.__name__, "native", _by_elements(_f))
