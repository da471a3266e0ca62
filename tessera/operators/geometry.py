"""Borders, resizing and affine warping, over dense arrays or over elements.

Every operator computes the source places of a part of its output grid and fetches whole rows and columns, or
corners (:mod:`.blocks`).  Dense arrays are not shuffled; of elements, each output tile gets the parts of source
tiles that it reads (:mod:`.footprints`).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.borders import MODES
from ..functions.depths import TensorError, lanes
from .blocks import Block, folded, rounded, saturated, source_places
from .footprints import Mapping, Rectangle, folded_span, on_frame, span


def copy_make_border(px: DataFrame, top: int, bottom: int, left: int, right: int, border: str, depth: str, value=0, channels: int = 1) -> DataFrame:
    """Images widened by a border; channels past the third take the fourth lane of a scalar."""
    if min(top, bottom, left, right) < 0 or border not in MODES:
        raise TensorError("borders have widths from 0 and a known kind")
    full = [*value, 0, 0, 0, 0][:4] if not isinstance(value, (int, float)) else [value] * 4

    def reads(h: int, w: int, part: Rectangle) -> Rectangle:
        return (*folded_span(part[0] - top, part[1] - 1 - top, h, border), *folded_span(part[2] - left, part[3] - 1 - left, w, border))

    def make(block: Block, part: Rectangle) -> np.ndarray:
        per = saturated(np.array([float(full[min(c, 3)]) for c in range(block.data.shape[3])]), depth)
        ys, in_y = source_places(part[0] - top, part[1] - top, block.h, border)
        xs, in_x = source_places(part[2] - left, part[3] - left, block.w, border)
        wide = block.data[:, ys - block.y0][:, :, xs - block.x0]  # constants are taken from the nearest place, which is read too
        return np.where((in_y[:, None] & in_x)[None, :, :, None], wide, per.astype(wide.dtype))

    return on_frame(px, Mapping(lambda h, w: (h + top + bottom, w + left + right), reads, make), depth)


def target_size(h: int, w: int, dsize: tuple[int, int] | None = None, fx: float = 0.0, fy: float = 0.0) -> tuple[int, int]:
    """Rows and columns of a resized image; a size (width, height) goes before factors."""
    if dsize and dsize[0] > 0 and dsize[1] > 0:
        return dsize[1], dsize[0]
    if fx <= 0 or fy <= 0:
        raise TensorError("resize takes a size or two factors")
    return max(1, int(rounded(np.float64(h * fy)))), max(1, int(rounded(np.float64(w * fx))))


def _ratio(p: np.ndarray, n: int, m: int) -> np.ndarray:
    return np.minimum(n - 1, p * n // m)


def _exact(p: np.ndarray, n: int, m: int) -> np.ndarray:
    step = (n * 65536 + m // 2) // m
    return np.clip((step * p + step // 2 - n % 2) >> 16, 0, n - 1)


def _axis(n: int, m: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two source places and the weight of the second for some of *m* places, in 32F."""
    half = np.float32(0.5)
    at = (places.astype(np.float32) + half) * np.float32(n / m) - half
    low = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
    return low, np.minimum(low + 1, n - 1), at - low.astype(np.float32)


def resize(px: DataFrame, depth: str, dsize: tuple[int, int] | None = None, fx: float = 0.0, fy: float = 0.0, interpolation: str = "LINEAR") -> DataFrame:
    """NEAREST, NEAREST_EXACT or LINEAR.  LINEAR clips source places but not weights, so it extrapolates at upper and left edges."""
    if interpolation not in ("NEAREST", "NEAREST_EXACT", "LINEAR"):
        raise TensorError(f"unknown interpolation {interpolation!r}")
    target_size(1, 1, dsize, fx, fy)  # fails on bad sizes

    place = _ratio if interpolation == "NEAREST" else _exact
    size = lambda h, w: target_size(h, w, dsize, fx, fy)

    def reads(h: int, w: int, part: Rectangle) -> Rectangle:
        out = []
        for n, m, first, end in zip((h, w), size(h, w), part[::2], part[1::2], strict=True):
            ends = np.array([first, end - 1])
            if interpolation != "LINEAR":
                out += span(place(ends, n, m))
            else:
                low, high, _ = _axis(n, m, ends)
                out += (int(low[0]), int(high[1]) + 1)
        return tuple(out)

    def make(block: Block, part: Rectangle) -> np.ndarray:
        (h, w), (mh, mw) = (block.h, block.w), size(block.h, block.w)
        rows, cols = np.arange(part[0], part[1]), np.arange(part[2], part[3])
        if interpolation != "LINEAR":
            return block.data[:, place(rows, h, mh) - block.y0][:, :, place(cols, w, mw) - block.x0]
        (y0, y1, wy), (x0, x1, wx) = _axis(h, mh, rows), _axis(w, mw, cols)
        mix = lambda a, b, t: a + (b - a) * t
        data = block.data.astype(np.float32)
        upper, lower = data[:, y0 - block.y0], data[:, y1 - block.y0]
        across = lambda held: mix(held[:, :, x0 - block.x0], held[:, :, x1 - block.x0], wx[None, None, :, None])
        return saturated(mix(across(upper), across(lower), wy[None, :, None, None]), depth)

    return on_frame(px, Mapping(size, reads, make), depth)


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The inverse of an affine map."""
    (a, b, c), (d, e, f) = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        raise TensorError("singular transform")
    inv = 1.0 / det
    p, q, r, s = e * inv, -b * inv, -d * inv, a * inv
    return [[p, q, -(p * c + q * f)], [r, s, -(r * c + s * f)]]


def warp_affine(px: DataFrame, matrix: list[list[float]], depth: str, dsize: tuple[int, int] | None = None, interpolation: str = "LINEAR", inverse_map: bool = False, border: str = "CONSTANT", value=0, channels: int = 1) -> DataFrame:
    """Images under an affine map; an empty size keeps the source's."""
    if border not in MODES:
        raise TensorError(f"unknown border {border!r}")
    (a, b, c), (d, e, f) = matrix if inverse_map else inverse(matrix)

    def size(h: int, w: int) -> tuple[int, int]:
        return (dsize[1], dsize[0]) if dsize and min(dsize) > 0 else (h, w)

    def sources(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x * float(a) + y * float(b) + float(c), x * float(d) + y * float(e) + float(f)

    def reads(h: int, w: int, part: Rectangle) -> Rectangle:
        """From the four corners; rounding is monotonous, and one place more on each side is read."""
        ux, uy = sources(np.array([part[2], part[3] - 1, part[2], part[3] - 1], np.float64), np.array([part[0], part[0], part[1] - 1, part[1] - 1], np.float64))
        far = 1 << 40
        ends = lambda u, n: folded_span(int(np.clip(np.floor(u.min()), -far, far)) - 1, int(np.clip(np.floor(u.max()), -far, far)) + 2, n, border)
        return (*ends(uy, h), *ends(ux, w))

    known: dict[tuple, tuple] = {}

    def places(block: Block, part: Rectangle) -> tuple:
        """What a part reads of images of this size: places of up to four corners, the last one standing for outside, and weights."""
        ux, uy = sources(np.arange(part[2], part[3], dtype=np.float64)[None, :], np.arange(part[0], part[1], dtype=np.float64)[:, None])
        rows, cols = block.data.shape[1:3]

        def spot(py: np.ndarray, px_: np.ndarray) -> np.ndarray:
            (ys, in_y), (xs, in_x) = folded(py, block.h, border), folded(px_, block.w, border)
            return np.where(in_y & in_x, (ys - block.y0) * cols + xs - block.x0, rows * cols).ravel()

        if interpolation == "NEAREST":
            return [spot(np.floor(uy + 0.5).astype(np.int64), np.floor(ux + 0.5).astype(np.int64))], None, None
        bx, by = np.floor(ux).astype(np.int64), np.floor(uy).astype(np.int64)
        return [spot(by + j, bx + i) for j in (0, 1) for i in (0, 1)], (ux - bx).reshape(1, -1, 1), (uy - by).reshape(1, -1, 1)

    def make(block: Block, part: Rectangle) -> np.ndarray:
        n, rows, cols, cn = block.data.shape
        outside = saturated(np.array((lanes(value, min(cn, max(channels, 1)), depth) * cn)[:cn], np.float64), depth)
        key = (block.h, block.w, block.y0, block.x0, rows, cols, part)
        if key not in known:
            known.clear()  # images of one size follow each other
            known[key] = places(block, part)
        at, wx, wy = known[key]
        shape = (n, part[1] - part[0], part[3] - part[2], cn)
        flat = np.empty((n, rows * cols + 1, cn), block.data.dtype if interpolation == "NEAREST" else np.float64)
        flat[:, :-1], flat[:, -1] = block.data.reshape(n, -1, cn), outside
        corners = [np.take(flat, k, axis=1) for k in at]
        if wx is None:
            return corners[0].reshape(shape)
        for first, second in ((0, 1), (2, 3)):
            corners[second] -= corners[first]
            corners[second] *= wx
            corners[first] += corners[second]
        upper, _, lower, _ = corners
        lower -= upper
        lower *= wy
        return saturated((upper + lower).reshape(shape), depth)

    return on_frame(px, Mapping(size, reads, make), depth)


def letterbox(px: DataFrame, depth: str, h: int, w: int, size: tuple[int, int], channels: int = 1, value=0) -> DataFrame:
    """Images of one shape scaled to fit a (width, height) and centred in a border."""
    scale = min(size[0] / w, size[1] / h)
    nh, nw = max(1, math.floor(h * scale + 0.5)), max(1, math.floor(w * scale + 0.5))
    top, left = (size[1] - nh) // 2, (size[0] - nw) // 2
    return copy_make_border(resize(px, depth, (nw, nh)), top, size[1] - nh - top, left, size[0] - nw - left, "CONSTANT", depth, value, channels)
