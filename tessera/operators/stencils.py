"""Neighbourhood operators, over dense arrays or over elements.

Every operator is a program over blocks (:mod:`.blocks`) and gives back the form that it got.  Dense
arrays are worked on where they are, without a shuffle.  Elements go through one exchange into
tiles with the margin that the operator reads, also where it has several passes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.borders import DEFAULT, check_filter
from ..functions.depths import TensorError
from . import blocks, transforms
from .blocks import Block, Program, reach, saturated, shifted, together, weighted
from .edges import across_tiles, components

Taps = list[tuple[int, int, float]]


def taps_of(kernel: list[list[float]], anchor: tuple[int, int] = (-1, -1)) -> Taps:
    """``dy, dx, weight`` of a kernel about its anchor (x, y); (-1, -1) is its centre.  No flip."""
    rows, cols = len(kernel), len(kernel[0])
    ax, ay = (cols // 2 if anchor[0] < 0 else anchor[0]), (rows // 2 if anchor[1] < 0 else anchor[1])
    if not (ax < cols and ay < rows):
        raise TensorError(f"anchor {anchor} outside the kernel")
    return [(y - ay, x - ax, float(kernel[y][x])) for y in range(rows) for x in range(cols)]


def filter2d(px: DataFrame, kernel: list[list[float]], depth: str, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: str = DEFAULT) -> DataFrame:
    """Correlation with a literal kernel; the result is 8U or 32F.

    Kernels of ``transforms.LARGE`` taps or more go through Fourier transforms, with the same 8U results.
    """
    if depth not in ("8U", "32F"):
        raise TensorError(f"filter2d does not give {depth}")
    check_filter(border)
    taps = taps_of(kernel, anchor)

    def program(block: Block) -> Block:
        made = transforms.correlated(block, taps, border, depth, delta) if transforms.large(taps) else None
        if made is None:
            acc = weighted(block, taps, border)
            made = acc.like(saturated(acc.data + delta if delta else acc.data, depth))
        return made

    return blocks.on_blocks(px, program, depth, max(reach(taps)))


def _weighted(px: DataFrame, taps: Taps, depth: str, border: str, finish) -> DataFrame:
    check_filter(border)

    def program(block: Block) -> Block:
        acc = weighted(block, taps, border)
        return acc.like(saturated(finish(acc.data), depth))

    return blocks.on_blocks(px, program, depth, max(reach(taps)))


#: Sums of a window that are looked up in a table of means, at most.
MEANS = 1 << 20


def box_filter(px: DataFrame, ksize: tuple[int, int], depth: str, anchor: tuple[int, int] = (-1, -1), normalize: bool = True, border: str = DEFAULT) -> DataFrame:
    """Sum or mean over a window of (width, height); the mean divides by the full area at borders too, in 32F for 8U.

    Windows of integers are running sums, so the cost does not grow with the window; means of bytes come from a table of all sums.
    """
    kw, kh = ksize
    if kw <= 0 or kh <= 0:
        raise TensorError("box_filter takes positive sizes")
    check_filter(border)
    area, taps = np.float32(1.0 / (kw * kh)), taps_of([[1.0] * kw] * kh, anchor)
    finish, known = (lambda acc: acc.astype(np.float32) * area) if normalize else (lambda acc: acc), []

    def program(block: Block) -> Block:
        acc = weighted(block, taps, border)
        if block.data.dtype == np.uint8 and depth == "8U" and 255 * kw * kh < MEANS:
            if not known:
                known.append(saturated(finish(np.arange(255 * kw * kh + 1)), depth).astype(np.uint8))
            return acc.like(known[0][acc.data])
        return acc.like(saturated(finish(acc.data), depth))

    return blocks.on_blocks(px, program, depth, max(reach(taps)))


def blur(px: DataFrame, ksize: tuple[int, int], depth: str, anchor: tuple[int, int] = (-1, -1), border: str = DEFAULT) -> DataFrame:
    """The normalised box filter."""
    return box_filter(px, ksize, depth, anchor, True, border)


def gaussian_kernel(ksize: int, sigma: float) -> list[float]:
    """Normalised weights of 32F precision."""
    import struct

    single = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    raw = [math.exp((i - ksize // 2) ** 2 * (-0.5 / (sigma * sigma))) for i in range(ksize)]
    scale = single(1.0 / sum(raw))
    return [single(single(v) * scale) for v in raw]


def gaussian_sizes(ksize: tuple[int, int], sigma_x: float, sigma_y: float = 0.0) -> tuple[tuple[int, float], tuple[int, float]]:
    """Size and sigma for x and y, filled in from each other."""
    if sigma_y <= 0:
        sigma_y = sigma_x
    out = []
    for k, sigma in zip(ksize, (sigma_x, sigma_y), strict=True):
        if k <= 0:
            if sigma <= 0:
                raise TensorError("gaussian_blur takes a size or a sigma")
            k = max(3, math.floor(sigma * 6 + 1 + 0.5))
            k += 1 - k % 2
        if k % 2 == 0:
            raise TensorError("gaussian_blur takes odd sizes")
        out.append((k, sigma if sigma > 0 else ((k - 1) * 0.5 - 1) * 0.3 + 0.8))
    return out[0], out[1]


def sep_filter2d(px: DataFrame, kernel_x: list[float], kernel_y: list[float], depth: str, anchor: tuple[int, int] = (-1, -1), delta: float = 0.0, border: str = DEFAULT) -> DataFrame:
    """Rows, then columns; what is between them is 32F."""
    check_filter(border)
    across, down = taps_of([kernel_x], (anchor[0], -1)), taps_of([[k] for k in kernel_y], (-1, anchor[1]))

    def program(block: Block) -> Block:
        if depth == "8U" and block.data.dtype.kind in "iu" and block.data.size:
            made = _rounded_sums(block, across, down, border, delta)
            if made is not None:
                return made
        rows = weighted(block, across, border)
        acc = weighted(rows.like(rows.data.astype(np.float32)), down, border)
        return acc.like(saturated(acc.data + delta, depth))

    return blocks.on_blocks(px, program, depth, max(reach(across)) + max(reach(down)))


#: Elements that are worked on at once, for a processor's nearest cache.
STRIP = 80_000
#: Share of places that are summed again in double; where more are in doubt, all are.
DOUBTFUL = 0.05


def _rounded_sums(block: Block, across: Taps, down: Taps, border: str, delta: float) -> Block | None:
    """Both passes in 32F with a bound of their error, and in double for the places whose rounding that leaves in doubt.

    The result is that of passes in double; nothing, if too many places are in doubt.
    """
    margins = (*reach(down)[:2], *reach(across)[2:])
    frame, wide, _ = block.around(*margins, border)
    rows, cols = frame.data.shape[1:3]
    most = float(max(abs(int(wide.min())), abs(int(wide.max()))))
    size = sum(abs(t[2]) for t in across) * sum(abs(t[2]) for t in down)
    # each product, sum and rounding to 32F, and those between the passes, adds half a unit at most
    doubt = (len(across) + len(down) + 4) * 2.0**-23 * (most * size + abs(delta))
    if most >= 1 << 24 or doubt > 0.2 or not (any(t[2] for t in across) and any(t[2] for t in down)):
        return None
    out = np.empty((len(wide), rows, cols, wide.shape[3]), np.uint8 if block.data.dtype == np.uint8 else np.int32)
    step, open_places = max(1, STRIP // max(1, len(wide) * cols * wide.shape[3])), 0
    right, below = [(dx + margins[2], w) for _, dx, w in across], [(dy + margins[0], w) for dy, _, w in down]
    for y0 in range(0, rows, step):
        part = wide[:, y0 : min(rows, y0 + step) + margins[0] + margins[1]]
        held = part.shape[1] - margins[0] - margins[1]
        sums = blocks.single_sums(blocks.single_sums(part.astype(np.float32), right, 2, cols), below, 1, held)
        sums += np.float32(delta + 0.5)
        whole = np.floor(sums)
        sums -= whole
        np.clip(whole, 0, 255, out=whole)
        out[:, y0 : y0 + held] = whole
        sums -= np.float32(0.5)
        unsure = np.flatnonzero(np.abs(sums, out=sums) > 0.5 - doubt)
        open_places += len(unsure)
        if open_places > DOUBTFUL * out.size:
            return None
        if len(unsure):
            n, y, x, c = np.unravel_index(unsure, sums.shape)
            total = np.zeros(len(n))
            for dy, weight in below:
                row = np.zeros(len(n))
                for dx, factor in right:
                    row += factor * part[n, y + dy, x + dx, c].astype(np.float64)
                total += weight * row.astype(np.float32).astype(np.float64)
            out[n, y + y0, x, c] = saturated(total + delta, "8U")
    return frame.like(out)


def gaussian_blur(px: DataFrame, ksize: tuple[int, int], sigma_x: float, depth: str, sigma_y: float = 0.0, border: str = DEFAULT) -> DataFrame:
    """Gaussian smoothing in two passes."""
    (kx, sx), (ky, sy) = gaussian_sizes(ksize, sigma_x, sigma_y)
    return sep_filter2d(px, gaussian_kernel(kx, sx), gaussian_kernel(ky, sy), depth, border=border)


#: Smoothing and derivative rows by size.
SMOOTH = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}
DERIVE = {3: [-1, 0, 1], 5: [-1, -2, 0, 2, 1]}


def sobel_kernel(dx: int, dy: int, ksize: int = 3) -> list[list[float]]:
    """The two-dimensional derivative kernel."""
    if (dx, dy) not in ((1, 0), (0, 1)) or ksize not in SMOOTH:
        raise TensorError("sobel takes one first derivative and size 3 or 5")
    across, down = (DERIVE if dx else SMOOTH)[ksize], (DERIVE if dy else SMOOTH)[ksize]
    return [[float(a * b) for a in across] for b in down]


def sobel(px: DataFrame, dx: int, dy: int, depth: str = "32F", ksize: int = 3, scale: float = 1.0, delta: float = 0.0, border: str = DEFAULT) -> DataFrame:
    """A first derivative as 16S or 32F.  A window of a larger image is isolated if it is cut out before, else after."""
    if depth not in ("16S", "32F"):
        raise TensorError(f"sobel does not give {depth}")
    return _weighted(px, taps_of(sobel_kernel(dx, dy, ksize)), depth, border, lambda acc: acc if (scale, delta) == (1, 0) else acc * scale + delta)


# -- morphology ------------------------------------------------------------


def structure(kernel: list[list[int]] | None, anchor: tuple[int, int] = (-1, -1)) -> Taps:
    """The taps of a structuring element; none is a 3x3 square about its centre."""
    taps = taps_of([[1] * 3] * 3) if not kernel else [t for t in taps_of(kernel, anchor) if t[2]]
    if not taps:
        raise TensorError("a structuring element has a non-zero place")
    return taps


def _runs(taps: Taps) -> dict[tuple[int, int], list[int]]:
    """The element's horizontal runs, as first place and length, and the rows that have each."""
    found: dict[tuple[int, int], list[int]] = {}
    by_row: dict[int, list[int]] = {}
    for dy, dx, _ in taps:
        by_row.setdefault(dy, []).append(dx)
    for dy, places in by_row.items():
        places = sorted(set(places))
        first = places[0]
        for a, b in zip(places, [*places[1:], None], strict=True):
            if b != a + 1:
                found.setdefault((first, a - first + 1), []).append(dy)
                first = b
    return found


def _extreme(block: Block, taps: Taps, border: str, value: float, least: bool) -> Block:
    """Extremes by rows of the element: each run is a window along the row, and runs that stand in consecutive rows a window of those."""
    margins = reach(taps)
    frame, wide, _ = block.around(*margins, border, saturated(np.array([float(value)]), "8U")[0])
    best, (rows, cols) = np.minimum if least else np.maximum, frame.data.shape[1:3]
    out = None
    for (first, length), at in _runs(taps).items():
        across = blocks.window_extremes(wide, length, 2, best)[:, :, margins[2] + first : margins[2] + first + cols]
        for down, height in _spans(at):
            part = blocks.window_extremes(across[:, margins[0] + down : margins[0] + down + rows + height - 1], height, 1, best)
            out = part if out is None else best(out, part)
    return frame.like(out)


def _spans(rows: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as their first and how many."""
    out: list[tuple[int, int]] = []
    for r in sorted(rows):
        if out and r == sum(out[-1]):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((r, 1))
    return out


def _repeated(kernel, anchor, iterations: int, border: str, value: float, least: bool) -> Program:
    if iterations <= 0:
        raise TensorError("iterations are positive")
    check_filter(border)
    taps = structure(kernel, anchor)

    def program(block: Block) -> Block:
        for _ in range(iterations):
            block = _extreme(block, taps, border, value, least)
        return block

    return program


def _margin(kernel, anchor, passes: int) -> int:
    return max(reach(structure(kernel, anchor))) * passes


def erode(px: DataFrame, kernel=None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: str = DEFAULT, value: float = 255) -> DataFrame:
    """The least value under the element, *iterations* times."""
    return blocks.on_blocks(px, _repeated(kernel, anchor, iterations, border, value, True), None, _margin(kernel, anchor, iterations))


def dilate(px: DataFrame, kernel=None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: str = DEFAULT, value: float = 0) -> DataFrame:
    """The greatest value under the element, *iterations* times."""
    return blocks.on_blocks(px, _repeated(kernel, anchor, iterations, border, value, False), None, _margin(kernel, anchor, iterations))


def _minus(a: Block, b: Block) -> Block:
    a, b = together(a, b)
    return a.like(np.maximum(a.data.astype(np.int32 if a.data.dtype == np.uint8 else np.int64) - b.data, 0))


def morphology(px: DataFrame, op: str, kernel=None, anchor: tuple[int, int] = (-1, -1), iterations: int = 1, border: str = "CONSTANT", value: float = 0) -> DataFrame:
    """ERODE, DILATE, OPEN, CLOSE, GRADIENT, TOPHAT, BLACKHAT or HITMISS; the border is a constant 0 unless given."""
    if op == "HITMISS":
        return hit_or_miss(px, kernel, anchor)
    down, up = (_repeated(kernel, anchor, iterations, border, value, least) for least in (True, False))
    made = {
        "ERODE": down, "DILATE": up, "OPEN": lambda b: up(down(b)), "CLOSE": lambda b: down(up(b)), "GRADIENT": lambda b: _minus(up(b), down(b)),
        "TOPHAT": lambda b: _minus(b, up(down(b))), "BLACKHAT": lambda b: _minus(down(up(b)), b),
    }
    if op not in made:
        raise TensorError(f"unknown morphology {op!r}")
    return blocks.on_blocks(px, made[op], None, _margin(kernel, anchor, 2 * iterations))


def hit_or_miss(px: DataFrame, kernel: list[list[int]], anchor: tuple[int, int] = (-1, -1)) -> DataFrame:
    """255 where all taps of 1 lie on non-zero and all of -1 on zero elements; taps outside do not count; no taps: the input."""
    taps = [t for t in taps_of(kernel, anchor) if t[2]]
    margins = reach(taps) if taps else (0, 0, 0, 0)

    def program(block: Block) -> Block:
        if not taps:
            return block
        frame, wide, mask = block.around(*margins, "CONSTANT")
        fits = np.ones((len(wide), *frame.data.shape[1:3], wide.shape[3]), bool)
        for dy, dx, weight in taps:
            held = shifted(frame, wide, margins, dy, dx)
            here = (held != 0) if weight > 0 else (held == 0)
            if mask is not None:
                here = here | ~shifted(frame, mask, margins, dy, dx)
            fits &= here
        return frame.like(np.where(fits, 255, 0))

    return blocks.on_blocks(px, program, None, max(margins))


# -- edges -----------------------------------------------------------------


def strength(gx: np.ndarray, gy: np.ndarray, l2: bool = False) -> np.ndarray:
    """The magnitude of derivatives."""
    if not l2 and gx.dtype.kind == "i":
        return (np.abs(gx) + np.abs(gy)).astype(np.float32)
    x, y = gx.astype(np.float64), gy.astype(np.float64)
    return (np.sqrt(x * x + y * y) if l2 else np.abs(x) + np.abs(y)).astype(np.float32)


#: Steps ahead along a gradient, by sector: across, down, up, and straight down.
_AHEAD = ((0, 1), (1, 1), (-1, 1), (1, 0))


def thinned(gx: np.ndarray, gy: np.ndarray, m: np.ndarray, low: float) -> np.ndarray:
    """Where the magnitude is above *low* and no neighbour along the gradient exceeds it; ties count for the left and upper one of two.

    Only elements above *low* are looked at.
    """
    above = m > np.float32(low)
    x, y = gx[above], gy[above]
    ax, ay = np.abs(x).astype(np.float64), np.abs(y).astype(np.float64)
    # tangents of 22.5 and 67.5 degrees; no quotient of integers is one
    flat, steep = ay < math.tan(math.pi / 8) * ax, ay >= math.tan(3 * math.pi / 8) * ax
    # places in images with a margin of one, where strengths are 0
    around = ((0, 0), (1, 1), (1, 1))
    wide, place = np.pad(m, around).ravel(), np.flatnonzero(np.pad(above, around))
    steps = np.array([dy * (m.shape[2] + 2) + dx for dy, dx in _AHEAD])
    step = np.where(steep, steps[3], np.where(flat, steps[0], np.where((x < 0) == (y < 0), steps[1], steps[2])))
    here, ahead, behind = m[above], wide[place + step], wide[place - step]
    out = np.zeros(m.shape, bool)
    out[above] = ((here > ahead) | ((here == ahead) & (flat | steep))) & (here > behind)
    return out


def reached(open_: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The elements of *open_* that are connected, over eight neighbours, to one of *seeds*."""
    places, root = components(open_)
    good = np.zeros(len(places), bool)
    good[root[seeds.ravel()[places]]] = True
    out = np.zeros(open_.shape, bool)
    out.ravel()[places] = good[root]
    return out


def _edges(gx: np.ndarray, gy: np.ndarray, low: float, high: float, l2: bool) -> np.ndarray:
    m = strength(gx, gy, l2)
    thin = thinned(gx, gy, m, low)
    return np.where(reached(thin, thin & (m > np.float32(high))), 255, 0).astype(np.int32)


def canny(px: DataFrame, threshold1: float, threshold2: float, aperture: int = 3, l2: bool = False) -> DataFrame:
    """Edges (255) of one-channel 8U images.  Elements are worked on tile by tile, and edges followed across tiles (:mod:`.edges`)."""
    low, high = sorted((threshold1, threshold2))
    taps = [taps_of(sobel_kernel(1 - k, k, aperture)) for k in (0, 1)]

    def derivatives(block: Block) -> list[Block]:
        return [b.like(saturated(b.data, "16S")) for b in (weighted(block, t, "REPLICATE") for t in taps)]

    def program(block: Block) -> Block:
        gx, gy = (b.data[..., 0] for b in derivatives(block))
        return block.like(_edges(gx, gy, low, high, l2)[..., None])

    if blocks.is_dense(px):
        return blocks.on_blocks(px, program, "8U")
    return across_tiles(px, aperture // 2 + 1, ["v"], lambda held: _detected(*together(*derivatives(held[0])), low, high, l2))


def _detected(gx: Block, gy: Block, low: float, high: float, l2: bool) -> tuple[Block, Block]:
    """Edge elements of a tile and its margin, and the strong ones."""
    m = strength(gx.data[..., 0], gy.data[..., 0], l2)
    thin = thinned(gx.data[..., 0], gy.data[..., 0], m, low)
    return gx.like(thin[..., None]), gx.like((thin & (m > np.float32(high)))[..., None])


def canny_derivatives(derivatives: DataFrame, threshold1: float, threshold2: float, l2: bool = False) -> DataFrame:
    """Edges from given 16S derivatives ``gx`` and ``gy`` of each element, tile by tile."""
    low, high = sorted((threshold1, threshold2))
    return across_tiles(derivatives, 1, ["gx", "gy"], lambda held: _detected(*held, low, high, l2))
