"""Correlation with large kernels by Fourier transforms of overlapping strips.

Strips of output rows are read with the rows that the kernel reaches, so what wraps around in a transform
is never kept; memory is that of a strip.  The error has a bound, and where rounding to 8U
is in doubt within it, a place is summed again over its taps, in double and in their order.
"""

from __future__ import annotations

import numpy as np

from .blocks import Block, reach, saturated

#: Taps from which a kernel is large.
LARGE = 400
#: Output rows of a strip.
STRIP_ROWS = 256
#: Share of places that are summed again; where more are in doubt, all are.
DOUBTFUL = 0.02


def good_size(n: int) -> int:
    """The least product of 2, 3 and 5 from *n* on."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def large(taps: list[tuple[int, int, float]]) -> bool:
    return sum(1 for t in taps if t[2]) >= LARGE


def correlated(block: Block, taps: list[tuple[int, int, float]], border: str, depth: str, delta: float) -> Block | None:
    """The weighted sums plus *delta* as elements of *depth*; nothing, if too many roundings are in doubt or numbers are not finite."""
    margins = reach(taps)
    frame, wide, _ = block.around(*margins, border)
    rows, cols = frame.data.shape[1:3]
    wide = wide.astype(np.float64)
    if not wide.size or not np.isfinite(wide).all():
        return None
    kernel = np.zeros((1 + margins[0] + margins[1], 1 + margins[2] + margins[3]))
    for dy, dx, weight in taps:
        kernel[dy + margins[0], dx + margins[2]] += weight
    most, out = float(np.abs(wide).max()), np.empty((len(wide), rows, cols, wide.shape[3]), np.float64)
    width = good_size(wide.shape[2])
    spectra: dict[int, np.ndarray] = {}
    for y0 in range(0, rows, STRIP_ROWS):
        part = wide[:, y0 : min(rows, y0 + STRIP_ROWS) + margins[0] + margins[1]]
        held, height = part.shape[1] - margins[0] - margins[1], good_size(part.shape[1])
        if height not in spectra:
            spectra[height] = np.conj(np.fft.rfft2(kernel, (height, width)))[None, :, :, None]
        made = np.fft.irfft2(np.fft.rfft2(part, (height, width), axes=(1, 2)) * spectra[height], (height, width), axes=(1, 2))
        out[:, y0 : y0 + held] = made[:, :held, :cols]
    out += delta
    if depth != "8U":
        return frame.like(saturated(out, depth))
    places = good_size(min(rows, STRIP_ROWS) + kernel.shape[0]) * width
    doubt = 2.0**-48 * np.log2(places) * np.sqrt(places) * most * np.sqrt((kernel**2).sum()) + 2.0**-50 * len(taps) * most * np.abs(kernel).sum()
    rest = out - np.floor(out)
    unsure = np.flatnonzero(np.abs(rest - 0.5) <= doubt)
    result = saturated(out, depth)
    if len(unsure) > DOUBTFUL * out.size:
        return None
    if len(unsure):
        n, y, x, c = np.unravel_index(unsure, out.shape)
        total = np.zeros(len(n))
        for dy, dx, weight in taps:
            total += weight * wide[n, y + dy + margins[0], x + dx + margins[2], c]
        result[n, y, x, c] = saturated(total + delta, depth)
    return frame.like(result)
