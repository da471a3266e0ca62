"""Colour conversion as array programs over whole images.

Planar layouts are views into one buffer an image: luma rows first, then chroma at its own
stride, interleaved or in two planes.  Encoding folds blocks of places into chroma cells
by two strided axes; decoding spreads cells over the same axes without copying them.
"""

from __future__ import annotations

import numpy as np

from ..functions.depths import TensorError
from .blocks import Block, Program, saturated


def _channels(block: Block, names: str) -> dict[str, np.ndarray]:
    """The channels by name, 8U as 32-bit integers."""
    if block.data.shape[3] != len(names):
        raise TensorError(f"{block.data.shape[3]} channels where {len(names)} are converted")
    data = block.data.astype(np.int32) if block.data.dtype.kind in "iu" else block.data
    return {n: data[..., k] for k, n in enumerate(names)}


def _whole(data: np.ndarray) -> Block:
    return Block(data, data.shape[1], data.shape[2])


def plain(source: str, target: str, depth: str) -> Program:
    """Gray, channel order and opacity; *source* and *target* name channels, ``y`` for gray."""

    def run(block: Block) -> Block:
        at = _channels(block, source)
        if source == "y":
            at |= dict.fromkeys("bgr", at["y"])
        elif target == "y" and depth == "8U":
            at["y"] = (at["b"] * 7471 + at["g"] * 38470 + at["r"] * 19595 + 32768) >> 16
        elif target == "y":
            at["y"] = saturated(at["b"].astype(np.float64) * 0.114 + at["g"].astype(np.float64) * 0.587 + at["r"].astype(np.float64) * 0.299, depth)
        if "a" not in at:
            at["a"] = np.full_like(next(iter(at.values())), 255 if depth == "8U" else 1)
        return block.like(np.stack([at[n] for n in target], axis=-1))

    return run


def analog(source: str, target: str, depth: str) -> Program:
    """Between colours and full-resolution luma and colour differences; one of the sides is ``yuv``."""
    delta = 128.0 if depth == "8U" else 0.5

    def run(block: Block) -> Block:
        at = {n: v.astype(np.float64) for n, v in _channels(block, source).items()}
        if target == "yuv":
            luma = at["b"] * 0.114 + at["g"] * 0.587 + at["r"] * 0.299
            made = [luma, (at["b"] - luma) * 0.492 + delta, (at["r"] - luma) * 0.877 + delta]
        else:
            y, u, v = at["y"], at["u"] - delta, at["v"] - delta
            colours = {"b": y + u * 2.032, "g": y - u * 0.395 - v * 0.581, "r": y + v * 1.140}
            made = [colours[n] for n in target]
        return block.like(np.stack([saturated(x, depth) for x in made], axis=-1))

    return run


def _clipped(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, 255)


def _luma(at: dict[str, np.ndarray]) -> np.ndarray:
    """Limited-range luma of integer colours."""
    return _clipped(((at["r"] * 66 + at["g"] * 129 + at["b"] * 25 + 128) >> 8) + 16)


def _chroma(at: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Limited-range U and V of integer colours."""
    return _clipped(((at["r"] * -38 - at["g"] * 74 + at["b"] * 112 + 128) >> 8) + 128), _clipped(((at["r"] * 112 - at["g"] * 94 - at["b"] * 18 + 128) >> 8) + 128)


def _chroma_views(buffer: np.ndarray, layout: str, h: int, w: int, sub: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second chroma plane of images (images, rows, columns, channels) of *h* rows and *w* columns of luma, as views of cells."""
    n, rows, cols = len(buffer), h // sub[1], w // sub[0]
    if layout in ("YUY2", "UYVY"):
        beside = buffer[..., 1 if layout == "YUY2" else 0]
        return beside[:, :, 0::2], beside[:, :, 1::2]
    below = buffer.reshape(n, -1)[:, h * w :]
    if layout.startswith("NV"):
        pairs = below.reshape(n, rows, cols, 2)
        return pairs[..., 0], pairs[..., 1]
    planes = below.reshape(n, 2, rows, cols)
    return planes[:, 0], planes[:, 1]


def encode(source: str, layout: str, sub: tuple[int, int], v_first: bool) -> Program:
    """Colours as a layout whose cells of *sub* columns and rows share a chroma pair."""

    def run(block: Block) -> Block:
        n, h, w, _ = block.data.shape
        sub_x, sub_y = sub
        if h % sub_y or w % sub_x:
            raise TensorError(f"{layout} does not take {h} rows and {w} columns")
        at, cells = _channels(block, source), sub_x * sub_y
        packed = layout in ("YUY2", "UYVY")
        out = np.empty((n, h, w, 2) if packed else (n, h * (cells + 2) // cells, w, 1), np.int32)
        if packed:
            out[..., 0 if layout == "YUY2" else 1] = _luma(at)
        else:
            out.reshape(n, -1)[:, : h * w].reshape(n, h, w)[:] = _luma(at)
        fold = lambda v: (v.reshape(n, h // sub_y, sub_y, w // sub_x, sub_x).sum((2, 4), dtype=np.int32) + cells // 2) // cells
        u, v = _chroma({k: fold(c) if cells > 1 else c for k, c in at.items()})
        first, second = _chroma_views(out, layout, h, w, sub)
        first[:], second[:] = (v, u) if v_first else (u, v)
        return _whole(out)

    return run


def decode(target: str, layout: str, sub: tuple[int, int], v_first: bool) -> Program:
    """Colours of a layout's images."""

    def run(block: Block) -> Block:
        n, rows, w, channels = block.data.shape
        (sub_x, sub_y), cells = sub, sub[0] * sub[1]
        packed = layout in ("YUY2", "UYVY")
        h = rows if packed else rows * cells // (cells + 2)
        if channels != (2 if packed else 1):
            raise TensorError(f"{layout} does not take {channels} channels")
        if (not packed and h * (cells + 2) != rows * cells) or h % sub_y or w % sub_x:
            raise TensorError(f"{layout} does not take {rows} rows and {w} columns")
        data = block.data.astype(np.int32)
        luma = data[..., 0 if layout == "YUY2" else 1] if packed else data.reshape(n, -1)[:, : h * w]
        first, second = _chroma_views(data, layout, h, w, sub)
        u, v = (second, first) if v_first else (first, second)
        # places by cell: chroma has axes of one there, and is spread by them
        c = np.maximum(luma - 16, 0).reshape(n, h // sub_y, sub_y, w // sub_x, sub_x) * 298 + 128
        d, e = (x[:, :, None, :, None] - 128 for x in (u, v))
        made = {"b": c + d * 516, "g": c - (d * 100 + e * 208), "r": c + e * 409}
        return _whole(np.stack([_clipped(made[k] >> 8).reshape(n, h, w) for k in target], axis=-1))

    return run
