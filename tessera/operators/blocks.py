"""Array programs over whole images or tiles of them, in Arrow batches.

A program takes a :class:`Block`, a rectangle of equally shaped images, and gives another one.  Dense
arrays are blocks as they are: no shuffle, images of one shape are stacked, a part of a batch
at a time.  Elements are first dealt into tiles, each with the margin that the program reads around it, in
one exchange by image and tile; a program that needs whole images has one tile an image.

Coordinates are those of the whole image, so borders are where the image ends and not where a tile does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.depths import LIMITS, STORAGE

#: Rows and columns of a tile.
TILE = 256
#: Elements that are stacked at once: few enough for a processor's cache, many enough for one call.
STACK = 400_000
#: Longest window whose sums are made of windows of powers of two; longer ones take running sums.
SHORT = 64


def source_places(first: int, last: int, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Source coordinates of *first* to *last* - 1 along an axis of length *n*, and which of them are read at all."""
    p = np.arange(first, last)
    return folded(p, n, border)


def folded(p: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Source coordinates of the places *p*, and which of them are read and not a constant."""
    if border == "CONSTANT":
        return np.clip(p, 0, n - 1), (p >= 0) & (p < n)
    if border == "REPLICATE":
        q = np.clip(p, 0, n - 1)
    elif border == "WRAP":
        q = p % n
    elif border == "REFLECT":
        q = p % (2 * n)
        q = np.where(q < n, q, 2 * n - 1 - q)
    else:
        q = (n - 1) - np.abs(p % max(1, 2 * (n - 1)) - (n - 1))
    return q, np.ones(p.shape, bool)


def rounded(v: np.ndarray) -> np.ndarray:
    """Nearest integers, halves away from zero."""
    whole = np.trunc(v)
    return whole + np.where(np.abs(v - whole) >= 0.5, np.copysign(1.0, v), 0.0)


def saturated(v: np.ndarray, depth: str) -> np.ndarray:
    """Numbers as elements of *depth*."""
    if depth in LIMITS:
        low, high = LIMITS[depth]
        if v.dtype.kind in "iu":
            return np.clip(v, low, high).astype(np.int32)
        if low < 0:
            return np.clip(rounded(np.nan_to_num(v, nan=0.0)), low, high).astype(np.int32)
        v = np.fmin(np.fmax(v, low), high)  # what is not a number becomes 0
        whole = np.floor(v)
        return (whole + (v - whole >= 0.5)).astype(np.int32)
    if depth == "16F":
        return v.astype(np.float16).astype(np.float32)
    return v.astype({"32F": np.float32, "64F": np.float64}[depth])


@dataclass
class Block:
    """Rows ``y0`` to ``y1`` and columns ``x0`` to ``x1`` of images of *h* rows and *w* columns: ``data`` is images, rows, columns, channels."""

    data: np.ndarray
    h: int
    w: int
    y0: int = 0
    x0: int = 0

    @property
    def y1(self) -> int:
        return self.y0 + self.data.shape[1]

    @property
    def x1(self) -> int:
        return self.x0 + self.data.shape[2]

    def like(self, data: np.ndarray) -> Block:
        return Block(data, self.h, self.w, self.y0, self.x0)

    def crop(self, y0: int, y1: int, x0: int, x1: int) -> Block:
        return Block(self.data[:, y0 - self.y0 : y1 - self.y0, x0 - self.x0 : x1 - self.x0], self.h, self.w, y0, x0)

    def _taken(self, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        """Rows *ys* and columns *xs*, most of which stand as they are: those are copied as one part."""
        spans = []
        for at in (ys, xs):
            if not len(at):
                return self.data[:, ys][:, :, xs]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
            k = int(np.argmax(np.diff(cuts)))
            spans.append((int(cuts[k]), int(cuts[k + 1])))
        (y0, y1), (x0, x1) = spans
        wide = np.empty((len(self.data), len(ys), len(xs), self.data.shape[3]), self.data.dtype)
        own = slice(ys[y0], ys[y1 - 1] + 1)
        wide[:, y0:y1, x0:x1] = self.data[:, own, xs[x0] : xs[x1 - 1] + 1]
        wide[:, y0:y1, :x0] = self.data[:, own][:, :, xs[:x0]]
        wide[:, y0:y1, x1:] = self.data[:, own][:, :, xs[x1:]]
        for rows in (slice(0, y0), slice(y1, len(ys))):
            wide[:, rows] = self.data[:, ys[rows]][:, :, xs]
        return wide

    def around(self, top: int, bottom: int, left: int, right: int, border: str, constant: float = 0) -> tuple[Block, np.ndarray, np.ndarray | None]:
        """The part whose margins are known, as a frame to fill; its elements with the margins; and a mask of those that exist, if not all do."""
        y0, y1 = self.y0 + (top if self.y0 else 0), self.y1 - (bottom if self.y1 < self.h else 0)
        x0, x1 = self.x0 + (left if self.x0 else 0), self.x1 - (right if self.x1 < self.w else 0)
        ys, in_y = source_places(y0 - top, y1 + bottom, self.h, border)
        xs, in_x = source_places(x0 - left, x1 + right, self.w, border)
        wide = self._taken(ys - self.y0, xs - self.x0)
        mask = None
        if not (in_y.all() and in_x.all()):
            mask = (in_y[:, None] & in_x)[None, :, :, None]
            wide = np.where(mask, wide, np.asarray(constant, wide.dtype))
        return Block(np.empty((0, y1 - y0, x1 - x0, 0)), self.h, self.w, y0, x0), wide, mask


Program = Callable[[Block], Block]


def reach(taps: list[tuple[int, int, float]]) -> tuple[int, int, int, int]:
    """How far taps read above, below, left and right."""
    ys, xs = [t[0] for t in taps], [t[1] for t in taps]
    return max(0, -min(ys)), max(0, max(ys)), max(0, -min(xs)), max(0, max(xs))


def shifted(frame: Block, wide: np.ndarray, margins: tuple[int, int, int, int], dy: int, dx: int) -> np.ndarray:
    """The elements of *wide* at a distance from the frame's."""
    rows, cols = frame.data.shape[1:3]
    top, left = margins[0] + dy, margins[2] + dx
    return wide[:, top : top + rows, left : left + cols]


def narrow(v: np.ndarray) -> bool:
    """Whether all numbers fit in 16 bits."""
    return not v.size or (int(v.min()) >= -(1 << 15) and int(v.max()) < 1 << 16)


def weighted(block: Block, taps: list[tuple[int, int, float]], border: str) -> Block:
    """The weighted sum of the taps in order, in double; constants count as 0."""
    margins = reach(taps)
    frame, wide, _ = block.around(*margins, border)
    if wide.dtype.kind in "iu" and all(t[2] == 1 for t in taps) and len(taps) == (1 + margins[0] + margins[1]) * (1 + margins[2] + margins[3]):
        # a full window of integers: columns, then rows, exact in any order
        width, height = 1 + margins[2] + margins[3], 1 + margins[0] + margins[1]
        most = 255 if wide.dtype == np.uint8 else None
        return frame.like(window_sums(window_sums(wide, width, 2, most), height, 1, most and most * width))
    shape = (len(wide), *frame.data.shape[1:3], wide.shape[3])
    if wide.dtype.kind in "iu" and (wide.dtype.itemsize <= 2 or narrow(wide)):
        if all(float(t[2]).is_integer() and abs(t[2]) < 1 << 15 for t in taps) and sum(abs(t[2]) for t in taps) < 1 << 15:
            # small integers: exact in 32 bits
            wide, acc = wide.astype(np.int32), np.zeros(shape, np.int32)
            for dy, dx, weight in taps:
                if weight:
                    part = shifted(frame, wide, margins, dy, dx)
                    acc += part if weight == 1 else part * np.int32(weight)
            return frame.like(acc)
    wide, acc = wide.astype(np.float64), np.zeros(shape)
    for dy, dx, weight in taps:
        acc += weight * shifted(frame, wide, margins, dy, dx)
    return frame.like(acc)


def _part(v: np.ndarray, axis: int, first: int, last: int | None) -> np.ndarray:
    return v[(slice(None),) * axis + (slice(first, last),)]


def window_sums(v: np.ndarray, size: int, axis: int, most: int | None = None) -> np.ndarray:
    """Sums of *size* consecutive integers along an axis, in 32 bits, or in 16 where *most*, the greatest element, allows.

    Windows up to ``SHORT`` are made of windows of powers of two, longer ones are differences of
    running sums, at the same cost whatever their length.  Running sums may wrap; their differences
    are exact as long as a window's sum fits.
    """
    count = v.shape[axis] - size + 1
    kind = np.uint16 if most is not None and v.min(initial=0) >= 0 and most * size < 1 << 16 else np.int32
    if size > SHORT:
        running = np.cumsum(v, axis=axis, dtype=np.int32)
        out = _part(running, axis, size - 1, None).copy()
        _part(out, axis, 1, None)[...] -= _part(running, axis, 0, count - 1)
        return out
    power, at, left, out = v.astype(kind), 0, size, None
    length = 1
    while left:
        if left & 1:
            part = _part(power, axis, at, at + count)
            out = part.copy() if out is None else np.add(out, part, out=out)
            at += length
        left >>= 1
        if left:
            power = _part(power, axis, 0, power.shape[axis] - length) + _part(power, axis, length, None)
            length *= 2
    return out


def window_extremes(v: np.ndarray, size: int, axis: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest of *size* consecutive elements along an axis.

    Extremes over windows of powers of two are made of two halves, and a window of two of them that may overlap.
    """
    reach_, out = 1, v
    while 2 * reach_ <= size:
        out = best(_part(out, axis, 0, out.shape[axis] - reach_), _part(out, axis, reach_, None))
        reach_ *= 2
    if reach_ < size:
        out = best(_part(out, axis, 0, out.shape[axis] - (size - reach_)), _part(out, axis, size - reach_, None))
    return out


def single_sums(wide: np.ndarray, weights: list[tuple[int, float]], axis: int, count: int) -> np.ndarray:
    """Weighted sums along an axis in 32F; taps with equal weights are added up first."""
    by: dict[float, list[int]] = {}
    for k, weight in weights:
        if weight:
            by.setdefault(weight, []).append(k)
    total = None
    for weight, places in by.items():
        part = _part(wide, axis, places[0], places[0] + count)
        if len(places) > 1:
            part = part + _part(wide, axis, places[1], places[1] + count)
            for k in places[2:]:
                part += _part(wide, axis, k, k + count)
            part *= np.float32(weight)
        else:
            part = part * np.float32(weight)
        total = part if total is None else np.add(total, part, out=total)
    return total


def together(a: Block, b: Block) -> tuple[Block, Block]:
    """The part that both blocks have."""
    span = max(a.y0, b.y0), min(a.y1, b.y1), max(a.x0, b.x0), min(a.x1, b.x1)
    return a.crop(*span), b.crop(*span)


# -- Spark -----------------------------------------------------------------


#: Bytes of small batches that are handed on together.
TOGETHER = 8 << 20


def few_batches(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """*run* with its small batches joined to larger ones, since each costs the same to hand on."""

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= TOGETHER:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def is_dense(frame: DataFrame) -> bool:
    return "data" in frame.columns


def _numbers(column) -> np.ndarray:
    """The elements of an Arrow list or binary column, joined."""
    import pyarrow as pa

    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return column.flatten().to_numpy(zero_copy_only=False)


def _stacks(shapes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last row of parts of a batch with one shape and about ``STACK`` elements."""
    first = 0
    while first < len(shapes):
        same = np.flatnonzero((shapes[first:] != shapes[first]).any(1))
        last = first + (int(same[0]) if len(same) else len(shapes) - first)
        step = max(1, STACK // max(1, int(shapes[first].prod())))
        for k in range(first, last, step):
            yield k, min(k + step, last)
        first = last


def _list(flat: np.ndarray, rows: int, kind: str):
    import pyarrow as pa

    per = flat.size // rows if rows else 0
    if kind == "binary":
        flat = np.ascontiguousarray(flat, np.uint8)
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * per).astype(np.int32)), pa.py_buffer(flat)])
    kinds = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}
    return pa.ListArray.from_arrays(pa.array((np.arange(rows + 1) * per).astype(np.int32)), pa.array(np.ascontiguousarray(flat.ravel(), kinds[kind])))


def element_kind(frame: DataFrame) -> str:
    """Spark's type of an element."""
    if not is_dense(frame):
        return frame.schema["v"].dataType.simpleString()
    kind = frame.schema["data"].dataType
    return "int" if kind.simpleString() == "binary" else kind.elementType.simpleString()


def on_blocks(frame: DataFrame, program: Program, depth: str | None, margin: int | None = None) -> DataFrame:
    """*program* over dense arrays or over elements, in the same form as they are given.

    *depth* names the result's elements (as they were, if none); *margin* is how far the program reads in all,
    none if it needs whole images or changes their shape.  Dense 8U results of binary arrays are binary too.
    """
    kind = STORAGE[depth] if depth else element_kind(frame)
    return _dense(frame, program, kind, depth) if is_dense(frame) else _tiled(frame, program, kind, margin)


def _dense(arrays: DataFrame, program: Program, kind: str, depth: str | None) -> DataFrame:
    import pyarrow as pa

    binary = arrays.schema["data"].dataType.simpleString() == "binary"
    kind, stored = ("binary", "binary") if binary and depth in (None, "8U") else (kind, f"array<{kind}>")

    def run(batches):
        for batch in batches:
            shapes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=1) if len(batch) else np.zeros((0, 3), np.int64)
            for first, last in _stacks(shapes):
                h, w, cn = map(int, shapes[first])
                flat = _numbers(batch.column(4).slice(first, last - first))
                made = program(Block(flat.reshape(last - first, h, w, cn), h, w))
                rows, (mh, mw, mcn) = last - first, made.data.shape[1:]
                sizes = [pa.array(np.full(rows, v, np.int32)) for v in (mh, mw, mcn)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), *sizes, _list(made.data, rows, kind)], ["img_id", "h", "w", "cn", "data"])

    return arrays.select("img_id", F.col("h").cast("int"), F.col("w").cast("int"), F.col("cn").cast("int"), "data").mapInArrow(run, f"img_id bigint, h int, w int, cn int, data {stored}")


def tiles(px: DataFrame, margin: int | None, values: list[str]) -> DataFrame:
    """Elements by image and tile, ``ty`` and ``tx``, each with those around it; one exchange."""
    if margin is None:
        each = px.withColumns({"ty": F.lit(0), "tx": F.lit(0)})
    else:
        near = lambda p, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(p) - margin) / TILE)), F.least(F.floor((F.col(n) - 1) / TILE), F.floor((F.col(p) + margin) / TILE)))
        each = px.withColumn("ty", F.explode(near("y", "h"))).withColumn("tx", F.explode(near("x", "w")))
    at = F.struct("y", "x", "c", *values)
    return each.groupBy("img_id", "h", "w", "ty", "tx").agg(F.collect_list(at).alias("at"))


def tile_blocks(batch, margin: int | None, values: list[str], size: int = TILE) -> Iterator[tuple[int, list[Block], tuple[int, int, int, int]]]:
    """From a batch of :func:`tiles`: the row, a block for each of the values, and the tile's own part."""
    for k in range(len(batch)):
        h, w, ty, tx = (int(batch.column(c)[k].as_py()) for c in (1, 2, 3, 4))
        at = batch.column(5).slice(k, 1).flatten()
        y, x, c, *found = (at.field(i).to_numpy(zero_copy_only=False) for i in range(3 + len(values)))
        own = (0, h, 0, w) if margin is None else (ty * size, min(h, (ty + 1) * size), tx * size, min(w, (tx + 1) * size))
        span = own if margin is None else (max(0, own[0] - margin), min(h, own[1] + margin), max(0, own[2] - margin), min(w, own[3] + margin))
        shape = (1, span[1] - span[0], span[3] - span[2], int(c.max()) + 1)
        blocks = []
        for v in found:
            data = np.zeros(shape, v.dtype)
            data[0, y - span[0], x - span[2], c] = v
            blocks.append(Block(data, h, w, span[0], span[2]))
        yield k, blocks, own


def _tiled(px: DataFrame, program: Program, kind: str, margin: int | None) -> DataFrame:
    import pyarrow as pa

    types, size = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}, TILE

    def run(batches):
        for batch in batches:
            for k, (block,), own in tile_blocks(batch, margin, ["v"], size):
                made = program(block)
                if margin is not None:
                    made = made.crop(*own)
                y, x, c = (p.ravel().astype(np.int32) for p in np.indices(made.data.shape[1:]))
                n = len(y)
                ids = pa.array(np.full(n, batch.column(0)[k].as_py()), pa.int64())
                sizes = [pa.array(np.full(n, v, np.int32)) for v in (made.h, made.w)]
                yield pa.RecordBatch.from_arrays([ids, *sizes, pa.array(y + made.y0), pa.array(x + made.x0), pa.array(c), pa.array(made.data.ravel().astype(types[kind]))], ["img_id", "h", "w", "y", "x", "c", "v"])

    return tiles(px, margin, ["v"]).mapInArrow(few_batches(run), f"img_id bigint, h int, w int, y int, x int, c int, v {kind}")
