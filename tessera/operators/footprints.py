"""Geometry by footprints: output tiles and the source tiles that they read.

Elements are packed into source tiles.  For each output tile the places that it reads are bounded by
a rectangle, from the inverse map of its corners; every source tile hands the part of it
that lies in such a rectangle to that output tile, which is made of those parts alone.  So no task
holds an image, and two exchanges move packed tiles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import Block

Rectangle = tuple[int, int, int, int]


@dataclass(frozen=True)
class Mapping:
    """A geometric operator: the size of its result, the source rows and columns that a part of it reads, and that part.

    Rectangles are first and end rows, then columns.  ``reads`` names one place at least.
    """

    size: Callable[[int, int], tuple[int, int]]
    reads: Callable[[int, int, Rectangle], Rectangle]
    make: Callable[[Block, Rectangle], np.ndarray]

    def whole(self, block: Block) -> Block:
        """The result of a whole image."""
        h, w = self.size(block.h, block.w)
        return Block(self.make(block, (0, h, 0, w)), h, w)


def span(places: np.ndarray) -> tuple[int, int]:
    """First and end of source places."""
    return int(places.min()), int(places.max()) + 1


def folded_span(first: int, last: int, n: int, border: str) -> tuple[int, int]:
    """First and end of what the places from *first* to *last* read of an axis, constants counting as the nearest place."""
    if first >= 0 and last < n:
        return first, last + 1
    if border in ("CONSTANT", "REPLICATE") or last - first >= 2 * n:
        low, high = (first, last) if border in ("CONSTANT", "REPLICATE") else (0, n - 1)
        return min(max(low, 0), n - 1), min(max(high, 0), n - 1) + 1
    return span(blocks.folded(np.arange(first, last + 1), n, border)[0])


def _targets(mapping: Mapping, h: int, w: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Output tiles, by row and column, and the rectangles that they read."""
    mh, mw = mapping.size(h, w)
    at = [(ty, tx) for ty in range(-(-mh // size)) for tx in range(-(-mw // size))]
    reads = [mapping.reads(h, w, (ty * size, min(mh, (ty + 1) * size), tx * size, min(mw, (tx + 1) * size))) for ty, tx in at]
    return np.array(at, np.int32).reshape(-1, 2), np.array(reads, np.int64).reshape(-1, 4)


def on_elements(px: DataFrame, mapping: Mapping, kind: str) -> DataFrame:
    """*mapping* over elements; *kind* is Spark's type of the result's."""
    import pyarrow as pa

    given, size = np.dtype({"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[blocks.element_kind(px)]), blocks.TILE
    made_kind = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[kind]
    head = ["img_id", "h", "w", "oy", "ox"]

    def parts(batches):
        """From a source tile, what each output tile reads of it."""
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, (block,), _ in blocks.tile_blocks(batch, 0, ["v"], size):
                at, reads = known.get((block.h, block.w)) or known.setdefault((block.h, block.w), _targets(mapping, block.h, block.w, size))
                first_y, end_y = np.maximum(reads[:, 0], block.y0), np.minimum(reads[:, 1], block.y1)
                first_x, end_x = np.maximum(reads[:, 2], block.x0), np.minimum(reads[:, 3], block.x1)
                for t in np.flatnonzero((first_y < end_y) & (first_x < end_x)):
                    y0, y1, x0, x1 = int(first_y[t]), int(end_y[t]), int(first_x[t]), int(end_x[t])
                    part = np.ascontiguousarray(block.crop(y0, y1, x0, x1).data)
                    row = [batch.column(0)[k].as_py(), block.h, block.w, int(at[t, 0]), int(at[t, 1]), y0, x0, y1 - y0, x1 - x0, part.shape[3]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if n == 0 else pa.int32()) for n, v in enumerate(row)] + [pa.array([part.tobytes()], pa.binary())], [*head, "y", "x", "rows", "cols", "cn", "data"])

    def tiles(batches):
        """An output tile, from its parts."""
        for batch in batches:
            for k in range(len(batch)):
                image, h, w, oy, ox = (batch.column(n)[k].as_py() for n in range(5))
                mh, mw = mapping.size(h, w)
                own = (oy * size, min(mh, (oy + 1) * size), ox * size, min(mw, (ox + 1) * size))
                y0, y1, x0, x1 = mapping.reads(h, w, own)
                y, x, rows, cols, cn, data = (batch.column(5).slice(k, 1).flatten().field(n) for n in range(6))
                y, x, rows, cols, cn = (np.asarray(c) for c in (y, x, rows, cols, cn))
                held = np.zeros((1, y1 - y0, x1 - x0, int(cn.max())), given)
                for n in range(len(y)):
                    held[0, y[n] - y0 : y[n] - y0 + rows[n], x[n] - x0 : x[n] - x0 + cols[n], : cn[n]] = np.frombuffer(data[n].as_buffer(), given).reshape(rows[n], cols[n], cn[n])
                made = mapping.make(Block(held, h, w, y0, x0), own)
                yy, xx, cc = (p.ravel().astype(np.int32) for p in np.indices(made.shape[1:]))
                n = len(yy)
                columns = [np.full(n, image, np.int64), np.full(n, mh, np.int32), np.full(n, mw, np.int32), yy + np.int32(own[0]), xx + np.int32(own[2]), cc, made.ravel().astype(made_kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["img_id", "h", "w", "y", "x", "c", "v"])

    handed = blocks.tiles(px, 0, ["v"]).mapInArrow(blocks.few_batches(parts), "img_id bigint, h int, w int, oy int, ox int, y int, x int, rows int, cols int, cn int, data binary")
    groups = handed.groupBy(*head).agg(F.collect_list(F.struct("y", "x", "rows", "cols", "cn", "data")).alias("parts"))
    return groups.mapInArrow(blocks.few_batches(tiles), f"img_id bigint, h int, w int, y int, x int, c int, v {kind}")


def on_frame(frame: DataFrame, mapping: Mapping, depth: str) -> DataFrame:
    """*mapping* over dense arrays, where they are, or over elements, by footprints."""
    if blocks.is_dense(frame):
        return blocks.on_blocks(frame, mapping.whole, depth)
    return on_elements(frame, mapping, blocks.STORAGE[depth])
