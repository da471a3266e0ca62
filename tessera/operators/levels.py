"""Thresholds, automatic thresholds and look-up tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.depths import STORAGE, TensorError, saturate
from ..sources.shared import stored
from . import blocks
from .arrays import KEY
from .blocks import Block, saturated

KINDS = ("BINARY", "BINARY_INV", "TRUNC", "TOZERO", "TOZERO_INV")


def threshold_value(v: Column, thresh: Column | float, maxval: float, kind: str, depth: str) -> Column:
    """The thresholded value; 8U floors the threshold, values are compared in double."""
    if kind not in KINDS or depth not in ("8U", "32F"):
        raise TensorError(f"threshold does not take {kind!r} of {depth}")
    t = thresh if isinstance(thresh, Column) else F.lit(float(math.floor(thresh)) if depth == "8U" else float(thresh))
    over, top, zero = v.cast("double") > t, saturate(F.lit(float(maxval)), depth), F.lit(0).cast(STORAGE[depth])
    low = saturate(t, depth)
    made = {"BINARY": (top, zero), "BINARY_INV": (zero, top), "TRUNC": (low, v), "TOZERO": (v, zero), "TOZERO_INV": (zero, v)}[kind]
    return F.when(over, made[0]).otherwise(made[1])


def _thresholded(v: np.ndarray, t: np.ndarray | float, maxval: float, kind: str, depth: str) -> np.ndarray:
    """Values against thresholds that spread over them."""
    top, low = (saturated(np.asarray(x, np.float64), depth) for x in (maxval, t))
    over, zero = v > t, np.zeros((), low.dtype)
    made = {"BINARY": (top, zero), "BINARY_INV": (zero, top), "TRUNC": (low, v), "TOZERO": (v, zero), "TOZERO_INV": (zero, v)}[kind]
    return np.where(over, *made)


def threshold(px: DataFrame, thresh: float, maxval: float, kind: str, depth: str = "8U") -> DataFrame:
    """A fixed threshold, over dense arrays or elements."""
    if kind not in KINDS or depth not in ("8U", "32F"):
        raise TensorError(f"threshold does not take {kind!r} of {depth}")
    if blocks.is_dense(px):
        t = float(math.floor(thresh)) if depth == "8U" else float(thresh)
        return blocks.on_blocks(px, lambda b: b.like(_thresholded(b.data, t, maxval, kind, depth)), depth)
    return px.withColumn("v", threshold_value(F.col("v"), thresh, maxval, kind, depth))


def histogram(px: DataFrame) -> DataFrame:
    """``img_id, v, n``; counts meet map-side."""
    return px.groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """``img_id, t``: the lowest threshold of greatest between-class variance of one-channel 8U images."""
    h = histogram(px)
    w = Window.partitionBy("img_id").orderBy("v")
    whole = Window.partitionBy("img_id")
    sums = h.select("img_id", "v", F.sum("n").over(w).alias("wb"), F.sum(F.col("n") * F.col("v")).over(w).alias("sb"), F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    wf = F.col("total") - F.col("wb")
    mb, mf = F.col("sb").cast("double") / F.col("wb"), (F.col("s") - F.col("sb")).cast("double") / F.when(wf == 0, 1).otherwise(wf)
    between = F.when(wf > 0, F.col("wb").cast("double") * wf.cast("double") * (mb - mf) * (mb - mf)).otherwise(0.0)
    best = sums.withColumn("between", between).groupBy("img_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("v"), F.max("between").alias("between"))
    return best.select("img_id", F.when(F.col("between") > 0, F.col("v")).otherwise(0).alias("t"))


def triangle(px: DataFrame) -> DataFrame:
    """``img_id, t``: the place farthest from the line between the histogram's peak and its longer tail, less one."""
    h = histogram(px)
    ends = h.groupBy("img_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max_by("v", F.struct("n", -F.col("v"))).alias("peak"), F.max("n").alias("top"))
    ends = ends.withColumns({"left": F.when(F.col("lo") > 0, F.col("lo") - 1).otherwise(F.col("lo")), "right": F.when(F.col("hi") < 255, F.col("hi") + 1).otherwise(F.col("hi"))})
    # the longer tail is looked at as the left one
    ends = ends.withColumn("flip", F.col("peak") - F.col("left") < F.col("right") - F.col("peak"))
    side = F.when(F.col("flip"), 255 - F.col("right")).otherwise(F.col("left"))
    peak = F.when(F.col("flip"), 255 - F.col("peak")).otherwise(F.col("peak"))
    lines = ends.select("img_id", "flip", "top", side.alias("first"), peak.alias("last"))
    places = lines.select("*", F.explode(F.when(F.col("last") > F.col("first"), F.sequence(F.col("first") + 1, F.col("last"))).otherwise(F.array().cast("array<int>"))).alias("i"))
    counts = h.select("img_id", F.col("v").alias("_v"), "n")
    at = places.withColumn("_v", F.when(F.col("flip"), 255 - F.col("i")).otherwise(F.col("i"))).join(counts, ["img_id", "_v"], "left")
    distance = F.col("top").cast("double") * F.col("i") + (F.col("first") - F.col("last")).cast("double") * F.coalesce("n", F.lit(0))
    best = at.withColumn("d", distance).groupBy("img_id").agg(F.max_by("i", F.struct("d", -F.col("i"))).alias("i"), F.max("d").alias("d"))
    full = lines.join(best, "img_id", "left")
    t = F.coalesce(F.when(F.col("d") > 0, F.col("i")), F.col("first")) - 1
    return full.select("img_id", F.when(F.col("flip"), 255 - t).otherwise(t).cast("int").alias("t"))


def otsu_level(counts: np.ndarray) -> int:
    """Otsu's threshold of 256 counts, as :func:`otsu`."""
    levels = np.arange(256)
    wb, sb = np.cumsum(counts), np.cumsum(counts * levels)
    wf, s = wb[-1] - wb, sb[-1]
    mb, mf = sb / np.maximum(wb, 1), (s - sb) / np.maximum(wf, 1)
    between = np.where((wf > 0) & (counts > 0), wb.astype(np.float64) * wf.astype(np.float64) * (mb - mf) * (mb - mf), 0.0)
    best = int(np.argmax(between))
    return best if between[best] > 0 else 0


def triangle_level(counts: np.ndarray) -> int:
    """The triangle threshold of 256 counts, as :func:`triangle`."""
    seen = np.flatnonzero(counts)
    low, high, peak = int(seen[0]), int(seen[-1]), int(np.argmax(counts))
    left, right = max(0, low - 1), min(255, high + 1)
    flip = peak - left < right - peak
    first, last = (255 - right, 255 - peak) if flip else (left, peak)
    counts = counts[::-1] if flip else counts
    t = first
    if last > first:
        places = np.arange(first + 1, last + 1)
        distance = float(counts[last]) * places + float(first - last) * counts[places]
        best = int(np.argmax(distance))
        t = int(places[best]) if distance[best] > 0 else first
    return 255 - (t - 1) if flip else t - 1


_LEVELS = {"OTSU": otsu_level, "TRIANGLE": triangle_level}


def _counts(values: np.ndarray) -> np.ndarray:
    return np.bincount(values.ravel(), minlength=256)[:256].astype(np.int64)


def auto_threshold(px: DataFrame, method: str, maxval: float, kind: str) -> DataFrame:
    """Otsu's or the triangle threshold of one-channel 8U images applied; of elements, with the threshold ``t``.

    Dense arrays need no exchange.  Elements are read once: they are packed into tiles with their counts, which
    are added up by image, and the thresholds go back to the tiles by a join of a row a tile.
    """
    if method not in _LEVELS:
        raise TensorError(f"unknown method {method!r}")
    if kind not in KINDS:
        raise TensorError(f"unknown threshold {kind!r}")
    level = _LEVELS[method]
    if blocks.is_dense(px):

        def program(block: Block) -> Block:
            if not block.data.size:
                return block
            t = np.array([level(_counts(one)) for one in block.data]).reshape(-1, 1, 1, 1)
            return block.like(_thresholded(block.data, t, maxval, kind, "8U"))

        return blocks.on_blocks(px, program, "8U")
    tiles = stored(_counted(px), "level-tiles")
    found = tiles.select("img_id", "counts").groupBy("img_id").applyInArrow(_merged(level), "img_id bigint, t int")
    return _applied(tiles.join(found, "img_id"), maxval, kind)


def _counted(px: DataFrame) -> DataFrame:
    """Tiles of elements as bytes, with their places and counts."""
    import pyarrow as pa

    size = blocks.TILE

    def run(batches):
        for batch in batches:
            for k, (block,), own in blocks.tile_blocks(batch, 0, ["v"], size):
                row = [batch.column(0)[k].as_py(), block.h, block.w, own[0], own[2], *block.data.shape[1:]]
                columns = [pa.array([v], pa.int64() if n == 0 else pa.int32()) for n, v in enumerate(row)]
                data = block.data.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data.tobytes()], pa.binary()), pa.array([_counts(data).tolist()], pa.list_(pa.int64()))], ["img_id", "h", "w", "y", "x", "rows", "cols", "cn", "data", "counts"])

    return blocks.tiles(px, 0, ["v"]).mapInArrow(blocks.few_batches(run), "img_id bigint, h int, w int, y int, x int, rows int, cols int, cn int, data binary, counts array<bigint>")


def _merged(level):
    import pyarrow as pa

    def run(group):
        counts = np.asarray(group.column("counts").combine_chunks().flatten()).reshape(-1, 256).sum(0)
        return pa.table([group.column("img_id").slice(0, 1), pa.array([level(counts)], pa.int32())], ["img_id", "t"])

    return run


def _applied(tiles: DataFrame, maxval: float, kind: str) -> DataFrame:
    """Elements of tiles against their ``t``."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                image, h, w, y0, x0, rows, cols, cn, t = (batch.column(n)[k].as_py() for n in range(9))
                data = np.frombuffer(batch.column(9)[k].as_buffer(), np.uint8).astype(np.int32)
                made = _thresholded(data, t, maxval, kind, "8U").astype(np.int32)
                y, x, c = (p.ravel().astype(np.int32) for p in np.indices((rows, cols, cn)))
                n = len(data)
                columns = [np.full(n, image, np.int64), np.full(n, h, np.int32), np.full(n, w, np.int32), y + np.int32(y0), x + np.int32(x0), c, np.full(n, t, np.int32), made]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], [*KEY, "t", "v"])

    return tiles.select("img_id", "h", "w", "y", "x", "rows", "cols", "cn", "t", "data").mapInArrow(blocks.few_batches(run), "img_id bigint, h int, w int, y int, x int, c int, t int, v int")


def lut(px: DataFrame, table: list[float] | list[list[float]], depth: str = "8U") -> DataFrame:
    """8U arrays or elements looked up in 256 values, or in 256 values for each channel."""
    per = table if isinstance(table[0], (list, tuple)) else [table]
    if any(len(t) != 256 for t in per):
        raise TensorError("a table has 256 values")
    if blocks.is_dense(px):
        known = np.array(per)

        def program(block: Block) -> Block:
            channel = np.arange(block.data.shape[3])
            channel[channel >= len(per)] = 0
            return block.like(known[channel, block.data])

        return blocks.on_blocks(px, program, depth)
    arrays = [F.array(*[F.lit(v) for v in t]).cast(f"array<{STORAGE[depth]}>") for t in per]
    value = F.get(arrays[0], F.col("v"))
    for k, a in enumerate(arrays[1:], 1):
        value = F.when(F.col("c") == k, F.get(a, F.col("v"))).otherwise(value)
    return px.withColumn("v", value)
