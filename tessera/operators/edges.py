"""Edges that run through several tiles.

A tile finds its own edge elements, with derivatives from the margin around it, and labels their
components by union-find.  Labels that reach a tile's border form an equivalence table:
elements on both sides of a border are joined by their place, the components of that table are found
image by image - a row a label, not an element - and each tile keeps the components that are
strong themselves or through others.  Tiles are stored once between the two passes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import blocks

#: What a tile's first pass needs: strengths that are edge elements, and which of them are strong, from its blocks.
Detect = Callable[[list[blocks.Block]], tuple[blocks.Block, blocks.Block]]

_TILE = "img_id bigint, h int, w int, ty int, tx int"


def components(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the open elements of (images, rows, columns) and the number of each one's component, over eight neighbours.

    Each takes the least number among its neighbours' until all of a component have one; numbers are
    followed to their ends in each round, so rounds go with the logarithm of the longest path.
    """
    places = np.flatnonzero(open_)
    wide = np.full((open_.shape[0], open_.shape[1] + 1, open_.shape[2] + 2), -1, np.int32)
    rows, cols = wide.shape[1:]
    line, column = np.divmod(places, open_.shape[2])
    image, line = np.divmod(line, open_.shape[1])
    at = (image * rows + line) * cols + column + 1
    flat = wide.ravel()
    flat[at] = np.arange(len(places))
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        near = flat[at + (dy * cols + dx)]
        held = np.flatnonzero(near >= 0)
        links.append(np.stack([held, near[held]]))
    return places, united(len(places), *np.concatenate(links, axis=1))


def united(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, under links from *a* to *b*."""
    root = np.arange(count)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _labelled(tiles: DataFrame, margin: int, values: list[str], detect: Detect, size: int) -> DataFrame:
    """A row a tile: places of edge elements and their labels, the strong labels, and the elements on the tile's border."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k, held, own in blocks.tile_blocks(batch, margin, values, size):
                thin, strong = (b.crop(*own).data[..., 0].astype(bool) for b in detect(held))
                places, label = components(thin)
                label = label.astype(np.int32)
                y, x = np.unravel_index(places, thin.shape)[1:]
                edge = (y == 0) | (y == thin.shape[1] - 1) | (x == 0) | (x == thin.shape[2] - 1)
                head = [pa.array([batch.column(0)[k].as_py()], pa.int64()), *(pa.array([batch.column(c)[k].as_py()], pa.int32()) for c in range(1, 5))]
                lists = [places.astype(np.int32), label, np.unique(label[strong.ravel()[places]]), (y[edge] + own[0]).astype(np.int32), (x[edge] + own[2]).astype(np.int32), label[edge]]
                yield pa.RecordBatch.from_arrays([*head, *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in lists)], ["img_id", "h", "w", "ty", "tx", "places", "labels", "strong", "ys", "xs", "ends"])

    return tiles.mapInArrow(blocks.few_batches(run), f"{_TILE}, places array<int>, labels array<int>, strong array<int>, ys array<int>, xs array<int>, ends array<int>")


def _joined_labels(tiles: DataFrame, size: int) -> DataFrame:
    """``img_id, ty, tx, good``: labels that are strong through labels of other tiles."""
    import pyarrow as pa

    ends = tiles.select("img_id", "ty", "tx", "strong", F.explode(F.arrays_zip("ys", "xs", "ends")).alias("e"))
    ends = ends.select("img_id", "ty", "tx", F.col("e.ys").alias("y"), F.col("e.xs").alias("x"), F.col("e.ends").alias("label"), F.array_contains("strong", F.col("e.ends")).alias("strong"))
    # each border element looks at those of its right and lower neighbours that lie in another tile
    ways = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    looks = ends.withColumn("s", F.explode(ways)).withColumns({"ny": F.col("y") + F.col("s.dy"), "nx": F.col("x") + F.col("s.dx")})
    looks = looks.filter((F.floor(F.col("ny") / size) != F.col("ty")) | (F.floor(F.col("nx") / size) != F.col("tx")))
    other = ends.select("img_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.struct("ty", "tx", "label").alias("to"), F.col("strong").alias("to_strong"))
    links = looks.select("img_id", "ny", "nx", F.struct("ty", "tx", "label").alias("from"), "strong").join(other, ["img_id", "ny", "nx"])
    table = links.groupBy("img_id", "from", "to").agg(F.max("strong").alias("s"), F.max("to_strong").alias("t"))
    flat = table.select("img_id", *[F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("from", "to") for n in ("ty", "tx", "label")], "s", "t")

    def solve(group):
        columns = {n: np.asarray(group.column(n).combine_chunks()) for n in group.schema.names if n not in ("s", "t")}
        both = np.concatenate([np.stack([columns[f"{p}_{n}"] for n in ("ty", "tx", "label")], axis=1) for p in ("from", "to")])
        strong = np.concatenate([group.column(n).to_numpy() for n in ("s", "t")]).astype(bool)
        nodes, at = np.unique(both, axis=0, return_inverse=True)
        at = at.reshape(-1)
        half = len(at) // 2
        root = united(len(nodes), at[:half], at[half:])
        good = np.zeros(len(nodes), bool)
        good[root[at[strong]]] = True
        kept = nodes[good[root]].astype(np.int32)
        image = pa.array([columns["img_id"][0]] * len(kept), pa.int64())
        return pa.table([image, *(pa.array(kept[:, n]) for n in range(3))], ["img_id", "ty", "tx", "label"])

    found = flat.groupBy("img_id").applyInArrow(solve, "img_id bigint, ty int, tx int, label int")
    return found.groupBy("img_id", "ty", "tx").agg(F.collect_list("label").alias("good"))


def _drawn(tiles: DataFrame, size: int) -> DataFrame:
    """Elements of 255 at kept components and 0 elsewhere."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                image, h, w, ty, tx = (batch.column(n)[k].as_py() for n in range(5))
                rows, cols = min(size, h - ty * size), min(size, w - tx * size)
                places, labels, strong, good = (np.asarray(batch.column(n)[k].values) if batch.column(n)[k].is_valid else np.zeros(0, np.int32) for n in range(5, 9))
                out = np.zeros(rows * cols, np.int32)
                out[places[np.isin(labels, np.concatenate((strong, good)))]] = 255
                y, x = (p.ravel().astype(np.int32) for p in np.indices((rows, cols)))
                n = rows * cols
                sizes = [np.full(n, image, np.int64), np.full(n, h, np.int32), np.full(n, w, np.int32), y + np.int32(ty * size), x + np.int32(tx * size), np.zeros(n, np.int32), out]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in sizes], ["img_id", "h", "w", "y", "x", "c", "v"])

    return tiles.select(*_TILE.replace(" bigint", "").replace(" int", "").split(", "), "places", "labels", "strong", "good").mapInArrow(blocks.few_batches(run), "img_id bigint, h int, w int, y int, x int, c int, v int")


def across_tiles(px: DataFrame, margin: int, values: list[str], detect: Detect) -> DataFrame:
    """Edges of elements; images may have any number of tiles."""
    size = blocks.TILE
    tiles = stored(_labelled(blocks.tiles(px, margin, values), margin, values, detect, size), "edge-tiles")
    return _drawn(tiles.join(_joined_labels(tiles, size), ["img_id", "ty", "tx"], "left"), size)
