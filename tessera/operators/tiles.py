"""Products of matrices by tiles: one row a tile, never a row an element product.

A tile is a row of batch keys, ``ti``, ``tj``, its size and its elements as little-endian doubles.
Tiles of a left and a right matrix meet by the inner tile, are multiplied where they meet, and
partial products of an output tile are added up: in the task that made them, then after one
exchange by output tile, a row at a time in key order.  So tiles are shuffled, in proportion to the
products of tiles at most, and a task holds ``HELD`` tiles, or as many small ones as have few bytes.  An inner tile with too many
partners is split by Spark's skew join, which copies the other side to each part.

Missing elements count as 0; a tile ends at the last row and column that it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import TOGETHER, _numbers, few_batches

#: Rows and columns of a tile.
SIDE = 128
#: Output tiles whose partial products a task adds up at least before it hands them on.
HELD = 64
_TILE = "rows int, cols int, data binary"


def _matrix(rows: int, cols: int, data) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, cols)


def _table(keys: list[tuple], fields, found: list[np.ndarray]):
    """An Arrow batch of tiles by their keys."""
    import pyarrow as pa

    columns = [pa.array([k[n] for k in keys], f.type) for n, f in enumerate(fields)]
    sizes = [pa.array([m.shape[n] for m in found], pa.int32()) for n in (0, 1)]
    data = pa.array([np.ascontiguousarray(m, "<f8").tobytes() for m in found], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, *sizes, data], [*(f.name for f in fields), "rows", "cols", "data"])


def _rows(batch, width: int) -> list[tuple]:
    """The first columns of a batch, row by row."""
    return list(zip(*(batch.column(n).to_pylist() for n in range(width)), strict=True))


def _tables(keys: list[tuple], fields, found: list[np.ndarray]):
    """Tiles as Arrow batches of ``TOGETHER`` bytes or little more."""
    first, size = 0, 0
    for k, tile in enumerate(found):
        size += tile.nbytes
        if size >= TOGETHER or k == len(found) - 1:
            yield _table(keys[first : k + 1], fields, found[first : k + 1])
            first, size = k + 1, 0


def _tasks(frame: DataFrame) -> int:
    """As many tasks as the session deals out to; a tile costs more than its bytes tell, so few bytes are not put together."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def of_elements(m: DataFrame, keys: list[str], trans: bool, side: int = SIDE) -> DataFrame:
    """Tiles of ``i, j, v`` elements; one exchange."""
    row, col = ("j", "i") if trans else ("i", "j")
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    within = F.struct((F.col(row) % side).alias("y"), (F.col(col) % side).alias("x"), F.col("v").cast("double").alias("v"))
    each = m.select(*keys, at(row).alias("ti"), at(col).alias("tj"), within.alias("e"))
    groups = each.repartition(_tasks(m), *keys, "ti", "tj").groupBy(*keys, "ti", "tj").agg(F.collect_list("e").alias("at"))
    names = [*keys, "ti", "tj"]

    def run(batches):
        for batch in batches:
            lists, fields = batch.column(len(names)), [batch.schema.field(n) for n in range(len(names))]
            y, x, v = (lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in range(3))
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            found = []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                tile = np.zeros((int(y[s:e].max()) + 1, int(x[s:e].max()) + 1))
                tile[y[s:e], x[s:e]] = v[s:e]
                found.append(tile)
            yield from _tables(_rows(batch, len(names)), fields, found)

    return groups.mapInArrow(few_batches(run), f"{_keys(groups, names)}, {_TILE}")


def of_dense(arrays: DataFrame, trans: bool, side: int = SIDE) -> DataFrame:
    """Tiles of dense one-channel arrays, cut where they are, with the key ``mat_id``."""
    import pyarrow as pa

    fields = [pa.field("mat_id", pa.int64()), pa.field("ti", pa.int32()), pa.field("tj", pa.int32())]

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                mat, h, w = (batch.column(n)[k].as_py() for n in range(3))
                whole = _numbers(batch.column(3).slice(k, 1)).astype("<f8").reshape(h, w)
                whole = whole.T if trans else whole
                spots = [(mat, y, x) for y in range(-(-whole.shape[0] // side)) for x in range(-(-whole.shape[1] // side))]
                yield from _tables(spots, fields, [whole[y * side : (y + 1) * side, x * side : (x + 1) * side] for _, y, x in spots])

    return arrays.select(F.col("img_id").alias("mat_id"), "h", "w", "data").mapInArrow(few_batches(run), f"mat_id bigint, ti int, tj int, {_TILE}")


def _keys(frame: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names)


def multiply(left: DataFrame, right: DataFrame, met: list[Column] | list[str], keys: dict[str, str]) -> DataFrame:
    """Tiles of the products of tiles that meet.

    *left* has ``ti, k`` and *right* ``k, tj`` besides their batch columns; *met* is the join's condition, *keys* names
    the result's batch columns and the input columns that hold them.
    """
    part = lambda f, p: f.withColumnsRenamed({n: f"{p}_{n}" for n in ("rows", "cols", "data")})
    joined = part(left, "l").join(part(right, "r"), met)
    names = [*keys, "ti", "tj"]
    pairs = joined.select(*[F.col(c).alias(n) for n, c in keys.items()], "ti", "tj", *[f"{p}_{n}" for p in "lr" for n in ("rows", "cols", "data")])
    width, schema = len(names), f"{_keys(pairs, names)}, {_TILE}"

    def products(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            fields = [batch.schema.field(n) for n in range(width)]
            sizes = [batch.column(width + n).to_pylist() for n in (0, 1, 3, 4)]
            left, right = batch.column(width + 2), batch.column(width + 5)
            for k, key in enumerate(_rows(batch, width)):
                a, b = _matrix(sizes[0][k], sizes[1][k], left[k].as_buffer()), _matrix(sizes[2][k], sizes[3][k], right[k].as_buffer())
                inner = min(a.shape[1], b.shape[0])
                made = a[:, :inner] @ b[:inner]
                held[key] = added(held[key], made) if key in held else made
                # small tiles are many: what is held is bounded in bytes
                if len(held) >= HELD and len(held) * made.nbytes >= TOGETHER:
                    yield from _tables(list(held), fields, list(held.values()))
                    held = {}
        if held:
            yield from _tables(list(held), fields, list(held.values()))

    def sums(batches):
        last, total, fields = None, None, None
        for batch in batches:
            fields = [batch.schema.field(n) for n in range(width)]
            rows, cols, data = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), batch.column(width + 2)
            keys, found = [], []
            for k, key in enumerate(_rows(batch, width)):
                tile = _matrix(rows[k], cols[k], data[k].as_buffer())
                if key == last:
                    total = added(total, tile)
                    continue
                if last is not None:
                    keys.append(last)
                    found.append(total)
                last, total = key, tile
            if total is not None:
                total = total.copy()  # the batch may go
            yield from _tables(keys, fields, found)
        if last is not None:
            yield _table([last], fields, [total])

    parts = pairs.mapInArrow(few_batches(products), schema)
    return parts.repartition(_tasks(parts), *names).sortWithinPartitions(*names).mapInArrow(few_batches(sums), schema)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two tiles; the smaller one counts as 0 beyond its end."""
    if a.shape == b.shape:
        return a + b
    out = np.zeros(tuple(map(max, a.shape, b.shape)))
    out[: a.shape[0], : a.shape[1]] += a
    out[: b.shape[0], : b.shape[1]] += b
    return out


def elements(found: DataFrame, keys: list[str], side: int = SIDE, kind: str = "float") -> DataFrame:
    """``i, j, v`` of tiles, as float or, before more is done to them, as double."""
    number = {"float": np.float32, "double": np.float64}[kind]

    def run(batches):
        import pyarrow as pa

        places: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            ti, tj, rows, cols = (batch.column(len(keys) + n).to_pylist() for n in range(4))
            out_i, out_j, out_v, data = [], [], [], batch.column(len(keys) + 4)
            for k, shape in enumerate(zip(rows, cols, strict=True)):
                if shape not in places:
                    if len(places) > 100:
                        places.clear()
                    places[shape] = tuple(p.ravel().astype(np.int32) for p in np.indices(shape))
                i, j = places[shape]
                out_i.append(i + np.int32(ti[k] * side))
                out_j.append(j + np.int32(tj[k] * side))
                with np.errstate(over="ignore"):
                    out_v.append(np.frombuffer(data[k].as_buffer(), "<f8").astype(number))
            if not out_v:
                continue
            at = pa.array(np.repeat(np.arange(len(batch)), [len(v) for v in out_v]))
            own = [batch.column(n).take(at) for n in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(v)) for v in (out_i, out_j, out_v))], [*keys, "i", "j", "v"])

    listed = f"{_keys(found, keys)}, " if keys else ""
    return found.select(*keys, "ti", "tj", "rows", "cols", "data").mapInArrow(few_batches(run), f"{listed}i int, j int, v {kind}")


def dense(found: DataFrame, side: int = SIDE) -> DataFrame:
    """Dense 32F arrays of tiles with the key ``mat_id``; an array is one group, bounded by its size."""
    groups = found.groupBy("mat_id").agg(F.collect_list(F.struct("ti", "tj", "rows", "cols", "data")).alias("at"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(len(batch)):
                ti, tj, rows, cols, data = (batch.column(1).slice(k, 1).flatten().field(n) for n in range(5))
                ti, tj, rows, cols = (np.asarray(c) for c in (ti, tj, rows, cols))
                whole = np.zeros((int((ti * side + rows).max()), int((tj * side + cols).max())), np.float32)
                for n in range(len(ti)):
                    with np.errstate(over="ignore"):
                        whole[ti[n] * side : ti[n] * side + rows[n], tj[n] * side : tj[n] * side + cols[n]] = _matrix(rows[n], cols[n], data[n].as_buffer())
                sizes = [pa.array([v], pa.int32()) for v in (*whole.shape, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *sizes, pa.ListArray.from_arrays(pa.array([0, whole.size], pa.int32()), pa.array(whole.ravel()))], ["img_id", "h", "w", "cn", "data"])

    return groups.mapInArrow(few_batches(run), "img_id bigint, h int, w int, cn int, data array<float>")
