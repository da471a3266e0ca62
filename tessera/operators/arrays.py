"""Arrays in two forms and the operators that move elements.

*dense*: ``img_id, h, w, cn, data`` - one row an array, rows first, channels interleaved.
*pixels*: ``img_id, h, w, y, x, c, v`` - one row an element.

Operators that need neighbourhoods deal elements out by array and tile themselves; all
joins and groupings have the array's id among their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.depths import BYTES, STORAGE, TensorError, from_type_code, lane, saturate

KEY = ["img_id", "h", "w", "y", "x", "c"]


def dense(frame: DataFrame, img_id: str, data: Column | str, h: int, w: int, cn: int = 1) -> DataFrame:
    """Arrays of one shape from a column that holds their elements."""
    column = F.col(data) if isinstance(data, str) else data
    return frame.select(F.col(img_id).cast("bigint").alias("img_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(cn).alias("cn"), column.alias("data"))


def is_bytes(arrays: DataFrame) -> bool:
    """Whether dense arrays hold their elements as bytes."""
    return arrays.schema["data"].dataType.simpleString() == "binary"


def length(arrays: DataFrame) -> Column:
    """How many elements an array holds."""
    return F.octet_length("data") if is_bytes(arrays) else F.size("data")


def listed(arrays: DataFrame) -> DataFrame:
    """Dense arrays with bytes as integers; others as they are."""
    if not is_bytes(arrays):
        return arrays
    import numpy as np
    import pyarrow as pa

    at = arrays.columns.index("data")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(flat))
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'data' else f.dataType.simpleString()}" for f in arrays.schema.fields)
    return arrays.mapInArrow(run, kinds)


def pixels(arrays: DataFrame, colocate: bool = False) -> DataFrame:
    """The element form of dense arrays; *colocate* deals elements out by array, for several joins by place of small arrays."""
    each = listed(arrays).select("img_id", "h", "w", "cn", F.posexplode("data").alias("i", "v"))
    per_row = F.col("w") * F.col("cn")
    out = each.select("img_id", "h", "w", F.floor(F.col("i") / per_row).cast("int").alias("y"), F.floor(F.col("i") % per_row / F.col("cn")).cast("int").alias("x"), (F.col("i") % F.col("cn")).cast("int").alias("c"), "v")
    return out.repartition("img_id") if colocate else out


def packed(px: DataFrame) -> DataFrame:
    """The dense form of elements; an array is one group, bounded by its size."""
    at = F.struct("y", "x", "c", "v")
    return px.groupBy("img_id", "h", "w").agg((F.max("c") + 1).alias("cn"), F.transform(F.array_sort(F.collect_list(at)), lambda s: s["v"]).alias("data"))


def fill(frame: DataFrame, img_id: str, h: int, w: int, cn: int, value, depth: str) -> DataFrame:
    """Arrays of one value or one value a channel."""
    per = [saturate(lane(value, cn, depth, F.lit(c)), depth) for c in range(cn)]
    return dense(frame, img_id, F.flatten(F.array_repeat(F.array(*per), h * w)), h, w, cn)


def set_to(px: DataFrame, value, depth: str, channels: int, mask: Column | None = None) -> DataFrame:
    """Every element (or where *mask* holds) replaced by a value saturated to the depth."""
    new = saturate(lane(value, channels, depth, F.col("c")), depth)
    return px.withColumn("v", new if mask is None else F.when(mask, new).otherwise(F.col("v")))


def convert_to(px: DataFrame, depth: str | int, channels: int | None = None) -> DataFrame:
    """Elements saturated to another depth; a type code with channels has to match theirs."""
    if isinstance(depth, int):
        code = depth
        depth, wanted = from_type_code(code)
        if code >= 32 and channels is not None and wanted != channels:
            raise TensorError(f"{channels} channels do not convert to {wanted}")
    return px.withColumn("v", saturate(F.col("v"), depth))


def reshape(arrays: DataFrame, h: int, w: int) -> DataFrame:
    """Another shape of the same number of elements; a row that does not fit fails."""
    ok = F.col("h") * F.col("w") == h * w
    return arrays.withColumn("data", F.when(ok, F.col("data")).otherwise(F.raise_error(F.lit("reshape: totals differ")))).withColumns({"h": F.lit(h), "w": F.lit(w)})


def set_size(arrays: DataFrame, h: int, w: int) -> DataFrame:
    """Another shape over the elements that an array holds, the first of them if there are more; too few fail."""
    return _sized(arrays, F.lit(h), F.lit(w))


def copy_size(arrays: DataFrame, other: DataFrame) -> DataFrame:
    """The shape of another array of the same id, as :func:`set_size`."""
    sizes = other.select("img_id", F.col("h").alias("_h"), F.col("w").alias("_w"))
    return _sized(arrays.join(sizes, "img_id"), F.col("_h"), F.col("_w")).select(*arrays.columns)


def _sized(arrays: DataFrame, h: Column, w: Column) -> DataFrame:
    total = h * w * F.col("cn")
    some = F.substring(F.col("data"), F.lit(1), total) if is_bytes(arrays) else F.slice("data", F.lit(1), total)
    kept = F.when(length(arrays) >= total, some).otherwise(F.raise_error(F.lit("set_size: more elements than the array holds")))
    return arrays.withColumns({"data": kept, "h": h, "w": w})


#: Numpy's types of elements.
_KINDS = {"8U": "u1", "8S": "i1", "16U": "<u2", "16S": "<i2", "32S": "<i4", "32U": "<u4", "16F": "<f2", "32F": "<f4", "64F": "<f8"}


def reinterpret(frame: DataFrame, depth: str, to: str) -> DataFrame:
    """The same bytes read as another depth.

    Elements: as another integer depth of the same width.  Dense arrays: as any depth; channels follow, so that a place
    keeps its bytes.
    """
    if "data" in frame.columns:
        return _reread(frame, depth, to)
    if BYTES[depth] != BYTES[to] or "F" in depth + to:
        raise TensorError(f"{depth} is not reinterpreted as {to}")
    width = 1 << (8 * BYTES[to])
    lane_ = F.pmod(F.col("v").cast("bigint"), F.lit(width))
    signed = F.when(lane_ >= width // 2, lane_ - width).otherwise(lane_)
    return frame.withColumn("v", (signed if to.endswith("S") else lane_).cast(STORAGE[to]))


def _reread(arrays: DataFrame, depth: str, to: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    arrays = listed(arrays)
    old, new, kind = BYTES[depth], BYTES[to], STORAGE[to]
    types = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    source, target = _KINDS[depth], _KINDS[to]

    def run(batches):
        for batch in batches:
            out, channels = [], []
            for cn, data in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                if cn * old % new:
                    raise TensorError(f"{cn} channels of {depth} are not reinterpreted as {to}")
                channels.append(cn * old // new)
                out.append(data.values.to_numpy(zero_copy_only=False).astype(source).view(target))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            values = pa.array(np.concatenate(out).astype(types[kind].to_pandas_dtype()) if out else np.zeros(0), types[kind])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(channels, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)], ["img_id", "h", "w", "cn", "data"])

    return arrays.select("img_id", F.col("h").cast("int"), F.col("w").cast("int"), F.col("cn").cast("int"), "data").mapInArrow(run, f"img_id bigint, h int, w int, cn int, data array<{kind}>")


def shape_string(arrays: DataFrame, channel_first: bool = False) -> Column:
    """An array's shape as text; channels come first where asked for and there are several."""
    shape = F.array("h", "w")
    if channel_first:
        shape = F.when(F.col("cn") > 1, F.array("cn", "h", "w")).otherwise(shape)
    text = F.concat(F.lit("["), F.array_join(shape.cast("array<string>"), " x "), F.lit("]"))
    return F.when(length(arrays) == 0, "[]").otherwise(text)


def printed(arrays: DataFrame, count: int = -1) -> DataFrame:
    """``img_id`` and ``text``: the shape of each array and its first elements, or all of them."""
    arrays = listed(arrays)
    some = F.col("data") if count < 0 else F.slice("data", 1, count)
    values = F.concat(F.lit("value = "), F.array_join(F.transform(some.cast("array<string>"), lambda v: F.concat(v, F.lit(","))), ""))
    text = F.concat(F.lit("shape = "), shape_string(arrays, True), F.lit("\n"), values)
    return arrays.select("img_id", F.when(F.size("data") == 0, "mat is empty").otherwise(text).alias("text"))


def window(px: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Half-open ranges of rows and columns, as arrays of their own."""
    out = px
    for axis, size, span in (("y", "h", rows), ("x", "w", cols)):
        if span is not None:
            start, end = span
            if not 0 <= start <= end:
                raise TensorError(f"bad range {span}")
            out = out.filter(F.col(axis).between(start, end - 1)).withColumns({axis: (F.col(axis) - start).cast("int"), size: F.least(F.col(size), F.lit(end)) - start})
    return out


def at(arrays: DataFrame, y: int, x: int, c: int = 0) -> DataFrame:
    """``img_id`` and the element ``v`` at a place; null outside."""
    inside = (F.lit(y) < F.col("h")) & (F.lit(x) < F.col("w")) & (F.lit(c) < F.col("cn"))
    return listed(arrays).select("img_id", F.when(inside, F.get("data", (F.lit(y) * F.col("w") + x) * F.col("cn") + c)).alias("v"))


def metadata(arrays: DataFrame, depth: str) -> DataFrame:
    """Shape, totals and element sizes of each array."""
    return arrays.select("img_id", F.array("h", "w").alias("shape"), F.col("cn").alias("channels"), (F.col("h") * F.col("w")).cast("bigint").alias("total"), (F.lit(BYTES[depth]) * F.col("cn")).alias("elem_size"), F.lit(BYTES[depth]).alias("elem_size1"), (length(arrays) == 0).alias("is_empty"))


def transpose(px: DataFrame) -> DataFrame:
    """Rows and columns exchanged."""
    return px.select("img_id", F.col("w").alias("h"), F.col("h").alias("w"), F.col("x").alias("y"), F.col("y").alias("x"), "c", "v")


def transpose_nd(arrays: DataFrame, shape: list[int], axes: list[int]) -> DataFrame:
    """``img_id, data`` with the axes of a constant *shape* permuted; an element's place is arithmetic on its new one."""
    if sorted(axes) != list(range(len(shape))):
        raise TensorError(f"axes {axes} are no permutation")
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    new = [shape[a] for a in axes]
    total = 1
    for n in new:
        total *= n

    def old(i: Column) -> Column:
        left, out = i, F.lit(0)
        for k in range(len(new) - 1, -1, -1):
            out = out + left % new[k] * strides[axes[k]]
            left = F.floor(left / new[k]).cast("int")
        return out.cast("int")

    return listed(arrays).select("img_id", F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: F.get("data", old(i))).alias("data"))


def merge(parts: list[DataFrame]) -> DataFrame:
    """Channels of several arrays of equal shape one after another; each part has one channel unless given as (px, channels)."""
    out, first = None, 0
    for part in parts:
        px, cn = part if isinstance(part, tuple) else (part, 1)
        moved = px.withColumn("c", (F.col("c") + first).cast("int"))
        out, first = (moved if out is None else out.unionByName(moved)), first + cn
    if first > 128:
        raise TensorError("more than 128 channels")
    return out


def split(px: DataFrame, channels: int) -> list[DataFrame]:
    """One array a channel."""
    return [px.filter(F.col("c") == k).withColumn("c", F.lit(0)) for k in range(channels)]


def to_chw(px: DataFrame) -> DataFrame:
    """Element places in channel-first order: ``img_id, i, v``."""
    return px.select("img_id", ((F.col("c") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")).cast("bigint").alias("i"), "v")
