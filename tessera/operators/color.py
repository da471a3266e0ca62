"""Colour conversion: 70 codes, built from their names.

Dense arrays are converted where they are, by array programs over whole images
(:mod:`.color_blocks`), without an exchange.  Of elements, channels are pivoted to columns of one
row a place; formulas are integer column arithmetic for 8U and double for 32F.  Planar layouts
are arithmetic on output places: encoding groups blocks of places for their mean chroma,
decoding joins luma rows with chroma rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.depths import TensorError, saturate
from . import blocks, color_blocks
from .arrays import KEY

ORDERS = {"BGR": "bgr", "RGB": "rgb", "BGRA": "bgra", "RGBA": "rgba", "GRAY": "y"}
PLAIN = ["GRAY2BGR", "BGR2GRAY", "BGR2RGB", "RGB2BGR", "BGR2BGRA", "BGRA2BGR", "RGB2RGBA", "RGBA2RGB", "BGR2RGBA", "RGBA2BGR", "RGB2BGRA", "BGRA2RGB", "BGRA2RGBA", "RGBA2BGRA", "GRAY2BGRA", "BGRA2GRAY", "GRAY2RGBA", "RGBA2GRAY"]
#: Subsampling of planar and packed layouts: (columns, rows) that share a chroma value.
LAYOUTS = {"NV12": (2, 2), "NV21": (2, 2), "I420": (2, 2), "YV12": (2, 2), "YUY2": (2, 1), "UYVY": (2, 1), "NV16": (2, 1), "NV61": (2, 1), "NV24": (1, 1), "NV42": (1, 1), "I444": (1, 1), "YV24": (1, 1)}
#: Layouts that put V before U.
V_FIRST = frozenset(["NV21", "YV12", "NV61", "NV42", "YV24"])
CODES = [*PLAIN, *[f"{a}2{b}" for c in ("BGR", "RGB") for a, b in ((c, "YUV"), ("YUV", c))], *[f"YUV2{c}_{k}" for k in LAYOUTS for c in ("BGR", "RGB")], *[f"{c}2YUV_{k}" for k in LAYOUTS for c in ("BGR", "RGB")]]


def planes(px: DataFrame, names: str) -> DataFrame:
    """One row a place with a column for each channel."""
    return px.groupBy("img_id", "h", "w", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"_{n}") for k, n in enumerate(names)])


def _long(places: DataFrame, values: list[Column]) -> DataFrame:
    """Elements from one column a channel."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("v")) for k, v in enumerate(values)])).alias("e")
    return places.select("img_id", "h", "w", "y", "x", each).select("img_id", "h", "w", "y", "x", "e.c", "e.v")


def _gray(depth: str) -> Column:
    b, g, r = F.col("_b"), F.col("_g"), F.col("_r")
    if depth == "8U":
        return F.shiftright(b * 7471 + g * 38470 + r * 19595 + 32768, 16)
    return saturate(b.cast("double") * 0.114 + g.cast("double") * 0.587 + r.cast("double") * 0.299, depth)


def _plain(px: DataFrame, source: str, target: str, depth: str) -> DataFrame:
    places = planes(px, ORDERS[source])
    opaque = F.lit(255) if depth == "8U" else F.lit(1.0).cast("float")
    if target == "GRAY":
        return _long(places, [_gray(depth)])
    pick = {n: F.col("_y") if source == "GRAY" else F.col(f"_{n}") for n in "bgr"}
    pick["a"] = F.col("_a") if source.endswith("A") else opaque
    return _long(places, [pick[n] for n in ORDERS[target]])


def _analog(px: DataFrame, source: str, target: str, depth: str) -> DataFrame:
    delta = 128.0 if depth == "8U" else 0.5
    if target == "YUV":
        b, g, r = (F.col(f"_{n}").cast("double") for n in "bgr")
        luma = b * 0.114 + g * 0.587 + r * 0.299
        return _long(planes(px, ORDERS[source]), [saturate(v, depth) for v in (luma, (b - luma) * 0.492 + delta, (r - luma) * 0.877 + delta)])
    y, u, v = F.col("_y").cast("double"), F.col("_u").cast("double") - delta, F.col("_v").cast("double") - delta
    made = {"b": y + u * 2.032, "g": y - u * 0.395 - v * 0.581, "r": y + v * 1.140}
    return _long(planes(px, "yuv"), [saturate(made[n], depth) for n in ORDERS[target]])


def _limited(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Limited-range Y, U and V of integer colours."""
    clip = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v))
    y = clip(F.shiftright(r * 66 + g * 129 + b * 25 + 128, 8) + 16)
    u = clip(F.shiftright(r * -38 - g * 74 + b * 112 + 128, 8) + 128)
    v = clip(F.shiftright(r * 112 - g * 94 - b * 18 + 128, 8) + 128)
    return y, u, v


def _fitting(px: DataFrame, layout: str, fits: Column) -> DataFrame:
    """The elements; an image whose size does not fit the layout fails."""
    message = F.concat(F.lit(f"{layout} does not take "), F.col("h"), F.lit(" rows and "), F.col("w"), F.lit(" columns"))
    return px.withColumn("h", F.when(fits, F.col("h")).otherwise(F.raise_error(message).cast("int")))


def _encode(px: DataFrame, source: str, layout: str) -> DataFrame:
    """Subsampled layouts take even sizes."""
    sub_x, sub_y = LAYOUTS[layout]
    px = _fitting(px, layout, (F.col("h") % sub_y == 0) & (F.col("w") % sub_x == 0))
    places = planes(px, ORDERS[source])
    luma = places.select("img_id", "h", "w", "y", "x", _limited(F.col("_b"), F.col("_g"), F.col("_r"))[0].alias("v"))
    cells = places.groupBy("img_id", "h", "w", F.floor(F.col("y") / sub_y).cast("int").alias("cy"), F.floor(F.col("x") / sub_x).cast("int").alias("cx")).agg(*[F.sum(f"_{n}").cast("int").alias(f"_{n}") for n in "bgr"])
    bits = {1: 0, 2: 1, 4: 2}[sub_x * sub_y]
    mean = [F.shiftright(F.col(f"_{n}") + (1 << bits) // 2, bits) if bits else F.col(f"_{n}") for n in "bgr"]
    _, u, v = _limited(*mean)
    chroma = cells.select("img_id", "h", "w", "cy", "cx", F.explode(F.array(F.struct(F.lit(0).alias("k"), (v if layout in V_FIRST else u).alias("v")), F.struct(F.lit(1).alias("k"), (u if layout in V_FIRST else v).alias("v")))).alias("e")).select("img_id", "h", "w", "cy", "cx", "e.k", "e.v")
    if layout in ("YUY2", "UYVY"):
        first = 0 if layout == "YUY2" else 1
        return luma.select(*KEY[:-1], F.lit(first).alias("c"), "v").unionByName(chroma.select("img_id", "h", "w", F.col("cy").alias("y"), (F.col("cx") * 2 + F.col("k")).alias("x"), F.lit(1 - first).alias("c"), "v"))
    rows = F.floor(F.col("h") * (sub_x * sub_y + 2) / (sub_x * sub_y)).cast("int")
    if layout.startswith("NV"):
        place = (F.col("cy") * F.floor(F.col("w") / sub_x) + F.col("cx")) * 2 + F.col("k")
    else:
        plane = F.floor(F.col("h") / sub_y) * F.floor(F.col("w") / sub_x)
        place = F.col("k") * plane + F.col("cy") * F.floor(F.col("w") / sub_x) + F.col("cx")
    below = chroma.select("img_id", rows.alias("h"), "w", (F.col("h") + F.floor(place / F.col("w"))).cast("int").alias("y"), (place % F.col("w")).cast("int").alias("x"), "v")
    return luma.select("img_id", rows.alias("h"), "w", "y", "x", "v").unionByName(below).select(*KEY[:-1], F.lit(0).alias("c"), "v")


def _decode(px: DataFrame, target: str, layout: str) -> DataFrame:
    sub_x, sub_y = LAYOUTS[layout]
    cells, packed = sub_x * sub_y, layout in ("YUY2", "UYVY")
    rows = F.col("h") if packed else F.col("h") * cells / (cells + 2)
    px = _fitting(px, layout, (rows == F.floor(rows)) & (F.floor(rows) % sub_y == 0) & (F.col("w") % sub_x == 0))
    if layout in ("YUY2", "UYVY"):
        first = 0 if layout == "YUY2" else 1
        luma = px.filter(F.col("c") == first).select("img_id", "h", "w", "y", "x", F.col("v").alias("_y"))
        chroma = px.filter(F.col("c") != first).select("img_id", F.col("y").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx"), (F.col("x") % 2).alias("k"), "v")
    else:
        h = F.floor(F.col("h") * (sub_x * sub_y) / (sub_x * sub_y + 2)).cast("int")
        sized = px.select("img_id", h.alias("h"), "w", "y", "x", "v")
        luma = sized.filter(F.col("y") < F.col("h")).select("img_id", "h", "w", "y", "x", F.col("v").alias("_y"))
        place, per = ((F.col("y") - F.col("h")) * F.col("w") + F.col("x")).cast("bigint"), F.floor(F.col("w") / sub_x)
        if layout.startswith("NV"):
            cell, k = F.floor(place / 2), place % 2
        else:
            plane = F.floor(F.col("h") / sub_y) * per
            cell, k = place % plane, F.floor(place / plane)
        chroma = sized.filter(F.col("y") >= F.col("h")).select("img_id", F.floor(cell / per).cast("int").alias("cy"), (cell % per).cast("int").alias("cx"), k.cast("int").alias("k"), "v")
    u_at = 1 if layout in V_FIRST else 0
    pairs = chroma.groupBy("img_id", "cy", "cx").agg(F.max(F.when(F.col("k") == u_at, F.col("v"))).alias("_u"), F.max(F.when(F.col("k") != u_at, F.col("v"))).alias("_v"))
    keyed = luma.withColumns({"cy": F.floor(F.col("y") / sub_y).cast("int"), "cx": F.floor(F.col("x") / sub_x).cast("int")}).join(pairs, ["img_id", "cy", "cx"])
    c, d, e = F.greatest(F.col("_y") - 16, F.lit(0)) * 298 + 128, F.col("_u") - 128, F.col("_v") - 128
    clip = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(v, 8)))
    made = {"b": clip(c + d * 516), "g": clip(c - d * 100 - e * 208), "r": clip(c + e * 409)}
    return _long(keyed, [made[n] for n in ORDERS[target]])


def _program(source: str, target: str, layout: str, depth: str) -> blocks.Program:
    """The array program of a code."""
    if layout:
        made, name = (color_blocks.decode, target) if source == "YUV" else (color_blocks.encode, source)
        return made(ORDERS[name], layout, LAYOUTS[layout], layout in V_FIRST)
    if "YUV" in (source, target):
        return color_blocks.analog(*("yuv" if n == "YUV" else ORDERS[n] for n in (source, target)), depth)
    return color_blocks.plain(ORDERS[source], ORDERS[target], depth)


def cvt_color(px: DataFrame, code: str, depth: str = "8U") -> DataFrame:
    """Dense arrays or elements converted by a code's name, such as ``BGR2GRAY`` or ``YUV2RGB_NV12``.

    Dense arrays have to have the channels that the code reads; of elements, others are left out.
    """
    if code not in CODES:
        raise TensorError(f"unknown colour code {code!r}")
    if depth not in ("8U", "32F") or ("_" in code and depth != "8U"):
        raise TensorError(f"{code} does not take {depth}")
    body, _, layout = code.partition("_")
    source, _, target = body.partition("2")
    if blocks.is_dense(px):
        return blocks.on_blocks(px, _program(source, target, layout, depth), depth)
    if layout:
        return (_decode(px, target, layout) if source == "YUV" else _encode(px, source, layout)).select(*KEY, "v")
    if "YUV" in (source, target):
        return _analog(px, source, target, depth).select(*KEY, "v")
    return _plain(px, source, target, depth).select(*KEY, "v")
