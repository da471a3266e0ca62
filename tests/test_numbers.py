"""Exact wide integers, what is not a number, and sizes that a layout does not take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import depths
from tessera.functions.elementwise import binary
from tessera.operators import arrays, blocks, color

NAN, INF = float("nan"), float("inf")


def test_products_wrap_exactly(spark):
    edge = [2147483647, -2147483648, -1, 0, 65537, 123456789, -987654321]
    df = spark.createDataFrame([(a, b) for a in edge for b in edge], "a long, b long")
    for depth, size in (("32S", 1 << 31), ("32U", 0)):
        pairs = [(a % (1 << 32), b % (1 << 32)) if depth == "32U" else (a, b) for a in edge for b in edge]
        source = df if depth == "32S" else df.select(*[F.pmod(c, F.lit(1 << 32)).alias(c) for c in "ab"])
        for op, f in (("MUL", lambda a, b: a * b), ("ADD", lambda a, b: a + b), ("SUB", lambda a, b: a - b), ("XOR", lambda a, b: a ^ b)):
            got = [r.v for r in source.select(binary(op, F.col("a"), F.col("b"), depth).alias("v")).collect()]
            assert got == [(f(a, b) + size) % (1 << 32) - size for a, b in pairs], (depth, op)


def test_no_number_is_zero_in_integers(spark):
    df = spark.createDataFrame([(v,) for v in (NAN, INF, -INF, 1.5)], "v double")
    got = {d: [r.v for r in df.select(depths.saturate(F.col("v"), d).alias("v")).collect()] for d in ("8U", "8S", "16U", "16S", "32S", "32U")}
    assert got == {"8U": [0, 255, 0, 2], "8S": [0, 127, -128, 2], "16U": [0, 65535, 0, 2], "16S": [0, 32767, -32768, 2], "32S": [0, 0, 0, 2], "32U": [0, 0, 0, 2]}
    values = np.array([NAN, INF, -INF, 1.5, 0.49999999999999994, 2.5, -2.5])
    for d in ("8U", "8S", "16S"):
        low, high = depths.LIMITS[d]
        assert blocks.saturated(values, d).tolist() == [0, high, low, 2, 0, 3, max(low, -3)]


def test_odd_sizes_fail(spark):
    def px(h, w, cn):
        return arrays.pixels(arrays.dense(spark.createDataFrame([(0, list(range(h * w * cn)))], "i long, d array<int>"), "i", "d", h, w, cn))

    for code, shape in (("BGR2YUV_NV12", (3, 4, 3)), ("BGR2YUV_I420", (4, 3, 3)), ("RGB2YUV_YUY2", (3, 3, 3)), ("YUV2BGR_NV12", (4, 4, 1)), ("YUV2BGR_NV16", (4, 3, 1)), ("YUV2RGB_UYVY", (2, 3, 2))):
        with pytest.raises(Exception, match="does not take"):
            color.cvt_color(px(*shape), code).collect()
    assert color.cvt_color(px(3, 4, 3), "BGR2YUV_NV16").count() == 24
    assert color.cvt_color(px(3, 3, 3), "BGR2YUV_I444").count() == 27
