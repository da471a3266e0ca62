"""Colour conversion of dense arrays: all codes, as by elements and as in loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import arrays, color

NAMES = {"BGR": 3, "RGB": 3, "BGRA": 4, "RGBA": 4, "GRAY": 1, "YUV": 3}


def shape(code):
    """Rows, columns and channels of an image that a code takes."""
    body, _, layout = code.partition("_")
    source = body.partition("2")[0]
    if not layout or source != "YUV":
        return 4, 6, NAMES[source]
    if layout in ("YUY2", "UYVY"):
        return 4, 6, 2
    cells = color.LAYOUTS[layout][0] * color.LAYOUTS[layout][1]
    return 4 * (cells + 2) // cells, 6, 1


def frame(spark, h, w, cn, n=3, binary=False):
    rng = np.random.default_rng(h * 100 + w + cn)
    images = [rng.integers(0, 256, h * w * cn).tolist() for _ in range(n)]
    rows = [(k, h, w, cn, bytes(d) if binary else d) for k, d in enumerate(images)]
    return spark.createDataFrame(rows, f"img_id long, h int, w int, cn int, data {'binary' if binary else 'array<int>'}")


def found(df):
    return {r.img_id: (r.h, r.w, r.cn, list(r.data)) for r in df.collect()}


@pytest.mark.parametrize("layout", ["", *color.LAYOUTS])
def test_dense_is_as_by_elements(spark, layout):
    for code in color.CODES:
        if code.partition("_")[2] == layout:
            images = frame(spark, *shape(code))
            got = color.cvt_color(images, code)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert found(got) == found(arrays.packed(color.cvt_color(arrays.pixels(images, colocate=False), code))), code


def test_bytes_stay_bytes_and_sizes_are_checked(spark):
    images = frame(spark, 4, 6, 3, binary=True)
    nv12 = color.cvt_color(images, "BGR2YUV_NV12")
    assert nv12.schema["data"].dataType.simpleString() == "binary" and found(nv12)[0][:3] == (6, 6, 1)
    assert found(color.cvt_color(nv12, "YUV2BGR_NV12"))[2][:3] == (4, 6, 3)
    for code, size in (("BGR2YUV_NV12", (3, 6, 3)), ("BGR2YUV_YUY2", (4, 5, 3)), ("YUV2BGR_I420", (5, 6, 1)), ("YUV2BGR_UYVY", (4, 6, 1)), ("BGR2GRAY", (4, 6, 4))):
        with pytest.raises(Exception, match="does not take|channels where"):
            color.cvt_color(frame(spark, *size), code).collect()
    floats = frame(spark, 4, 6, 3).withColumn("data", F.transform("data", lambda v: (v / 255).cast("float")))
    gray = found(color.cvt_color(floats, "BGR2GRAY", "32F"))[1]
    want = found(arrays.packed(color.cvt_color(arrays.pixels(floats, colocate=False), "BGR2GRAY", "32F")))[1]
    assert gray == want


def test_chroma_of_a_hand_made_picture(spark):
    """Two by two cells of one colour each, against the formulas."""
    cells = {(0, 0): (0, 0, 255), (0, 1): (255, 0, 0), (1, 0): (0, 255, 0), (1, 1): (255, 255, 255)}
    data = [v for y in range(4) for x in range(4) for v in cells[y // 2, x // 2]]
    one = spark.createDataFrame([(1, 4, 4, 3, data)], "img_id long, h int, w int, cn int, data array<int>")
    got = found(color.cvt_color(one, "BGR2YUV_I420"))[1][3]
    formula = lambda b, g, r: (((66 * r + 129 * g + 25 * b + 128) >> 8) + 16, ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128, ((112 * r - 94 * g - 18 * b + 128) >> 8) + 128)
    made = {k: formula(*c) for k, c in cells.items()}
    assert got == [made[y // 2, x // 2][0] for y in range(4) for x in range(4)] + [made[c][k] for k in (1, 2) for c in ((0, 0), (0, 1), (1, 0), (1, 1))]
