"""Tiles of elements against whole dense arrays, and arrays of bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import arrays, blocks, geometry, stencils
from tessera.plans import registry

OPERATORS = {
    "box": lambda p: stencils.box_filter(p, (5, 3), "8U"),
    "sum": lambda p: stencils.box_filter(p, (2, 3), "32F", normalize=False, border="CONSTANT"),
    "gauss": lambda p: stencils.gaussian_blur(p, (5, 3), 1.2, "8U", border="REFLECT"),
    "filter": lambda p: stencils.filter2d(p, [[0.5, -1.0, 0.25], [1.0, 2.0, 0.0]], "8U", (0, 1), 3.0, "REPLICATE"),
    "sobel": lambda p: stencils.sobel(p, 1, 0, "16S", 5),
    "erode": lambda p: stencils.erode(p, [[0, 1], [1, 1]], iterations=3),
    "open": lambda p: stencils.morphology(p, "OPEN", iterations=2),
    "gradient": lambda p: stencils.morphology(p, "GRADIENT", border="REFLECT_101"),
    "tophat": lambda p: stencils.morphology(p, "TOPHAT", [[1, 1, 1]]),
    "hitmiss": lambda p: stencils.morphology(p, "HITMISS", [[0, 1, 0], [-1, 1, 1]]),
    "resize": lambda p: geometry.resize(p, "8U", (5, 17)),
    "shrink": lambda p: geometry.resize(p, "8U", fx=0.4, fy=0.7, interpolation="NEAREST_EXACT"),
    "border": lambda p: geometry.copy_make_border(p, 5, 3, 9, 2, "REFLECT_101", "8U"),
    "border_constant": lambda p: geometry.copy_make_border(p, 9, 9, 0, 6, "CONSTANT", "8U", (1, 2, 3, 4)),
    "turned": lambda p: geometry.warp_affine(p, [[0.0, 1.0, 0.0], [-1.0, 0.0, 9.0]], "8U", dsize=(13, 6), interpolation="NEAREST", value=7),
    "far": lambda p: geometry.warp_affine(p, [[1.0, 0.0, 400.0], [0.0, 1.0, -300.0]], "8U", border="CONSTANT", value=9),
    "reflected": lambda p: geometry.warp_affine(p, [[3.0, 0.5, -20.0], [-0.5, 2.0, 7.0]], "8U", inverse_map=True, border="REFLECT"),
    "warp": lambda p: geometry.warp_affine(p, [[0.75, 0.25, 1.5], [-0.25, 0.875, 2.25]], "8U", inverse_map=True, border="WRAP"),
}


def images(spark, shapes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, h, w, c, rng.integers(0, 256, h * w * c).tolist()) for i, (h, w, c) in enumerate(shapes)]
    return spark.createDataFrame(rows, "img_id bigint, h int, w int, cn int, data array<int>")


def by_place(px):
    return {(r.img_id, r.h, r.w, r.y, r.x, r.c): r.v for r in px.collect()}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_tiles_give_what_whole_images_give(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "TILE", 4)
    dense = images(spark, [(11, 9, 1), (11, 9, 1), (1, 7, 3), (6, 1, 2), (4, 4, 4)])
    want = by_place(arrays.pixels(OPERATORS[name](dense)))
    assert by_place(OPERATORS[name](arrays.pixels(dense))) == want and by_place(OPERATORS[name](arrays.pixels(dense, colocate=False))) == want


def test_bytes_stay_bytes(spark):
    dense = images(spark, [(8, 6, 3), (5, 5, 1)])
    packed = dense.withColumn("data", F.unhex(F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v), 2, "0")), "")))
    for f in (OPERATORS["box"], OPERATORS["erode"], OPERATORS["resize"]):
        want = {r.img_id: r.data for r in f(dense).collect()}
        got = f(packed)
        assert dict(got.dtypes)["data"] == "binary" and {r.img_id: list(r.data) for r in got.collect()} == want


def test_plans(spark):
    dense = images(spark, [(8, 6, 3)])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, f in OPERATORS.items():
        assert plan(f(dense)).count("Exchange") == 0
        footprints = name in ("resize", "shrink", "border", "border_constant", "turned", "far", "reflected", "warp")  # source tiles, then what output tiles read of them
        assert plan(f(arrays.pixels(dense, colocate=False))).count("Exchange hashpartitioning") == 1 + footprints


def test_long_and_winding_edges(spark):
    size = 64
    snake = np.zeros((size, size), bool)
    for y in range(0, size, 4):
        snake[y] = True
        snake[y : y + 4, -1 if y % 8 == 0 else 0] = True
    seeds = np.zeros_like(snake)
    seeds[0, 0] = True
    assert (stencils.reached(snake[None], seeds[None])[0] == snake).all()
    cut = snake.copy()
    cut[32, 10] = False
    found = stencils.reached(cut[None], seeds[None])[0]
    assert found[:32].sum() == cut[:32].sum() and not found[40:].any()


@pytest.mark.parametrize("l2", [False, True])
def test_edges_across_tiles(spark, monkeypatch, l2):
    """Small tiles, so that edges wind through many; the same as in one tile."""
    monkeypatch.setattr(blocks, "TILE", 8)
    rng = np.random.default_rng(5)
    rows = []
    for k, (h, w) in enumerate([(50, 41), (8, 8), (3, 60), (1, 1), (33, 17)]):
        y, x = np.mgrid[:h, :w]
        waves = 90 * np.sin(x / 5 + np.cos(y / 6) * 2) + 90 * np.sin(y / 7) + rng.normal(0, 12, (h, w)) + 128
        rows.append((k, h, w, 1, np.clip(waves, 0, 255).astype(int).ravel().tolist()))
    dense = spark.createDataFrame(rows, "img_id bigint, h int, w int, cn int, data array<int>")
    high = 300 if l2 else 400
    want = by_place(arrays.pixels(stencils.canny(dense, 60, high, l2=l2)))
    got = stencils.canny(arrays.pixels(dense, colocate=False), 60, high, l2=l2)
    assert by_place(got) == want and {0, 255} == set(want.values())
    weak = by_place(arrays.pixels(stencils.canny(dense, 60, 60, l2=l2)))
    strong = by_place(arrays.pixels(stencils.canny(dense, high, high, l2=l2)))
    assert sum(strong.values()) < sum(want.values()) < sum(weak.values())
    gx, gy = (arrays.pixels(stencils.sobel(dense, 1 - k, k, "16S", border="REPLICATE"), colocate=False).withColumnRenamed("v", n) for k, n in ((0, "gx"), (1, "gy")))
    assert by_place(stencils.canny_derivatives(gx.join(gy, arrays.KEY), 60, high, l2=l2)) == want


def test_one_edge_through_all_tiles(spark, monkeypatch):
    """A snake with one strong element: its weak part is kept to its end, through every tile."""
    monkeypatch.setattr(blocks, "TILE", 8)
    size = 40
    gx, gy = np.zeros((2, size, size), int)
    for n, y in enumerate(range(2, size - 2, 6)):
        if y + 6 < size - 2:
            gx[y : y + 7, size - 3 if n % 2 == 0 else 2] = 100
        gx[y], gy[y, 2 : size - 2] = 0, 100
    gy[2, 4] = 900
    gx = [(0, size, size, y, x, 0, int(gx[y, x]), int(gy[y, x])) for y in range(size) for x in range(size)]
    px = spark.createDataFrame(gx, "img_id bigint, h int, w int, y int, x int, c int, gx int, gy int")
    got = {(r.y, r.x) for r in stencils.canny_derivatives(px, 50, 500).filter("v = 255").collect()}
    alone = {(r.y, r.x) for r in stencils.canny_derivatives(px.withColumn("gy", F.least("gy", F.lit(100))), 50, 500).filter("v = 255").collect()}
    assert not alone and (2, 4) in got and max(y for y, _ in got) == 32 and len(got) > 200


def test_every_dense_operator_is_registered(spark):
    dense = images(spark, [(8, 6, 1)])
    for op, args in {"box_filter": ((3, 3), "8U"), "resize": ("8U", (3, 4)), "canny": (100, 40), "copy_make_border": (1, 1, 1, 1, "WRAP", "8U")}.items():
        assert registry.implementations(op) == ["arrow", "native"]
        arrow, native = (registry.run(op, dense, *args, impl=k).select("h", "w", "cn", "data").first() for k in ("arrow", "native"))
        assert arrow == native
