"""Window sums and extremes, margins and certain rounding, against loops over numpy arrays."""

import time

import numpy as np
import pytest

from tessera.operators import blocks, stencils, transforms
from tessera.operators.blocks import Block, saturated, weighted

RNG = np.random.default_rng(8)
BORDERS = ["CONSTANT", "REPLICATE", "REFLECT", "REFLECT_101", "WRAP"]


def image(h=40, w=150, n=2, c=1, kind=np.uint8):
    return RNG.integers(0, 256, (n, h, w, c)).astype(kind)


def program(monkeypatch, make):
    """The array program that an operator hands to Spark."""
    held = []
    monkeypatch.setattr(blocks, "on_blocks", lambda px, run, *a: held.append(run))
    make()
    return held[0]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 31, 64, 65, 100])
@pytest.mark.parametrize("axis", [1, 2])
def test_sums_and_extremes(size, axis):
    v = RNG.integers(-300, 300, (2, 110, 130, 2)).astype(np.int32)
    byte = image(110, 130, 2, 2)
    for data, most in ((v, None), (byte, 255), (byte.astype(np.int32) * 200, None)):
        slides = np.lib.stride_tricks.sliding_window_view(data, size, axis)
        assert (blocks.window_sums(data, size, axis, most) == slides.sum(-1, dtype=np.int64)).all()
        for best in (np.minimum, np.maximum):
            assert (blocks.window_extremes(data, size, axis, best) == best.reduce(slides, -1)).all()


@pytest.mark.parametrize("border", BORDERS)
def test_margins(border):
    v = image(5, 6, 2, 3)
    for margins in ((0, 0, 0, 0), (2, 1, 3, 0), (9, 7, 8, 13)):
        _, wide, _ = Block(v, 5, 6).around(*margins, border, 9)
        ys, in_y = blocks.source_places(-margins[0], 5 + margins[1], 5, border)
        xs, in_x = blocks.source_places(-margins[2], 6 + margins[3], 6, border)
        want = np.where((in_y[:, None] & in_x)[None, :, :, None], v[:, ys][:, :, xs], np.uint8(9))
        assert (wide == want).all()


@pytest.mark.parametrize("least", [True, False])
@pytest.mark.parametrize("border", BORDERS[:4])
def test_elements_of_any_shape(least, border):
    v = image(13, 17, 1, 2)
    for kernel in ([[1] * 5] * 3, [[0, 1, 0], [1, 1, 1], [0, 1, 0]], [[1, 0, 1, 1], [0, 0, 0, 0], [1, 1, 0, 1]], [[1]], RNG.integers(0, 2, (6, 7)).tolist()):
        taps = stencils.structure(kernel) if np.any(kernel) else stencils.structure(None)
        got = stencils._extreme(Block(v, 13, 17), taps, border, 40, least).data
        margins = blocks.reach(taps)
        frame, wide, _ = Block(v, 13, 17).around(*margins, border, 40)
        parts = [blocks.shifted(frame, wide, margins, dy, dx) for dy, dx, _ in taps]
        assert (got == (np.min if least else np.max)(parts, axis=0)).all()


@pytest.mark.parametrize("border", BORDERS[:4])
def test_rounding_is_that_of_doubles(monkeypatch, border):
    for ksize, sigma, kind in ((5, 1.1, np.uint8), (9, 0.0, np.int32), (3, 0.7, np.uint8)):
        k = stencils.gaussian_kernel(ksize, sigma or ((ksize - 1) * 0.5 - 1) * 0.3 + 0.8)
        across, down = stencils.taps_of([k]), stencils.taps_of([[x] for x in k])
        run = program(monkeypatch, lambda: stencils.sep_filter2d(None, k, k, "8U", border=border))  # noqa: B023
        for v in (image(200, 300, 2, 1, kind), np.full((1, 30, 30, 1), 101, kind)):
            block = Block(v, *v.shape[1:3])
            rows = weighted(block, across, border)
            want = saturated(weighted(rows.like(rows.data.astype(np.float32)), down, border).data, "8U")
            assert (run(block).data == want).all()
    # halves everywhere: all places are in doubt, and are summed in double
    half = program(monkeypatch, lambda: stencils.sep_filter2d(None, [0.5, 0.5], [1.0], "8U", border=border))
    v = np.tile(np.array([10, 11], np.uint8), 40).reshape(1, 8, 10, 1)
    assert set(np.unique(half(Block(v, 8, 10)).data)) <= {10, 11} | ({5} if border == "CONSTANT" else set())


def test_means_from_a_table(monkeypatch):
    for k in (3, 31, 71):
        run = program(monkeypatch, lambda: stencils.box_filter(None, (k, k), "8U"))  # noqa: B023
        v = image(90, 120)
        sums = weighted(Block(v.astype(np.int32), 90, 120), stencils.taps_of([[1.0] * k] * k), stencils.DEFAULT).data
        assert (run(Block(v, 90, 120)).data == saturated(sums.astype(np.float32) * np.float32(1 / (k * k)), "8U")).all()


def test_cost_hardly_grows_with_the_window(monkeypatch):
    v = image(480, 640, 1)
    for make in (lambda k: stencils.box_filter(None, (k, k), "8U"), lambda k: stencils.erode(None, [[1] * k] * k)):
        best = {}
        for k in (3, 31, 101):
            run = program(monkeypatch, lambda: make(k))  # noqa: B023
            times = []
            for _ in range(7):
                began = time.perf_counter()
                run(Block(v, 480, 640))
                times.append(time.perf_counter() - began)
            best[k] = min(times)
        # direct windows cost a hundred and a thousand times one of 3 x 3
        assert best[31] < 20 * best[3] and best[101] < 80 * best[3]


@pytest.mark.parametrize("border", BORDERS[:4])
def test_large_kernels(monkeypatch, border):
    monkeypatch.setattr(transforms, "STRIP_ROWS", 37)
    v = image(70, 55, 2, 2)
    for kernel, delta in ((RNG.normal(0, 0.02, (23, 31)), 90.0), (np.full((21, 21), 1 / 441), 0.0), (RNG.integers(-1, 2, (25, 19)) * 0.25, 3.0)):
        taps = stencils.taps_of(kernel.tolist(), (3, 11))
        assert transforms.large(stencils.taps_of(np.ones((20, 20)).tolist())) and not transforms.large(stencils.taps_of([[1.0] * 19] * 19))
        sums = weighted(Block(v, 70, 55), taps, border).data + delta
        run = program(monkeypatch, lambda: stencils.filter2d(None, kernel.tolist(), "8U", (3, 11), delta, border))  # noqa: B023
        assert (run(Block(v, 70, 55)).data == saturated(sums, "8U")).all()
        made = transforms.correlated(Block(v, 70, 55), taps, border, "32F", delta)
        assert np.allclose(made.data, sums, atol=1e-6, rtol=1e-6)
    assert [transforms.good_size(n) for n in (1, 7, 11, 97, 1025)] == [1, 8, 12, 100, 1080]


def test_transform_cost(monkeypatch):
    v, best = image(480, 640, 1), {}
    for k in (15, 63):
        run = program(monkeypatch, lambda: stencils.filter2d(None, RNG.random((k, k)).tolist(), "32F"))  # noqa: B023
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run(Block(v, 480, 640))
            times.append(time.perf_counter() - began)
        best[k] = min(times)
    assert best[63] < 3 * best[15]  # eighteen times the taps
