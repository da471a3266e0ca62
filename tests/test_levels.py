"""Thresholds and tables of dense arrays and of elements, against the level tables."""

import numpy as np
import pytest

from tessera.functions.depths import TensorError
from tessera.operators import arrays, blocks, levels


def frame(spark, found, kind="int"):
    rows = [(k, *a.shape, a.ravel().tolist()) for k, a in enumerate(found)]
    return spark.createDataFrame(rows, f"img_id bigint, h int, w int, cn int, data array<{kind}>")


def pictures():
    rng = np.random.default_rng(6)
    two = np.where(rng.random((9, 14, 1)) < 0.4, rng.normal(60, 9, (9, 14, 1)), rng.normal(190, 20, (9, 14, 1)))
    skewed = 255 - rng.exponential(20, (13, 6, 1))
    return [np.clip(a, 0, 255).astype(int) for a in (two, skewed, 255 - skewed, np.full((3, 3, 1), 77), np.array([[[0], [255]]]), rng.integers(0, 256, (10, 11, 1)))]


@pytest.mark.parametrize("method", ["OTSU", "TRIANGLE"])
def test_levels_agree(spark, monkeypatch, method):
    monkeypatch.setattr(blocks, "TILE", 4)  # counts of several tiles meet
    dense = frame(spark, pictures())
    px = arrays.pixels(dense)
    want = {r.img_id: r.t for r in (levels.otsu if method == "OTSU" else levels.triangle)(px).collect()}
    level = levels.otsu_level if method == "OTSU" else levels.triangle_level
    assert {k: level(np.bincount(a.ravel(), minlength=256)) for k, a in enumerate(pictures())} == want
    by_element = levels.auto_threshold(px, method, 200, "BINARY_INV").collect()
    assert {r.img_id: r.t for r in by_element} == want and len(by_element) == sum(a.size for a in pictures())
    got = {r.img_id: r.data for r in levels.auto_threshold(dense, method, 200, "BINARY_INV").collect()}
    for k, a in enumerate(pictures()):
        held = np.where(a > want[k], 0, 200).ravel().tolist()
        assert got[k] == held
        assert [r.v for r in sorted((r for r in by_element if r.img_id == k), key=lambda r: (r.y, r.x))] == held


def test_dense_is_as_by_elements(spark):
    rng = np.random.default_rng(7)
    ints = frame(spark, [rng.integers(0, 256, (5, 4, 3)), rng.integers(0, 256, (2, 2, 1))])
    floats = frame(spark, [rng.normal(0, 2, (5, 4, 2))], "float")
    same = lambda a, b: {r.img_id: r.data for r in a.collect()} == {r.img_id: r.data for r in arrays.packed(b).collect()}
    for kind in levels.KINDS:
        for thresh, top in ((100.7, 300), (-3, 9), (400, 20)):
            assert same(levels.threshold(ints, thresh, top, kind), levels.threshold(arrays.pixels(ints), thresh, top, kind)), kind
        assert same(levels.threshold(floats, 0.3, 5, kind, "32F"), levels.threshold(arrays.pixels(floats), 0.3, 5, kind, "32F"))
    one, per = [(7 * k + 3) % 256 for k in range(256)], [[255 - k for k in range(256)], [k // 2 for k in range(256)]]
    for table in (one, per):
        assert same(levels.lut(ints, table), levels.lut(arrays.pixels(ints), table))
    halves = [k / 2 for k in range(256)]
    assert same(levels.lut(ints, halves, "32F"), levels.lut(arrays.pixels(ints), halves, "32F"))
    with pytest.raises(TensorError):
        levels.auto_threshold(ints, "MEAN", 1, "BINARY")
    assert levels.auto_threshold(arrays.pixels(ints.limit(0)), "OTSU", 1, "BINARY").count() == 0
