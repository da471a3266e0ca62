"""Sizes, printed forms, bytes read anew, and products over leading axes."""

import numpy as np
import pytest

from tessera.operators import arrays, linalg


def dense(spark, data, h, w, cn=1, kind="int"):
    return spark.createDataFrame([(0, h, w, cn, data)], f"img_id bigint, h int, w int, cn int, data array<{kind}>")


def test_sizes(spark):
    found = arrays.set_size(dense(spark, list(range(12)), 3, 4), 2, 5).first()
    assert (found.h, found.w, found.data) == (2, 5, list(range(10)))
    like = arrays.copy_size(dense(spark, list(range(12)), 3, 2, 2), dense(spark, [1, 2], 2, 1)).first()
    assert (like.h, like.w, like.cn, like.data) == (2, 1, 2, [0, 1, 2, 3])
    with pytest.raises(Exception, match="more elements"):
        arrays.set_size(dense(spark, [1], 1, 1), 2, 2).collect()


def test_printed(spark):
    text = lambda df, n=-1: arrays.printed(df, n).first().text
    assert text(dense(spark, [1, 2, 3, 4], 2, 2)) == "shape = [2 x 2]\nvalue = 1,2,3,4,"
    assert text(dense(spark, list(range(12)), 2, 2, 3), 4) == "shape = [3 x 2 x 2]\nvalue = 0,1,2,3,"
    assert text(dense(spark, [], 0, 0)) == "mat is empty"


def test_bytes_read_as_other_depths(spark):
    raw = np.arange(3, 3 + 16).astype(np.uint8)
    for to in ("32F", "16S", "64F", "8S", "32U", "16F"):
        got = arrays.reinterpret(dense(spark, raw.tolist(), 1, 2, 8), "8U", to).first()
        want = raw.view(arrays._KINDS[to])
        assert got.data == want.tolist() and got.cn * 2 == len(want)
    back = arrays.reinterpret(arrays.reinterpret(dense(spark, raw.tolist(), 1, 2, 8), "8U", "32F"), "32F", "8U").first()
    assert back.data == raw.tolist() and back.cn == 8
    with pytest.raises(Exception, match="not reinterpreted"):
        arrays.reinterpret(dense(spark, [1, 2, 3], 1, 1, 3), "8U", "16U").collect()


def relation(spark, m):
    names = [f"n{k}" for k in range(m.ndim - 2)]
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(m) for at in [at]]
    return spark.createDataFrame(rows, ", ".join([f"{n} int" for n in names] + ["i int", "j int", "v double"]))


@pytest.mark.parametrize(("a", "b"), [((2, 3, 5), (2, 5, 4)), ((1, 3, 2, 4), (2, 3, 4, 3)), ((2, 1, 2, 3), (2, 4, 3, 2)), ((3, 2, 4), (2, 3, 4, 2)), ((2, 3, 2, 4), (3, 4, 2)), ((3, 4), (2, 4, 2))])
@pytest.mark.parametrize("turned", [(False, False), (True, True)])
def test_leading_axes_broadcast(spark, a, b, turned):
    rng = np.random.default_rng(4)
    x, y = rng.integers(-4, 5, a).astype(float), rng.integers(-4, 5, b).astype(float)
    given = [m.swapaxes(-1, -2) if t else m for m, t in zip((x, y), turned, strict=True)]
    want = x @ y
    found = linalg.gemm_batched(relation(spark, given[0]), relation(spark, given[1]), a[:-2], b[:-2], *turned).collect()
    got = np.full(want.shape, np.nan)
    for r in found:
        got[tuple(r)[:-1]] = r.v
    assert (got == want).all()


def test_large_shared_operands_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.integers(-4, 5, (3, 4, 5)).astype(float), rng.integers(-4, 5, (5, 6)).astype(float)
    a = spark.createDataFrame([(int(n), int(i), int(j), float(v)) for (n, i, j), v in np.ndenumerate(x)], "mat_id int, i int, j int, v double")
    for most in (0, 256):
        monkeypatch.setattr(linalg, "PACKED_TILES", most)
        got = {(r.mat_id, r.i, r.j): r.v for r in linalg.gemm(a, relation(spark, y), shared_b=True).collect()}
        assert got == {at: v for at, v in np.ndenumerate((x @ y))}


def test_bytes_as_elements(spark):
    """Every operator over dense arrays takes bytes as it takes integers."""
    data = list(range(200, 224))
    ints = dense(spark, data, 2, 3, 4)
    raw = spark.createDataFrame([(0, 2, 3, 4, bytes(data))], "img_id bigint, h int, w int, cn int, data binary")
    same = lambda f: [tuple(r) for r in f(raw).collect()] == [tuple(r) for r in f(ints).collect()]
    for f in (
        arrays.pixels, arrays.printed, lambda a: arrays.printed(a, 3), lambda a: arrays.at(a, 1, 2, 3), lambda a: arrays.metadata(a, "8U"), lambda a: a.select(arrays.shape_string(a, True)),
        lambda a: arrays.transpose_nd(a, [2, 3, 4], [2, 0, 1]), lambda a: arrays.reinterpret(a, "8U", "16S"), lambda a: arrays.pixels(arrays.set_size(a, 1, 2)), lambda a: arrays.pixels(arrays.reshape(a, 3, 2)),
    ):
        assert same(f)
    assert arrays.set_size(raw, 1, 2).first().data == bytes(data[:8])
