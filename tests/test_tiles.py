"""Matrix products by tiles of more than one tile a side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linalg, tiles


def elements(spark, m):
    """Matrices as elements made by Spark, from arrays a row."""
    rows = [(k, i, row.tolist()) for k, one in enumerate(m) for i, row in enumerate(one)]
    return spark.createDataFrame(rows, "mat_id long, i int, d array<double>").select("mat_id", "i", F.posexplode("d").alias("j", "v"))


def dense(spark, m):
    return spark.createDataFrame([(k, *one.shape, 1, one.ravel().tolist()) for k, one in enumerate(m)], "img_id long, h int, w int, cn int, data array<double>")


def filled(found, shape):
    out = np.full(shape, np.nan)
    t = found.toPandas()
    out[t.mat_id, t.i, t.j] = t.v
    return out


@pytest.mark.parametrize("turned", [(False, False), (True, False), (False, True), (True, True)])
def test_several_tiles(spark, turned):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 10, (2, 150, 270)).astype(float), rng.integers(-9, 10, (2, 270, 140)).astype(float)
    given = [m.swapaxes(1, 2) if t else m for m, t in zip((a, b), turned, strict=True)]
    found = linalg.gemm(elements(spark, given[0]), elements(spark, given[1]), *turned)
    assert (filled(found, (2, 150, 140)) == a @ b).all()
    arrays = linalg.gemm(dense(spark, given[0]), dense(spark, given[1]), *turned).collect()
    assert all((r.h, r.w) == (150, 140) and (np.array(r.data).reshape(150, 140) == (a @ b)[r.img_id]).all() for r in arrays) and len(arrays) == 2


def test_rows_of_the_plan_are_tiles(spark):
    """The published size: 2 x 2 x 2 tiles, so 8 rows are joined and 4 are left."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(1, 256, 256)), rng.normal(size=(1, 256, 256))
    left, right = (tiles.of_dense(dense(spark, m), False) for m in (a, b))
    assert left.count() == right.count() == 4
    met = left.withColumnRenamed("tj", "k").join(right.withColumnRenamed("ti", "k"), ["mat_id", "k"])
    assert met.count() == 8
    found = linalg.gemm(dense(spark, a), dense(spark, b)).first()
    assert np.allclose(np.array(found.data).reshape(256, 256), a[0] @ b[0], atol=1e-3)


def test_missing_elements_count_as_zero(spark):
    a = spark.createDataFrame([(0, 0, 0, 2.0), (0, 140, 130, 3.0)], "mat_id long, i int, j int, v double")
    b = spark.createDataFrame([(0, 0, 5, 7.0), (0, 130, 131, 11.0), (0, 200, 3, 5.0)], "mat_id long, i int, j int, v double")
    got = {(r.i, r.j): r.v for r in linalg.gemm(a, b).collect() if r.v}
    assert got == {(0, 5): 14.0, (140, 131): 33.0}
    assert linalg.gemm(a.limit(0), b).count() == 0


def test_one_inner_tile_many_matrices_held_apart(spark, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 2)
    rng = np.random.default_rng(3)
    a, b = rng.integers(-5, 6, (40, 3, 4)).astype(float), rng.integers(-5, 6, (4, 2)).astype(float)
    right = elements(spark, b[None]).drop("mat_id")
    assert (filled(linalg.gemm(elements(spark, a), right, shared_b=True), (40, 3, 2)) == a @ b).all()
    scales = spark.createDataFrame([(0, 0.5), (1, 2.0)], "j int, scale float")
    assert (filled(linalg.gemm(elements(spark, a), right, shared_b=True, scales=scales), (40, 3, 2)) == (a @ b) * [0.5, 2.0]).all()
