"""Normalisations over rows of many values, in many tasks."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import neural


def test_a_long_row_is_split(spark):
    n = 400_000
    frame = spark.range(n, numPartitions=8).select(F.lit("one").alias("row"), "id", ((F.col("id") % 1000) / 10 - 50 + F.when(F.col("id") == 7, 900).otherwise(0)).alias("v"))
    made = neural.softmax(frame, ["row"], scale=1.5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    x = ((np.arange(n) % 1000) / 10 - 50 + np.where(np.arange(n) == 7, 900, 0)) * 1.5
    want = np.exp(x - x.max())
    want /= want.sum()
    got = np.array([r.softmax for r in made.orderBy("id").collect()])
    assert np.allclose(got, want, rtol=1e-9, atol=0) or np.abs(got - want).max() < 1e-12
    scaled = neural.rmsnorm(frame, ["row"], F.lit(2.0))
    v = x / 1.5
    assert np.allclose([r.rmsnorm for r in scaled.orderBy("id").collect()], v / math.sqrt((v * v).mean() + 1e-6) * 2, rtol=1e-9)


def test_masked_null_and_infinite_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0, 1.0), ("a", 1, -inf), ("a", 2, 3.0), ("b", 0, nan), ("b", 1, 1.0), ("c", 0, inf), ("c", 1, 0.0), ("d", 0, -inf), (None, 0, 5.0), (None, 1, 5.0), ("e", 0, None), ("e", 1, 2.0), ("f", 0, 2000.0), ("f", 1, -2000.0)]
    got = {(r.k, r.i): r.softmax for r in neural.softmax(spark.createDataFrame(rows, "k string, i int, v double"), ["k"]).collect()}
    e = math.exp(-2)
    assert len(got) == len(rows) and math.isclose(got["a", 0], e / (1 + e)) and got["a", 1] == 0.0 and math.isclose(got["a", 2], 1 / (1 + e))
    assert all(math.isnan(got[k]) for k in (("b", 0), ("b", 1), ("c", 0), ("c", 1), ("d", 0)))
    assert got[None, 0] == got[None, 1] == 0.5 and got["e", 0] is None and got["e", 1] == 1.0 and got["f", 0] == 1.0 and got["f", 1] == 0.0


def test_causal(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(2, 5, 7)) * 40
    rows = [(k, i, j, float(m[k, i, j])) for k, i, j in np.ndindex(m.shape)]
    got = np.zeros(m.shape)
    for r in neural.causal_softmax(spark.createDataFrame(rows, "k int, i int, j int, v double"), ["k"], "i", "j", scale=0.5).collect():
        got[r.k, r.i, r.j] = r.softmax
    x = np.where(np.arange(7)[None, None, :] <= np.arange(5)[None, :, None], m * 0.5, -np.inf)
    want = np.exp(x - x.max(-1, keepdims=True))
    assert np.allclose(got, want / want.sum(-1, keepdims=True), rtol=1e-12)
