"""Expressions over dense arrays: as by elements, for every operation and depth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.depths import STORAGE, TensorError
from tessera.functions.elementwise import COMPARISONS, INTEGER_ONLY, binary
from tessera.operators.expressions import Expression, evaluate
from tessera.operators.tensor import Tensor

OPS = ["ADD", "SUB", "MUL", "DIV", "AND", "OR", "XOR", "NOT", "MOD", "FMOD", "BITSHIFT", "MAX", "MIN", "MEAN", *COMPARISONS]
VALUES = {
    "8U": [0, 1, 2, 3, 7, 100, 128, 254, 255], "8S": [-128, -127, -7, -1, 0, 1, 3, 9, 127], "16U": [0, 1, 5, 17, 255, 40000, 65535], "16S": [-32768, -300, -1, 0, 2, 19, 32767],
    "32S": [-(1 << 31), -77777, -1, 0, 3, 33, (1 << 31) - 1], "32U": [0, 1, 31, 65537, (1 << 32) - 1], "32F": [-1.5, 0.0, 0.25, 3.0, 1e30, float("nan"), float("inf")], "64F": [-2.5, -0.0, 0.1, 7.0, float("nan"), float("-inf")],
    "16F": [-1.5, 0.0, 0.25, 3.0, 60000.0],
}


def same(a, b):
    return a == b or (a != a and b != b)


@pytest.mark.parametrize("depth", sorted(VALUES))
def test_every_operation(spark, depth):
    pairs = [(x, y) for x in VALUES[depth] for y in VALUES[depth]]
    kind = STORAGE[depth]
    row = (0, 1, len(pairs), 1, [p[0] for p in pairs], [p[1] for p in pairs])
    frame = spark.createDataFrame([row], f"img_id long, h int, w int, cn int, a array<{kind}>, b array<{kind}>")
    a, b = Expression(frame, depth, column="a"), Expression(frame, depth, column="b")
    ops = [op for op in OPS if depth in ("8U", "8S", "16U", "16S", "32S", "32U") or op not in INTEGER_ONLY]
    got = {r.x: r for r in evaluate({op: a.apply(op, b) for op in ops}, elements=True).collect()}
    each = frame.select(F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("i", *[binary(op, F.col("p.a"), F.col("p.b"), depth).alias(op) for op in ops])
    for want in each.collect():
        for op in ops:
            assert same(got[want.i][op], want[op]), (op, pairs[want.i])


def test_trees_join_by_image_and_fold(spark):
    rng = np.random.default_rng(1)
    frames = [spark.createDataFrame([(k, 2, 3, 2, rng.integers(0, 256, 12).tolist()) for k in range(4)], "img_id long, h int, w int, cn int, data array<int>") for _ in range(2)]
    a, b = (Expression(f, "8U", 2) for f in frames)
    shared = (a + b) * b
    made = {"one": shared - 3, "two": 2 * a - b * 0.5, "three": (9, 200) - shared, "four": 100 / a, "five": shared > (10, 20), "six": -a + 255}
    df = evaluate(made)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1
    got = {r.img_id: r for r in df.collect()}
    clip = lambda v: np.clip(v, 0, 255)
    away = lambda v: np.trunc(v + np.copysign(0.5, v))
    for first, second in zip(frames[0].collect(), frames[1].collect(), strict=True):
        x, y = (np.array(r.data).reshape(6, 2) for r in (first, second))
        s = clip(clip(x + y) * y)
        want = {"one": clip(s - 3), "two": clip(away(2 * x - 0.5 * y)), "three": clip(np.array([9, 200]) - s), "four": np.where(x == 0, 0, 100 // np.maximum(x, 1)), "five": np.where(s > [10, 20], 255, 0), "six": clip(clip(-x) + 255)}
        for k, v in want.items():
            assert got[first.img_id][k] == v.ravel().tolist(), k
    nodes = {}
    made["one"].settled.value({n: np.zeros((1, 1, 1, 2), np.int32) for n in (a.node, b.node)} | nodes)
    assert made["one"].node.parts[0] == shared.node


def test_same_as_tensors_and_errors(spark):
    frame = spark.createDataFrame([(0, 1, 4, 1, [1, 50, 200, 255])], "img_id long, h int, w int, cn int, data array<int>")
    other = spark.createDataFrame([(0, 2, 2, 1, [1, 2, 3, 4])], "img_id long, h int, w int, cn int, data array<int>")
    px = frame.select("img_id", "h", "w", F.lit(0).alias("y"), F.posexplode("data").alias("x", "v")).withColumn("c", F.lit(0))
    t, e = Tensor(px, "8U"), Expression(frame, "8U")
    for f in (lambda m: m * 3 - m, lambda m: -m, lambda m: (m * 0.5) / 3, lambda m: m == 50):
        assert e.frame().columns == ["img_id", "h", "w", "cn", "data"]
        assert f(e).frame().first().data == [r.v for r in f(t).frame().orderBy("x").collect()]
    with pytest.raises(Exception, match="differ in shape"):
        (e + Expression(other, "8U")).frame().collect()
    with pytest.raises(TensorError):
        e + Expression(frame, "16S")
    with pytest.raises(Exception, match="unknown operation"):
        e.apply("NONE", e).frame().collect()
