"""Operators against plain loops, over edge shapes, borders and channels; errors; files; streams."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import borders, depths
from tessera.functions.depths import TensorError
from tessera.functions.elementwise import binary, compare
from tessera.operators import arrays, color, geometry, levels, linalg, neural, stencils
from tessera.operators.tensor import Tensor, broadcast_binary
from tessera.plans import registry
from tessera.sources import images
from tessera.streaming import images as streams

SHAPES = [(1, 7, 1), (6, 1, 1), (5, 4, 3), (3, 3, 5)]


def pictures(seed=0, shapes=SHAPES):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, s) for s in shapes]


def frame(spark, found):
    rows = [(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(found)]
    return spark.createDataFrame(rows, "img_id long, h int, w int, cn int, data array<int>")


def px(spark, found):
    return arrays.pixels(frame(spark, found))


def back(df, dtype=float):
    """Arrays by id of a pixel frame."""
    out = {}
    for r in df.collect():
        out.setdefault(r.img_id, []).append(r)
    made = {}
    for k, rows in out.items():
        shape = tuple(max(r[n] for r in rows) + 1 for n in ("y", "x", "c"))
        a = np.full(shape, np.nan)
        for r in rows:
            a[r.y, r.x, r.c] = np.nan if r.v is None else r.v
        made[k] = a.astype(dtype)
    return made


def at(p, n, mode):
    """The border rule by walking."""
    if mode == "CONSTANT":
        return p if 0 <= p < n else None
    if mode == "REPLICATE":
        return min(max(p, 0), n - 1)
    if mode == "WRAP":
        return p % n
    if n == 1:
        return 0
    while not 0 <= p < n:
        p = (-p - (mode == "REFLECT")) if p < 0 else 2 * n - 1 - p - (mode == "REFLECT_101")
    return p


def rounded(v, low=0, high=255):
    return min(high, max(low, math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)))


def loop_filter(a, kernel, mode, anchor=(-1, -1), delta=0.0):
    kh, kw = len(kernel), len(kernel[0])
    ax, ay = (kw // 2 if anchor[0] < 0 else anchor[0]), (kh // 2 if anchor[1] < 0 else anchor[1])
    out = np.zeros(a.shape)
    for y, x, c in np.ndindex(a.shape):
        acc = delta
        for i, j in itertools.product(range(kh), range(kw)):
            sy, sx = at(y + i - ay, a.shape[0], mode), at(x + j - ax, a.shape[1], mode)
            acc += kernel[i][j] * a[sy, sx, c] if sy is not None and sx is not None else 0
        out[y, x, c] = acc
    return out


@pytest.mark.parametrize("mode", borders.MODES)
def test_border_rule(spark, mode):
    places = [(p, n) for n in range(1, 7) for p in range(-25, 26)]
    got = spark.createDataFrame(places, "p int, n int").select("p", "n", borders.source(F.col("p"), F.col("n"), mode).alias("s")).collect()
    assert all(r.s == at(r.p, r.n, mode) for r in got)


@pytest.mark.parametrize("mode", borders.FILTER_MODES)
def test_filter2d_native_and_arrow(spark, mode):
    found, kernel = pictures(), [[0.5, -1.0, 2.0], [1.0, 0.25, -0.75]]
    got = back(stencils.filter2d(px(spark, found), kernel, "8U", (0, 1), 2.0, mode))
    dense = {r.img_id: r for r in registry.run("filter2d", frame(spark, found), kernel, "8U", (0, 1), 2.0, mode).collect()}
    for i, a in enumerate(found):
        want = np.vectorize(rounded)(loop_filter(a, kernel, mode, (0, 1), 2.0))
        assert (got[i] == want).all() and dense[i].data == want.ravel().tolist()
    assert registry.implementations("filter2d") == ["arrow", "native"]
    native = {r.img_id: r.data for r in registry.run("filter2d", frame(spark, found), kernel, "8U", (0, 1), 2.0, mode, impl="native").collect()}
    assert native == {k: r.data for k, r in dense.items()}


def test_separable_equals_outer_product(spark):
    found = pictures(1)
    kx, ky = [1.0, 2.0, 1.0], [0.5, 0.0, -0.5]
    a = back(stencils.sep_filter2d(px(spark, found), kx, ky, "32F"))
    b = back(stencils.filter2d(px(spark, found), [[x * y for x in kx] for y in ky], "32F"))
    assert all(np.allclose(a[i], b[i], atol=1e-4) for i in a)
    assert stencils.gaussian_sizes((0, 0), 1.5) == ((11, 1.5), (11, 1.5)) and abs(sum(stencils.gaussian_kernel(7, 1.2)) - 1) < 1e-6


def test_sobel_of_a_window_reads_the_parent_unless_isolated(spark):
    found = [np.arange(64).reshape(8, 8, 1) ** 2 % 251]
    parent = back(arrays.window(stencils.sobel(px(spark, found), 1, 0), (2, 6), (2, 6)))[0]
    isolated = back(stencils.sobel(arrays.window(px(spark, found), (2, 6), (2, 6)), 1, 0))[0]
    kernel = stencils.sobel_kernel(1, 0)
    assert (parent == loop_filter(found[0], kernel, "REFLECT_101")[2:6, 2:6]).all() and (isolated == loop_filter(found[0][2:6, 2:6], kernel, "REFLECT_101")).all()


def test_morphology_against_loops(spark):
    found, kernel = pictures(2), [[0, 1, 0], [1, 1, 1]]
    for mode, value in (("REFLECT_101", 255), ("CONSTANT", 30)):
        for f, best in ((stencils.erode, min), (stencils.dilate, max)):
            got = back(f(px(spark, found), kernel, (1, 0), border=mode, value=value))
            for i, a in enumerate(found):
                for y, x, c in np.ndindex(a.shape):
                    seen = [(at(y + r, a.shape[0], mode), at(x + k - 1, a.shape[1], mode)) for r in range(2) for k in range(3) if kernel[r][k]]
                    assert got[i][y, x, c] == best(value if None in s else a[s[0], s[1], c] for s in seen)
    assert (back(stencils.morphology(px(spark, found), "HITMISS", [[0]]))[0] == found[0]).all()


def loop_canny(a, low, high, l2):
    gx, gy = (loop_filter(a, stencils.sobel_kernel(1 - k, k), "REPLICATE")[..., 0] for k in (0, 1))
    m = np.float32(np.sqrt(gx * gx + gy * gy)) if l2 else np.float32(abs(gx) + abs(gy))
    h, w = m.shape
    look = lambda y, x: m[y, x] if 0 <= y < h and 0 <= x < w else 0
    keep = np.zeros((h, w), bool)
    for y, x in np.ndindex(h, w):
        if m[y, x] <= low:
            continue
        angle = math.inf if gx[y, x] == 0 else gy[y, x] / gx[y, x]
        if abs(angle) < math.tan(math.pi / 8):
            d = (0, 1)
        elif math.tan(math.pi / 8) <= angle <= math.tan(3 * math.pi / 8):
            d = (1, 1)
        elif -math.tan(3 * math.pi / 8) <= angle <= -math.tan(math.pi / 8):
            d = (-1, 1)
        else:
            d = (1, 0)
        b, c = look(y + d[0], x + d[1]), look(y - d[0], x - d[1])
        keep[y, x] = (m[y, x] > b or (m[y, x] == b and d in ((0, 1), (1, 0)))) and m[y, x] > c
    edges = keep & (m > high)
    while True:
        grown = edges.copy()
        for y, x in np.argwhere(edges):
            grown[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] |= keep[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
        if (grown == edges).all():
            return edges * 255
        edges = grown


@pytest.mark.parametrize("l2", [False, True])
def test_canny_against_a_loop(spark, l2):
    rng = np.random.default_rng(4)
    blocks = np.kron(rng.integers(0, 256, (4, 4)), np.ones((4, 4), int))[..., None] + rng.integers(0, 9, (16, 16, 1))
    found = [np.minimum(blocks, 255), rng.integers(0, 256, (1, 6, 1))]
    got = back(stencils.canny(px(spark, found), 300, 90, l2=l2))
    for i, a in enumerate(found):
        assert (got[i][..., 0] == loop_canny(a, 90, 300, l2)).all()


@pytest.mark.parametrize("mode", borders.MODES)
def test_borders_of_images(spark, mode):
    found = pictures(3)
    got = back(geometry.copy_make_border(px(spark, found), 2, 1, 0, 3, mode, "8U", (1, 2, 3, 400)))
    for i, a in enumerate(found):
        assert got[i].shape == (a.shape[0] + 3, a.shape[1] + 3, a.shape[2])
        for y, x, c in np.ndindex(got[i].shape):
            s = at(y - 2, a.shape[0], mode), at(x, a.shape[1], mode)
            assert got[i][y, x, c] == ([1, 2, 3, 255][min(c, 3)] if None in s else a[s[0], s[1], c])


def test_resize_against_loops(spark):
    found, size = pictures(5), (5, 4)
    near, exact, linear = (back(geometry.resize(px(spark, found), "8U", size, interpolation=k)) for k in ("NEAREST", "NEAREST_EXACT", "LINEAR"))
    f = np.float32
    for i, a in enumerate(found):
        h, w = a.shape[:2]
        for y, x, c in np.ndindex(near[i].shape):
            assert near[i][y, x, c] == a[min(h - 1, y * h // 4), min(w - 1, x * w // 5), c]
            e = [min(n - 1, max(0, ((((n << 16) + m // 2) // m) * p + (((n << 16) + m // 2) // m) // 2 - n % 2) >> 16)) for n, m, p in ((h, 4, y), (w, 5, x))]
            assert exact[i][y, x, c] == a[e[0], e[1], c]
            u, v = ((f(p) + f(0.5)) * (f(n) / f(m)) - f(0.5) for n, m, p in ((h, 4, y), (w, 5, x)))
            y0, x0 = (min(n - 1, max(0, math.floor(q))) for q, n in ((u, h), (v, w)))
            y1, x1, wy, wx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), u - f(y0), v - f(x0)
            lerp = lambda p, q, t: f(p) + (f(q) - f(p)) * t
            assert linear[i][y, x, c] == rounded(lerp(lerp(a[y0, x0, c], a[y0, x1, c], wx), lerp(a[y1, x0, c], a[y1, x1, c], wx), wy))
    assert geometry.target_size(10, 7, fx=0.5, fy=0.25) == (3, 4)


@pytest.mark.parametrize("mode", ["CONSTANT", "REPLICATE", "REFLECT_101"])
def test_warp_against_a_loop(spark, mode):
    found, m = pictures(6), [[0.8, 0.2, -1.0], [-0.3, 1.1, 0.5]]
    inv = geometry.inverse(m)
    for kind in ("NEAREST", "LINEAR"):
        got = back(geometry.warp_affine(px(spark, found), m, "8U", (6, 5), kind, border=mode, value=77))
        for i, a in enumerate(found):

            def look(y, x, c, a=a):
                s = at(y, a.shape[0], mode), at(x, a.shape[1], mode)
                return 77.0 if None in s else float(a[s[0], s[1], c])

            for y, x, c in np.ndindex(got[i].shape):
                u, v = (r[0] * x + r[1] * y + r[2] for r in inv)
                if kind == "NEAREST":
                    want = look(math.floor(v + 0.5), math.floor(u + 0.5), c)
                else:
                    x0, y0 = math.floor(u), math.floor(v)
                    top = look(y0, x0, c) + (look(y0, x0 + 1, c) - look(y0, x0, c)) * (u - x0)
                    low = look(y0 + 1, x0, c) + (look(y0 + 1, x0 + 1, c) - look(y0 + 1, x0, c)) * (u - x0)
                    want = rounded(top + (low - top) * (v - y0))
                assert got[i][y, x, c] == want
    with pytest.raises(TensorError):
        geometry.inverse([[1, 2, 0], [2, 4, 0]])


def test_letterbox_keeps_proportions(spark):
    got = back(geometry.letterbox(px(spark, [np.full((4, 8, 1), 9)]), "8U", 4, 8, (16, 16)))[0][..., 0]
    assert got.shape == (16, 16) and (got[4:12] == 9).all() and (got[:4] == 0).all() and (got[12:] == 0).all()


def test_colour_codes():
    assert len(color.CODES) == len(set(color.CODES)) == 70


@pytest.mark.parametrize("layout", sorted(color.LAYOUTS))
def test_flat_colour_survives_planar_layouts(spark, layout):
    flat = np.tile(np.array([60, 120, 180]), (4, 4, 1))
    again = back(color.cvt_color(color.cvt_color(px(spark, [flat]), f"RGB2YUV_{layout}"), f"YUV2RGB_{layout}"))[0]
    assert again.shape == (4, 4, 3) and abs(again - flat).max() <= 2


def test_colour_in_floats(spark):
    found = px(spark, pictures(7, [(2, 2, 3)])).withColumn("v", (F.col("v") / 255).cast("float"))
    gray = back(color.cvt_color(found, "BGR2GRAY", "32F"))[0][..., 0]
    again = back(color.cvt_color(color.cvt_color(found, "BGR2YUV", "32F"), "YUV2BGR", "32F"))[0]
    a = pictures(7, [(2, 2, 3)])[0] / 255
    assert np.allclose(gray, a @ [0.114, 0.587, 0.299], atol=1e-6) and np.allclose(again, a, atol=2e-2)
    with pytest.raises(TensorError):
        color.cvt_color(found, "BGR2YUV_NV12", "32F")


def test_saturation_traps(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (300.0,), (-7.4,)], "v double")
    assert [r.v for r in df.select(depths.saturate(F.col("v"), "8U").alias("v")).collect()] == [3, 0, 255, 0]
    assert [r.v for r in df.select(depths.saturate(F.col("v"), "8S").alias("v")).collect()] == [3, -3, 127, -7]
    assert [r.v for r in df.select(depths.saturate(F.col("v"), "32U").alias("v")).collect()] == [3, 4294967293, 300, 4294967289]
    halves = [0.1, 65519.0, 65520.0, -1e-7, 6e-8, 1.0009765625, 0.0, float("inf"), 3.14159]
    got = [r.v for r in spark.createDataFrame([(v,) for v in halves], "v double").select(depths.half(F.col("v")).alias("v")).collect()]
    assert got == [float(np.float32(np.float16(v))) for v in halves]
    assert depths.type_code("8U", 3) == 64 and depths.from_type_code(64) == ("8U", 3)


def test_integer_rules(spark):
    df = spark.createDataFrame([(5, -3), (-7, 2), (7, 0), (1, 33), (-128, -1), (-1, 3)], "a int, b int")
    one = lambda op, depth: [r.v for r in df.select(binary(op, F.col("a"), F.col("b"), depth).alias("v")).collect()]
    assert one("MOD", "16S") == [-1, 1, 0, 1, 0, 2] and one("FMOD", "16S") == [2, -1, 0, 1, 0, -1]
    assert one("DIV", "16S") == [-1, -3, 0, 0, 128, 0] and one("NOT", "16S") == [5 & ~-3, -7 & ~2, 7, 1 & ~33, 0, -4]
    assert one("BITSHIFT", "8S") == [0, -28, 7, 0, 64, -8]
    with pytest.raises(TensorError):
        binary("AND", F.col("a"), F.col("b"), "32F")
    floats = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), float("nan"))], "a double, b double")
    got = [r.v for r in floats.select(binary("DIV", F.col("a"), F.col("b"), "32F").alias("v")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])
    assert [tuple(r) for r in floats.select(compare("EQ", F.col("a"), F.col("b")), compare("NE", F.col("a"), F.col("b"))).collect()][3] == (0, 255)


def test_expressions_saturate_step_by_step(spark):
    p = px(spark, [np.array([[[200], [10]]])])
    t = Tensor(p, "8U")
    value = lambda x: [r.v for r in x.frame().orderBy("x").collect()]
    assert value(t + t - t) == [55, 10] and value(t * 2 - t) == [200, 10] and value(-t + t) == [0, 0] and value(t + -5.0) == [200, 10]
    other = Tensor(px(spark, [np.array([[[3], [0]]])]), "8U")
    assert value(t / other) == [67 - 1, 0] and value(t > other) == [255, 255] and value(255 - t) == [55, 245] and value((t == 10)) == [0, 255]
    with pytest.raises(TensorError):
        t + Tensor(p, "32F")
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 10.0), (1, 20.0)], "j int, v double")
    assert sorted(r.v for r in broadcast_binary("ADD", a, b, "32F", ["j"], ["i", "j"]).collect()) == [11.0, 22.0]


def test_moves_and_errors(spark):
    found = pictures(8)
    p = px(spark, found)
    assert all((back(arrays.transpose(p))[i] == a.transpose(1, 0, 2)).all() for i, a in enumerate(found))
    again = {r.img_id: r.data for r in arrays.packed(p).collect()}
    assert again == {i: a.ravel().tolist() for i, a in enumerate(found)}
    nd = arrays.transpose_nd(frame(spark, [np.arange(120).reshape(10, 12, 1)]), [2, 3, 4, 5], [0, 2, 1, 3]).first().data
    assert nd == np.arange(120).reshape(2, 3, 4, 5).transpose(0, 2, 1, 3).ravel().tolist()
    assert back(arrays.reinterpret(p, "8U", "8S"))[2].min() < 0
    with pytest.raises(TensorError):
        arrays.reinterpret(p, "8U", "16U")
    with pytest.raises(TensorError):
        arrays.window(p, (3, 1))
    with pytest.raises(TensorError):
        stencils.box_filter(p, (3, 3), "8U", border="WRAP")
    with pytest.raises(Exception, match="totals differ"):
        arrays.reshape(frame(spark, found[:1]), 2, 3).collect()
    assert depths.lanes((1, 300), 4, "8U") == [1, 255, 0, 0]
    with pytest.raises(TensorError):
        depths.lanes((1, 2, 3, 4), 5, "8U")
    assert back(px(spark, []), int) == {}


def test_thresholds_on_constant_images(spark):
    found = [np.full((3, 3, 1), 7), np.array([[[0], [255]]]), np.full((1, 1, 1), 255)]
    assert {r.img_id: r.t for r in levels.otsu(px(spark, found)).collect()} == {0: 0, 1: 0, 2: 0}
    assert set(r.img_id for r in levels.triangle(px(spark, found)).collect()) == {0, 1, 2}
    with pytest.raises(TensorError):
        levels.threshold(px(spark, found), 1, 2, "NONE")


GEMMS = [((2, 3), (3, 4), False, False), ((3, 2), (3, 4), True, False), ((2, 3), (4, 3), False, True), ((3, 2), (4, 3), True, True)]


@pytest.mark.parametrize(("sa", "sb", "ta", "tb"), GEMMS)
def test_gemm(spark, sa, sb, ta, tb):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, *sa)), rng.normal(size=sb)
    rows = spark.createDataFrame([(m, i, j, float(a[m, i, j])) for m, i, j in np.ndindex(a.shape)], "mat_id long, i int, j int, v double")
    right = spark.createDataFrame([(i, j, float(b[i, j])) for i, j in np.ndindex(b.shape)], "i int, j int, v double")
    got = {(r.mat_id, r.i, r.j): r.v for r in linalg.gemm(rows, right, ta, tb, shared_b=True).collect()}
    want = (a.transpose(0, 2, 1) if ta else a) @ (b.T if tb else b)
    assert linalg.gemm_shape((2, *sa), sb, ta, tb) == want.shape and all(abs(v - want[k]) < 1e-5 for k, v in got.items()) and len(got) == want.size
    packed = linalg.gemm(rows, linalg.pack_b(right, tb), ta, is_packed=True)
    assert all(abs(r.v - want[r.mat_id, r.i, r.j]) < 1e-5 for r in packed.collect())
    with pytest.raises(TensorError):
        linalg.gemm_shape((2, 3), (4, 5))
    assert linalg.gemm_shape((5, 1, 2, 3), (7, 3, 4)) == (5, 7, 2, 4)


def test_neural_helpers(spark):
    rng = np.random.default_rng(2)
    q, seq, heads, dim = rng.normal(size=(3, 2, 8)), 3, 2, 8
    rows = spark.createDataFrame([(s, q[s].ravel().tolist()) for s in range(seq)], "s int, d array<double>")
    got = {r.s: np.array(r.d).reshape(heads, dim) for r in rows.select("s", neural.rope_array(F.col("d"), F.col("s") + 5, dim).alias("d")).collect()}
    for s in range(seq):
        for i in range(dim // 2):
            t = (s + 5) / 10000.0 ** (2 * i / dim)
            x, y = q[s][:, 2 * i], q[s][:, 2 * i + 1]
            assert np.allclose(got[s][:, 2 * i], x * math.cos(t) - y * math.sin(t)) and np.allclose(got[s][:, 2 * i + 1], x * math.sin(t) + y * math.cos(t))
    soft = np.array(rows.select(neural.softmax_array(F.col("d")).alias("v")).first().v)
    e = np.exp(q[0].ravel() - q[0].max())
    assert np.allclose(soft, e / e.sum())
    assert rows.select(neural.argmax(F.col("d")).alias("v")).first().v == int(q[0].ravel().argmax())
    assert neural.precision("Half") == "FP16" and spark.range(1).select(neural.shape_to_str(F.array(F.lit(2), F.lit(3))).alias("v")).first().v == "[2, 3]"
    with pytest.raises(TensorError):
        neural.precision("fp8")


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_image_files_round_trip(spark, tmp_path, kind):
    found = pictures(9, [(3, 5, 3), (4, 2, 1)])
    images.imwrite(frame(spark, found), f"{tmp_path}/out", kind)
    (tmp_path / "out" / "broken.png").write_bytes(b"no image")
    body = b"P6\n# note\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6])
    (tmp_path / "out" / "9.ppm").write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r for r in images.imread(spark, f"{tmp_path}/out").collect()}
    assert got["0." + kind].data == found[0].ravel().tolist() and (got["0." + kind].h, got["0." + kind].w, got["0." + kind].cn) == (3, 5, 3)
    assert got["1." + kind].data == np.repeat(found[1].ravel(), 3).tolist()
    assert got["broken.png"].data == [] and got["9.ppm"].data == [3, 2, 1, 6, 5, 4]
    gray = {r.path.rsplit("/", 1)[1]: r.data for r in images.imread(spark, f"{tmp_path}/out", images.GRAYSCALE).collect()}
    b, g, r = found[0].reshape(-1, 3).T
    assert gray["0." + kind] == ((b * 7471 + g * 38470 + r * 19595 + 32768) >> 16).tolist()
    assert images.show(frame(spark, found), 0)[:4] == b"\x89PNG" and images.encoded(frame(spark, [np.full((1, 1, 5), 3)])).first().content is None


def test_stream_of_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pgm").write_bytes(b"P5 3 2 255\n" + bytes([i, i, 200, 201, 5, 5]))
    stream = streams.pixel_stream(streams.read_pnm_stream(spark, str(tmp_path / "in")))
    query = levels.threshold(stream, 100, 255, "BINARY").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 18 and spark.table("seen").filter("v = 255").count() == 6
    query = streams.level_counts(streams.read_pnm_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "at2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 18
