"""Registered queries of the array and image operators, each with its SQL."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.depths import saturate
from ..functions.elementwise import COMPARISONS, add_weighted, binary, compare
from ..operators import arrays, color, geometry, levels, linalg, neural, stencils
from ..operators.blocks import is_dense
from ..operators.expressions import Expression, evaluate
from ..operators.tensor import Tensor
from . import oracle as sql
from .fixtures import bytes_of, clipped_bytes_of, colour, images, matrices, operands, pixels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a query under a name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def elements(frame: DataFrame) -> DataFrame:
    """The elements of either form."""
    return arrays.pixels(frame, colocate=False) if is_dense(frame) else frame


def out(px: DataFrame) -> DataFrame:
    return px.select("img_id", "y", "x", "c", "v")


def whole(name: str, make, oracle: str, **shape) -> None:
    """A query over the dense 8U fixture images."""
    register(name, oracle)(lambda spark, sf: out(arrays.pixels(make(images(spark, sf, **shape)), colocate=False)))


def simple(name: str, make, oracle: str, **shape) -> None:
    """A query over the 8U fixture images."""
    register(name, oracle)(lambda spark, sf: out(make(pixels(spark, sf, **shape))))


# -- element-wise ----------------------------------------------------------

BINARY_8U = ["ADD", "SUM", "SUB", "MUL", "DIV", "AND", "OR", "XOR", "NOT", "MOD", "FMOD", "BITSHIFT", "POW", "MAX", "MIN", "ATAN2", "HYPOT", "MEAN", "EQUAL", "GREATER", "GREATER_EQUAL", "LESS", "LESS_EQUAL"]
_SQL_8U = {
    "ADD": "a+b", "SUM": "a+b", "SUB": "a-b", "MUL": "a*b", "DIV": "case when b=0 then 0 else a//b end", "AND": "a & b", "OR": "a | b", "XOR": "xor(a, b)", "NOT": "a & ~b", "MOD": "case when b=0 then 0 else a%b end",
    "FMOD": "case when b=0 then 0 else a%b end", "BITSHIFT": "case when b>=8 then 0 else (a << cast(b as int)) & 255 end", "POW": "pow(a, b)", "MAX": "greatest(a,b)", "MIN": "least(a,b)", "ATAN2": "atan2(a, b)", "HYPOT": "sqrt(a*a+b*b)", "MEAN": "(a+b)*0.5",
}
_SQL_COMPARE = {"EQUAL": "=", "GREATER": ">", "GREATER_EQUAL": ">=", "LESS": "<", "LESS_EQUAL": "<=", "EQ": "=", "GT": ">", "GE": ">=", "LT": "<", "LE": "<=", "NE": "<>"}
_OPERANDS = f"ab as (select img_id, i, cast({sql.FIRST} as bigint) as a, cast({sql.SECOND} as bigint) as b, e as f, g from raw)"


def _sql_8u(op: str) -> str:
    if op in _SQL_COMPARE:
        return f"case when a {_SQL_COMPARE[op]} b then 255 else 0 end as {op.lower()}"
    return f"{sql.sat(_SQL_8U[op])} as {op.lower()}"


@register("binary_ops_8u", sql.query(_OPERANDS, final=f"select img_id, cast(i as int) as i, {', '.join(map(_sql_8u, BINARY_8U))} from ab"))
def binary_ops_8u(spark, sf):
    """One array program over two columns of a row; no join."""
    e = table(spark, sf, "embeddings")
    both = e.select(F.col("vec_id").alias("img_id"), F.lit(1).alias("h"), F.size("embedding").alias("w"), F.lit(1).alias("cn"), bytes_of(F.col("embedding")).alias("a"), clipped_bytes_of(F.col("embedding")).alias("b"))
    a, b = Expression(both, "8U", column="a"), Expression(both, "8U", column="b")
    found = evaluate({op.lower(): a.apply(op, b) for op in BINARY_8U}, elements=True)
    return found.select("img_id", F.col("x").alias("i"), *[op.lower() for op in BINARY_8U])


register("binary_ops_8u_columns", ORACLES["binary_ops_8u"])(lambda spark, sf: operands(spark, sf).select("img_id", "i", *[binary(op, F.col("a"), F.col("b"), "8U").alias(op.lower()) for op in BINARY_8U]))


_FLOAT = {"ADD": "f+g", "SUB": "f-g", "MUL": "f*g", "DIV": "f/g", "POW": "pow(abs(f), g)", "MAX": "greatest(f,g)", "MIN": "least(f,g)", "ATAN2": "atan2(f,g)", "HYPOT": "sqrt(f*f+g*g)", "MEAN": "(f+g)*0.5"}


@register("binary_ops_32f", sql.query(_OPERANDS, "fg as (select img_id, i, cast(f as double) as f, cast(g as double) as g from ab)", final="select img_id, cast(i as int) as i, " + ", ".join(f"round(cast(cast({v} as float) as double), 4) as {k.lower()}" for k, v in _FLOAT.items()) + " from fg"))
def binary_ops_32f(spark, sf):
    f, g = F.col("f"), F.col("g")
    return operands(spark, sf).select("img_id", "i", *[F.round(binary(op, F.abs(f) if op == "POW" else f, g, "32F").cast("double"), 4).alias(op.lower()) for op in _FLOAT])


@register("compare_ops", sql.query(_OPERANDS, final="select img_id, cast(i as int) as i, " + ", ".join(f"case when a {_SQL_COMPARE[c]} b then 255 else 0 end as {c.lower()}" for c in COMPARISONS) + " from ab"))
def compare_ops(spark, sf):
    return operands(spark, sf).select("img_id", "i", *[compare(c, F.col("a"), F.col("b")).alias(c.lower()) for c in COMPARISONS])


_LANES = "(case c when 0 then 10 when 1 then 200 when 2 then 3 else 0 end)"
_SCALAR = {"add_s": f"v+{_LANES}", "sub_s": f"v-{_LANES}", "s_sub": f"{_LANES}-v", "mul_s": f"v*{_LANES}", "div_s": f"case when {_LANES}=0 then 0 else v//{_LANES} end", "s_div": f"case when v=0 then 0 else {_LANES}//v end"}


@register("scalar_ops", sql.query(sql.px(4, 4, 4), final="select img_id, y, x, c, " + ", ".join(f"{sql.sat(v)} as {k}" for k, v in _SCALAR.items()) + f", case when v > {_LANES} then 255 else 0 end as gt_s from px"))
def scalar_ops(spark, sf):
    t, s = Tensor(pixels(spark, sf, 4, 4, 4), "8U", 4), (10, 200, 3, -5)
    made = {"add_s": t + s, "sub_s": t - s, "s_sub": s - t, "mul_s": t * s, "div_s": t / s, "s_div": s / t, "gt_s": t > s}
    return t.px.select("img_id", "y", "x", "c", *[v.column.alias(k) for k, v in made.items()])


@register("add_weighted", sql.query(_OPERANDS, final=f"select img_id, cast(i as int) as i, {sql.sat('a*0.7::double+b*0.6::double')} as v, {sql.sat('a*2-b*3.0')} as d from ab"))
def weighted_sum(spark, sf):
    a, b = F.col("a"), F.col("b")
    return operands(spark, sf).select("img_id", "i", add_weighted(a, 0.7, b, 0.6, "8U").alias("v"), add_weighted(a, 2, b, -3, "8U").alias("d"))


_SAT_EXPR = {"two_a_plus_b": "a*2+b*0.5", "minus_a_plus_b": "b-a", "a_over_b_minus_3": f"{sql.sat('case when b=0 then 0 else a//b end')}-3", "sum_times_b": f"{sql.sat('a+b')}*b"}


@register("expressions", sql.query(sql.px(), sql.px(name="py", value=sql.SECOND), "ab as (select px.img_id, px.y, px.x, px.c, px.v as a, py.v as b from px join py using (img_id, y, x, c))", final="select img_id, y, x, c, " + ", ".join(f"{sql.sat(v)} as {k}" for k, v in _SAT_EXPR.items()) + " from ab"))
def expressions(spark, sf):
    """Dense arrays of two frames, joined by image."""
    a, b = Expression(images(spark, sf), "8U"), Expression(images(spark, sf, second=True), "8U")
    return evaluate({"two_a_plus_b": a * 2 + b * 0.5, "minus_a_plus_b": -a + b, "a_over_b_minus_3": a / b - 3, "sum_times_b": (a + b) * b}, elements=True)


@register("expressions_by_element", ORACLES["expressions"])
def expressions_by_element(spark, sf):
    a, b = Tensor(pixels(spark, sf), "8U").together(Tensor(pixels(spark, sf, second=True), "8U"))
    made = {"two_a_plus_b": a * 2 + b * 0.5, "minus_a_plus_b": -a + b, "a_over_b_minus_3": a / b - 3, "sum_times_b": (a + b) * b}
    return a.px.select("img_id", "y", "x", "c", *[v.column.alias(k) for k, v in made.items()])


_CAST = {"8U": (0, 255), "8S": (-128, 127), "16U": (0, 65535), "16S": (-32768, 32767)}


@register("convert_to", sql.query("d as (select img_id, i, cast(e as double) * 150000 as d from raw)", final="select img_id, cast(i as int) as i, " + ", ".join(f"{sql.sat('d', *v)} as to_{k.lower()}" for k, v in _CAST.items()) + ", cast(round(d) as int) as to_32s, cast(case when round(d) < 0 then round(d) + 4294967296 else round(d) end as bigint) as to_32u, round(cast(cast(d as float) as double), 3) as to_32f from d"))
def convert_to(spark, sf):
    each = operands(spark, sf).select("img_id", "i", (F.col("f").cast("double") * 150000).alias("d"))
    return each.select("img_id", "i", *[saturate(F.col("d"), k).alias(f"to_{k.lower()}") for k in (*_CAST, "32S", "32U")], F.round(saturate(F.col("d"), "32F").cast("double"), 3).alias("to_32f"))


# -- wide integers and halves ----------------------------------------------

#: Elements that wrap and clip: 32-bit ones come from large multiples, and 16-bit ones reach their limits.
_WIDE = {"32S": (3e9, 2147483648), "32U": (3e9, 0), "16S": (60000, None), "16U": (90000, None), "8S": (300, None)}
_WIDE_OPS = ["ADD", "SUB", "MUL", "DIV", "AND", "OR", "XOR", "MAX", "MIN", "FMOD"]
_WIDE_SQL = {"ADD": "a+b", "SUB": "a-b", "MUL": "a*b", "DIV": "case when b=0 then 0 else a//b end", "AND": "a & b", "OR": "a | b", "XOR": "xor(a, b)", "MAX": "greatest(a, b)", "MIN": "least(a, b)", "FMOD": "case when b=0 then 0 else a % b end"}


def _wide_element(v: str, depth: str) -> str:
    """A hugeint as an element: wrapped to 32 bits or clipped."""
    if depth in ("32S", "32U"):
        half = _WIDE[depth][1]
        kind = "int" if depth == "32S" else "bigint"
        return f"cast((((({v}) + {half}) % 4294967296) + 4294967296) % 4294967296 - {half} as {kind})"
    low, high = _CAST[depth]
    return f"cast(least({high}, greatest({low}, {v})) as int)"


for _depth, (_scale, _) in _WIDE.items():
    _first = _wide_element(f"cast(round(cast(e as double) * {_scale!r}::double) as hugeint)", _depth)
    _second = _wide_element(f"cast(round(cast(g as double) * {_scale!r}::double) as hugeint)", _depth)

    def _wide(spark, sf, depth=_depth, scale=_scale):
        a, b = (saturate(F.col(k).cast("double") * scale, depth) for k in "fg")
        each = operands(spark, sf).select("img_id", "i", a.alias("a"), b.alias("b"))
        return each.select("img_id", "i", *[binary(op, F.col("a"), F.col("b"), depth).alias(op.lower()) for op in _WIDE_OPS])

    register(f"binary_ops_{_depth.lower()}", sql.query(f"ab as (select img_id, cast(i as int) as i, cast({_first} as hugeint) as a, cast({_second} as hugeint) as b from raw)", final="select img_id, i, " + ", ".join(f"{_wide_element(_WIDE_SQL[op], _depth)} as {op.lower()}" for op in _WIDE_OPS) + " from ab"))(_wide)


@register("binary_ops_64f", sql.query("ab as (select img_id, cast(i as int) as i, cast(e as double) as f, cast(g as double) as g from raw)", final="select img_id, i, " + ", ".join(f"round({v}, 9) as {k.lower()}" for k, v in _FLOAT.items()) + " from ab"))
def binary_ops_64f(spark, sf):
    f, g = F.col("f").cast("double"), F.col("g").cast("double")
    return operands(spark, sf).select("img_id", "i", *[F.round(binary(op, F.abs(f) if op == "POW" else f, g, "64F"), 9).alias(op.lower()) for op in _FLOAT])


# -- every overload of the array operators -----------------------------------

#: Operands: an array, another, each as an open product, a scalar and a number; with their SQL.
_TERMS = {"m": "a", "o": "b", "e": "a*2", "x": "b*0.5", "s": "10", "n": "7"}
_PAIRS = ["mo", "ms", "sm", "mn", "nm", "em", "me", "eo", "oe", "es", "se", "en", "ne", "ex", "ee"]


def _term(k: str) -> str:
    """The SQL of a settled operand."""
    return sql.sat(_TERMS[k]) if k in "ex" else _TERMS[k]


def _sql_overload(op: str, pair: str) -> str:
    left, right = pair
    if op in "+-" and not set(pair) & set("sn"):
        return sql.sat(f"{_TERMS[left]} {op} ({_TERMS[right]})")
    if op == "*" and "n" in pair:
        return sql.sat(f"({_TERMS[left]}) * ({_TERMS[right]})")
    if op == "/":
        return sql.sat(f"case when {_term(right)} = 0 then 0 else {_term(left)} // {_term(right)} end")
    if op in "+-*":
        return sql.sat(f"{_term(left)} {op} {_term(right)}")
    return f"case when {_term(left)} {'<>' if op == '!=' else '=' if op == '==' else op} {_term(right)} then 255 else 0 end"


_PYTHON = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
for _name, _ops in {"add": "+", "sub": "-", "mul": "*", "div": "/"}.items():

    def _overloads(spark, sf, op=_ops):
        a, b = Tensor(pixels(spark, sf), "8U").together(Tensor(pixels(spark, sf, second=True), "8U"))
        terms = {"m": a, "o": b, "e": a * 2, "x": b * 0.5, "s": (10, 1, 2, 3), "n": 7}
        made = {p: _PYTHON[op](terms[p[0]], terms[p[1]]) for p in _PAIRS}
        return a.px.select("img_id", "y", "x", "c", *[v.column.alias(k) for k, v in made.items()])

    register(f"overloads_{_name}", sql.query(sql.px(), sql.px(name="py", value=sql.SECOND), "ab as (select px.img_id, px.y, px.x, px.c, px.v as a, py.v as b from px join py using (img_id, y, x, c))", final="select img_id, y, x, c, " + ", ".join(f"{_sql_overload(_ops, p)} as {p}" for p in _PAIRS) + " from ab"))(_overloads)



def _dense_terms(spark, sf) -> dict:
    a, b = Expression(images(spark, sf), "8U"), Expression(images(spark, sf, second=True), "8U")
    return {"m": a, "o": b, "e": a * 2, "x": b * 0.5, "s": (10, 1, 2, 3), "n": 7}


for _name, _ops in {"add": "+", "sub": "-", "mul": "*", "div": "/"}.items():

    def _dense_overloads(spark, sf, op=_ops):
        terms = _dense_terms(spark, sf)
        return evaluate({p: _PYTHON[op](terms[p[0]], terms[p[1]]) for p in _PAIRS}, elements=True)

    register(f"overloads_dense_{_name}", ORACLES[f"overloads_{_name}"])(_dense_overloads)

_COMPARED = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@register("overloads_compare", sql.query(sql.px(), sql.px(name="py", value=sql.SECOND), "ab as (select px.img_id, px.y, px.x, px.c, px.v as a, py.v as b from px join py using (img_id, y, x, c))", final="select img_id, y, x, c, " + ", ".join(f"{_sql_overload(op, p)} as {k}_{p}" for k, op in _COMPARED.items() for p in ("mo", "ms", "sm", "mn", "nm", "em", "me")) + " from ab"))
def overloads_compare(spark, sf):
    a, b = Tensor(pixels(spark, sf), "8U").together(Tensor(pixels(spark, sf, second=True), "8U"))
    terms = {"m": a, "o": b, "e": a * 2, "s": (10, 1, 2, 3), "n": 7}
    made = {f"{k}_{p}": _PYTHON[op](terms[p[0]], terms[p[1]]) for k, op in _COMPARED.items() for p in ("mo", "ms", "sm", "mn", "nm", "em", "me")}
    return a.px.select("img_id", "y", "x", "c", *[v.column.alias(k) for k, v in made.items()])


@register("overloads_dense_compare", ORACLES["overloads_compare"])
def overloads_dense_compare(spark, sf):
    terms = _dense_terms(spark, sf)
    return evaluate({f"{k}_{p}": _PYTHON[op](terms[p[0]], terms[p[1]]) for k, op in _COMPARED.items() for p in ("mo", "ms", "sm", "mn", "nm", "em", "me")}, elements=True)


# -- moving elements -------------------------------------------------------

simple("transpose", arrays.transpose, sql.query(sql.px(4, 16), final="select img_id, x as y, y as x, c, v from px"), h=4, w=16)
simple("sub_window", lambda p: arrays.window(p, (2, 6), (1, 5)), sql.query(sql.px(), final="select img_id, y-2 as y, x-1 as x, c, v from px where y between 2 and 5 and x between 1 and 4"))
simple("set_to_mask", lambda p: arrays.set_to(p, (300, 5, -1), "8U", 4, F.col("v") > 128), sql.query(sql.px(4, 4, 4), final="select img_id, y, x, c, case when v > 128 then (case c when 0 then 255 when 1 then 5 else 0 end) else v end as v from px"), h=4, w=4, cn=4)


@register("merge_channels", sql.query(sql.px(), sql.px(name="py", value=sql.SECOND), final="select img_id, y, x, 0 as c, v from px union all select img_id, y, x, 1, v from py union all select img_id, y, x, 2, v from px"))
def merge_channels(spark, sf):
    a, b = pixels(spark, sf), pixels(spark, sf, second=True)
    return out(arrays.merge([a, b, a]))


@register("split_channels", sql.query(sql.px(4, 4, 4), final="select img_id, y, x, 0 as c, v, c as part from px"))
def split_channels(spark, sf):
    parts = arrays.split(pixels(spark, sf, 4, 4, 4), 4)
    tagged = [out(p).withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    return tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3])


@register("transpose_nd", sql.query(final=f"select img_id, cast((i % 8) * 8 + (i // 32) * 4 + (i // 8) % 4 as int) as i, {sql.FIRST} as v from raw"))
def transpose_nd(spark, sf):
    moved = arrays.transpose_nd(images(spark, sf), [2, 4, 8], [2, 0, 1])
    return moved.select("img_id", F.posexplode("data").alias("i", "v"))


@register("metadata", "select vec_id as img_id, 4 as rows_, 4 as cols_, 4 as channels, cast(16 as bigint) as total, 4 as elem_size, 1 as elem_size1, false as is_empty from embeddings")
def metadata(spark, sf):
    m = arrays.metadata(images(spark, sf, 4, 4, 4), "8U")
    return m.select("img_id", F.col("shape")[0].alias("rows_"), F.col("shape")[1].alias("cols_"), "channels", "total", "elem_size", "elem_size1", "is_empty")


@register("reshape_at", sql.query(final=f"select img_id, {sql.FIRST} as v from raw where i = 3 * 16 + 5"))
def reshape_at(spark, sf):
    return arrays.at(arrays.reshape(images(spark, sf), 4, 16), 3, 5)


register("fill_lanes", "select vec_id as img_id, cast(k // 8 as int) as y, cast(k // 4 % 2 as int) as x, cast(k % 4 as int) as c, case k % 4 when 0 then 7 when 1 then 255 when 2 then 0 else 3 end as v from embeddings, range(16) r(k)")(
    lambda spark, sf: out(arrays.pixels(arrays.fill(table(spark, sf, "embeddings"), "vec_id", 2, 2, 4, (7, 300, -5, 2.5), "8U")))
)
whole("set_size", lambda p: arrays.set_size(p, 4, 5), sql.query(final=f"select img_id, cast(i // 5 as int) as y, cast(i % 5 as int) as x, 0 as c, {sql.FIRST} as v from raw where i < 20"))
simple("reinterpret_signed", lambda p: arrays.reinterpret(p, "8U", "8S"), sql.query(sql.px(), final="select img_id, y, x, c, case when v >= 128 then v - 256 else v end as v from px"))


@register("reinterpret_wider", sql.query(sql.px(4, 4, 4), final="select img_id, y, x, cast(c // 2 as int) as c, cast(sum(v * case c % 2 when 0 then 1 else 256 end) as int) as v from px group by all"))
def reinterpret_wider(spark, sf):
    return out(arrays.pixels(arrays.reinterpret(images(spark, sf, 4, 4, 4), "8U", "16U")))


@register("printed", sql.query(final=f"select img_id, 'shape = [4 x 4 x 4]' || chr(10) || 'value = ' || string_agg(cast({sql.FIRST} as varchar) || ',', '' order by i) as text from raw where i < 6 group by img_id"))
def printed(spark, sf):
    return arrays.printed(images(spark, sf, 4, 4, 4), 6)


_HALF_STEP = "pow(2.0, greatest(floor(log2(abs(cast(e as double)))), -14) - 10)"


@register("half_precision", sql.query(final=f"select img_id, cast(i as int) as i, case when e = 0 then 0.0::double else round_even(cast(e as double) / {_HALF_STEP}, 0) * {_HALF_STEP} end as v from raw"))
def half_precision(spark, sf):
    return operands(spark, sf).select("img_id", "i", neural.align_precision(F.col("f"), "fp16").cast("double").alias("v"))


@register("to_chw", sql.query(sql.px(4, 4, 4), final="select img_id, cast((c * 4 + y) * 4 + x as bigint) as i, v from px"))
def to_chw(spark, sf):
    return arrays.to_chw(pixels(spark, sf, 4, 4, 4))


# -- linear algebra --------------------------------------------------------

_MATS = "a as (select img_id as mat_id, cast(i // 8 as int) as i, cast(i % 8 as int) as j, cast(e as double) as v from raw), b as (select img_id as mat_id, cast(i // 8 as int) as i, cast(i % 8 as int) as j, cast(g as double) as v from raw)"
_ROUND = "round(cast(cast(sum(a.v * b.v) as float) as double), 4) as v"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round(F.col("v").cast("double"), 4).alias("v"))


for _ta in (False, True):
    for _tb in (False, True):
        _name = f"gemm_{'t' if _ta else 'n'}{'t' if _tb else 'n'}"
        _left, _inner = ("a.j", "a.i") if _ta else ("a.i", "a.j")
        _other, _right = ("b.j", "b.i") if _tb else ("b.i", "b.j")
        register(_name, sql.query(_MATS, final=f"select a.mat_id, {_left} as i, {_right} as j, {_ROUND} from a join b on a.mat_id = b.mat_id and {_inner} = {_other} group by 1, 2, 3"))(
            lambda spark, sf, ta=_ta, tb=_tb: _rounded(linalg.gemm(matrices(spark, sf), matrices(spark, sf, True), ta, tb), "mat_id", "i", "j")
        )


@register("gemm_leading_axes", sql.query(_MATS, final=f"select a.mat_id as n0, a.i, b.j, {_ROUND} from a join (select i, j, v from b where mat_id = 1) b on a.j = b.i group by 1, 2, 3"))
def gemm_leading_axes(spark, sf):
    """One matrix, with a leading axis of one, times every matrix of an axis."""
    a, b = matrices(spark, sf).withColumnRenamed("mat_id", "n0"), matrices(spark, sf, True).filter("mat_id = 1").withColumn("n0", F.lit(0)).drop("mat_id")
    return _rounded(linalg.gemm_batched(a, b, (table(spark, sf, "embeddings").count(),), (1,)), "n0", "i", "j")


@register("gemm_dense", ORACLES["gemm_nn"])
def gemm_dense(spark, sf):
    """Dense arrays, cut into tiles where they are."""
    e = table(spark, sf, "embeddings")
    a, b = arrays.dense(e, "vec_id", "embedding", 8, 8), arrays.dense(e, "vec_id", F.reverse("embedding"), 8, 8)
    found = arrays.pixels(linalg.gemm(a, b)).select(F.col("img_id").alias("mat_id"), F.col("y").alias("i"), F.col("x").alias("j"), "v")
    return _rounded(found, "mat_id", "i", "j")


@register("gemm_packed", sql.query(_MATS, final=f"select a.mat_id, a.i, b.j, {_ROUND} from a join (select i, j, v from b where mat_id = 0) b on a.j = b.i group by 1, 2, 3"))
def gemm_packed(spark, sf):
    b = linalg.pack_b(matrices(spark, sf, True).filter("mat_id = 0").drop("mat_id"))
    return _rounded(linalg.gemm(matrices(spark, sf), b, is_packed=True), "mat_id", "i", "j")


@register("gemm_int8", sql.query(_MATS, f"q as (select i, j, {sql.sat('v*100', -128, 127)} as v from b where mat_id = 0)", final="select a.mat_id, a.i, q.i as j, round(cast(cast(sum(a.v * q.v) * cast(cast(0.01 + q.i * 0.001 as float) as double) as float) as double), 4) as v from a join q on a.j = q.j group by a.mat_id, a.i, q.i"))
def gemm_int8(spark, sf):
    b = matrices(spark, sf, True).filter("mat_id = 0").select("i", "j", saturate(F.col("v").cast("double") * 100, "8S").alias("v"))
    scales = spark.range(8).select(F.col("id").cast("int").alias("j"), (F.lit(0.01) + F.col("id") * 0.001).cast("float").alias("scale"))
    return _rounded(linalg.gemm(matrices(spark, sf), b, trans_b=True, shared_b=True, scales=scales), "mat_id", "i", "j")


@register("norms", sql.query(_OPERANDS, final="select img_id, cast(sum(a) as double) as l1, cast(sum(a*a) as double) as l2, cast(max(a) as double) as inf, cast(sum(abs(a-b)) as double) as l1_diff, cast(sum((a-b)*(a-b)) as double) as l2_diff, cast(max(abs(a-b)) as double) as inf_diff from ab group by img_id"))
def norms(spark, sf):
    a, b = pixels(spark, sf), pixels(spark, sf, second=True)
    apart = linalg.norms(a, b)
    return linalg.norms(a).join(apart.select("img_id", *[F.col(c).alias(f"{c}_diff") for c in ("l1", "l2", "inf")]), "img_id")


# -- rows of numbers -------------------------------------------------------


@register("softmax", "select event_id, round(exp(value/100 - max(value/100) over w) / sum(exp(value/100)) over w * exp(max(value/100) over w), 6) as v from events window w as (partition by user_id)")
def softmax(spark, sf):
    return neural.softmax(table(spark, sf, "events"), ["user_id"], "value", 0.01).select("event_id", F.round("softmax", 6).alias("v"))


@register("causal_softmax", sql.query(_MATS, "e as (select mat_id, i, j, case when j <= i then exp(v * 0.5) else 0 end as e from a)", final="select mat_id, i, j, round(e / sum(e) over (partition by mat_id, i), 6) as v from e"))
def causal_softmax(spark, sf):
    return neural.causal_softmax(matrices(spark, sf), ["mat_id"], "i", "j", scale=0.5).select("mat_id", "i", "j", F.round("softmax", 6).alias("v"))


@register("silu", sql.query(final="select img_id, cast(i as int) as i, round(cast(e as double) * 4 / (1 + exp(-cast(e as double) * 4)), 6) as v from raw"))
def silu(spark, sf):
    return operands(spark, sf).select("img_id", "i", F.round(neural.silu(F.col("f").cast("double") * 4), 6).alias("v"))


@register("rmsnorm", sql.query(_MATS, "m as (select *, avg(v*v) over (partition by mat_id, i) as q from a)", final="select mat_id, i, j, round(v / sqrt(q + 1e-6) * (1 + j * 0.1), 5) as v, round(v / sqrt(q + 1e-6) * ((j - 3) * 0.02), 5) as w from m"))
def rmsnorm(spark, sf):
    a = neural.rmsnorm(matrices(spark, sf), ["mat_id", "i"], 1 + F.col("j") * 0.1).withColumnRenamed("rmsnorm", "n")
    b = neural.rmsnorm(a, ["mat_id", "i"], F.col("j") - 3, scale=0.02)
    return b.select("mat_id", "i", "j", F.round("n", 5).alias("v"), F.round("rmsnorm", 5).alias("w"))


@register("rope", sql.query("r as (select img_id, i, cast(e as double) as v, (5 + i // 16) / pow(10000.0, 2.0 * (i % 8 // 2) / 8) as t from raw)", final="select a.img_id, cast(a.i as int) as i, round(case when a.i % 2 = 0 then a.v * cos(a.t) - b.v * sin(a.t) else b.v * sin(a.t) + a.v * cos(a.t) end, 5) as v from r a join r b on a.img_id = b.img_id and b.i = (case when a.i % 2 = 0 then a.i + 1 else a.i - 1 end)"))
def rope(spark, sf):
    """Four positions from 5 on, two heads of eight elements each, in every embedding."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img_id"), "embedding")
    rows = e.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p"), "embedding").select("img_id", "p", F.slice("embedding", F.col("p") * 16 + 1, F.lit(16)).alias("d"))
    turned = rows.select("img_id", "p", F.posexplode(neural.rope_array(F.col("d"), F.col("p") + 5, 8)).alias("k", "v"))
    return turned.select("img_id", (F.col("p") * 16 + F.col("k")).alias("i"), F.round("v", 5).alias("v"))


@register("argmax_tokens", sql.query(_MATS, "n as (select mat_id, i, j, row_number() over (partition by mat_id, i order by v desc, j) as k from a)", final="select mat_id, i, j as token from n where k = 1"))
def argmax_tokens(spark, sf):
    return neural.argmax_rows(matrices(spark, sf), ["mat_id", "i"], "j")


# -- levels ----------------------------------------------------------------

_KINDS = {"BINARY": "case when v > 127 then 200 else 0 end", "BINARY_INV": "case when v > 127 then 0 else 200 end", "TRUNC": "case when v > 127 then 127 else v end", "TOZERO": "case when v > 127 then v else 0 end", "TOZERO_INV": "case when v > 127 then 0 else v end"}


@register("threshold", sql.query(sql.px(), final="select img_id, y, x, c, " + ", ".join(f"{v} as {k.lower()}" for k, v in _KINDS.items()) + " from px"))
def threshold(spark, sf):
    return pixels(spark, sf).select("img_id", "y", "x", "c", *[levels.threshold_value(F.col("v"), 127.6, 200, k, "8U").alias(k.lower()) for k in _KINDS])


_OTSU = """h as (select img_id, v, count(*) as n from px group by 1, 2),
s as (select img_id, v, sum(n) over w as wb, sum(n*v) over w as sb, sum(n) over (partition by img_id) as t, sum(n*v) over (partition by img_id) as s from h window w as (partition by img_id order by v)),
b as (select img_id, v, case when t > wb then cast(wb as double) * cast(t-wb as double) * (cast(sb as double)/wb - cast(s-sb as double)/(t-wb)) * (cast(sb as double)/wb - cast(s-sb as double)/(t-wb)) else 0 end as d from s),
r as (select img_id, case when d > 0 then v else 0 end as t, row_number() over (partition by img_id order by d desc, v) as k from b)"""
whole("threshold_otsu", lambda p: levels.auto_threshold(p, "OTSU", 255, "BINARY"), sql.query(sql.px(), _OTSU, final="select img_id, y, x, c, case when v > t then 255 else 0 end as v from px join (select * from r where k = 1) r using (img_id)"))

_TRIANGLE = """h as (select img_id, v, count(*) as n from px group by 1, 2),
e as (select img_id, case when min(v) > 0 then min(v) - 1 else min(v) end as l, case when max(v) < 255 then max(v) + 1 else max(v) end as r, max(n) as top from h group by 1),
p as (select h.img_id, min(v) as peak from h join e on h.img_id = e.img_id and n = top group by 1),
f as (select e.*, peak, peak - l < r - peak as flip from e join p using (img_id)),
g as (select *, case when flip then 255 - r else l end as lo, case when flip then 255 - peak else peak end as hi from f),
d as (select g.*, k.k as i, cast(top as double) * k.k + cast(lo - hi as double) * coalesce((select n from h where h.img_id = g.img_id and h.v = (case when flip then 255 - k.k else k.k end)), 0) as d from g join range(256) k(k) on k.k > lo and k.k <= hi),
b as (select img_id, i, d, row_number() over (partition by img_id order by d desc, i) as o from d),
t as (select g.img_id, case when flip then 255 - (coalesce(case when d > 0 then i end, lo) - 1) else coalesce(case when d > 0 then i end, lo) - 1 end as t from g left join (select * from b where o = 1) b using (img_id))"""
whole("threshold_triangle", lambda p: levels.auto_threshold(p, "TRIANGLE", 255, "BINARY"), sql.query(sql.px(), _TRIANGLE, final="select img_id, y, x, c, case when v > t then 255 else 0 end as v from px join t using (img_id)"))
for _method in ("otsu", "triangle"):
    simple(f"threshold_{_method}_elements", lambda p, m=_method.upper(): levels.auto_threshold(p, m, 255, "BINARY"), ORACLES[f"threshold_{_method}"])
whole("lut", lambda p: levels.lut(p, [(i * 7 + 3) % 256 for i in range(256)]), sql.query(sql.px(), final="select img_id, y, x, c, (v * 7 + 3) % 256 as v from px"))
whole("lut_channels", lambda p: levels.lut(p, [[255 - i for i in range(256)], [i // 2 for i in range(256)], [i ^ 15 for i in range(256)], list(range(256))]), sql.query(sql.px(4, 4, 4), final="select img_id, y, x, c, case c when 0 then 255 - v when 1 then v // 2 when 2 then xor(v, 15) else v end as v from px"), h=4, w=4, cn=4)

# -- colour ----------------------------------------------------------------

_PIVOT = "pv as (select img_id, y, x, max(case when c=0 then v end) as c0, max(case when c=1 then v end) as c1, max(case when c=2 then v end) as c2, max(case when c=3 then v end) as c3 from px group by 1, 2, 3)"


def _sql_plain(code: str) -> str:
    source, target = code.split("2")
    names = {"BGR": "bgr", "RGB": "rgb", "BGRA": "bgra", "RGBA": "rgba", "GRAY": "y"}
    at = {n: f"c{k}" for k, n in enumerate(names[source])} | ({} if source.endswith("A") else {"a": "255"}) | (dict.fromkeys("bgr", "c0") if source == "GRAY" else {})
    values = [f"(7471*{at['b']} + 38470*{at['g']} + 19595*{at['r']} + 32768) >> 16"] if target == "GRAY" else [at[n] for n in names[target]]
    return " union all ".join(f"select '{code}' as code, img_id, y, x, {k} as c, cast({v} as int) as v from pv" for k, v in enumerate(values))


def _tagged(spark, sf, codes: list[str], channels: Callable[[str], int], make=colour) -> DataFrame:
    parts = [elements(color.cvt_color(make(spark, sf, channels(c)), c)).select(F.lit(c).alias("code"), "img_id", "y", "x", "c", "v") for c in codes]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


_CHANNELS = {"GRAY": 1, "BGR": 3, "RGB": 3, "YUV": 3, "BGRA": 4, "RGBA": 4}
for _part, _codes in (("opaque", [c for c in color.PLAIN if "A2" not in c]), ("alpha", [c for c in color.PLAIN if "A2" in c])):
    register(f"cvt_color_{_part}", sql.query(sql.px(4, 4, 4), _PIVOT, final=" union all ".join(map(_sql_plain, _codes))))(lambda spark, sf, codes=_codes: _tagged(spark, sf, codes, lambda c: _CHANNELS[c.split("2")[0]]))


def _sql_analog(code: str) -> str:
    source, target = code.split("2")
    order = (target if source == "YUV" else source).lower()
    at = {n: f"c{k}" for k, n in enumerate("yuv" if source == "YUV" else order)}
    if target == "YUV":
        y = f"({at['b']}*0.114::double + {at['g']}*0.587::double + {at['r']}*0.299::double)"
        values = [y, f"({at['b']}-{y})*0.492::double+128", f"({at['r']}-{y})*0.877::double+128"]
    else:
        made = {"b": "c0+(c1-128)*2.032::double", "g": "c0-(c1-128)*0.395::double-(c2-128)*0.581::double", "r": "c0+(c2-128)*1.140::double"}
        values = [made[n] for n in order]
    return " union all ".join(f"select '{code}' as code, img_id, y, x, {k} as c, {sql.sat(v)} as v from pv" for k, v in enumerate(values))


_ANALOG = ["BGR2YUV", "YUV2BGR", "RGB2YUV", "YUV2RGB"]
register("cvt_color_yuv", sql.query(sql.px(4, 4, 4), _PIVOT, final=" union all ".join(map(_sql_analog, _ANALOG))))(lambda spark, sf: _tagged(spark, sf, _ANALOG, lambda c: 3))


_FLOAT_COLOUR = {
    "BGR2GRAY": ["c0*0.114+c1*0.587+c2*0.299"], "RGB2BGR": ["c2", "c1", "c0"], "BGR2RGBA": ["c2", "c1", "c0", "1.0"], "BGR2YUV": ["{y}", "(c0-{y})*0.492+0.5", "(c2-{y})*0.877+0.5"],
    "YUV2RGB": ["c0+(c2-0.5)*1.140", "c0-(c1-0.5)*0.395-(c2-0.5)*0.581", "c0+(c1-0.5)*2.032"],
}
_FLOAT_VALUE = "cast(e as double)"


@register("cvt_color_32f", sql.query(sql.px(4, 4, 4, value=_FLOAT_VALUE), _PIVOT, final=" union all ".join(f"select '{code}' as code, img_id, y, x, {k} as c, round(cast(cast({v.format(y='(c0*0.114+c1*0.587+c2*0.299)')} as float) as double), 5) as v from pv" for code, values in _FLOAT_COLOUR.items() for k, v in enumerate(values))))
def cvt_color_32f(spark, sf):
    three = F.filter("embedding", lambda v, i: i % 4 < 3)
    px = arrays.dense(table(spark, sf, "embeddings"), "vec_id", three, 4, 4, 3)
    found = None
    for code in _FLOAT_COLOUR:
        part = elements(color.cvt_color(px, code, "32F")).select(F.lit(code).alias("code"), "img_id", "y", "x", "c", F.round(F.col("v").cast("double"), 5).alias("v"))
        found = part if found is None else found.union(part)
    return found


def _limited(b: str, g: str, r: str) -> tuple[str, str, str]:
    return sql.sat(f"((66*({r}) + 129*({g}) + 25*({b}) + 128) >> 8) + 16"), sql.sat(f"((-38*({r}) - 74*({g}) + 112*({b}) + 128) >> 8) + 128"), sql.sat(f"((112*({r}) - 94*({g}) - 18*({b}) + 128) >> 8) + 128")


def _sql_encode(code: str) -> str:
    source, layout = code.split("2")[0], code.split("_")[1]
    sx, sy = color.LAYOUTS[layout]
    at = {n: f"c{k}" for k, n in enumerate(source.lower())}
    bits = {1: 0, 2: 1, 4: 2}[sx * sy]
    mean = {n: f"((cast(sum({v}) as int) + {(1 << bits) // 2}) >> {bits})" for n, v in at.items()}
    _, u, v = _limited(mean["b"], mean["g"], mean["r"])
    y = _limited(at["b"], at["g"], at["r"])[0]
    first, second = (v, u) if layout in color.V_FIRST else (u, v)
    parts, per, plane = [], 4 // sx, (4 // sx) * (4 // sy)
    packed = layout in ("YUY2", "UYVY")
    lead = 0 if layout != "UYVY" else 1
    parts.append(f"select '{code}' as code, img_id, y, x, {lead} as c, {y} as v from pv")
    for k, value in enumerate((first, second)):
        cell = f"select img_id, y // {sy} as cy, x // {sx} as cx, {value} as v from pv group by 1, 2, 3"
        if packed:
            parts.append(f"select '{code}', img_id, cast(cy as int), cast(cx * 2 + {k} as int), {1 - lead}, v from ({cell})")
        else:
            place = f"(cy * {per} + cx) * 2 + {k}" if layout.startswith("NV") else f"{k * plane} + cy * {per} + cx"
            parts.append(f"select '{code}', img_id, cast(4 + ({place}) // 4 as int), cast(({place}) % 4 as int), 0, v from ({cell})")
    return " union all ".join(parts)


for _c in ("BGR", "RGB"):
    _codes = [f"{_c}2YUV_{k}" for k in color.LAYOUTS]
    register(f"cvt_color_encode_{_c.lower()}", sql.query(sql.px(4, 4, 4), _PIVOT, final=" union all ".join(map(_sql_encode, _codes))))(lambda spark, sf, codes=_codes: _tagged(spark, sf, codes, lambda c: 3))

#: Rows of the fixture images that hold a 4-column picture in a layout, by its subsampling.
_DECODE = {(2, 2): (6, 4), (2, 1): (8, 4), (1, 1): (12, 4)}


def _planar(spark, sf, layout: str) -> DataFrame:
    if layout in ("YUY2", "UYVY"):
        return images(spark, sf, 8, 4, 2)
    h, w = _DECODE[color.LAYOUTS[layout]]
    return arrays.dense(table(spark, sf, "embeddings"), "vec_id", F.slice(bytes_of(F.col("embedding")), 1, h * w), h, w)


def _sql_decode(code: str) -> str:
    target, layout = code.split("2", 1)[1].split("_")
    sx, sy = color.LAYOUTS[layout]
    rows = 8 if layout in ("YUY2", "UYVY") else 4
    places = f"(select img_id, d as el, cast(yy.y as int) as y, cast(xx.x as int) as x, yy.y // {sy} as cy, xx.x // {sx} as cx from im cross join range({rows}) yy(y) cross join range(4) xx(x))"
    flip = 1 if layout in color.V_FIRST else 0
    if layout in ("YUY2", "UYVY"):
        lead = 0 if layout == "YUY2" else 1
        luma, chroma = f"p.y * 8 + p.x * 2 + {lead}", [f"p.cy * 8 + (p.cx * 2 + {k}) * 2 + {1 - lead}" for k in (0, 1)]
    else:
        base, per, plane = rows * 4, 4 // sx, (4 // sx) * (rows // sy)
        luma = "p.y * 4 + p.x"
        chroma = [f"{base} + (p.cy * {per} + p.cx) * 2 + {k}" if layout.startswith("NV") else f"{base} + {k * plane} + p.cy * {per} + p.cx" for k in (0, 1)]
    u, v = chroma[flip], chroma[1 - flip]
    made = {"b": "(c + 516*d) >> 8", "g": "(c - 100*d - 208*e) >> 8", "r": "(c + 409*e) >> 8"}
    joined = f"(select p.img_id, p.y, p.x, 298 * greatest(p.el[{luma} + 1] - 16, 0) + 128 as c, p.el[{u} + 1] - 128 as d, p.el[{v} + 1] - 128 as e from {places} p)"
    return " union all ".join(f"select '{code}' as code, img_id, y, x, {k} as c, {sql.sat(made[n])} as v from {joined}" for k, n in enumerate(target.lower()))


for _c in ("BGR", "RGB"):
    _codes = [f"YUV2{_c}_{k}" for k in color.LAYOUTS]

    def _decoded(spark, sf, codes=_codes):
        found = None
        for c in codes:
            part = elements(color.cvt_color(_planar(spark, sf, c.split("_")[1]), c)).select(F.lit(c).alias("code"), "img_id", "y", "x", "c", "v")
            found = part if found is None else found.union(part)
        return found

    register(f"cvt_color_decode_{_c.lower()}", sql.query(f"im as (select img_id, list({sql.FIRST} order by i) as d from raw group by img_id)", final=" union all ".join(map(_sql_decode, _codes))))(_decoded)

#: One code of every family by elements; the other queries of this part convert dense arrays.
_BY_ELEMENTS = {"cvt_color_elements": (["BGR2GRAY", "BGRA2RGB", "GRAY2RGBA"], _sql_plain), "cvt_color_elements_yuv": (["BGR2YUV", "YUV2RGB"], _sql_analog), "cvt_color_elements_encode": (["BGR2YUV_NV21", "RGB2YUV_I420", "BGR2YUV_YUY2", "RGB2YUV_YV24"], _sql_encode)}
for _name, (_codes, _made) in _BY_ELEMENTS.items():
    register(_name, sql.query(sql.px(4, 4, 4), _PIVOT, final=" union all ".join(map(_made, _codes))))(lambda spark, sf, codes=_codes: _tagged(spark, sf, codes, lambda c: _CHANNELS[c.split("2")[0]], lambda *a: elements(colour(*a))))
_SOME_LAYOUTS = ["YUV2BGR_NV12", "YUV2RGB_YV12", "YUV2BGR_UYVY", "YUV2RGB_NV42"]


@register("cvt_color_elements_decode", sql.query(f"im as (select img_id, list({sql.FIRST} order by i) as d from raw group by img_id)", final=" union all ".join(map(_sql_decode, _SOME_LAYOUTS))))
def cvt_color_elements_decode(spark, sf):
    parts = [color.cvt_color(elements(_planar(spark, sf, c.split("_")[1])), c).select(F.lit(c).alias("code"), "img_id", "y", "x", "c", "v") for c in _SOME_LAYOUTS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# -- stencils --------------------------------------------------------------

_BOX = sql.sat(f"cast({sql.SUM} as float) * cast(1.0/9 as float)")
_ONES = [[1.0] * 3] * 3


@register("box_threshold", sql.query(sql.px(), sql.stencil("px", _ONES, _BOX), final="select img_id, y, x, c, case when v > 127 then 255 else 0 end as v from out"))
def box_threshold(spark, sf):
    """Smoothed and thresholded fixture images."""
    smooth = stencils.box_filter(images(spark, sf), (3, 3), "8U")
    return out(elements(levels.threshold(smooth, 127, 255, "BINARY")))


for _mode in ("CONSTANT", "REPLICATE", "REFLECT", "REFLECT_101"):
    whole(f"box_filter_{_mode.lower()}", lambda p, m=_mode: stencils.box_filter(p, (3, 3), "8U", border=m), sql.query(sql.px(), sql.stencil("px", _ONES, _BOX, _mode), final=f"{sql.KEYED} out"))
whole("box_filter_sum", lambda p: stencils.box_filter(p, (2, 1), "8U", (1, 0), normalize=False), sql.query(sql.px(), sql.stencil("px", [[1.0, 1.0]], sql.sat(sql.SUM), anchor=(1, 0)), final=f"{sql.KEYED} out"))
whole("blur", lambda p: stencils.blur(p, (5, 3), "8U"), sql.query(sql.px(), sql.stencil("px", [[1.0] * 5] * 3, sql.sat(f"cast({sql.SUM} as float) * cast(1.0/15 as float)")), final=f"{sql.KEYED} out"))
_SHARP = [[0.0, -1.0, 0.0], [-1.0, 5.0, -1.0], [0.0, -1.0, 0.5]]
whole("filter2d", lambda p: stencils.filter2d(p, _SHARP, "8U", delta=3), sql.query(sql.px(), sql.stencil("px", _SHARP, sql.sat(f"{sql.SUM} + 3")), final=f"{sql.KEYED} out"))


def _two_pass(kx: list[float], ky: list[float], value: str) -> tuple[str, str]:
    return sql.stencil("px", [kx], f"cast({sql.SUM} as float)", name="mid"), sql.stencil("mid", [[k] for k in ky], value)


whole("sep_filter2d", lambda p: stencils.sep_filter2d(p, [0.25, 0.5, 0.25], [-1.0, 0.0, 2.0], "8U", delta=1), sql.query(sql.px(), *_two_pass([0.25, 0.5, 0.25], [-1.0, 0.0, 2.0], sql.sat(f"{sql.SUM} + 1")), final=f"{sql.KEYED} out"))
_GAUSS = stencils.gaussian_kernel(5, 1.1)
whole("gaussian_blur", lambda p: stencils.gaussian_blur(p, (5, 5), 1.1, "8U"), sql.query(sql.px(), *_two_pass(_GAUSS, _GAUSS, sql.sat(sql.SUM)), final=f"{sql.KEYED} out"))
for _dx, _k in ((1, 3), (0, 3), (1, 5), (0, 5)):
    _kernel = [[float(a * b) for a in ([-1, 0, 1] if _k == 3 else [-1, -2, 0, 2, 1])] for b in ([1, 2, 1] if _k == 3 else [1, 4, 6, 4, 1])]
    _kernel = _kernel if _dx else [list(r) for r in zip(*_kernel, strict=True)]
    whole(f"sobel_{'x' if _dx else 'y'}{_k}", lambda p, dx=_dx, k=_k: stencils.sobel(p, dx, 1 - dx, "16S", k, border="REPLICATE"), sql.query(sql.px(), sql.stencil("px", _kernel, f"cast({sql.SUM} as int)", "REPLICATE"), final=f"{sql.KEYED} out"))

_CROSS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
_CROSS_F = [[float(v) for v in r] for r in _CROSS]


def _morph(op: str, source: str, name: str, kernel=None, mode: str = "CONSTANT", value: int = 0) -> str:
    best = "min" if op == "e" else "max"
    return sql.stencil(source, kernel or _ONES, f"{best}(coalesce(s.s, {value}))", mode, name=name, skip_zero=True)


whole("erode", lambda p: stencils.erode(p, iterations=2), sql.query(sql.px(), _morph("e", "px", "o1", None, "REFLECT_101"), _morph("e", "o1", "o2", None, "REFLECT_101"), final=f"{sql.KEYED} o2"))
whole("dilate", lambda p: stencils.dilate(p, _CROSS, border="CONSTANT", value=40), sql.query(sql.px(), _morph("d", "px", "o1", _CROSS_F, "CONSTANT", 40), final=f"{sql.KEYED} o1"))
_EX = [_morph("e", "px", "er", _CROSS_F), _morph("d", "px", "di", _CROSS_F), _morph("d", "er", "op", _CROSS_F), _morph("e", "di", "cl", _CROSS_F)]
_MINUS = "select a.img_id, a.y, a.x, a.c, greatest(0, a.v - b.v) as v from {} a join {} b using (img_id, y, x, c)"
for _op, _final in {"ERODE": f"{sql.KEYED} er", "DILATE": f"{sql.KEYED} di", "OPEN": f"{sql.KEYED} op", "CLOSE": f"{sql.KEYED} cl", "GRADIENT": _MINUS.format("di", "er"), "TOPHAT": _MINUS.format("px", "op"), "BLACKHAT": _MINUS.format("cl", "px")}.items():
    whole(f"morphology_{_op.lower()}", lambda p, op=_op: stencils.morphology(p, op, _CROSS), sql.query(sql.px(), *_EX, final=_final))
_HIT = [[0.0, 1.0, 0.0], [-1.0, 1.0, 1.0], [0.0, -1.0, 0.0]]


@register("morphology_hitmiss", sql.query(sql.px(value=f"case when {sql.FIRST} > 128 then 255 else 0 end"), sql.stencil("px", _HIT, "case when bool_and(s.s is null or (t.k > 0) = (s.s <> 0)) then 255 else 0 end", "CONSTANT", skip_zero=True), final=f"{sql.KEYED} out"))
def hitmiss(spark, sf):
    p = levels.threshold(arrays.pixels(images(spark, sf), colocate=False), 128, 255, "BINARY")
    return out(stencils.morphology(p, "HITMISS", [[int(v) for v in r] for r in _HIT]))


_CANNY = [
    sql.px(), sql.stencil("px", [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]], f"cast({sql.SUM} as int)", "REPLICATE", name="gx"), sql.stencil("px", [[-1.0, -2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 2.0, 1.0]], f"cast({sql.SUM} as int)", "REPLICATE", name="gy"),
    "m as (select img_id, gx.y, gx.x, gx.v as gx, gy.v as gy, abs(gx.v) + abs(gy.v) as m, case when gx.v = 0 then (case when gy.v >= 0 then 1e308 else -1e308 end) else cast(gy.v as double) / gx.v end as tg from gx join gy using (img_id, y, x))",
    "d as (select *, case when abs(tg) < tan(pi()/8) then 0 when tg between tan(pi()/8) and tan(3*pi()/8) then 1 when tg between -tan(3*pi()/8) and -tan(pi()/8) then 2 else 3 end as sec from m)",
    "n as (select d.img_id, d.y, d.x, d.m, d.sec, coalesce(b.m, 0) as b, coalesce(c.m, 0) as c from d left join m b on b.img_id = d.img_id and b.y = d.y + (case sec when 0 then 0 when 1 then 1 when 2 then -1 else 1 end) and b.x = d.x + (case sec when 3 then 0 else 1 end) left join m c on c.img_id = d.img_id and c.y = d.y - (case sec when 0 then 0 when 1 then 1 when 2 then -1 else 1 end) and c.x = d.x - (case sec when 3 then 0 else 1 end))",
    "k as (select img_id, y, x, m from n where m > 15 and (m > b or (m = b and sec in (0, 3))) and m > c)",
    "e as (select img_id, y, x from k where m > 40 union select k.img_id, k.y, k.x from e join k on k.img_id = e.img_id and abs(k.y - e.y) <= 1 and abs(k.x - e.x) <= 1)",
]
whole("canny", lambda p: stencils.canny(p, 40, 15), sql.query(*_CANNY, final="select px.img_id, px.y, px.x, px.c, case when e.y is null then 0 else 255 end as v from px left join e on e.img_id = px.img_id and e.y = px.y and e.x = px.x"))

_CANNY_FINAL = "select px.img_id, px.y, px.x, px.c, case when e.y is null then 0 else 255 end as v from px left join e on e.img_id = px.img_id and e.y = px.y and e.x = px.x"


@register("canny_derivatives", sql.query(*_CANNY, final=_CANNY_FINAL))
def canny_derivatives(spark, sf):
    gx, gy = (arrays.pixels(stencils.sobel(images(spark, sf), 1 - k, k, "16S", border="REPLICATE"), colocate=False).withColumnRenamed("v", n) for k, n in ((0, "gx"), (1, "gy")))
    return out(stencils.canny_derivatives(gx.join(gy, arrays.KEY), 40, 15))


# -- geometry --------------------------------------------------------------

for _mode in ("CONSTANT", "REPLICATE", "REFLECT", "WRAP", "REFLECT_101"):
    whole(f"copy_make_border_{_mode.lower()}", lambda p, m=_mode: geometry.copy_make_border(p, 2, 1, 3, 0, m, "8U", 9), sql.query(sql.px(), sql.element(11, 11, "px", sql.border("yy.y-2", "sh", _mode), sql.border("xx.x-3", "sw", _mode), "9"), final=f"{sql.KEYED} out"))
whole("resize_nearest", lambda p: geometry.resize(p, "8U", (5, 13), interpolation="NEAREST"), sql.query(sql.px(), sql.element(13, 5, "px", "least(sh-1, yy.y*sh//13)", "least(sw-1, xx.x*sw//5)"), final=f"{sql.KEYED} out"))
_EXACT = "greatest(0, least({n}-1, ((({n}*65536 + {m}//2)//{m}) * {p} + (({n}*65536 + {m}//2)//{m})//2 - {n}%2) >> 16))"
whole("resize_nearest_exact", lambda p: geometry.resize(p, "8U", fx=0.6, fy=1.6, interpolation="NEAREST_EXACT"), sql.query(sql.px(), sql.element(13, 5, "px", _EXACT.format(n="sh", m=13, p="yy.y"), _EXACT.format(n="sw", m=5, p="xx.x")), final=f"{sql.KEYED} out"))
_AXIS = "select k as p, cast(least(7, greatest(0, floor(f))) as int) as a, cast(least(7, greatest(0, floor(f)) + 1) as int) as b, cast(f - cast(least(7, greatest(0, floor(f))) as float) as float) as w from (select k, cast(cast((cast(k as float) + 0.5::float) as float) * cast(8::float / {m}::float as float) as float) - 0.5::float as f from range({m}) r(k))"
_LERP = "cast({a} + cast(({b} - {a}) as float) * {t} as float)"
_TOP, _LOW = _LERP.format(a="cast(p.v as float)", b="cast(q.v as float)", t="xs.w"), _LERP.format(a="cast(r.v as float)", b="cast(s.v as float)", t="xs.w")
_LINEAR = [f"ys as ({_AXIS.format(m=13)})", f"xs as ({_AXIS.format(m=5)})", f"out as (select p.img_id, cast(ys.p as int) as y, cast(xs.p as int) as x, p.c, {sql.sat(_LERP.format(a=_TOP, b=_LOW, t='ys.w'))} as v from ys cross join xs join px p on p.y = ys.a and p.x = xs.a join px q on q.img_id = p.img_id and q.c = p.c and q.y = ys.a and q.x = xs.b join px r on r.img_id = p.img_id and r.c = p.c and r.y = ys.b and r.x = xs.a join px s on s.img_id = p.img_id and s.c = p.c and s.y = ys.b and s.x = xs.b)"]
whole("resize_linear", lambda p: geometry.resize(p, "8U", (5, 13)), sql.query(sql.px(), *_LINEAR, final=f"{sql.KEYED} out"))
_MAP = [[0.75, 0.25, 1.5], [-0.25, 0.875, 2.25]]
_UX, _UY = "(0.75::double*xx.x + 0.25::double*yy.y + 1.5::double)", "(-0.25::double*xx.x + 0.875::double*yy.y + 2.25::double)"
whole("warp_affine_nearest", lambda p: geometry.warp_affine(p, _MAP, "8U", interpolation="NEAREST", inverse_map=True, border="REPLICATE"), sql.query(sql.px(), sql.element(8, 8, "px", sql.border(f"cast(floor({_UY}+0.5) as int)", "sh", "REPLICATE"), sql.border(f"cast(floor({_UX}+0.5) as int)", "sw", "REPLICATE")), final=f"{sql.KEYED} out"))
_CORNER = "left join px {n} on {n}.img_id = g.img_id and {n}.c = g.c and {n}.y = g.y0 + {dy} and {n}.x = g.x0 + {dx}"
_WARP = f"""g as (select i.img_id, i.c, cast(yy.y as int) as y, cast(xx.x as int) as x, cast(floor({_UX}) as int) as x0, cast(floor({_UY}) as int) as y0, {_UX} - floor({_UX}) as fx, {_UY} - floor({_UY}) as fy from (select distinct img_id, c from px) i cross join range(8) yy(y) cross join range(8) xx(x)),
q as (select g.*, coalesce(a.v, 50)::double as a, coalesce(b.v, 50)::double as b, coalesce(d.v, 50)::double as d, coalesce(e.v, 50)::double as e from g {_CORNER.format(n="a", dy=0, dx=0)} {_CORNER.format(n="b", dy=0, dx=1)} {_CORNER.format(n="d", dy=1, dx=0)} {_CORNER.format(n="e", dy=1, dx=1)})"""
whole("warp_affine_linear", lambda p: geometry.warp_affine(p, _MAP, "8U", inverse_map=True, value=50), sql.query(sql.px(), _WARP, final=f"select img_id, y, x, c, {sql.sat('(a+(b-a)*fx) + ((d+(e-d)*fx) - (a+(b-a)*fx)) * fy')} as v from q"))


@register("image_pipeline", sql.query(sql.px(4, 4, 4, channels=3), sql.element(3, 6, "px", "least(sh-1, yy.y*sh//3)", "least(sw-1, xx.x*sw//6)"), "gr as (select img_id, y, x, (7471*max(case when c=0 then v end) + 38470*max(case when c=1 then v end) + 19595*max(case when c=2 then v end) + 32768) >> 16 as v from out group by 1, 2, 3)", final="select img_id, y, x, 0 as c, case when v > 96 then 255 else 0 end as v from gr"))
def image_pipeline(spark, sf):
    """Resize, gray and threshold in one plan."""
    three = images(spark, sf, 4, 4, 4).withColumns({"data": F.filter("data", lambda v, i: i % 4 < 3), "cn": F.lit(3)})
    small = geometry.resize(three, "8U", (6, 3), interpolation="NEAREST")
    return out(elements(levels.threshold(color.cvt_color(small, "BGR2GRAY"), 96, 255, "BINARY")))
