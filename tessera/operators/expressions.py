"""Array expressions over dense arrays, folded into one array program.

An :class:`Expression` is a tree of operations over columns of dense arrays.  Equal parts of a tree, or of
several trees evaluated together, are worked out once; products with numbers stay open, so that
``a * 2 + b * 3`` is one weighted sum that saturates once.  Arrays of different frames meet by ``img_id``
alone, one row an image; columns of one frame need no join.  The rules are those of
:class:`~tessera.operators.tensor.Tensor`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.depths import BYTES, INTEGRAL, STORAGE, TensorError, check_depth, lanes
from ..functions.elementwise import ALIASES, COMPARISONS, INTEGER_ONLY
from . import blocks

_KINDS = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}


def _wrapped(v: np.ndarray, depth: str) -> np.ndarray:
    """Whole numbers of 64 bits as elements of 32 bits, modulo 2^32."""
    return v.astype(np.int32) if depth == "32S" else v & np.int64((1 << 32) - 1)


def saturated(v: np.ndarray, depth: str) -> np.ndarray:
    """Numbers as elements of *depth*: narrow integers clip, 32-bit ones wrap; what is not a number becomes 0."""
    if depth not in ("32S", "32U"):
        return blocks.saturated(v, depth)
    if v.dtype.kind in "iu":
        return _wrapped(v.astype(np.int64), depth)
    whole = np.mod(blocks.rounded(np.where(np.isfinite(v), v, 0.0)), 4294967296.0)
    return _wrapped(whole.astype(np.int64), depth)


def _quotient(a: np.ndarray, b: np.ndarray, depth: str) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    made = x / np.where(y == 0, 1.0, y)
    if depth in INTEGRAL:
        return np.where(y == 0, 0.0, np.trunc(made))
    zero = 0.0 if depth == "16F" else np.where((x == 0) | np.isnan(x), np.nan, np.where(x > 0, np.inf, -np.inf))
    return np.where(y == 0, zero, made)


def _shifted(a: np.ndarray, b: np.ndarray, depth: str) -> np.ndarray:
    width = 8 * BYTES[depth]
    mask = np.int64((1 << width) - 1)
    bits, n = a.astype(np.int64) & mask, np.minimum(np.abs(b.astype(np.int64)), width)
    kept = np.where(n >= width, 0, np.where(b >= 0, bits << n, bits >> n)) & mask
    return np.where(kept >= 1 << (width - 1), kept - (1 << width), kept) if depth in ("8S", "16S", "32S") else kept


def binary(op: str, a: np.ndarray, b: np.ndarray, depth: str) -> np.ndarray:
    """An element-wise operation on two arrays of *depth*; comparisons give 8U masks."""
    op = ALIASES.get(op, op)
    if op in COMPARISONS:
        test = {"EQ": np.equal, "GT": np.greater, "GE": np.greater_equal, "LT": np.less, "LE": np.less_equal, "NE": np.not_equal}[op]
        return np.where(test(a.astype(np.float64), b.astype(np.float64)), 255, 0).astype(np.int32)
    if op in INTEGER_ONLY and depth not in INTEGRAL:
        raise TensorError(f"{op} takes integers, not {depth}")
    kind = np.float64 if depth not in INTEGRAL else np.int32 if depth in ("8U", "8S") else np.int64
    i, j = a.astype(kind), b.astype(kind)
    if op in ("ADD", "SUB", "MUL", "AND", "OR", "XOR", "NOT"):
        made = {"ADD": np.add, "SUB": np.subtract, "MUL": np.multiply, "AND": np.bitwise_and, "OR": np.bitwise_or, "XOR": np.bitwise_xor, "NOT": lambda p, q: p & ~q}[op](i, j)
    elif op in ("MOD", "FMOD"):
        made = np.where(j == 0, 0, (np.mod if op == "MOD" else np.fmod)(i, np.where(j == 0, 1, j)))
    elif op == "DIV":
        made = _quotient(a, b, depth)
    elif op == "BITSHIFT":
        made = _shifted(a, b, depth)
    else:
        x, y = a.astype(np.float64), b.astype(np.float64)
        extreme = lambda f: np.where(np.isnan(x) | np.isnan(y), x, f(x, y))
        known = {"POW": lambda: np.power(x, y), "MAX": lambda: extreme(np.maximum), "MIN": lambda: extreme(np.minimum), "ATAN2": lambda: np.arctan2(x, y), "HYPOT": lambda: np.hypot(x, y), "MEAN": lambda: (x + y) * 0.5}
        if op not in known:
            raise TensorError(f"unknown operation {op!r}")
        made = known[op]()
    return saturated(made, depth)


@dataclass(frozen=True)
class Node:
    """A part of a tree: a source, the lanes of a scalar, or an operation on other parts."""

    op: str
    parts: tuple[Node, ...] = ()
    given: tuple = ()

    def value(self, known: dict[Node, np.ndarray]) -> np.ndarray:
        if self not in known:
            known[self] = self._made([p.value(known) for p in self.parts])
        return known[self]

    def _made(self, parts: list[np.ndarray]) -> np.ndarray:
        if self.op == "lanes":
            return np.array(self.given)
        if self.op == "scaled":
            return saturated(parts[0].astype(np.float64) * self.given[0], self.given[1])
        if self.op == "blend":
            return saturated(parts[0].astype(np.float64) * self.given[0] + parts[1].astype(np.float64) * self.given[1], self.given[2])
        return binary(self.op, parts[0], parts[1], self.given[0])


class Expression:
    """A tree over dense arrays of one depth, times an open factor."""

    def __init__(self, frame: DataFrame | None, depth: str, channels: int = 1, column: str = "data", node: Node | None = None, frames: dict | None = None, factor: float = 1.0):
        self.depth, self.channels, self.factor = check_depth(depth), channels, factor
        self.frames = frames or {(id(frame), column): frame}
        self.node = node or Node("source", given=(id(frame), column))

    @property
    def settled(self) -> Node:
        return self.node if self.factor == 1.0 else Node("scaled", (self.node,), (self.factor, self.depth))

    def _like(self, node: Node, other=None, depth: str | None = None, factor: float = 1.0) -> Expression:
        frames = self.frames | (other.frames if isinstance(other, Expression) else {})
        return Expression(None, depth or self.depth, self.channels, node=node, frames=frames, factor=factor)

    def _other(self, other) -> Node:
        if not isinstance(other, Expression):
            return Node("lanes", given=tuple(lanes(other, self.channels, self.depth)))
        if (other.depth, other.channels) != (self.depth, self.channels):
            raise TensorError(f"{self.depth} C{self.channels} and {other.depth} C{other.channels} differ")
        return other.settled

    def apply(self, op: str, other, turned: bool = False) -> Expression:
        """An operation of :mod:`tessera.functions.elementwise` by name; *turned* puts *other* first."""
        sides = (self.settled, self._other(other))
        mask = ALIASES.get(op, op) in COMPARISONS
        return self._like(Node(op, sides[::-1] if turned else sides, (self.depth,)), other, "8U" if mask else None)

    def _sum(self, other, sign: int) -> Expression:
        if isinstance(other, Expression) and (self.factor, other.factor) != (1.0, 1.0):
            self._other(other)
            return self._like(Node("blend", (self.node, other.node), (self.factor, sign * other.factor, self.depth)), other)
        return self.apply("ADD" if sign > 0 else "SUB", other)

    def __mul__(self, other) -> Expression:
        return self._like(self.node, factor=self.factor * other) if isinstance(other, (int, float)) else self.apply("MUL", other)

    __add__ = __radd__ = lambda self, other: self._sum(other, 1)
    __sub__ = lambda self, other: self._sum(other, -1)
    __rsub__ = lambda self, other: self.apply("SUB", other, turned=True)
    __neg__ = lambda self: self._like(self.node, factor=-self.factor)
    __rmul__ = __mul__
    __truediv__ = lambda self, other: self.apply("DIV", other)
    __rtruediv__ = lambda self, other: self.apply("DIV", other, turned=True)
    __eq__ = lambda self, other: self.apply("EQ", other)
    __ne__ = lambda self, other: self.apply("NE", other)
    __lt__ = lambda self, other: self.apply("LT", other)
    __le__ = lambda self, other: self.apply("LE", other)
    __gt__ = lambda self, other: self.apply("GT", other)
    __ge__ = lambda self, other: self.apply("GE", other)
    __hash__ = None

    def frame(self) -> DataFrame:
        """The result as dense arrays."""
        return evaluate({"data": self})


def _met(frames: dict) -> tuple[DataFrame, dict[tuple, str]]:
    """One row an image with all sources' columns, and the name of each source's."""
    by_frame: dict[int, list[str]] = {}
    for at, column in frames:
        by_frame.setdefault(at, []).append(column)
    out, names = None, {}
    for n, (at, columns) in enumerate(by_frame.items()):
        frame = next(f for (k, _), f in frames.items() if k == at)
        names |= {(at, c): f"s{n}_{k}" for k, c in enumerate(columns)}
        sizes = [F.col(c).cast("int").alias(c if out is None else f"{c}{n}") for c in ("h", "w", "cn")]
        part = frame.select("img_id", *sizes, *[F.col(c).alias(names[at, c]) for c in columns])
        if out is not None:
            same = F.concat(*[F.when(F.col(c) != F.col(f"{c}{n}"), F.raise_error("arrays of one expression differ in shape").cast("string")).otherwise("") for c in ("h", "w", "cn")])
            part = out.join(part, "img_id").filter(same == "").drop(*[f"{c}{n}" for c in ("h", "w", "cn")])
        out = part
    return out, names


def evaluate(made: dict[str, Expression], elements: bool = False) -> DataFrame:
    """Several expressions in one pass: dense arrays with a column a name, or one row an element."""
    import pyarrow as pa

    frames: dict = {}
    for e in made.values():
        frames |= e.frames
    joined, names = _met(frames)
    order = [names[k] for k in frames]
    sources = {Node("source", given=k): 4 + order.index(names[k]) for k in frames}
    trees = {n: (e.settled, _KINDS[STORAGE[e.depth]]) for n, e in made.items()}
    joined = joined.select("img_id", "h", "w", "cn", *order)

    def run(batches):
        for batch in batches:
            shapes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], axis=1) if len(batch) else np.zeros((0, 3), np.int64)
            for first, last in blocks._stacks(shapes):
                n, (h, w, cn) = last - first, map(int, shapes[first])
                known = {s: blocks._numbers(batch.column(k).slice(first, n)).reshape(n, h, w, cn) for s, k in sources.items()}
                with np.errstate(all="ignore"):
                    found = [np.broadcast_to(t.value(known), (n, h, w, cn)).astype(kind) for t, kind in trees.values()]
                if elements:
                    ids = np.repeat(np.asarray(batch.column(0).slice(first, n)), h * w * cn)
                    places = [np.broadcast_to(p, (n, h, w, cn)).ravel().astype(np.int32) for p in np.indices((h, w, cn))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *places, *(f.ravel() for f in found))], ["img_id", "y", "x", "c", *trees])
                else:
                    sizes = [pa.array(np.full(n, v, np.int32)) for v in (h, w, cn)]
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w * cn)), pa.array(f.ravel())) for f in found]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *sizes, *lists], ["img_id", "h", "w", "cn", *trees])

    each = ", ".join(f"{n} {STORAGE[e.depth] if elements else f'array<{STORAGE[e.depth]}>'}" for n, e in made.items())
    return joined.mapInArrow(run, f"img_id bigint, {'y int, x int, c int' if elements else 'h int, w int, cn int'}, {each}")


