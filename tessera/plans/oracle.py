"""DuckDB SQL for the registered queries, written from the operators' definitions.

It shares parameters with the queries and nothing else.
"""

from __future__ import annotations

#: One row an element of an embedding.
RAW = "raw as (select vec_id as img_id, unnest(range(64)) as i, unnest(embedding) as e, unnest(list_reverse(embedding)) as g from embeddings)"


def sat(v: str, low: int = 0, high: int = 255) -> str:
    return f"cast(least({high}, greatest({low}, round(cast({v} as double)))) as int)"


FIRST, SECOND = sat("(cast(e as double)+1)*127.5"), sat("cast(e as double)*600+128")


def px(h: int = 8, w: int = 8, cn: int = 1, name: str = "px", value: str = FIRST, channels: int | None = None) -> str:
    """Elements as a table expression."""
    kept = "" if channels is None else f" where i % {cn} < {channels}"
    return f"{name} as (select img_id, {h} as h, {w} as w, cast(i // {w * cn} as int) as y, cast(i % {w * cn} // {cn} as int) as x, cast(i % {cn} as int) as c, {value} as v from raw{kept})"


def border(p: str, n: str, mode: str) -> str:
    """A source coordinate."""
    return {
        "CONSTANT": f"(case when ({p}) between 0 and ({n})-1 then ({p}) end)",
        "REPLICATE": f"greatest(0, least(({n})-1, ({p})))",
        "WRAP": f"((({p}) % ({n})) + ({n})) % ({n})",
        "REFLECT": f"(case when (((({p}) % (2*({n}))) + 2*({n})) % (2*({n}))) < ({n}) then (((({p}) % (2*({n}))) + 2*({n})) % (2*({n}))) else 2*({n})-1-(((({p}) % (2*({n}))) + 2*({n})) % (2*({n}))) end)",
        "REFLECT_101": f"(({n})-1-abs((((({p}) % (2*(({n})-1))) + 2*(({n})-1)) % (2*(({n})-1)))-(({n})-1)))",
    }[mode]


def stencil(source: str, kernel: list[list[float]], value: str, mode: str = "REFLECT_101", anchor: tuple[int, int] | None = None, name: str = "out", skip_zero: bool = False) -> str:
    """``name as (...)``: *value* aggregates ``s`` (null outside) and ``k`` (the weight) for each element of *source*."""
    ay, ax = (len(kernel) // 2, len(kernel[0]) // 2) if anchor is None else anchor[::-1]
    taps = ", ".join(f"({y - ay}, {x - ax}, {float(k)!r}::double)" for y, row in enumerate(kernel) for x, k in enumerate(row) if k or not skip_zero)
    return f"""{name} as (select t.img_id, t.h, t.w, t.y, t.x, t.c, {value} as v from
      (select p.*, k.k, {border("p.y+k.dy", "p.h", mode)} as sy, {border("p.x+k.dx", "p.w", mode)} as sx from {source} p cross join (values {taps}) k(dy, dx, k)) t
      left join (select img_id, y, x, c, v as s from {source}) s on s.img_id = t.img_id and s.c = t.c and s.y = t.sy and s.x = t.sx
      group by t.img_id, t.h, t.w, t.y, t.x, t.c)"""


def query(*tables: str, final: str) -> str:
    return f"with recursive {', '.join([RAW, *tables])} {final}"


KEYED = "select img_id, y, x, c, v from "
SUM = "sum(t.k * coalesce(s.s, 0))"


def element(h: int, w: int, source: str, sy: str, sx: str, constant: str | None = None, name: str = "out", value: str | None = None) -> str:
    """A new grid whose places read one source place."""
    got = f"coalesce(s.v, {constant})" if constant is not None else "s.v"
    return f"""{name} as (select g.img_id, {h} as h, {w} as w, g.y, g.x, g.c, {value or got} as v from
      (select i.img_id, i.c, cast(yy.y as int) as y, cast(xx.x as int) as x, {sy} as sy, {sx} as sx from (select distinct img_id, c, h as sh, w as sw from {source}) i
        cross join range({h}) yy(y) cross join range({w}) xx(x)) g
      left join {source} s on s.img_id = g.img_id and s.c = g.c and s.y = g.sy and s.x = g.sx)"""
