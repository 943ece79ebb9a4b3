"""SQL for whole catalogs of factors: every operator said a second time, as DuckDB's windows, one select a depth of the trees."""

from __future__ import annotations

from collections.abc import Mapping

from barloom.plans.compiler import lower
from barloom.plans.expression import Apply, Field, Literal, Node, node_hash, parse
from barloom.queries.operators import _w, full, lagged, rank, roll
from barloom.queries.panels import PANEL_SQL

_ROLL = {"ts_mean": "avg", "ts_sum": "sum", "ts_product": "product", "ts_std": "stddev_samp", "ts_var": "var_samp", "ts_min": "min", "ts_max": "max", "ts_med": "median"}
_COMPARE = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}


def _nn(e: str) -> str:
    return f"case when isnan({e}) then null else {e} end"


def _varies(x: str, d: int) -> str:
    return f"max({x}) over {_w(d)} > min({x}) over {_w(d)}"


def _sql(op: str, a: list) -> str:
    """One operator over columns and numbers."""
    x = a[0]
    y = a[1] if len(a) > 1 else None
    days = lambda v: int(float(v))
    if op in ("add", "sub", "mul"):
        return _nn(f"({x} {dict(add='+', sub='-', mul='*')[op]} {y})")
    if op == "div":
        return f"case when {y} = 0 then case when {x} > 0 then 'inf'::double when {x} < 0 then '-inf'::double end else {_nn(f'({x} / nullif({y}, 0))')} end"
    if op in _COMPARE:
        return f"({x} {_COMPARE[op]} {y})::int::double"
    if op in ("or", "and"):
        return f"case when {x} is null and {y} is null then null else (coalesce({x} <> 0, false) {op} coalesce({y} <> 0, false))::int::double end"
    if op in _ROLL:
        return roll(_ROLL[op], x, days(y))
    simple = {
        "neg": "-{x}", "not": "({x} = 0)::int::double", "abs": "abs({x})", "log": "case when {x} > 0 then ln(case when {x} > 0 then {x} end) end", "sign": "sign({x})::double", "sqrt": "case when {x} >= 0 then sqrt(case when {x} >= 0 then {x} end) end",
        "pow": "pow({x}, {y})", "elem_min": "case when {x} is not null and {y} is not null then least({x}, {y}) end", "elem_max": "case when {x} is not null and {y} is not null then greatest({x}, {y}) end",
        "signed_power": "sign({x}) * pow(abs({x}), {y})", "cs_demean": "{x} - avg({x}) over (partition by date)", "cs_neutralize": "{x} - avg({x}) over (partition by date, {y})",
    }
    if op in simple:
        return simple[op].format(x=x, y=y)
    if op == "where":
        return f"case when {x} is null then null when {x} <> 0 then {y} else {a[2]} end"
    if op == "cs_rank":
        return rank(x)
    if op == "cs_scale":
        return f"{float(y) if y else 1.0} * {x} / nullif(sum(abs({x})) over (partition by date), 0)"
    if op == "ts_delay":
        return lagged(x, days(y)) if days(y) else x
    if op == "ts_delta":
        return f"{x} - {lagged(x, days(y))}"
    if op == "ts_returns":
        return f"{x} / nullif({lagged(x, days(y))}, 0) - 1"
    if op == "ts_decay_linear":
        d = days(y)
        return "(" + " + ".join(f"{d - k} * {lagged(x, k) if k else x}" for k in range(d)) + f") / {d * (d + 1) / 2}"
    if op in ("ts_argmax", "ts_argmin"):
        d = days(y)
        return full(f"({d} - list_position(list({x}) over {_w(d)}, {op[6:]}({x}) over {_w(d)}))::double", d, x)
    if op == "ts_rank":
        d = days(y)
        return full(f"(len(list_filter(list({x}) over {_w(d)}, lambda z: z <= {x})) - 1) / {d - 1}::double", d, x)
    if op == "ts_quantile":
        return full(f"quantile_cont({x}, {float(a[2])}) over {_w(days(y))}", days(y), x)
    if op in ("ts_cov", "ts_corr"):
        d = days(a[2])
        cov = f"covar_samp({x}, {y}) over {_w(d)}"
        both = [f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"]
        if op == "ts_corr":
            cov = f"case when {_varies(both[0], d)} and {_varies(both[1], d)} then {cov} / nullif(stddev_samp({both[0]}) over {_w(d)} * stddev_samp({both[1]}) over {_w(d)}, 0) end"
        return full(cov, d, *both)
    d = days(y)
    slope = f"regr_slope({x}, bar_no) over {_w(d)}"
    if op == "ts_slope":
        return full(slope, d, x)
    if op == "ts_resi":
        return full(f"{x} - (avg({x}) over {_w(d)} + {slope} * {(d - 1) / 2})", d, x)
    if op == "ts_rsquare":
        return full(f"case when {_varies(x, d)} then regr_r2({x}, bar_no) over {_w(d)} end", d, x)
    raise KeyError(op)


def catalog_sql(factors: Mapping[str, str], summary: str, panel: str = PANEL_SQL) -> str:
    """``summary`` over ``v`` (factor_id, symbol, date, v) of the named expressions over the dense panel ``p`` that ``panel`` defines."""
    roots = {name: lower(parse(e)) for name, e in factors.items()}
    depth: dict[str, int] = {}
    nodes: dict[str, Node] = {}

    def look(n: Node) -> int:
        h = node_hash(n)
        if h not in depth:
            nodes[h] = n
            depth[h] = 1 + max(map(look, n.args)) if isinstance(n, Apply) else 0
        return depth[h]

    for r in roots.values():
        look(r)

    def arg(n: Node):
        if isinstance(n, Field):
            return n.name
        if isinstance(n, Literal):
            return n.value if isinstance(n.value, str) else f"{float(n.value)!r}"
        return f"c_{node_hash(n)}"

    parts = ["s0 as (select * from p)"]
    for level in range(1, max(depth.values()) + 1):
        cols = ", ".join(f"({_sql(n.op, [arg(x) for x in n.args])})::double as c_{h}" for h, n in nodes.items() if depth[h] == level)
        parts.append(f"s{level} as materialized (select *, {cols} from s{level - 1})")
    last = f"s{max(depth.values())}"
    names = ", ".join(f"'{k}'" for k in roots)
    values = ", ".join(arg(r) for r in roots.values())
    return f"with {panel}, {', '.join(parts)}, v as (select symbol, date, unnest([{names}]) as factor_id, unnest([{values}]) as v from {last}) {summary}"
