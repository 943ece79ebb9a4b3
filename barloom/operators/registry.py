"""The operators of factor expressions: how each is spelled, what it takes and how its column is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Along which axis an operator looks: 'elem' (the cell), 'ts' (the symbol's past) or 'cs' (the date's symbols).
AXES = ("elem", "ts", "cs")


@dataclass(frozen=True)
class Operator:
    """``build(ctx, *args)`` gets columns for series and plain values for literals, and returns a column."""

    name: str
    axis: str
    build: Callable
    min_args: int
    max_args: int
    window_arg: str | None = None
    group_arg: int | None = None
    doc: str = ""
    extra: dict = field(default_factory=dict)


_operators: dict[str, Operator] = {}


def register(name: str, build: Callable, min_args: int = 1, max_args: int | None = None, *, axis: str = "elem", window: bool = False, group: int | None = None, doc: str = "", **extra) -> Operator:
    """Add an operator, or replace one; expressions may use it at once."""
    if axis not in AXES:
        raise ValueError(f"axis must be one of {AXES}")
    if not name.isidentifier():
        raise ValueError(f"{name!r} can't be written in an expression")
    op = Operator(name, axis, build, min_args, min_args if max_args is None else max_args, "last" if window else None, group, doc or (build.__doc__ or "").strip(), extra)
    _operators[name] = op
    return op


def operator(name: str, min_args: int = 1, max_args: int | None = None, **kw) -> Callable:
    def add(build: Callable) -> Callable:
        register(name, build, min_args, max_args, **kw)
        return build

    return add


def unregister(name: str) -> None:
    _operators.pop(name, None)


def is_registered(name: str) -> bool:
    return name in _operators


def names() -> list[str]:
    return sorted(operator_schema())


def get(name: str) -> Operator:
    if name not in _operators:
        raise KeyError(f"unregistered operator {name!r}")
    return _operators[name]


def operator_schema() -> dict[str, dict]:
    return {o.name: {"axis": o.axis, "min_args": o.min_args, "max_args": o.max_args, "doc": o.doc, **o.extra} for o in sorted(_operators.values(), key=lambda o: o.name)}
