"""From expression trees to one staged DataFrame.

All expressions of a batch become one tree of distinct subtrees, each computed once. Operators along time need
rows clustered by symbol, operators across symbols rows clustered by date, and each change between the two is a
shuffle. So the compiler stays on one axis as long as anything there is ready, and only then changes. All
windows of a pass share one exchange; columns nobody needs any more are dropped before the next one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import builtin, registry  # noqa: F401  (registers the operators)
from barloom.plans.expression import Apply, Field, Literal, Node, node_hash, parse
from barloom.plans.panel import densify
from barloom.runtime import broadcast_if_small

KEYS = ("symbol", "date", "bar_no")


def lower(node: Node) -> Node:
    """Composite operators in terms of simple ones."""
    if not isinstance(node, Apply):
        return node
    args = tuple(lower(a) for a in node.args)
    if node.op == "ts_ema":
        return Apply("fill_forward", (Apply("ema_here", args),))
    if node.op == "ts_dema":
        once = lower(Apply("ts_ema", args))
        return Apply("sub", (Apply("mul", (Literal(2), once)), lower(Apply("ts_ema", (once, args[1])))))
    if node.op == "fillna":
        method = args[1] if len(args) > 1 else Literal("zero")
        name = method.name if isinstance(method, Field) else method.value
        if name not in ("zero", "median", "ffill"):
            raise ValueError(f"fillna knows zero, median and ffill, not {name!r}")
        return Apply({"zero": "fill_zero", "median": "fill_median", "ffill": "fill_forward"}[name], args[:1])
    return Apply(node.op, args)


class Context:
    """What operators see while their columns are built."""

    def __init__(self, groups: Mapping[str, str]):
        self.by_symbol = Window.partitionBy("symbol").orderBy("date")
        self.bar_no = F.col("bar_no")
        self.groups = groups
        self.helpers: list[dict[str, Column]] = []
        self.names: dict = {}

    def window(self, key, make, level: int = 0) -> Column:
        """A helper column; one of a higher ``level`` may use those of lower ones."""
        if key not in self.names:
            self.names[key] = f"w_{len(self.names)}"
            while len(self.helpers) <= level:
                self.helpers.append({})
            self.helpers[level][self.names[key]] = make()
        return F.col(self.names[key])

    def group(self, name: str) -> str:
        if name not in self.groups:
            raise KeyError(f"no group data for {name!r}")
        return self.groups[name]


class Plan:
    """A compiled batch: ``frame`` holds symbol, date and one column per factor; ``switches`` counts the exchanges between axes."""

    def __init__(self, frame: DataFrame, names: list[str], switches: int, nodes: int):
        self.frame, self.names, self.switches, self.nodes = frame, names, switches, nodes


def compile_factors(panel: DataFrame, factors: Mapping[str, str | Node], groups: DataFrame | None = None, *, order: str | None = None, dense: bool = False, keep: tuple[str, ...] = ()) -> Plan:
    """Compile named expressions over a (date, symbol, fields...) panel into one plan.

    ``groups``: (symbol, label columns) for operators with a group; a symbol without a label raises when the plan is compiled. ``keep`` names fields
    to carry along. ``dense`` says that the panel is a :func:`densify` result already. Unknown fields and groups raise ``KeyError``.
    """
    roots = {name: lower(parse(e) if isinstance(e, str) else e) for name, e in factors.items()}
    nodes: dict[str, Node] = {}

    def collect(n: Node):
        h = node_hash(n)
        if h not in nodes:
            for a in getattr(n, "args", ()):
                collect(a)
            nodes[h] = n

    for r in roots.values():
        collect(r)
    fields = sorted({n.name for n in nodes.values() if isinstance(n, Field)} | set(keep))
    missing = [f for f in fields if f not in panel.columns]
    if missing:
        raise KeyError(f"the panel has no field {', '.join(missing)}")
    frame = panel.select(*KEYS, *fields) if dense else densify(panel, fields, order)
    labels = sorted({n.args[g].value for n in nodes.values() if isinstance(n, Apply) and (g := registry.get(n.op).group_arg) is not None and len(n.args) > g})
    named = {g: f"_group_{g}" for g in labels}
    if labels:
        if groups is None or any(g not in groups.columns for g in labels):
            raise KeyError(f"no group data for {', '.join(g for g in labels if groups is None or g not in groups.columns)}")
        own = groups.where("symbol is not null").groupBy("symbol").agg(*[F.max(g).alias(named[g]) for g in labels])
        unlabelled = panel.select("symbol").where("symbol is not null").distinct().join(own.dropna(), "symbol", "left_anti").limit(1).collect()
        if unlabelled:
            raise ValueError(f"no group label for {unlabelled[0].symbol!r}")
        frame = frame.join(broadcast_if_small(own), "symbol")

    def arg(n: Node):
        return n.value if isinstance(n, Literal) else F.col(n.name if isinstance(n, Field) else f"n_{node_hash(n)}")

    pending = {h: n for h, n in nodes.items() if isinstance(n, Apply)}
    done: set[str] = {h for h in nodes if h not in pending}
    ready = lambda axis: {h: n for h, n in pending.items() if registry.get(n.op).axis == axis and all(node_hash(a) in done for a in n.args)}
    clustered, switches = None, 0
    n_tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def live() -> list[str]:
        used = {node_hash(a) for n in pending.values() for a in n.args} | {node_hash(r) for r in roots.values()}
        cols = [f"n_{h}" for h in used if h in done and isinstance(nodes[h], Apply)]
        flds = {nodes[h].name for h in used if h in done and isinstance(nodes[h], Field)} | set(keep)
        return [*KEYS, *sorted(flds), *named.values(), *sorted(cols)]

    def finish(found: dict[str, Node]):
        for h in found:
            done.add(h)
            del pending[h]

    while pending:
        if simple := ready("elem"):
            ctx = Context(named)
            frame = frame.withColumns({f"n_{h}": registry.get(n.op).build(ctx, *map(arg, n.args)).cast("double") for h, n in simple.items()})
            finish(simple)
            continue
        axis = clustered if clustered and ready(clustered) else ("ts" if ready("ts") else "cs")
        if axis != clustered:
            # The number is named so that small but costly windows keep their parallelism; it is the cluster's own setting.
            frame = frame.select(*live()).repartition(n_tasks, "symbol" if axis == "ts" else "date")
            clustered, switches = axis, switches + 1
        work, ctx = ready(axis), Context(named)
        built = {f"n_{h}": registry.get(n.op).build(ctx, *map(arg, n.args)).cast("double") for h, n in work.items()}
        for helpers in ctx.helpers:
            frame = frame.withColumns(helpers) if helpers else frame
        frame = frame.withColumns(built)
        finish(work)
        frame = frame.select(*live())
    out = {name: (F.lit(float(r.value)) if isinstance(r, Literal) else arg(r)) for name, r in roots.items()}
    return Plan(frame.select("symbol", "date", *[k for k in keep if k not in out], *[c.alias(name) for name, c in out.items()]), list(roots), switches, len(nodes))


def evaluate(panel: DataFrame, expression: str | Node, groups: DataFrame | None = None, **kw) -> DataFrame:
    """(symbol, date, factor): one factor on every cell of the grid, null where it is missing."""
    return compile_factors(panel, {"factor": expression}, groups, **kw).frame


def evaluate_long(panel: DataFrame, factors: Mapping[str, str], groups: DataFrame | None = None, **kw) -> DataFrame:
    """(factor_id, symbol, date, value): a batch of factors, computed in one plan with shared subtrees."""
    plan = compile_factors(panel, factors, groups, **kw)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("factor_id"), F.col(n).alias("value")) for n in plan.names])).alias("_f")
    return plan.frame.select("symbol", "date", stacked).select(F.col("_f.factor_id").alias("factor_id"), "symbol", "date", F.col("_f.value").alias("value"))
