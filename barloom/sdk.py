"""One door to the engine: a session over a panel that checks, evaluates, scores, combines and backtests factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.evaluation import metrics as M
from barloom.evaluation.combine import Splits, combine
from barloom.library.analysis import factor_id
from barloom.library.catalogs import unique_names
from barloom.library.sharing import batches
from barloom.operators import registry
from barloom.plans.compiler import compile_factors, lower
from barloom.plans.expression import Apply, ExpressionError, Field, Literal, fields_of, node_hash, parse, walk
from barloom.plans.panel import densify, panel_dates
from barloom.portfolio import accounting, construction
from barloom.portfolio.metrics import compute_metrics
from barloom.runtime import stage

#: Rules on expressions (fixed values): P while parsing, E when they meet the data.
RULES = {
    "EMPTY_EXPRESSION": "P001", "UNEXPECTED_CHARACTER": "P002", "UNEXPECTED_TOKEN": "P003", "UNEXPECTED_EOF": "P004", "TRAILING_TOKENS": "P005", "UNKNOWN_OPERATOR": "P006",
    "OPERATOR_ARITY": "P007", "INVALID_ARGUMENT": "P008", "INVALID_WINDOW": "P009", "EXPRESSION_TOO_DEEP": "P010", "CONSTANT_EXPRESSION": "P011", "BARE_FIELD": "P012",
    "UNKNOWN_FIELD": "E001", "UNREGISTERED_OPERATOR": "E002", "INVALID_OPERATOR_PARAM": "E004", "MISSING_GROUP_DATA": "E005", "NO_DATA": "E006", "LOOKAHEAD_SHIFT": "E007", "INTERNAL_ERROR": "E099",
}
#: The smallest windows of operators that need more than one bar.
LEAST_WINDOW = {"ts_delay": 0, "ts_delta": 0, "ts_returns": 0, "ts_log_returns": 0, "ts_std": 2, "ts_var": 2, "ts_rank": 2, "ts_cov": 2, "ts_slope": 2, "ts_resi": 2, "ts_rsquare": 2}


@dataclass(frozen=True)
class Finding:
    code: str
    name: str
    message: str
    span: tuple[int, int] | None = None


def _finding(name: str, message: str, span=None) -> Finding:
    return Finding(RULES[name], name, message, span)


def diagnose(expression: str, fields: Sequence[str] | None = None, groups: Sequence[str] = ()) -> list[Finding]:
    """What is wrong with an expression, without running it; never raises. ``fields`` None skips the check of names."""
    try:
        tree = parse(expression)
    except ExpressionError as e:
        return [_finding(e.code, e.message, e.span)]
    except Exception as e:  # noqa: BLE001
        return [_finding("INTERNAL_ERROR", repr(e))]
    out = []
    if isinstance(tree, Field):
        out.append(_finding("BARE_FIELD", f"{tree.name} alone is no factor"))
    elif not fields_of(tree):
        out.append(_finding("CONSTANT_EXPRESSION", "no field in the expression"))
    for f in sorted(fields_of(tree) - set(fields)) if fields is not None else ():
        out.append(_finding("UNKNOWN_FIELD", f"the panel has no field {f}"))
    for n in walk(tree):
        if not isinstance(n, Apply):
            continue
        spec = registry.get(n.op)
        if spec.window_arg == "last" or n.op == "ts_quantile":
            d = n.args[1 if n.op == "ts_quantile" else -1]
            least = LEAST_WINDOW.get(n.op, 1)
            if isinstance(d, Literal) and not isinstance(d.value, str):
                if d.value < 0:
                    out.append(_finding("LOOKAHEAD_SHIFT", f"{n.op} with {d.value} looks into the future"))
                elif d.value < least:
                    out.append(_finding("INVALID_OPERATOR_PARAM", f"{n.op} needs a window of at least {least}"))
        if n.op == "cs_winsorize" and not (isinstance(n.args[1], Literal) and 0 < n.args[1].value < 0.5):
            out.append(_finding("INVALID_OPERATOR_PARAM", "cs_winsorize needs a tail between 0 and 0.5"))
        if spec.group_arg is not None and len(n.args) > spec.group_arg and n.args[spec.group_arg].value not in groups:
            out.append(_finding("MISSING_GROUP_DATA", f"no labels for {n.args[spec.group_arg].value}"))
    try:
        lower(tree)
    except ValueError as e:
        out.append(_finding("INVALID_OPERATOR_PARAM", str(e)))
    return out


class Session:
    """Factors over one panel. The dense panel and its forward returns are written once and read by everything after."""

    def __init__(self, panel: DataFrame, groups: DataFrame | None = None, *, horizons: Sequence[int] = (1, 5, 10, 20), execution: str = "next_open", order: str | None = None):
        self.spark, self.groups, self.horizons = panel.sparkSession, groups, tuple(sorted(set(horizons)))
        self.fields = [c for c in panel.columns if c not in ("symbol", "date", order) and dict(panel.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        self.dense = stage(densify(panel, self.fields, order), "session")
        self.labels = [c for c in groups.columns if c != "symbol"] if groups is not None else []
        self.execution = execution

    def diagnose(self, expression: str) -> list[Finding]:
        return diagnose(expression, self.fields, self.labels)

    def _checked(self, specs) -> tuple[dict[str, str], dict[str, list[Finding]]]:
        named = unique_names(specs)
        found = {k: [f for f in self.diagnose(e) if f.name != "BARE_FIELD"] for k, e in named.items()}
        return {k: e for k, e in named.items() if not found[k]}, {k: f for k, f in found.items() if f}

    def evaluate(self, expression: str) -> DataFrame:
        """(symbol, date, factor) on every cell of the grid."""
        return compile_factors(self.dense, {"factor": expression}, self.groups, dense=True).frame

    def factor_series(self, expression: str, symbols: Sequence[str]) -> DataFrame:
        """(symbol, date, factor) of some symbols. If the expression looks along time only, just their bars are read."""
        wanted = [s.strip().upper() for s in symbols]
        here = F.upper(F.trim("symbol")).isin(wanted)
        alone = not any(isinstance(n, Apply) and registry.get(n.op).axis == "cs" for n in walk(lower(parse(expression))))
        frame = compile_factors(self.dense.where(here) if alone else self.dense, {"factor": expression}, self.groups, dense=True).frame
        return frame if alone else frame.where(here)

    def factors(self, specs) -> DataFrame:
        """(factor_id, symbol, date, value, fwd_h...) of a batch, one plan for each group of related factors."""
        good, _ = self._checked(specs)
        if not good:
            raise ValueError("no factor can be evaluated")
        price = "open" if self.execution == "next_open" else "close"
        parts = []
        for group in batches(good):
            names = {f"v{i}": k for i, k in enumerate(group)}
            plan = compile_factors(self.dense, {v: group[k] for v, k in names.items()}, self.groups, dense=True, keep=(price,))
            frame = M.forward_returns(plan.frame, self.horizons, self.execution, dense=True, carry=list(names))
            stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("factor_id"), F.col(v).alias("value")) for v, k in names.items()])).alias("_f")
            parts.append(frame.select("symbol", "date", *[f"fwd_{h}" for h in self.horizons], stacked).select(F.col("_f.factor_id").alias("factor_id"), "symbol", "date", F.col("_f.value").alias("value"), *[f"fwd_{h}" for h in self.horizons]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def backtest(self, specs, label: str | None = None) -> DataFrame:
        """One report row a factor: coefficients at the shortest horizon and by horizon, decay, spread, turnover, quality codes."""
        long = stage(self.factors(specs).withColumnRenamed("value", "factor"), "factors")
        if label is not None:
            long = M.neutralize(long, self.groups, label, by=["factor_id"])
        by_h = M.evaluate_ic(M.by_horizon(long, self.horizons, ["factor_id", "symbol", "date", "factor"]), by=["factor_id", "horizon"])
        by_h = stage(by_h, "coefficients")
        head = by_h.where(F.col("horizon") == self.horizons[0]).drop("horizon")
        curve = by_h.groupBy("factor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "rank_ic")))).alias("ic_by_horizon"))
        first = long.withColumnRenamed(f"fwd_{self.horizons[0]}", "fwd")
        spread = M.long_short(M.group_returns(first, by=["factor_id"]), ["factor_id"])
        out = head.join(curve, "factor_id").join(M.decay_halflife(by_h, by=["factor_id"]), "factor_id", "left").join(spread, "factor_id", "left")
        out = out.join(M.turnover(long, by=["factor_id"]), "factor_id", "left").join(M.output_diagnostics(long, by=["factor_id"]).select("factor_id", "coverage", "codes"), "factor_id", "left")
        return out.withColumnRenamed("factor_id", "name")

    def dropped(self, specs) -> dict[str, list[Finding]]:
        return self._checked(specs)[1]

    def combine(self, specs, splits: Splits, method: str = "ic_weight", **kw) -> dict:
        long = stage(self.factors(specs), "factors")
        returns = long.where(F.col("factor_id") == F.lit(next(iter(self._checked(specs)[0])))).select("symbol", "date", F.col(f"fwd_{self.horizons[0]}").alias("fwd"))
        return combine(long.select("factor_id", "symbol", "date", "value"), returns, splits, method, **kw)

    def backtest_portfolio(self, expression: str, *, frequency: str = "monthly", day: str = "last", offset: int = 1, transform: str = "rank", method: str = "signal_prop", price: str = "open", constraints: Mapping | None = None, rates: Mapping | None = None, long_short: bool = False, gross: float = 1.0, net: float = 1.0) -> dict[str, DataFrame]:
        """nav, rebalances and metrics of the portfolio that trades the factor on a calendar."""
        frame = stage(compile_factors(self.dense, {"signal": expression}, self.groups, dense=True, keep=(price,)).frame, "signal")
        days = panel_dates(frame)
        plan = construction.shift_schedule(days, construction.calendar_schedule(days, frequency, day), offset)
        if not plan:
            raise ValueError("no rebalance lies within the panel")
        when = F.broadcast(self.spark.createDataFrame(sorted(plan.items()), "date date, _exec date"))
        signal = construction.process_signal(frame.select("date", "symbol", "signal").join(when, "date"), transform)
        w = construction.weights(signal, method, long_short=long_short, gross=gross, net=net)
        w = construction.apply_constraints(w, long_short=long_short, gross=gross, net=net, **({"cap": 1.0} | dict(constraints or {})))
        run = factor_id(expression)
        targets = w.select(F.lit(run).alias("run_id"), F.col("_exec").alias("date"), "symbol", "weight")
        returns = accounting.daily_returns(frame, price)
        nav, trades = accounting.account(returns, targets, **dict(rates or {}))
        nav = stage(nav, "nav")
        return {"nav": nav, "rebalances": trades, "metrics": compute_metrics(nav.join(accounting.benchmark_nav(returns), "date"))}


class Sessions:
    """Open sessions by name, the least recently used closed beyond ``most``; evaluated factors are kept by structure."""

    def __init__(self, most: int = 8):
        self.most, self._open, self._memo = most, {}, {}

    def open(self, name: str, make) -> Session:
        """The session of that name, made by ``make()`` if there is none."""
        session = self._open.pop(name, None) or make()
        self._open[name] = session
        while len(self._open) > self.most:
            self.close(next(iter(self._open)))
        return session

    def evaluate(self, name: str, expression: str) -> DataFrame:
        """As :meth:`Session.evaluate`, staged the first time an expression of that structure is asked for."""
        key = (name, node_hash(parse(expression)))
        if key not in self._memo:
            self._memo[key] = stage(self._open[name].evaluate(expression), "memo")
        return self._memo[key]

    def close(self, name: str) -> bool:
        """Whether there was such a session."""
        self._memo = {k: v for k, v in self._memo.items() if k[0] != name}
        return self._open.pop(name, None) is not None

    def names(self) -> list[str]:
        return list(self._open)
