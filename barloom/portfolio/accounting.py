"""The book over time: a relational accountant where targets do not depend on the book, and a walk where they do.

Between two rebalances a book is held unchanged, so its value is 1 + sum of w (G - 1) with G the
growth of each holding since the rebalance, and its drifted weights are w G over that. All segments of all runs are
computed at once by window products; only the chain of segment factors is sequential, and that is one row per rebalance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite


def daily_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    """(symbol, date, ret): price over the bar before, less 1; missing unless both are finite and the one before positive."""
    before = F.lag(price).over(Window.partitionBy("symbol").orderBy("date"))
    ok = finite(F.col(price)) & finite(before) & (before > 0)
    return panel.select("symbol", "date", F.when(ok, F.col(price) / F.when(ok, before) - 1).alias("ret"))


def cost_rate(side_sell: Column, participation: Column | None = None, *, commission: float = 0.0005, stamp: float = 0.0, transfer: float = 0.0, impact: float = 0.0, law: str = "sqrt", least: float = 0.0, notional: Column | None = None) -> Column:
    """Cost per unit traded: rates of both sides, of sales, and market impact by the share of daily volume ('sqrt', also called 'almgren_chriss', 'linear', 'zero').

    ``least`` is the smallest commission of one trade in money; it holds where ``notional``, the trade's size in money, is given.
    """
    if law not in ("sqrt", "almgren_chriss", "linear", "zero"):
        raise ValueError(f"unknown law of impact {law!r}")
    fee = F.lit(commission)
    if least > 0 and notional is not None:
        fee = F.when(notional > 0, F.greatest(fee, F.lit(least) / F.when(notional > 0, notional))).otherwise(fee)
    rate = fee + transfer + F.when(side_sell, F.lit(stamp)).otherwise(F.lit(0.0))
    if participation is None or law == "zero":
        return rate
    p = F.when(finite(participation) & (participation > 0), participation).otherwise(F.lit(0.0))
    return rate + impact * (p if law == "linear" else F.sqrt(p))


def round_trip(commission: float = 0.0005, stamp: float = 0.0, transfer: float = 0.0, impact: float = 0.0, participation: float = 0.0, law: str = "sqrt") -> float:
    one = 0.0 if law == "zero" or not participation > 0 else impact * (participation if law == "linear" else participation**0.5)
    return 2 * (commission + transfer + one) + stamp


def books(returns: DataFrame, targets: DataFrame, run: str = "run_id") -> dict[str, DataFrame]:
    """The drifted books of runs whose targets are given in advance: starts, marks (segment of each date), held (growth of each holding), value, moves."""
    t = targets.groupBy(run, "date", "symbol").agg(F.sum("weight").alias("weight"))
    days = returns.select("date").where("date is not null").distinct()
    # Calendar-sized tables: one row per run and date.
    starts = t.select(run, F.col("date").alias("seg")).distinct()
    runs = starts.select(run).distinct()
    marks = _days_of_runs(runs, days)
    marks = marks.join(starts.select(run, F.col("seg").alias("date"), F.col("seg").alias("_s")), [run, "date"], "left")
    earlier = Window.partitionBy(run).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("seg", F.last("_s", ignorenulls=True).over(earlier)).drop("_s")
    held = t.where("weight <> 0").select(run, F.col("date").alias("seg"), "symbol", "weight").join(marks.where("seg is not null"), [run, "seg"])
    held = held.join(returns.where(finite(F.col("ret"))).select("symbol", "date", "ret"), ["symbol", "date"], "left")
    grown = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(Window.partitionBy(run, "seg", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("g", grown)
    value = held.groupBy(run, "seg", "date").agg((1 + F.sum(F.col("weight") * (F.col("g") - 1))).alias("f"))
    value = marks.join(value, [run, "seg", "date"], "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    # The drifted book on the day it is traded.
    at_trade = held.join(starts.select(run, F.col("seg").alias("date")), [run, "date"], "left_semi").join(value.select(run, "date", "f"), [run, "date"])
    book = at_trade.select(run, "date", "symbol", (F.col("weight") * F.col("g") / F.when(F.col("f") != 0, F.col("f"))).alias("held"))
    moves = t.join(book, [run, "date", "symbol"], "full").select(run, "date", "symbol", (F.coalesce("weight", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))).alias("move"))
    return {"starts": starts, "held": held, "value": value, "book": book, "moves": moves.where(F.abs("move") > 1e-12)}


def account(returns: DataFrame, targets: DataFrame, *, run: str = "run_id", **rates) -> tuple[DataFrame, DataFrame]:
    """(nav, rebalances) of runs whose targets are given in advance.

    ``returns``: (symbol, date, ret), missing counts as 0. ``targets``: (run, date, symbol, weight) at execution dates; a symbol
    not named has target 0. A date's return is earned by the book of the rebalance before it; then the book is traded.
    nav: (run, date, nav, gross_nav, ret) on every date of ``returns``, 1 before the first rebalance. rebalances: (run, date,
    turnover, cost, n_trades) with one-way turnover.
    """
    b = books(returns, targets, run)
    starts, value, moves = b["starts"], b["value"], b["moves"]
    cost = F.sum(F.abs("move") * cost_rate(F.col("move") < 0, **rates))
    trades = starts.select(run, F.col("seg").alias("date")).join(moves.groupBy(run, "date").agg((F.sum(F.abs("move")) / 2).alias("turnover"), cost.alias("cost"), F.count(F.lit(1)).alias("n_trades")), [run, "date"], "left").fillna(0.0, ["turnover", "cost"]).fillna(0, ["n_trades"])
    # Chain the segments: the factor of each segment's last day, and what trading cost on that day.
    line = value.join(trades.select(run, "date", "cost"), [run, "date"], "left")
    order = Window.partitionBy(run).orderBy("date")
    closing = F.when(F.col("cost").isNotNull(), F.col("f"))
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    chained = F.coalesce(F.product(F.coalesce(closing, F.lit(1.0))).over(before), F.lit(1.0)) * F.col("f")
    paid = F.product(1 - F.coalesce("cost", F.lit(0.0))).over(upto)
    nav = line.withColumns({"gross_nav": chained, "_paid": paid}).withColumn("nav", F.col("gross_nav") * F.col("_paid"))
    prev = F.coalesce(F.lag("nav").over(order), F.lit(1.0))
    nav = nav.withColumn("ret", F.col("nav") / F.when(prev != 0, prev) - 1)
    return nav.select(run, "date", "nav", "gross_nav", "ret"), trades


def _days_of_runs(runs: DataFrame, days: DataFrame) -> DataFrame:
    """Every run with every day of the calendar, which is bounded and goes along as a literal."""
    from barloom.plans.panel import panel_dates

    every = panel_dates(days)
    if not every:
        return runs.select("*", F.lit(None).cast("date").alias("date")).limit(0)
    return runs.select("*", F.explode(F.lit(every)).alias("date"))


def cap_turnover(target: np.ndarray, book: np.ndarray, most: float) -> np.ndarray:
    """The target, or the point towards it at which one-way turnover is ``most``; from 1 on there is no limit."""
    turnover = np.abs(target - book).sum() / 2
    return target if most >= 1 or turnover <= most else book + (target - book) * (most / turnover)


def walk(returns: np.ndarray, targets: dict[int, np.ndarray], *, max_turnover: float = 1.0, drift_limit: float | None = None, tradable: np.ndarray | None = None, participation: np.ndarray | None = None, max_participation: float = 0.1, commission: float = 0.0005, stamp: float = 0.0, transfer: float = 0.0, impact: float = 0.0, no_buy: np.ndarray | None = None, no_sell: np.ndarray | None = None, defer: bool = False, ranks: np.ndarray | None = None, rank_shift: float | None = None) -> pd.DataFrame:
    """One run day by day, for what depends on the live book: limits on turnover, trading only on drift or on a shift of ranks, names that cannot trade, partial fills.

    ``tradable``, ``no_buy`` and ``no_sell`` are masks by day and name. With ``defer`` what could not be traded is tried again every day until it is done or
    the next rebalance takes its place. With ``drift_limit`` or ``rank_shift`` (on ``ranks`` by day and name, against those of the name's last trade) only the names beyond a limit are traded.
    """
    n_days, n = returns.shape
    r = np.where(np.isfinite(returns), returns, 0.0)
    book, nav, gross, rows = np.zeros(n), 1.0, 1.0, []
    waiting, last_rank, moved_days = np.full(n, np.nan), np.full(n, np.nan), 0
    for t in range(n_days):
        earned = float(book @ r[t])
        nav, gross = nav * (1 + earned), gross * (1 + earned)
        if 1 + earned != 0:
            book = book * (1 + r[t]) / (1 + earned)
        turnover = cost = 0.0
        traded = 0
        goal = None
        if t in targets:
            goal = np.where(np.isfinite(targets[t]), targets[t], book)
            beyond = np.zeros(n, bool)
            if drift_limit is not None:
                beyond |= np.abs(goal - book) > drift_limit
            if rank_shift is not None and ranks is not None:
                beyond |= np.abs(ranks[t] - last_rank) > rank_shift
            if (drift_limit is not None or rank_shift is not None) and moved_days:
                goal = np.where(beyond, goal, book) if rank_shift is not None else goal if beyond.any() else None
            waiting[:] = np.nan
        elif defer and np.isfinite(waiting).any():
            goal = np.where(np.isfinite(waiting), waiting, book)
        if goal is not None:
            goal = book + (cap_turnover(goal, book, max_turnover) - book)
            move = goal - book
            if tradable is not None:
                move = np.where(tradable[t], move, 0.0)
            if no_buy is not None:
                move = np.where(no_buy[t] & (move > 0), 0.0, move)
            if no_sell is not None:
                move = np.where(no_sell[t] & (move < 0), 0.0, move)
            share = np.zeros(n)
            if participation is not None:
                share = np.nan_to_num(participation[t])
                fill = np.where(share > max_participation, max_participation / np.where(share > 0, share, 1), 1.0)
                move, share = move * fill, share * fill
            done = np.abs(goal - book - move) <= 1e-12
            waiting = np.where(done, np.nan, goal)
            some = np.abs(move) > 1e-12
            if ranks is not None:
                last_rank = np.where(some, ranks[t], last_rank)
            moved_days += bool(some.any())
            traded = int(some.sum())
            turnover = float(np.abs(move).sum() / 2)
            cost = float((np.abs(move) * (commission + transfer + stamp * (move < 0) + impact * np.sqrt(share))).sum())
            nav *= 1 - cost
            book = book + move
        rows.append((nav, gross, turnover, cost, traded))
    return pd.DataFrame(rows, columns=["nav", "gross_nav", "turnover", "cost", "n_trades"])


def account_by_walk(returns: DataFrame, targets: DataFrame, *, run: str = "run_id", **limits) -> DataFrame:
    """(run, date, nav, gross_nav, turnover, cost, n_trades): :func:`walk` for every run, each a task of its own.

    A run holds days x symbols numbers and is sequential; runs are independent. Returns reach each run by a join on the run's symbols.
    """
    symbols = targets.select(run, "symbol").distinct()
    r = symbols.join(returns.select("symbol", "date", "ret"), "symbol").select(run, "date", "symbol", "ret", F.lit(None).cast("double").alias("weight"), F.lit(0).alias("kind"))
    t = targets.select(run, "date", "symbol", F.lit(None).cast("double").alias("ret"), "weight", F.lit(1).alias("kind"))
    kind = targets.schema[run].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = g[g.kind == 0].pivot_table(index="date", columns="symbol", values="ret", aggfunc="last", dropna=False).sort_index()
        w = g[g.kind == 1].pivot_table(index="date", columns="symbol", values="weight", aggfunc="sum").reindex(columns=m.columns).fillna(0.0)
        at = {d: i for i, d in enumerate(m.index)}
        out = walk(m.to_numpy(float), {at[d]: w.loc[d].to_numpy(float) for d in w.index if d in at}, **limits)
        return out.assign(date=m.index, **{run: g[run].iloc[0]})[[run, "date", "nav", "gross_nav", "turnover", "cost", "n_trades"]]

    return r.unionByName(t).groupBy(run).applyInPandas(one, f"{run} {kind}, date date, nav double, gross_nav double, turnover double, cost double, n_trades long")


def benchmark_nav(returns: DataFrame, kind: str = "equal", annual_rate: float = 0.0) -> DataFrame:
    """(date, bench): the compounded mean return of all symbols ('equal'), or cash at an annual rate ('cash'); 252 sessions a year."""
    if kind == "cash":
        daily = returns.groupBy("date").agg(F.lit((1 + annual_rate) ** (1 / 252) - 1).alias("m"))
    elif kind == "equal":
        daily = returns.groupBy("date").agg(F.coalesce(F.avg(F.when(finite(F.col("ret")), F.col("ret"))), F.lit(0.0)).alias("m"))
    else:
        raise ValueError(f"benchmark must be equal or cash, not {kind!r}")
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date: a bounded calendar
    return daily.select("date", F.product(1 + F.col("m")).over(order).alias("bench"))


def sample_series(nav: DataFrame, frequency: str = "monthly", by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The last point of every week or month; 'daily' keeps all."""
    if frequency == "daily":
        return nav
    unit = {"weekly": "week", "monthly": "month"}[frequency]
    last = F.row_number().over(Window.partitionBy(*by, F.date_trunc(unit, F.col("date").cast("timestamp_ntz"))).orderBy(F.desc("date")))
    return nav.withColumn("_n", last).where("_n = 1").drop("_n")
