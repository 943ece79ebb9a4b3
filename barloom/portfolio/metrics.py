"""Performance of NAV series: one row per run, all runs in one job. 252 sessions make a year; what is not defined is null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite, only_finite

YEAR = 252


def nav_returns(nav: DataFrame, column: str = "nav", by: Sequence[str] = ("run_id",)) -> Column:
    before = F.lag(column).over(Window.partitionBy(*by).orderBy("date"))
    ok = finite(F.col(column)) & finite(before) & (before > 0)
    return F.when(ok, F.col(column) / F.when(ok, before) - 1)


def _over(a: Column, b: Column) -> Column:
    """a / b where b is not zero nor dust."""
    ok = F.abs(b) > 1e-12
    return F.when(ok, a / F.when(ok, b))


def compute_metrics(nav: DataFrame, by: Sequence[str] = ("run_id",), risk_free: float = 0.0) -> DataFrame:
    """One row per run from (run, date, nav, gross_nav, bench): returns, risk, drawdown and figures against the benchmark."""
    order = Window.partitionBy(*by).orderBy("date")
    has = {c: c in nav.columns for c in ("gross_nav", "bench")}
    df = nav.select(*by, "date", only_finite(F.col("nav")).alias("nav"), *[only_finite(F.col(c)).alias(c) if has[c] else F.lit(None).cast("double").alias(c) for c in has])
    df = df.withColumns({"r": nav_returns(df, "nav", by), "b": nav_returns(df, "bench", by), "_t": F.row_number().over(order)})
    df = df.withColumn("_peak", F.max("nav").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_dd", 1 - F.col("nav") / F.when(F.col("_peak") > 0, F.col("_peak")))
    df = df.withColumn("_under", F.coalesce(F.col("nav") < F.col("_peak"), F.lit(False)))
    # Days under water between two peaks share the number of peaks before them.
    df = df.withColumn("_island", F.sum((~F.col("_under")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_depth", F.sum(F.col("_under").cast("int")).over(Window.partitionBy(*by, "_island")))
    rf = risk_free / YEAR
    r, b = F.col("r"), F.col("b")
    active = F.when(r.isNotNull() & b.isNotNull(), r - b)
    pr, pb = F.when(b.isNotNull(), r), F.when(r.isNotNull(), b)
    first, last = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_t"))), lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_t")))
    span = F.max(F.when(F.col("nav").isNotNull(), F.col("_t"))) - F.min(F.when(F.col("nav").isNotNull(), F.col("_t")))
    m = df.groupBy(*by).agg(
        (_over(last("nav"), first("nav")) - 1).alias("total_return"),
        (_over(last("bench"), first("bench")) - 1).alias("benchmark_return"),
        (_over(last("gross_nav"), first("gross_nav")) - 1).alias("_gross"),
        span.alias("_span"),
        F.sum(F.when(r > -1, F.ln(F.when(r > -1, 1 + r)))).alias("log_return"),
        (F.avg(r) - rf).alias("_mean"),
        F.stddev_samp(r).alias("_sd"),
        F.sqrt(F.avg(F.pow(F.least(r - rf, F.lit(0.0)), 2))).alias("_down"),
        F.max("_dd").alias("max_drawdown"),
        F.max("_depth").alias("drawdown_days"),
        F.avg(active).alias("_active"),
        F.stddev_samp(active).alias("_te"),
        F.covar_samp(pr, pb).alias("_cov"),
        F.var_samp(pb).alias("_vb"),
        (F.avg(pr) - rf).alias("_mp"),
        (F.avg(pb) - rf).alias("_mb"),
    )
    root = math.sqrt(YEAR)
    years = F.when(F.col("_span") > 0, YEAR / F.when(F.col("_span") > 0, F.col("_span")))
    m = m.withColumn("annual_return", F.pow(F.greatest(1 + F.col("total_return"), F.lit(0.0)), years) - 1).withColumn("beta", _over(F.col("_cov"), F.col("_vb")))
    return m.select(
        *by, "total_return", "annual_return", "log_return", (F.col("total_return") - F.col("benchmark_return")).alias("excess_return"), (_over(F.col("_mean"), F.col("_sd")) * root).alias("sharpe"), (_over(F.col("_mean"), F.col("_down")) * root).alias("sortino"),
        "max_drawdown", "drawdown_days", _over(F.col("annual_return"), F.col("max_drawdown")).alias("calmar"), (_over(F.col("_active"), F.col("_te")) * root).alias("information_ratio"), (F.col("_te") * root).alias("tracking_error"), "beta",
        ((F.col("_mp") - F.col("beta") * F.col("_mb")) * YEAR).alias("alpha"), (F.col("_gross") - F.col("total_return")).alias("cost_drag"),
    )


def monthly_returns(nav: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(run, month, ret): each month's last NAV over the month before's; the first month over its own opening."""
    ok = nav.where(finite(F.col("nav")))
    m = ok.groupBy(*by, F.date_format("date", "yyyy-MM").alias("month")).agg(F.max_by("nav", "date").alias("close"), F.min_by("nav", "date").alias("open"))
    before = F.coalesce(F.lag("close").over(Window.partitionBy(*by).orderBy("month")), F.col("open"))
    return m.select(*by, "month", (F.col("close") / F.when(before > 0, before) - 1).alias("ret"))


def trading_metrics(rebalances: DataFrame, by: Sequence[str] = ("run_id",), sessions: int | None = None) -> DataFrame:
    """(run, n_rebalances, mean_turnover, annual_turnover, holding_days, total_cost); the year's share from ``sessions`` if given, else from the dates' span."""
    a = rebalances.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rebalances"), F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost"), F.datediff(F.max("date"), F.min("date")).alias("_days"))
    years = F.lit(sessions / YEAR) if sessions else F.when(F.col("_days") > 0, F.col("_days") / 365.25)
    a = a.withColumn("annual_turnover", F.col("mean_turnover") * F.col("n_rebalances") / F.when(years > 0, years))
    return a.withColumn("holding_days", _over(F.lit(float(YEAR)), F.col("annual_turnover"))).drop("_days")
