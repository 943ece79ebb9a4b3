"""Scoring factors: forward returns, information coefficients, decay, quantile groups, turnover, output quality.

Every function takes and gives DataFrames; ``by`` names further key columns (factor, horizon), so a batch of factors and
horizons is scored in one job. Only jointly finite cells count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite, nn, only_finite, pearson
from barloom.plans.panel import densify
from barloom.runtime import broadcast_if_small

EXECUTIONS = ("next_open", "next_close")


def forward_returns(panel: DataFrame, horizons: Sequence[int] = (1, 5, 10, 20), execution: str = "next_open", *, dense: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(symbol, date, *carry, fwd_h...): the return over the h bars after a signal on ``date``, on the dense grid.

    'next_open' enters at the next bar's open and leaves at the open h bars later; 'next_close' enters at the close of
    the signal's own bar. Missing if either price is not finite or the entry is not positive. ``carry`` names columns of a dense panel to
    keep, so that a factor needs no join to meet its returns.
    """
    if execution not in EXECUTIONS:
        raise ValueError(f"execution must be one of {EXECUTIONS}, not {execution!r}")
    hs = sorted(set(horizons))
    if not hs or hs[0] < 1:
        raise ValueError("horizons must be at least 1")
    price = "open" if execution == "next_open" else "close"
    grid = panel if dense else densify(panel, [price])
    order, lag = Window.partitionBy("symbol").orderBy("date"), 1 if execution == "next_open" else 0
    px = only_finite(F.col(price))
    grid = grid.withColumn("_in", F.lead(px, lag).over(order) if lag else px).withColumns({f"_out{h}": F.lead(px, lag + h).over(order) for h in hs})
    ok = F.col("_in") > 0
    return grid.select("symbol", "date", *carry, *[F.when(ok, nn(F.col(f"_out{h}") / F.when(ok, F.col("_in")) - 1)).alias(f"fwd_{h}") for h in hs])


def by_horizon(scored: DataFrame, horizons: Iterable[int], keys: Sequence[str]) -> DataFrame:
    """One row per horizon from the columns fwd_h: keys, horizon, fwd."""
    parts = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in sorted(set(horizons))])).alias("_h")
    return scored.select(*keys, parts).select(*keys, F.col("_h.horizon").alias("horizon"), F.col("_h.fwd").alias("fwd"))


def joint(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(finite(F.col(x)) & finite(F.col(y)))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Rank from 1 with ties at their average, within ``keys``: the mean of the first and the last place of equal values, from one sort."""
    ordered = Window.partitionBy(*keys).orderBy(x)
    return (F.rank().over(ordered) + F.count(F.lit(1)).over(ordered.rangeBetween(Window.unboundedPreceding, 0))) / 2


def ic_series(df: DataFrame, x: str = "factor", y: str = "fwd", by: Sequence[str] = ()) -> DataFrame:
    """(*by, date, n, ic): Pearson per date over jointly finite cells; null below two cells or without variance."""
    return joint(df, x, y).groupBy(*by, "date").agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("ic"))


def rank_ic_series(df: DataFrame, x: str = "factor", y: str = "fwd", by: Sequence[str] = ()) -> DataFrame:
    """(*by, date, n, rank_ic): Spearman per date, both sides ranked over the jointly finite cells."""
    keys = [*by, "date"]
    ranked = joint(df, x, y).repartition(*keys).withColumns({"_rx": average_rank(x, keys), "_ry": average_rank(y, keys)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("rank_ic"))


def _ratio_of(series: Column) -> Column:
    sd = F.stddev_samp(series)
    ok = (F.count(series) >= 2) & (sd > 0)
    return F.when(ok, F.avg(series) / F.when(ok, sd))


def ic_summary(series: DataFrame, value: str = "ic", by: Sequence[str] = ()) -> DataFrame:
    """(*by, mean, ir, n): mean and mean over sample deviation of the finite dates; ir is null below two or without any deviation."""
    v = only_finite(F.col(value))
    return series.groupBy(*by).agg(F.avg(v).alias("mean"), _ratio_of(v).alias("ir"), F.count(v).alias("n"))


def evaluate_ic(df: DataFrame, x: str = "factor", y: str = "fwd", by: Sequence[str] = ("horizon",)) -> DataFrame:
    """(*by, ic, icir, rank_ic, rank_icir, n_dates): both coefficients in one pass over the joint cells."""
    keys = [*by, "date"]
    ranked = joint(df, x, y).repartition(*keys).withColumns({"_rx": average_rank(x, keys), "_ry": average_rank(y, keys)})
    daily = ranked.groupBy(*keys).agg(pearson(F.col(x), F.col(y)).alias("ic"), pearson(F.col("_rx"), F.col("_ry")).alias("rank_ic"))
    return daily.groupBy(*by).agg(F.avg("ic").alias("ic"), _ratio_of(F.col("ic")).alias("icir"), F.avg("rank_ic").alias("rank_ic"), _ratio_of(F.col("rank_ic")).alias("rank_icir"), F.count("rank_ic").alias("n_dates"))


def decay_halflife(by_h: DataFrame, ic: str = "rank_ic", by: Sequence[str] = ()) -> DataFrame:
    """(*by, half_life): ln 2 over the decay rate of positive coefficients against the horizon; null below two points or without decay."""
    good = F.col(ic) > 0
    h, y = F.when(good, F.col("horizon").cast("double")), F.when(good, F.ln(F.when(good, F.col(ic))))
    slope = F.regr_slope(y, h)
    ok = (F.count(y) >= 2) & (slope < 0)
    return by_h.groupBy(*by).agg(F.when(ok, -math.log(2) / F.when(ok, slope)).alias("half_life"))


def group_returns(df: DataFrame, n_groups: int = 5, x: str = "factor", y: str = "fwd", by: Sequence[str] = ()) -> DataFrame:
    """(*by, bucket, mean_return, n_dates): mean over dates of the buckets' mean forward returns.

    Bucket = floor(position * n_groups / number) of the ascending order (ties by symbol); dates with fewer cells than groups are skipped.
    """
    if n_groups < 2:
        raise ValueError("at least two groups")
    keys = [*by, "date"]
    w = Window.partitionBy(*keys)
    placed = joint(df, x, y).withColumns({"_pos": F.row_number().over(w.orderBy(x, "symbol")) - 1, "_m": F.count(F.lit(1)).over(w)}).where(F.col("_m") >= n_groups)
    daily = placed.groupBy(*keys, F.floor(F.col("_pos") * n_groups / F.col("_m")).cast("int").alias("bucket")).agg(F.avg(y).alias("r"))
    return daily.groupBy(*by, "bucket").agg(F.avg("r").alias("mean_return"), F.count(F.lit(1)).alias("n_dates"))


def long_short(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, long_short, monotonic): top minus bottom bucket, and whether the means rise or fall strictly."""
    means = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "mean_return"))), lambda s: s["mean_return"])
    g = groups.groupBy(*by).agg(means.alias("m"))
    steps = lambda test: F.forall(F.zip_with(F.slice("m", 1, F.size("m") - 1), F.slice("m", 2, F.size("m") - 1), test), lambda ok: ok)
    g = g.where(F.size("m") >= 2)
    return g.select(*by, (F.element_at("m", -1) - F.element_at("m", 1)).alias("long_short"), (steps(lambda a, b: b > a) | steps(lambda a, b: b < a)).alias("monotonic"))


def rank_autocorrelation(factor: DataFrame, lag: int = 1, x: str = "factor", by: Sequence[str] = ()) -> DataFrame:
    """(*by, date, n, autocorr): Spearman between the factor ``lag`` bars before and now; ``factor`` is on the dense grid."""
    if lag < 1:
        raise ValueError("the lag must be at least 1")
    lagged = factor.withColumn("_before", F.lag(x, lag).over(Window.partitionBy(*by, "symbol").orderBy("date")))
    return rank_ic_series(lagged, "_before", x, by).withColumnRenamed("rank_ic", "autocorr")


def turnover(factor: DataFrame, lag: int = 1, x: str = "factor", by: Sequence[str] = ()) -> DataFrame:
    """(*by, turnover): one minus the mean rank autocorrelation."""
    return rank_autocorrelation(factor, lag, x, by).groupBy(*by).agg((1 - F.avg("autocorr")).alias("turnover"))


def neutralize(factor: DataFrame, labels: DataFrame, label: str, x: str = "factor", by: Sequence[str] = ()) -> DataFrame:
    """The factor less the mean of its date and group; symbols without a label form a group of their own ('UNKNOWN')."""
    own = labels.where("symbol is not null").groupBy("symbol").agg(F.max(label).alias("_label"))
    joined = factor.join(broadcast_if_small(own), "symbol", "left").withColumn("_label", F.coalesce(F.col("_label").cast("string"), F.lit("UNKNOWN")))
    w = Window.partitionBy(*by, "date", "_label")
    v = only_finite(F.col(x))
    return joined.withColumn(x, v - F.avg(v).over(w)).drop("_label")


#: Rules on a factor's output and their default limits (fixed values).
OUTPUT_RULES = {
    "O001": "no finite value", "O002": "more than half of the cells missing", "O003": "no cross-sectional variance", "O004": "infinite values", "O005": "magnitudes above 1e12",
    "O006": "valid only after half of the dates", "O007": "coverage below 2 %", "O008": "most dates have fewer than two values", "O009": "range negligible against the level",
}
LIMITS = {"missing": 0.5, "flat_share": 0.99, "flat_std": 1e-12, "extreme": 1e12, "warm_up": 0.5, "coverage": 0.02, "thin": 0.5, "narrow": 1e-6}


def output_diagnostics(factor: DataFrame, x: str = "factor", by: Sequence[str] = ()) -> DataFrame:
    """(*by, n_cells, coverage, n_infinite, first_valid, n_values, codes): quality of a factor on its dense grid.

    ``codes`` are those of ``OUTPUT_RULES``, in order; O001 is an error, the others warn. Two aggregations: by date, then over dates.
    """
    v, c = only_finite(F.col(x)), F.col(x)
    daily = factor.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("cells"), F.count(v).alias("ok"), F.sum(F.when(F.abs(c) == float("inf"), 1).otherwise(0)).alias("inf"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("s"), F.collect_set(F.round(v, 12)).alias("set"))
    daily = daily.withColumn("set", F.slice("set", 1, 2)).withColumn("bar", F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1)
    cells, ok = F.sum("cells"), F.sum("ok")
    t = daily.groupBy(*by).agg(
        cells.alias("n_cells"), ok.alias("n_ok"), F.sum("inf").alias("n_infinite"), F.min(F.when(F.col("ok") > 0, F.col("bar"))).alias("first_valid"), F.count(F.lit(1)).alias("n_dates"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.when(ok > 0, ok)).alias("mean"),
        F.sum((F.col("ok") >= 2).cast("int")).alias("wide"), F.sum(((F.col("ok") >= 2) & (F.col("sd") <= LIMITS["flat_std"])).cast("int")).alias("flat"), F.sum((F.col("ok") >= 1).cast("int")).alias("filled"), F.size(F.array_distinct(F.flatten(F.collect_set("set")))).alias("n_values"),
    )
    t = t.withColumn("coverage", F.col("n_ok") / F.when(F.col("n_cells") > 0, F.col("n_cells")))
    some = F.col("n_ok") > 0
    constant = some & ((F.col("n_values") <= 1) | ((F.col("wide") > 0) & (F.col("flat") >= LIMITS["flat_share"] * F.col("wide"))))
    tests = {
        "O001": ~some,
        "O002": 1 - F.col("coverage") > LIMITS["missing"],
        "O003": constant,
        "O004": F.col("n_infinite") > 0,
        "O005": some & (F.greatest(F.abs("lo"), F.abs("hi")) > LIMITS["extreme"]),
        "O006": some & (F.col("first_valid") > LIMITS["warm_up"] * F.col("n_dates")),
        "O007": some & (F.col("coverage") < LIMITS["coverage"]),
        "O008": some & (F.col("wide") < LIMITS["thin"] * F.col("filled")),
        "O009": some & ~constant & ((F.col("hi") - F.col("lo")) / (F.abs("mean") + 1e-12) < LIMITS["narrow"]),
    }
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))
    return t.select(*by, "n_cells", "coverage", "n_infinite", "first_valid", "n_values", codes.alias("codes"))
