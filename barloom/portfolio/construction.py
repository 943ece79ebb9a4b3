"""From signals to target weights, date by date: cleaning, weighting, constraints. Windows only; nothing is collected."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import only_finite

TRANSFORMS = ("rank", "zscore", "raw")
METHODS = ("equal", "signal_prop", "quintile", "decile")


def process_signal(signal: DataFrame, transform: str = "rank", tail: float = 0.01, group: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Winsorize at ``tail``, subtract the group's mean if ``group`` names a column, then rank to [0, 1], z-score or leave raw.

    Missing signals stay missing; z-scores of a date without spread are missing, a lone rank is one half.
    """
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of {TRANSFORMS}, not {transform!r}")
    if not 0 < tail < 0.5:
        raise ValueError("the tail must lie between 0 and 0.5")
    keys = [*by, "date"]
    w = Window.partitionBy(*keys)
    s = signal.withColumn("signal", only_finite(F.col("signal"))).repartition(*keys)
    s = s.withColumns({"_lo": F.percentile("signal", tail).over(w), "_hi": F.percentile("signal", 1 - tail).over(w)})
    s = s.withColumn("signal", F.when(F.col("signal").isNotNull(), F.greatest(F.least("signal", "_hi"), "_lo"))).drop("_lo", "_hi")
    if group is not None:
        s = s.withColumn("signal", F.col("signal") - F.avg("signal").over(Window.partitionBy(*keys, group)))
    if transform == "zscore":
        sd = F.stddev_samp("signal").over(w)
        ok = (sd > 0) & (F.min("signal").over(w) < F.max("signal").over(w))
        s = s.withColumn("signal", F.when(ok, (F.col("signal") - F.avg("signal").over(w)) / F.when(ok, sd)))
    elif transform == "rank":
        n = F.count("signal").over(w)
        ordered = w.orderBy(F.col("signal").asc_nulls_last())
        twice = F.rank().over(ordered) - 1 + F.count("signal").over(ordered.rangeBetween(Window.unboundedPreceding, 0)) - 1
        s = s.withColumn("signal", F.when(F.col("signal").isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise(twice / 2 / F.when(n > 1, n - 1))))
    return s


def scale_legs(raw: Column, w, long_short: bool, gross: float, net: float) -> Column:
    """Raw weights scaled so that absolute ones add up to ``gross`` and signed ones to ``net``; an empty leg stays empty."""
    up, down = F.greatest(raw, F.lit(0.0)), F.greatest(-raw, F.lit(0.0))
    if not long_short:
        total = F.sum(up).over(w)
        return F.when(total > 0, up * gross / F.when(total > 0, total)).otherwise(F.lit(0.0))
    leg = lambda x, budget: F.when(F.sum(x).over(w) > 0, x * max(budget, 0.0) / F.when(F.sum(x).over(w) > 0, F.sum(x).over(w))).otherwise(F.lit(0.0))
    return leg(up, (gross + net) / 2) - leg(down, (gross - net) / 2)


def weights(signal: DataFrame, method: str = "signal_prop", *, long_short: bool = False, gross: float = 1.0, net: float = 1.0, long_n: int = 1, short_n: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """``signal`` with a column ``weight``; symbols without a signal get 0.

    equal: everyone alike, or with ``long_short`` the upper half (from the median) against the lower one. signal_prop: in proportion
    to the signal above the date's minimum, or to its deviation from the mean; equal if all are alike.
    quintile, decile: the top ``long_n`` and bottom ``short_n`` of 5 or 10 buckets, floor(place * groups / number) by
    signal and symbol; equal if there are fewer symbols than buckets.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    keys = [*by, "date"]
    w = Window.partitionBy(*keys)
    s = signal.withColumn("signal", only_finite(F.col("signal"))).repartition(*keys)
    s = s.withColumns({"_n": F.count("signal").over(w), "_mean": F.avg("signal").over(w), "_med": F.percentile("signal", 0.5).over(w), "_min": F.min("signal").over(w), "_max": F.max("signal").over(w)})
    there = F.col("signal").isNotNull()
    flat = F.col("_min") == F.col("_max")
    one = F.when(there, F.lit(1.0)).otherwise(F.lit(0.0))
    # A date whose median is its minimum has no lower half: the mean parts it.
    pivot = F.when(F.col("_med") > F.col("_min"), F.col("_med")).otherwise(F.col("_mean"))
    halves = F.when(there, F.when(F.col("signal") >= pivot, 1.0).otherwise(-1.0)).otherwise(F.lit(0.0))
    equal = halves if long_short else one
    if method == "equal":
        raw = equal
    elif method == "signal_prop":
        raw = F.when(flat, equal).otherwise(F.when(there, F.col("signal") - F.col("_mean" if long_short else "_min")).otherwise(F.lit(0.0)))
    else:
        g = 5 if method == "quintile" else 10
        place = F.row_number().over(w.orderBy(F.col("signal").asc_nulls_last(), "symbol")) - 1
        s = s.withColumn("_bucket", F.when(F.col("signal").isNotNull(), F.least(F.floor(place * g / F.when(F.col("_n") > 0, F.col("_n"))), F.lit(g - 1))))
        tails = F.when(F.col("_bucket") >= g - long_n, 1.0).when((F.col("_bucket") < short_n) & F.lit(long_short), -1.0).otherwise(F.lit(0.0))
        raw = F.when(F.col("_n") < g, equal).otherwise(tails)
    s = s.withColumn("_raw", raw)
    return s.withColumn("weight", scale_legs(F.col("_raw"), w, long_short, gross, net)).drop("_n", "_mean", "_med", "_min", "_max", "_raw", "_bucket")


def sector_neutral(targets: DataFrame, sector: str, by: Sequence[str] = ()) -> DataFrame:
    """Every sector of a date gets the same share of the gross weight; proportions inside stay. A sector that nets to zero is scaled by magnitude."""
    keys = [*by, "date"]
    w, ws = Window.partitionBy(*keys), Window.partitionBy(*keys, sector)
    share = F.sum(F.abs("weight")).over(w) / F.size(F.collect_set(F.col(sector)).over(w))
    total, size = F.sum("weight").over(ws), F.sum(F.abs("weight")).over(ws)
    return targets.withColumn("weight", F.when(total != 0, F.col("weight") * share / F.when(total != 0, total)).when(size > 0, F.col("weight") * share / F.when(size > 0, size)).otherwise(F.lit(0.0)))


def drop_dust(targets: DataFrame, least: float, long_short: bool) -> DataFrame:
    """Weights below ``least`` in size become 0, without ``long_short`` also negative ones."""
    x = F.col("weight") if long_short else F.greatest(F.col("weight"), F.lit(0.0))
    return targets.withColumn("weight", F.when(F.abs(x) < least, F.lit(0.0)).otherwise(x))


def cap_count(targets: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Only the ``most`` largest weights of a date stay, ties by symbol."""
    place = F.row_number().over(Window.partitionBy(*by, "date").orderBy(F.desc(F.abs("weight")), "symbol"))
    return targets.withColumn("weight", F.when(place <= most, F.col("weight")).otherwise(F.lit(0.0)))


def water_fill(targets: DataFrame, cap: float, gross: float, net: float, long_short: bool, by: Sequence[str] = ()) -> DataFrame:
    """Weights up to ``cap`` that keep each leg's budget: what the cap frees goes to the others in proportion.

    The result of the repeated clipping is min(f * size, cap) for one factor f a leg. f is found in one pass over the sizes in
    descending order: with the k largest at the cap, f = (budget - k cap) / rest, for the smallest k that leaves no other above the cap.
    """
    keys = [*by, "date"]
    size, side = F.abs("weight"), F.when(F.col("weight") > 0, 1).when(F.col("weight") < 0, -1).otherwise(0)
    t = targets.withColumns({"_size": size, "_side": side})
    budget = F.when(F.col("_side") == 1, (gross + net) / 2).otherwise((gross - net) / 2) if long_short else F.lit(float(gross))
    leg = [*keys, "_side"]
    down = Window.partitionBy(*leg).orderBy(F.desc("_size"), "symbol")
    t = t.withColumns({"_k": F.row_number().over(down) - 1, "_rest": F.sum("_size").over(down.rowsBetween(0, Window.unboundedFollowing))})
    f = (budget - F.col("_k") * cap) / F.when(F.col("_rest") > 0, F.col("_rest"))
    fits = F.when((f * F.col("_size") <= cap + 1e-15) & (f > 0), F.struct(F.col("_k").alias("k"), f.alias("f")))
    t = t.withColumn("_f", F.min(fits).over(Window.partitionBy(*leg)))
    # No k fits: even all at the cap do not reach the budget.
    level = F.when(F.col("_f").isNull(), F.lit(float(cap))).otherwise(F.least(F.col("_f.f") * F.col("_size"), F.lit(float(cap))))
    return t.withColumn("weight", F.when(F.col("_side") == 0, F.lit(0.0)).otherwise(F.col("_side") * level)).drop("_size", "_side", "_k", "_rest", "_f")


def apply_constraints(targets: DataFrame, *, cap: float = 0.05, least: float = 0.0, most: int | None = None, gross: float = 1.0, net: float = 1.0, long_short: bool = False, sector: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Sector shares, dust, count, exposure, cap: in this order. A limit on turnover needs the drifted book: see the accountant."""
    t = sector_neutral(targets, sector, by) if sector else targets
    t = drop_dust(t, least, long_short)
    if most:
        t = cap_count(t, most, by)
    t = t.withColumn("weight", scale_legs(F.col("weight"), Window.partitionBy(*by, "date"), long_short, gross, net))
    return water_fill(t, cap, gross, net, long_short, by)


WEEKDAYS = {d: i for i, d in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))}


def calendar_schedule(days: Sequence[dt.date], frequency: str = "monthly", day: str = "last", min_gap: int = 1) -> list[dt.date]:
    """Rebalance dates out of a bounded calendar: one a period (first, last, or the last such weekday, else the last), at least ``min_gap`` sessions apart."""
    key = {"daily": lambda d: d, "weekly": lambda d: d.isocalendar()[:2], "monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3)}.get(frequency)
    if key is None:
        raise ValueError(f"frequency must be daily, weekly, monthly or quarterly, not {frequency!r}")
    days = sorted(set(days))
    groups: dict = {}
    for d in days:
        groups.setdefault(key(d), []).append(d)
    wanted = WEEKDAYS.get(day.lower()[:3])
    picks = []
    for g in groups.values():
        match = [d for d in g if d.weekday() == wanted] if wanted is not None else []
        picks.append(g[0] if day.lower() == "first" else (match or g)[-1])
    return spaced(days, picks, min_gap)


def spaced(days: Sequence[dt.date], picks: Sequence[dt.date], min_gap: int) -> list[dt.date]:
    """Picks in order, without those fewer than ``min_gap`` sessions after the one kept before."""
    at, kept = {d: i for i, d in enumerate(days)}, []
    for d in sorted(set(picks)):
        if not kept or at[d] - at[kept[-1]] >= max(1, min_gap):
            kept.append(d)
    return kept


def churn_schedule(autocorr: DataFrame, days: Sequence[dt.date], floor: float = 0.7, min_gap: int = 5, window: int = 5) -> list[dt.date]:
    """Dates on which the trailing mean of the rank autocorrelation falls below ``floor``; one number a date comes to the driver."""
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row per date: a bounded calendar
    low = autocorr.withColumn("_m", F.avg("autocorr").over(w)).where(F.col("_m") < floor).select("date").collect()
    return spaced(days, [r.date for r in low], min_gap)


def shift_schedule(days: Sequence[dt.date], picks: Sequence[dt.date], offset: int = 1) -> dict[dt.date, dt.date]:
    """Signal date to execution date, ``offset`` (at least 1) sessions later; signals too close to the end have none."""
    if offset < 1:
        raise ValueError("an execution offset below 1 looks ahead")
    at = {d: i for i, d in enumerate(days)}
    return {d: days[at[d] + offset] for d in picks if at[d] + offset < len(days)}
