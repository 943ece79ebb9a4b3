"""Implausible readings per source: spikes, stuck values and impossible ones, by a hidden Markov model.

A source is a symbol at a vendor. Its readings, in order of their dates, are emissions of the hidden
states normal, spike, stuck and out of range:

* normal: the residual against the bars around it follows a Student distribution with the source's own scale, and a
  value seldom equals the one of the preceding bar;
* spike: any residual is as likely as any other;
* stuck: the value equals the one of the preceding bar;
* out of range: the value breaks a hard bound (zero or negative).

Forward and backward probabilities give each reading's posterior; exact checks follow (hard bounds, the length
of a run).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.curation.units import vendor_of
from barloom.runtime import broadcast_if_small, norm_key, stage, staged_small

NORMAL, SPIKE, STUCK, OUT = range(4)
START = np.log([0.99, 0.004, 0.004, 0.002])
MOVE = np.log(
    [
        [0.990, 0.004, 0.004, 0.002],
        [0.950, 0.040, 0.006, 0.004],
        [0.120, 0.006, 0.870, 0.004],
        [0.950, 0.010, 0.010, 0.030],
    ]
)
#: Degrees of freedom of the normal state's residual, the range over which a spike's residual is even, and chances of a repeat.
FREEDOM, SPIKE_RANGE, REPEAT_NORMAL, REPEAT_STUCK = 12.0, 400.0, 0.02, 0.97


def posteriors(z: np.ndarray, repeat: np.ndarray, broken: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Posterior of the four states for each reading; ``source`` numbers the sequences (sorted, contiguous).

    A NaN residual tells nothing between normal and spike.
    """
    n = len(z)
    if not n:
        return np.zeros((0, 4))
    a = np.abs(np.nan_to_num(z))
    t_norm = math.lgamma((FREEDOM + 1) / 2) - math.lgamma(FREEDOM / 2) - 0.5 * math.log(FREEDOM * math.pi)
    student = t_norm - (FREEDOM + 1) / 2 * np.log1p(a * a / FREEDOM)
    rep = lambda p: np.where(repeat, math.log(p), math.log(1 - p))
    e = np.empty((n, 4))
    e[:, NORMAL] = student + rep(REPEAT_NORMAL)
    e[:, SPIKE] = np.where(np.isnan(z), student, -math.log(SPIKE_RANGE)) + rep(REPEAT_NORMAL)
    e[:, STUCK] = student + rep(REPEAT_STUCK)
    e[:, OUT] = -60.0
    e[broken] = [-60.0, -60.0, -60.0, 0.0]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
    length = np.diff(np.r_[first, n])
    out = np.empty((n, 4))
    # Sequences of like length are walked together, so padding at most doubles the work, however long the longest is.
    kind = np.ceil(np.log2(length)).astype(int)
    for k in np.unique(kind):
        some = np.flatnonzero(kind == k)
        size = length[some]
        rows = np.repeat(first[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[rows] = _walk(e[rows], size)
    return out


def _walk(e: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Forward and backward probabilities of sequences that lie one after the other in ``e``, all walked at once."""
    n, first = len(e), np.cumsum(length) - length
    # Longest sequences first, so that those still going on at a step are the first ones.
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(first), int)
    place[order] = np.arange(len(first))
    seq = np.repeat(place, length)
    pos = np.arange(n) - np.repeat(first, length)
    t = int(length.max())
    alive = np.searchsorted(-length[order], -np.arange(t), side="left")  # sequences longer than the step
    em = np.ones((t, len(first), 4))
    em[pos, seq] = e
    move, fwd, bwd = np.exp(MOVE), np.ones((t, len(first), 4)), np.ones((t, len(first), 4))
    fwd[0] = np.exp(START) * em[0]
    fwd[0] /= fwd[0].sum(axis=1, keepdims=True)
    for k in range(1, t):
        now = (fwd[k - 1, : alive[k]] @ move) * em[k, : alive[k]]
        fwd[k, : alive[k]] = now / now.sum(axis=1, keepdims=True)
    for k in range(t - 2, -1, -1):
        now = (em[k + 1, : alive[k + 1]] * bwd[k + 1, : alive[k + 1]]) @ move.T
        bwd[k, : alive[k + 1]] = now / now.sum(axis=1, keepdims=True)
    post = (fwd * bwd)[pos, seq]
    return post / post.sum(axis=1, keepdims=True)


def _around(level: np.ndarray, group: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Median of the k levels before and after each place within its group (NaN where there are none)."""
    n = len(level)
    out = []
    for sign in (1, -1):
        cols = np.full((n, k), np.nan)
        for i in range(1, k + 1):
            if i >= n:
                break
            here, there = (slice(i, None), slice(None, -i)) if sign == 1 else (slice(None, -i), slice(i, None))
            cols[here, i - 1] = np.where(group[here] == group[there], level[there], np.nan)
        out.append(np.full(n, np.nan))
        some = ~np.isnan(cols).all(axis=1)
        out[-1][some] = np.nanmedian(cols[some], axis=1)
    return out[0], out[1]


def _least(*devs: np.ndarray) -> np.ndarray:
    """The smallest deviation if all known ones point the same way, else 0; NaN if none is known."""
    d = np.vstack(devs)
    known = ~np.isnan(d)
    some = known.any(axis=0)
    up, down = np.where(known, d > 0, True).all(axis=0), np.where(known, d < 0, True).all(axis=0)
    size = np.where(known, np.abs(d), np.inf).min(axis=0)
    return np.where(some, np.where(up, size, np.where(down, -size, 0.0)), np.nan)


def score_field(g: pd.DataFrame, value: str, field: str, usual: np.ndarray | None = None, spread: np.ndarray | None = None) -> pd.DataFrame:
    """Posteriors of one field of the distinct readings of some symbols: key columns, field, p_spike, p_stuck, p_out, run, run_first."""
    g = g[g[value].notna()]
    if not len(g):
        return pd.DataFrame(columns=["symbol", "vendor", "day", "value", "z", "p_spike", "p_stuck", "p_out", "run", "run_first"])
    g = g.drop_duplicates(["symbol", "vendor", "day", value])
    v = g[value].to_numpy(float)
    good = v > 0
    level = np.log(np.where(good, v, np.nan))
    g = g.assign(level=level, good=good)
    # What the symbol's bars say, one level a date, whoever reported it.
    bars = g[g.good].groupby(["symbol", "day"], sort=True)["level"].median().reset_index()
    code = pd.factorize(bars.symbol)[0]
    bars["before"], bars["after"] = _around(bars.level.to_numpy(), code)
    step = np.where(np.r_[False, code[1:] == code[:-1]], np.abs(np.r_[0.0, np.diff(bars.level.to_numpy())]), np.nan)
    bars["step"] = step
    g = g.merge(bars[["symbol", "day", "before", "after"]], on=["symbol", "day"], how="left")
    x = g.level.to_numpy()
    if usual is None:
        scale = bars.groupby("symbol")["step"].median() * 1.4826
        sd = np.maximum(np.nan_to_num(g.symbol.map(scale).to_numpy(float), nan=0.02), 0.003)
        z = _least(x - g.before.to_numpy(), x - g.after.to_numpy()) / sd
    else:
        sd = np.maximum(np.nan_to_num(g[spread].to_numpy(float), nan=0.5), 0.1)
        z = _least(x - g[usual].to_numpy(float), x - g.before.to_numpy(), x - g.after.to_numpy()) / sd
    # Runs: the value stands on successive bar dates of the source.
    g = g.assign(z=z)
    g["bar"] = g.groupby(["symbol", "vendor"])["day"].rank(method="dense").astype(int)
    g = g.sort_values(["symbol", "vendor", value, "bar"], kind="stable")
    same = (g.symbol == g.symbol.shift()) & (g.vendor == g.vendor.shift()) & (g[value] == g[value].shift())
    repeat = same & (g.bar - g.bar.shift() == 1)
    run_id = (~repeat).cumsum()
    g["repeat"], g["run"], g["run_first"] = repeat, np.bincount(run_id)[run_id], ~repeat
    g = g.sort_values(["symbol", "vendor", "day", value], kind="stable")
    source = pd.factorize(pd.MultiIndex.from_frame(g[["symbol", "vendor"]]))[0]
    post = posteriors(g.z.to_numpy(float), g.repeat.to_numpy(bool), ~g.good.to_numpy(bool), source)
    return pd.DataFrame({"symbol": g.symbol, "vendor": g.vendor, "day": g.day, "value": g[value], "z": g.z, "p_spike": post[:, SPIKE], "p_stuck": post[:, STUCK], "p_out": post[:, OUT], "run": g.run, "run_first": g.run_first})


def _score(min_run: int):
    def score(g: pd.DataFrame) -> pd.DataFrame:
        # Numbers sort and group faster than names.
        (sym, symbols), (ven, vendors) = pd.factorize(g["symbol"]), pd.factorize(g["vendor"])
        g = g.assign(symbol=sym, vendor=ven)
        parts = []
        for field, frame in (("close", score_field(g, "close", "close")), ("volume", score_field(g, "volume", "volume", "usual", "spread"))):
            stuck = (frame.p_stuck > 0.5) & (frame.run >= min_run) & ~frame.run_first.astype(bool)
            state = np.where(frame.p_out > 0.5, "out_of_range", np.where(stuck, "stuck", np.where(frame.p_spike > 0.5, "spike", "")))
            # A spike and a repeat of it are told apart by the run, not by the state that won.
            parts.append(frame.assign(field_name=field, state=state)[["symbol", "vendor", "day", "value", "field_name", "state", "z"]][state != ""])
        out = pd.concat(parts, ignore_index=True)
        return out.assign(symbol=symbols.to_numpy()[out["symbol"].to_numpy(int)], vendor=vendors.to_numpy()[out["vendor"].to_numpy(int)])

    return score


def flag_implausible(prices: DataFrame, units: DataFrame, *, min_run: int = 6, rows_per_group: int = 100_000) -> DataFrame:
    """(row_id, field_name, state): the readings of close and volume that cannot be true for their symbol.

    ``prices``: row_id, date, symbol, close, volume, source_id; ``units``: (vendor, day, power) for volumes.
    ``state`` is 'out_of_range' (zero or negative), 'stuck' (a run over at least ``min_run`` successive bar dates of a source,
    without its first date) or 'spike'. Null and NaN values are never flagged and do not break a run. Rows with a null symbol or date
    have no neighbours and get no verdict but for the hard bound. Repeated deliveries share their reading's verdict. Dates with
    too few neighbours are judged by those there are.

    Readings are first reduced to distinct (symbol, vendor, date, values), combined before the shuffle:
    a symbol with a third of all rows then has as many readings as dates, vendors and corrections. Groups of symbols of about
    ``rows_per_group`` readings go to the model; its verdicts, keyed by value, find the rows again.
    """
    p = prices.select("row_id", norm_key(F.col("symbol")).alias("symbol"), vendor_of(F.col("source_id")).alias("vendor"), F.col("date").alias("day"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    p = p.withColumn("close", clean("close")).withColumn("volume", clean("volume"))
    p = p.join(broadcast_if_small(units.select("vendor", "day", "power")), ["vendor", "day"], "left")
    p = p.withColumn("volume", F.col("volume") * F.pow(F.lit(10.0), F.coalesce("power", F.lit(0)))).drop("power")
    readings = p.where("symbol is not null and day is not null").select("symbol", "vendor", "day", "close", "volume").distinct()
    log_volume = F.when(F.col("volume") > 0, F.ln("volume"))
    usual = p.where("symbol is not null").groupBy("symbol").agg(F.percentile_approx(log_volume, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"), F.count(F.lit(1)).alias("n"))
    usual = stage(usual.select("symbol", F.col("q")[1].alias("usual"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread"), "n"), "usual")
    n_groups = max(8, math.ceil((usual.agg(F.sum("n").alias("n")).first().n or 0) / rows_per_group))
    grouped = readings.join(broadcast_if_small(usual.drop("n"), 1_000_000), "symbol").withColumns({"_g": F.pmod(F.xxhash64("symbol"), F.lit(n_groups)), "day": F.unix_date("day")})
    flags = grouped.groupBy("_g").applyInPandas(_score(min_run), "symbol string, vendor string, day int, value double, field_name string, state string, z double").withColumn("day", F.date_from_unix_date("day"))
    row = p.select("row_id", "symbol", "vendor", "day", F.explode(F.array(F.struct(F.lit("close").alias("field_name"), F.col("close").alias("value")), F.struct(F.lit("volume").alias("field_name"), F.col("volume").alias("value")))).alias("_v")).select("row_id", "symbol", "vendor", "day", "_v.*").where("value is not null")
    hit = row.join(staged_small(flags.select("symbol", "vendor", "day", "value", "field_name", "state"), "flags"), ["symbol", "vendor", "day", "value", "field_name"], "left")
    # Rows without symbol or date have met no verdict; only the hard bound holds for them.
    state = F.coalesce("state", F.when((F.col("symbol").isNull() | F.col("day").isNull()) & (F.col("value") <= 0), "out_of_range"))
    return hit.select("row_id", "field_name", state.alias("state")).where("state is not null")
