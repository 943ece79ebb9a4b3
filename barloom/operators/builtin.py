"""The built-in operators as Spark columns. Importing this module registers them.

``ctx.window(key, make)`` gives a helper column computed over a window: all helpers of one axis are
computed in one pass, and equal ones once. What an operator returns is a plain expression over helpers.
Time-series windows are strict: a missing value in the window makes the result missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import ieee_div, nn, num, truth
from barloom.operators.registry import operator

MAX_DOUBLE = 1.7976931348623157e308

# --- arithmetic, comparison, logic


@operator("add", 2)
def _add(ctx, a, b):
    return nn(num(a) + num(b))


@operator("sub", 2)
def _sub(ctx, a, b):
    return nn(num(a) - num(b))


@operator("mul", 2)
def _mul(ctx, a, b):
    return nn(num(a) * num(b))


@operator("div", 2)
def _div(ctx, a, b):
    """x/0 is infinite, 0/0 missing."""
    return ieee_div(num(a), num(b))


@operator("neg", 1)
def _neg(ctx, a):
    return -num(a)


for _name, _compare in {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}.items():
    operator(_name, 2, doc="1.0 or 0.0; missing if either side is")(lambda ctx, a, b, _c=_compare: truth(_c(num(a), num(b))))


def _set(x: Column) -> Column:
    return F.coalesce(x != 0, F.lit(False))


@operator("or", 2)
def _or(ctx, a, b):
    """Missing counts as false; the result is missing only if both are."""
    a, b = num(a), num(b)
    return F.when(a.isNotNull() | b.isNotNull(), truth(_set(a) | _set(b)))


@operator("and", 2)
def _and(ctx, a, b):
    """Missing counts as false; the result is missing only if both are."""
    a, b = num(a), num(b)
    return F.when(a.isNotNull() | b.isNotNull(), truth(_set(a) & _set(b)))


@operator("not", 1)
def _not(ctx, a):
    return truth(num(a) == 0)


# --- element-wise mathematics


@operator("abs", 1)
def _abs(ctx, x):
    return F.abs(num(x))


@operator("log", 1)
def _log(ctx, x):
    x = num(x)
    return F.when(x > 0, F.ln(F.when(x > 0, x)))


@operator("sign", 1)
def _sign(ctx, x):
    return F.signum(num(x))


@operator("sqrt", 1)
def _sqrt(ctx, x):
    x = num(x)
    return F.when(x >= 0, F.sqrt(F.when(x >= 0, x)))


@operator("signed_power", 2)
def _signed_power(ctx, x, e):
    x = num(x)
    return nn(F.signum(x) * F.pow(F.abs(x), num(e)))


@operator("pow", 2)
def _pow(ctx, x, e):
    return nn(F.pow(num(x), num(e)))


@operator("clip", 3)
def _clip(ctx, x, low, high):
    x = num(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, num(high)), num(low)))


@operator("elem_min", 2)
def _elem_min(ctx, x, y):
    x, y = num(x), num(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))


@operator("elem_max", 2)
def _elem_max(ctx, x, y):
    x, y = num(x), num(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


@operator("where", 3)
def _where(ctx, c, a, b):
    c = num(c)
    return F.when(c.isNull(), None).when(c != 0, num(a)).otherwise(num(b))


@operator("safe_div", 2, 3)
def _safe_div(ctx, a, b, fill=0):
    """``fill`` wherever the divisor is zero, even if the dividend is missing."""
    a, b = num(a), num(b)
    return F.when(b == 0, num(fill)).otherwise(nn(a / F.when(b != 0, b)))


@operator("sigmoid", 1)
def _sigmoid(ctx, x):
    return 1 / (1 + F.exp(-num(x)))



# --- windows along time


def _days(d, least: int = 1) -> int:
    d = math.floor(d)
    if d < least:
        raise ValueError(f"the window must be at least {least}, not {d}")
    return d


class Past:
    """Helpers over the last ``d`` bars of a series."""

    def __init__(self, ctx, x: Column, d: int):
        self.ctx, self.x, self.d = ctx, num(x), d
        self.frame = ctx.by_symbol.rowsBetween(-(d - 1), 0)
        self.key = (str(self.x._jc.toString()), d)

    def agg(self, name: str, f) -> Column:
        return self.ctx.window((name, *self.key), lambda: f(self.x).over(self.frame))

    @property
    def full(self) -> Column:
        """No value of the window is missing: the last gap lies at least ``d`` bars back. One running helper serves all windows of a series."""
        gap = self.ctx.window(("gap", self.key[0]), lambda: F.last(F.when(self.x.isNull(), self.ctx.bar_no), ignorenulls=True).over(self.ctx.by_symbol.rowsBetween(Window.unboundedPreceding, 0)))
        return self.ctx.bar_no - F.coalesce(gap, F.lit(-1)) >= self.d

    @property
    def values(self) -> Column:
        """The window's values, oldest first; only meaningful under ``full``."""
        return self.agg("list", F.collect_list)

    def strict(self, value: Column) -> Column:
        return F.when(self.full, nn(value))

    def spread(self) -> Column:
        """Whether the window's values differ (an exact test, unlike a variance near zero)."""
        return self.agg("min", F.min) < self.agg("max", F.max)


def _lagged(ctx, x, d: int) -> Column:
    x = num(x)
    if d < 0:
        raise ValueError(f"a delay of {d} would look ahead")
    return x if d == 0 else ctx.window(("lag", str(x._jc.toString()), d), lambda: F.lag(x, d).over(ctx.by_symbol))


@operator("ts_delay", 2, axis="ts", window=True)
def _ts_delay(ctx, x, d):
    return _lagged(ctx, x, d)


@operator("ts_delta", 2, axis="ts", window=True)
def _ts_delta(ctx, x, d):
    return nn(num(x) - _lagged(ctx, x, d))


@operator("ts_returns", 2, axis="ts", window=True)
def _ts_returns(ctx, x, d):
    before = _lagged(ctx, x, d)
    return F.when(before != 0, nn(num(x) / F.when(before != 0, before) - 1))


@operator("ts_log_returns", 2, axis="ts", window=True)
def _ts_log_returns(ctx, x, d):
    ratio = ieee_div(num(x), _lagged(ctx, x, d))
    return F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio)))


def _rolling(name: str, agg, least: int = 1) -> None:
    def build(ctx, x, d):
        p = Past(ctx, x, _days(d, least))
        return p.strict(p.agg(name, agg))

    operator(name, 2, axis="ts", window=True, doc=f"strict rolling {name[3:]} of the last d bars")(build)


for _name, _agg, _least in (("ts_mean", F.avg, 1), ("ts_sum", F.sum, 1), ("ts_product", F.product, 1), ("ts_std", F.stddev_samp, 2), ("ts_var", F.var_samp, 2), ("ts_min", F.min, 1), ("ts_max", F.max, 1)):
    _rolling(_name, _agg, _least)


@operator("ts_skew", 2, axis="ts", window=True)
def _ts_skew(ctx, x, d):
    """Population skewness; missing for a constant window."""
    p = Past(ctx, x, _days(d))
    return F.when(p.spread(), p.strict(p.agg("skew", F.skewness)))


@operator("ts_kurt", 2, axis="ts", window=True)
def _ts_kurt(ctx, x, d):
    """Population excess kurtosis; missing for a constant window."""
    p = Past(ctx, x, _days(d))
    return F.when(p.spread(), p.strict(p.agg("kurt", F.kurtosis)))


def _days_ago(best):
    def build(ctx, x, d):
        """Bars ago of the extreme; the oldest of equal ones."""
        p = Past(ctx, x, _days(d))
        return p.strict((F.lit(p.d) - F.array_position(p.values, best(p.values))).cast("double"))

    return build


operator("ts_argmax", 2, axis="ts", window=True)(_days_ago(F.array_max))
operator("ts_argmin", 2, axis="ts", window=True)(_days_ago(F.array_min))


@operator("ts_rank", 2, axis="ts", window=True)
def _ts_rank(ctx, x, d):
    """Share of the other values in the window that are not above the newest."""
    p = Past(ctx, x, _days(d, 2))
    return p.strict((F.size(F.filter(p.values, lambda v: v <= p.x)) - 1) / (p.d - 1))


@operator("ts_decay_linear", 2, axis="ts", window=True)
def _ts_decay_linear(ctx, x, d):
    """Mean with weights 1 (oldest) to d (newest)."""
    p = Past(ctx, x, _days(d))
    weighted = F.zip_with(p.values, F.sequence(F.lit(1), F.lit(p.d)), lambda v, k: v * k)
    return p.strict(F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v) / (p.d * (p.d + 1) / 2))


def _ema(ctx, x, d):
    """The fold s(1 - a) + va over the present values, in blocks of running sums: a row keeps three numbers, however long the window.

    Within a block of n values the sum of v(1 - a)^-i is scaled back at each row; the blocks before enter through the last two ends. n is
    such that what lies further back weighs less than 1e-18.
    """
    d = _days(d)
    alpha = 2 / (d + 1)
    x = num(x)
    if alpha == 1:
        return x
    keep = 1 - alpha
    n = math.ceil(math.log(1e-9) / math.log(keep))
    name = str(x._jc.toString())
    own = Window.partitionBy("symbol", x.isNull()).orderBy("date")
    k = ctx.window(("ema-k", name), lambda: F.row_number().over(own) - 1)
    block, place = F.floor(k / n), (k % n).cast("double")
    weight = F.when(k == 0, 1.0).otherwise(alpha) * F.pow(F.lit(keep), -place)
    inside = Window.partitionBy("symbol", x.isNull(), block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    here = ctx.window(("ema-sum", name, d), lambda: F.sum(x * weight).over(inside), 1) * F.pow(F.lit(keep), place)
    before, at_end = own.rowsBetween(Window.unboundedPreceding, -1), place == n - 1
    last = ctx.window(("ema-end", name, d), lambda: F.last(F.when(at_end, here), ignorenulls=True).over(before), 2)
    ends = ctx.window(("ema-ends", name, d), lambda: F.last(F.when(at_end, here + keep**n * F.coalesce(last, F.lit(0.0))), ignorenulls=True).over(before), 3)
    return F.when(x.isNotNull(), here + F.pow(F.lit(keep), place + 1) * F.coalesce(ends, F.lit(0.0)))


@operator("ema_here", 2, axis="ts", window=True)
def _ema_here(ctx, x, d):
    """The exponential mean on bars that have a value, else missing."""
    return _ema(ctx, x, d)


def _lowered(name: str):
    def build(ctx, *args):
        raise AssertionError(f"{name} is rewritten before columns are built")

    return build


operator("ts_ema", 2, axis="ts", window=True, doc="exponential mean with 2/(d+1), seeded with the first value; a missing bar repeats the last result")(_lowered("ts_ema"))
operator("ts_dema", 2, axis="ts", window=True, doc="2 ema(x) - ema(ema(x))")(_lowered("ts_dema"))
operator("fillna", 1, 2, doc="'zero' (infinities become the largest doubles), 'median' of the date, or 'ffill' of the symbol")(_lowered("fillna"))


@operator("ts_med", 2, axis="ts", window=True)
def _ts_med(ctx, x, d):
    p = Past(ctx, x, _days(d))
    return p.strict(p.agg("median", lambda c: F.percentile(c, 0.5)))


@operator("ts_quantile", 3, axis="ts")
def _ts_quantile(ctx, x, d, q):
    """Quantile with linear interpolation; the window is the second argument."""
    p = Past(ctx, x, _days(d))
    return p.strict(p.agg(f"quantile{q}", lambda c: F.percentile(c, float(q))))


@operator("ts_mad", 2, axis="ts", window=True)
def _ts_mad(ctx, x, d):
    """Mean absolute deviation from the mean."""
    p = Past(ctx, x, _days(d))
    m = p.agg("ts_mean", F.avg)
    return p.strict(F.aggregate(p.values, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / p.d)


@operator("ts_count", 2, axis="ts", window=True)
def _ts_count(ctx, x, d):
    """Bars of the window that are not zero."""
    p = Past(ctx, x, _days(d))
    return p.strict(p.agg("nonzero", lambda c: F.sum((c != 0).cast("double"))))


class Pair(Past):
    """Helpers over the last ``d`` bars of two series; missing in either counts."""

    def __init__(self, ctx, x, y, d):
        super().__init__(ctx, F.when(num(y).isNotNull(), num(x)), d)
        self.y = F.when(num(x).isNotNull(), num(y))
        self.other = Past(ctx, self.y, d)
        self.both = (self.key, self.other.key)

    def pair(self, name: str, f) -> Column:
        return self.ctx.window((name, self.both), lambda: f(self.x, self.y).over(self.frame))


@operator("ts_cov", 3, axis="ts", window=True)
def _ts_cov(ctx, x, y, d):
    p = Pair(ctx, x, y, _days(d, 2))
    return p.strict(p.pair("cov", F.covar_samp))


@operator("ts_corr", 3, axis="ts", window=True)
def _ts_corr(ctx, x, y, d):
    """Pearson correlation; missing without variance (``corr`` would raise)."""
    p = Pair(ctx, x, y, _days(d))
    if p.d < 2:
        return F.when(p.full, None).cast("double")
    scale = p.agg("std", F.stddev_samp) * p.other.agg("std", F.stddev_samp)
    ok = p.spread() & p.other.spread() & (scale > 0)
    return p.strict(F.when(ok, p.pair("cov", F.covar_samp) / F.when(ok, scale)))


def _slope(p: Past) -> Column:
    return p.ctx.window(("slope", *p.key), lambda: F.regr_slope(p.x, p.ctx.bar_no).over(p.frame))


@operator("ts_slope", 2, axis="ts", window=True)
def _ts_slope(ctx, x, d):
    """Least-squares slope against the bar number."""
    p = Past(ctx, x, _days(d, 2))
    return p.strict(_slope(p))


@operator("ts_resi", 2, axis="ts", window=True)
def _ts_resi(ctx, x, d):
    """The newest bar's residual from the line of ``ts_slope``."""
    p = Past(ctx, x, _days(d, 2))
    return p.strict(p.x - (p.agg("ts_mean", F.avg) + _slope(p) * ((p.d - 1) / 2)))


@operator("ts_rsquare", 2, axis="ts", window=True)
def _ts_rsquare(ctx, x, d):
    """Share of variance the line explains; missing for a constant window."""
    p = Past(ctx, x, _days(d, 2))
    r2 = ctx.window(("r2", *p.key), lambda: F.regr_r2(p.x, ctx.bar_no).over(p.frame))
    return F.when(p.spread(), p.strict(r2))


# --- across the symbols of a date


class Across:
    """Helpers over the symbols of a date, or of a date and a group."""

    def __init__(self, ctx, x, group: str | None = None):
        self.ctx, self.x = ctx, num(x)
        self.by = ["date"] if group is None else ["date", ctx.group(group)]
        self.all = Window.partitionBy(*self.by)
        self.key = (str(self.x._jc.toString()), group)

    def agg(self, name: str, f) -> Column:
        return self.ctx.window(("cs", name, *self.key), lambda: f(self.x).over(self.all))

    def here(self, value: Column) -> Column:
        return F.when(self.x.isNotNull(), nn(value))

    def rank(self) -> Column:
        """Average rank in [0, 1]; alone: one half."""
        # Values below and values up to this one, from one sort: their mean is the average rank of ties.
        ordered = self.all.orderBy(self.x.asc_nulls_last())
        first = self.ctx.window(("cs", "rank", *self.key), lambda: F.rank().over(ordered))
        upto = self.ctx.window(("cs", "upto", *self.key), lambda: F.count(self.x).over(ordered.rangeBetween(Window.unboundedPreceding, 0)))
        n = self.agg("count", F.count)
        return F.when(self.x.isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise(((first - 1) + (upto - 1)) / 2 / F.when(n > 1, n - 1)))


@operator("cs_rank", 1, axis="cs")
def _cs_rank(ctx, x):
    return Across(ctx, x).rank()


@operator("cs_zscore", 1, axis="cs")
def _cs_zscore(ctx, x):
    """Deviation from the date's mean in sample deviations; missing without any."""
    a = Across(ctx, x)
    sd = a.agg("std", F.stddev_samp)
    ok = (sd > 0) & (a.agg("min", F.min) < a.agg("max", F.max))
    return a.here(F.when(ok, (a.x - a.agg("mean", F.avg)) / F.when(ok, sd)))


@operator("cs_demean", 1, axis="cs")
def _cs_demean(ctx, x):
    a = Across(ctx, x)
    return a.here(a.x - a.agg("mean", F.avg))


@operator("cs_scale", 1, 2, axis="cs")
def _cs_scale(ctx, x, total=1):
    """Absolute values add up to ``total``."""
    a = Across(ctx, x)
    s = a.agg("gross", lambda c: F.sum(F.abs(c)))
    return a.here(F.when(s > 0, a.x * float(total) / F.when(s > 0, s)))


@operator("cs_winsorize", 2, axis="cs")
def _cs_winsorize(ctx, x, p):
    """Clipped to the date's p and 1-p quantiles."""
    if not 0 < p < 0.5:
        raise ValueError(f"p must lie between 0 and 0.5, not {p}")
    a = Across(ctx, x)
    low, high = (a.agg(f"q{q}", lambda c, q=q: F.percentile(c, q)) for q in (float(p), 1 - float(p)))
    return a.here(F.greatest(F.least(a.x, high), low))


@operator("cs_neutralize", 2, axis="cs", group=1)
def _cs_neutralize(ctx, x, group):
    """Deviation from the mean of the date's group."""
    a = Across(ctx, x, group)
    return a.here(a.x - a.agg("mean", F.avg))


@operator("cs_group_rank", 2, axis="cs", group=1)
def _cs_group_rank(ctx, x, group):
    return Across(ctx, x, group).rank()


@operator("cs_group_mean", 2, axis="cs", group=1)
def _cs_group_mean(ctx, x, group):
    """The group's mean, also for members that miss a value."""
    return Across(ctx, x, group).agg("mean", F.avg)


@operator("fill_zero", 1)
def _fill_zero(ctx, x):
    x = F.coalesce(num(x), F.lit(0.0))
    return F.greatest(F.least(x, F.lit(MAX_DOUBLE)), F.lit(-MAX_DOUBLE))


@operator("fill_median", 1, axis="cs")
def _fill_median(ctx, x):
    a = Across(ctx, x)
    return F.coalesce(a.x, a.agg("median", lambda c: F.percentile(c, 0.5)))


@operator("fill_forward", 1, axis="ts")
def _fill_forward(ctx, x):
    x = num(x)
    return ctx.window(("ffill", str(x._jc.toString())), lambda: F.last(x, ignorenulls=True).over(ctx.by_symbol.rowsBetween(Window.unboundedPreceding, 0)))
