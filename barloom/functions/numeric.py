"""Arithmetic with one missing value: null. No operator leaves a NaN behind; infinities stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def num(x) -> Column:
    """A literal as a double column; a column as it is."""
    return x if isinstance(x, Column) else F.lit(float(x))


def nn(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = +-inf and 0/0 missing, safe under ANSI; the sign of a zero divisor is not looked at."""
    whole = F.when(b != 0, b)
    return F.when(b == 0, F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))).otherwise(nn(a / whole))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def only_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def truth(c: Column) -> Column:
    """A condition as 1.0, 0.0 or missing."""
    return c.cast("double")


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; missing below two pairs or without variance (``corr`` would raise)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    ok = (sx > 0) & (sy > 0) & ~flat
    return F.when(ok, F.covar_pop(x, y) / F.when(ok, sx * sy))
