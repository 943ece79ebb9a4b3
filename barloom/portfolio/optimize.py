"""Weights from covariances: shrinkage, risk parity, mean-variance. Dense algebra on one rebalance's names, in pandas groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance shrunk towards its mean variance by the intensity of Ledoit and Wolf (2004).

    Columns with a missing value are NaN in the result; below two rows it is a tiny diagonal.
    """
    n = x.shape[1]
    live = np.isfinite(x).all(axis=0)
    out = np.full((n, n), np.nan)
    if len(x) < 2 or not live.any():
        return np.eye(n) * 1e-6
    z = x[:, live] - x[:, live].mean(axis=0)
    t, k = z.shape
    s = z.T @ z / t
    target = np.trace(s) / k * np.eye(k)
    far = ((s - target) ** 2).sum()
    # Sum over rows of the squared distance of each outer product from s, without forming them.
    noise = ((z**2).sum(axis=1) ** 2).sum() - t * (s**2).sum()
    share = min(max(noise / t**2 / far, 0.0), 1.0) if far > 0 else 0.0
    out[np.ix_(live, live)] = share * target + (1 - share) * s
    return out


def sample_covariance(x: np.ndarray) -> np.ndarray:
    """The unbiased covariance; columns with a missing value are NaN, below two rows it is a tiny diagonal."""
    n = x.shape[1]
    live = np.isfinite(x).all(axis=0)
    out = np.full((n, n), np.nan)
    if len(x) < 2 or not live.any():
        return np.eye(n) * 1e-6
    out[np.ix_(live, live)] = np.atleast_2d(np.cov(x[:, live], rowvar=False))
    return out


#: 'factor_model' has no factor data here and is the shrunk one.
COVARIANCES = {"ledoit_wolf": shrunk_covariance, "factor_model": shrunk_covariance, "sample": sample_covariance}
#: Names of one rebalance whose covariance one task forms: 4,000 squared are 128 MB.
MAX_NAMES = 4_000


def risk_parity(cov: np.ndarray, gross: float = 1.0, steps: int = 500) -> np.ndarray:
    """Long-only weights to which every name contributes the same risk; names without variance get 0."""
    out, var = np.zeros(len(cov)), np.diag(cov)
    ok = np.isfinite(var) & (var > 0)
    if not ok.any():
        return out
    c = cov[np.ix_(ok, ok)]
    w = 1 / np.sqrt(np.diag(c))
    w /= w.sum()
    for _ in range(steps):
        part = w * (c @ w)
        fresh = w * np.sqrt(part.sum() / len(w) / np.maximum(part, 1e-18))
        fresh /= fresh.sum()
        if np.abs(fresh - w).max() < 1e-10:
            w = fresh
            break
        w = fresh
    out[ok] = w * gross
    return out


def project(v: np.ndarray, low: float, high: float, total: float) -> np.ndarray:
    """The nearest point with entries in [low, high] that add up to ``total`` (bisection on the common shift)."""
    total = min(max(total, low * len(v)), high * len(v))
    a, b = (v - high).min(), (v - low).max()
    for _ in range(100):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(v - mid, low, high).sum() > total else (a, mid)
    return np.clip(v - (a + b) / 2, low, high)


def mean_variance(alpha: np.ndarray, cov: np.ndarray, *, aversion: float = 1.0, low: float = 0.0, high: float = 0.05, net: float = 1.0, steps: int = 2000, before: np.ndarray | None = None, max_turnover: float = 1.0) -> np.ndarray:
    """With ``before``, at most ``max_turnover`` is traded one way from it: the optimum, or the point towards it at that bound. The w that maximises alpha'w - aversion/2 w'Cw in a box with a given sum, by accelerated projected gradients; names without alpha or variance get 0."""
    out = np.zeros(len(alpha))
    ok = np.isfinite(alpha) & np.isfinite(np.diag(cov))
    if not ok.any():
        return out
    a, c = alpha[ok], aversion * (cov[np.ix_(ok, ok)] + 1e-8 * np.eye(ok.sum()))
    rate = 1 / max(np.linalg.eigvalsh(c)[-1], 1e-12)
    w = v = project(np.full(len(a), net / len(a)), low, high, net)
    k = 1.0
    for _ in range(steps):
        fresh = project(v + rate * (a - c @ v), low, high, net)
        nxt = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v = fresh + (k - 1) / nxt * (fresh - w)
        done = np.abs(fresh - w).max() < 1e-12
        w, k = fresh, nxt
        if done:
            break
    out[ok] = w
    if before is not None and max_turnover < 1:
        turnover = np.abs(out - before).sum() / 2
        out = out if turnover <= max_turnover else before + (out - before) * (max_turnover / turnover)
    return out


def optimized_weights(signal: DataFrame, returns: DataFrame, method: str = "risk_parity", *, window: int = 60, covariance: str = "ledoit_wolf", **options) -> DataFrame:
    """(date, symbol, weight) for the dates of ``signal``, from the ``window`` sessions of ``returns`` up to each.

    ``method``: 'risk_parity', or 'mean_variance' (also 'mv', and 'bl', which without views is the same). More than ``MAX_NAMES`` names on a date raise.

    Each rebalance is a group of (its symbols x window) numbers; windows are gathered per symbol and date before the
    group is formed, so a group holds one row per symbol.
    """
    from pyspark.sql import Window

    if method not in ("risk_parity", "mean_variance", "mv", "bl") or covariance not in COVARIANCES:
        raise ValueError(f"unknown method {method!r} or covariance {covariance!r}")
    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(window - 1), 0)
    full = returns.withColumn("_r", F.collect_list(F.coalesce("ret", F.lit(float("nan")))).over(past)).select("symbol", "date", "_r")
    rows = signal.select("date", "symbol", "signal").join(full, ["symbol", "date"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("symbol")
        t = max(map(len, g["_r"]), default=0)
        x = np.array([np.r_[np.full(t - len(r), np.nan), r] for r in g["_r"]]).T
        if x.shape[1] > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names in one covariance")
        cov = COVARIANCES[covariance](x)
        alpha = g["signal"].to_numpy(float)
        if method == "risk_parity":
            cov = np.where(np.isfinite(alpha)[:, None] & np.isfinite(alpha)[None, :], cov, np.nan)
            w = risk_parity(cov, **options)
        else:
            w = mean_variance(alpha, cov, **options)
        return pd.DataFrame({"date": g["date"], "symbol": g["symbol"], "weight": w})

    return rows.groupBy("date").applyInPandas(one, "date date, symbol string, weight double")


def covariances(returns: DataFrame, dates, *, window: int = 60, covariance: str = "ledoit_wolf") -> DataFrame:
    """(date, a, b, cov) for a <= b: the covariance of the ``window`` sessions up to each of ``dates``; names with a missing session have none."""
    from pyspark.sql import Window

    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(window - 1), 0)
    full = returns.withColumn("_r", F.collect_list(F.coalesce("ret", F.lit(float("nan")))).over(past)).where(F.col("date").isin(list(dates))).select("date", "symbol", "_r")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("symbol")
        if len(g) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} names in one covariance")
        t = max(map(len, g["_r"]), default=0)
        c = COVARIANCES[covariance](np.array([np.r_[np.full(t - len(r), np.nan), r] for r in g["_r"]]).T)
        i, j = np.triu_indices(len(g))
        s = g["symbol"].to_numpy()
        out = pd.DataFrame({"date": g["date"].iloc[0], "a": s[i], "b": s[j], "cov": c[i, j]})
        return out[out["cov"].notna()]

    return full.groupBy("date").applyInPandas(one, "date date, a string, b string, cov double")
