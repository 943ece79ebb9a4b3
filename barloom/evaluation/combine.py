"""Combining factors under a train, validation and test protocol.

Everything that touches the panel is aggregated in Spark: coefficients per date, and the Gram matrix of all factors with the
returns. Only K numbers per date or K x K numbers in all reach the driver, where weights are solved.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.evaluation.metrics import evaluate_ic, ic_series, joint
from barloom.functions.numeric import finite, only_finite

LINEAR = ("equal", "ic_weight", "icir_weight", "ols", "ridge", "nnls", "max_icir")
LEARNED = ("linear", "lasso", "elastic_net", "random_forest", "gbrt")
#: Known names without a distributed counterpart here.
UNAVAILABLE = ("extra_trees", "hist_gbrt", "mlp", "lightgbm", "xgboost")
AUTO = ("equal", "ic_weight", "icir_weight", "ridge", "max_icir")


@dataclass(frozen=True)
class Splits:
    train: tuple[dt.date, dt.date]
    validation: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]
    embargo: int = 0


def methods() -> dict[str, bool]:
    """Names of all methods and whether they can be used."""
    return {**dict.fromkeys((*LINEAR, *LEARNED), True), **dict.fromkeys(UNAVAILABLE, False)}


def standardize(long: DataFrame, how: str = "zscore", by: str = "factor_id") -> DataFrame:
    """Each factor on each date: 'zscore' by the population deviation (0 on a constant date), or 'rank' to [-1, 1] (0 alone)."""
    keys = [by, "date"]
    w, v = Window.partitionBy(*keys), only_finite(F.col("value"))
    df = long.withColumn("value", v).repartition(*keys)
    if how == "zscore":
        sd = F.stddev_pop("value").over(w)
        flat = (F.min("value").over(w) == F.max("value").over(w)) | ~(sd > 0)
        z = F.when(F.col("value").isNotNull(), F.when(flat, F.lit(0.0)).otherwise((F.col("value") - F.avg("value").over(w)) / F.when(~flat, sd)))
    elif how == "rank":
        n = F.count("value").over(w)
        ordered = w.orderBy(F.col("value").asc_nulls_last())
        twice = F.rank().over(ordered) - 1 + F.count("value").over(ordered.rangeBetween(Window.unboundedPreceding, 0)) - 1
        z = F.when(F.col("value").isNotNull(), F.when(n == 1, F.lit(0.0)).otherwise(twice / F.when(n > 1, n - 1) - 1))
    else:
        raise ValueError(f"standardize by zscore or rank, not {how!r}")
    return df.withColumn("value", z)


def split_of(dates: DataFrame, splits: Splits) -> DataFrame:
    """(date, split): 'train', 'validation' or 'test' by inclusive windows; the last ``embargo`` dates of the first two are left out."""
    d = dates.select("date").distinct()
    which = F.lit(None).cast("string")
    for name in ("test", "validation", "train"):
        a, b = getattr(splits, name)
        which = F.when(F.col("date").between(a, b), name).otherwise(which)
    d = d.withColumn("split", which).where("split is not null")
    last = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("date")))
    return d.withColumn("_last", last).where((F.col("split") == "test") | (F.col("_last") > splits.embargo)).drop("_last")


def wide(long: DataFrame, names: Sequence[str], by: str = "factor_id") -> DataFrame:
    """(symbol, date, f0, f1, ...) of the named factors, one shuffle."""
    return long.groupBy("symbol", "date").agg(*[F.max(F.when(F.col(by) == n, F.col("value"))).alias(f"f{i}") for i, n in enumerate(names)])


def gram(table: DataFrame, k: int, y: str = "fwd") -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, rows) over rows where all factors and the return are finite; one aggregation, K(K+3)/2 numbers."""
    xs = [f"f{i}" for i in range(k)]
    ok = finite(F.col(y))
    for x in xs:
        ok = ok & finite(F.col(x))
    sums = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(x) * F.col(y)).alias(f"b{i}") for i, x in enumerate(xs)]
    r = table.where(ok).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if not r.n:
        return np.zeros((k, k)), np.zeros(k), 0
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
    return g, np.array([r[f"b{i}"] for i in range(k)]), r.n


def nnls(g: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """The non-negative w that minimises w'Gw - 2b'w, by an active set on the Gram matrix."""
    k = len(b)
    w, free = np.zeros(k), np.zeros(k, bool)
    tol = 1e-10 * max(1.0, np.abs(b).max(initial=0))
    for _ in range(steps):
        grad = b - g @ w
        if free.all() or grad[~free].max(initial=-np.inf) <= tol:
            break
        free[np.flatnonzero(~free)[grad[~free].argmax()]] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(g[np.ix_(free, free)], b[free], rcond=None)[0]
            if not free.any() or s[free].min() > 0:
                break
            bad = free & (s <= 0)
            step = (w[bad] / np.maximum(w[bad] - s[bad], 1e-300)).min()
            w = w + step * (s - w)
            free &= w > 1e-12
            w[~free] = 0
        w = s
    return w


def _scaled(w: np.ndarray) -> np.ndarray:
    """Absolute weights add up to one; weights that say nothing become equal ones."""
    total = np.abs(w).sum()
    return w / total if np.isfinite(total) and total > 1e-12 else np.full(len(w), 1 / max(1, len(w)))


def solve(method: str, ic: np.ndarray, g: np.ndarray, b: np.ndarray, n: int, ridge: float = 1.0) -> np.ndarray:
    """Weights of oriented factors. ``ic``: (dates, K) coefficients of the training window, NaN where there is none."""
    k = len(b)
    seen = ~np.isnan(ic)
    n_seen = seen.sum(0)
    mean = np.where(n_seen > 0, np.nansum(ic, 0) / np.maximum(n_seen, 1), 0.0)
    if method == "equal":
        w = np.ones(k)
    elif method == "ic_weight":
        w = mean
    elif method == "icir_weight":
        dev = np.where(seen, ic - mean, 0.0)
        sd = np.sqrt((dev**2).sum(0) / np.maximum(n_seen - 1, 1))
        w = np.where((n_seen > 1) & (sd > 0), mean / np.where(sd > 0, sd, 1), 0)
    elif method == "max_icir":
        whole = ic[~np.isnan(ic).any(axis=1)]
        if len(whole) < 3:
            return _scaled(np.ones(k))
        cov = np.atleast_2d(np.cov(whole.T))
        w = np.linalg.pinv(cov + np.eye(k) * 1e-6 * max(np.trace(cov) / k, 1e-12)) @ whole.mean(0)
    elif n <= k:
        w = np.ones(k)
    elif method == "ols":
        w = np.linalg.lstsq(g, b, rcond=None)[0]
    elif method == "ridge":
        w = np.linalg.solve(g + np.eye(k) * ridge * 1e-2 * np.trace(g) / k, b) if np.trace(g) > 0 else np.ones(k)
    elif method == "nnls":
        w = nnls(g, b)
    else:
        raise ValueError(f"unknown method {method!r}")
    return _scaled(w)


def blend(long: DataFrame, weights: Mapping[str, float], by: str = "factor_id") -> DataFrame:
    """(symbol, date, factor): weighted sum over the factors that are there; missing where none is."""
    pairs = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    v = only_finite(F.col("value"))
    return long.where(F.col(by).isin(list(weights))).groupBy("symbol", "date").agg(F.sum(v * pairs[F.col(by)]).alias("factor"))


def _learned(method: str, train: DataFrame, everything: DataFrame, k: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """(symbol, date, factor) predicted by a distributed learner, and its importances."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    gather = VectorAssembler(inputCols=[f"f{i}" for i in range(k)], outputCol="x", handleInvalid="skip")
    kw = {"featuresCol": "x", "labelCol": "fwd", "predictionCol": "factor"}
    learner = {
        "linear": lambda: LinearRegression(**kw),
        "lasso": lambda: LinearRegression(regParam=1e-4, elasticNetParam=1.0, **kw),
        "elastic_net": lambda: LinearRegression(regParam=1e-4, elasticNetParam=0.5, **kw),
        "random_forest": lambda: RandomForestRegressor(numTrees=50, maxDepth=5, seed=seed, **kw),
        "gbrt": lambda: GBTRegressor(maxIter=40, maxDepth=3, seed=seed, **kw),
    }[method]()
    model = learner.fit(gather.transform(train))
    raw = np.abs(model.coefficients.toArray()) if hasattr(model, "coefficients") else model.featureImportances.toArray()
    return model.transform(gather.transform(everything)).select("symbol", "date", "factor"), _scaled(raw)


#: Factors that are combined at once.
MAX_FACTORS = 2_000


def combine(factors: DataFrame, returns: DataFrame, splits: Splits, method: str = "ic_weight", *, names: Sequence[str] | None = None, how: str = "zscore", ridge: float = 1.0, seed: int = 0) -> dict:
    """Fit on the training dates, judge on each window.

    ``factors``: (factor_id, symbol, date, value); ``returns``: (symbol, date, fwd). Factors are standardized by date and turned so
    that their training coefficient is positive. 'auto' fits each of ``AUTO`` and keeps the one with the best validation ICIR; the
    test window plays no part. Returns method, weights, orientation, composite (a DataFrame) and metrics by split.
    """
    if method in UNAVAILABLE:
        raise ValueError(f"{method} is not available here")
    if method != "auto" and method not in (*LINEAR, *LEARNED):
        raise ValueError(f"unknown method {method!r}")
    names = list(names or sorted(r[0] for r in factors.select("factor_id").distinct().limit(MAX_FACTORS + 1).collect()))
    if len(names) > MAX_FACTORS:
        raise ValueError(f"more than {MAX_FACTORS} factors")
    k = len(names)
    dates = F.broadcast(split_of(returns, splits))  # one row per date: a bounded calendar
    z = standardize(factors, how)
    train_long = z.join(dates.where("split = 'train'"), "date").join(returns, ["symbol", "date"])
    daily = ic_series(train_long, "value", "fwd", ["factor_id"]).select("factor_id", "date", "ic").collect()  # K numbers a date
    days = sorted({r.date for r in daily})
    ic = np.full((len(days), k), np.nan)
    at, no = {d: i for i, d in enumerate(days)}, {n: i for i, n in enumerate(names)}
    for r in daily:
        if r.ic is not None and r.factor_id in no:
            ic[at[r.date], no[r.factor_id]] = r.ic
    n_seen = (~np.isnan(ic)).sum(0)
    mean = np.where(n_seen > 0, np.nansum(ic, 0) / np.maximum(n_seen, 1), 0)
    sign = np.where(mean < 0, -1.0, 1.0)
    turned = F.create_map(*[x for n, s in zip(names, sign) for x in (F.lit(n), F.lit(float(s)))])
    z = z.where(F.col("factor_id").isin(names)).withColumn("value", F.col("value") * turned[F.col("factor_id")])
    table = wide(z, names).join(returns, ["symbol", "date"]).join(dates, "date")
    g, b, n = gram(table.where("split = 'train'"), k) if method in ("ols", "ridge", "nnls", "auto") else (np.zeros((k, k)), np.zeros(k), 0)

    def judged(composite: DataFrame) -> dict[str, dict]:
        scored = composite.join(returns, ["symbol", "date"]).join(dates, "date")
        return {r.split: {"ic": r.ic, "icir": r.icir, "rank_ic": r.rank_ic, "rank_icir": r.rank_icir, "n_dates": r.n_dates} for r in evaluate_ic(scored, by=["split"]).collect()}

    def fitted(m: str):
        if m in LEARNED:
            rows = joint(table.where("split = 'train'"), "f0", "fwd").dropna()
            if rows.limit(max(k + 1, 10) + 1).count() <= max(k + 1, 10):
                w = np.full(k, 1 / k)
            else:
                composite, importance = _learned(m, rows, table, k, seed)
                return dict(zip(names, importance)), composite
        else:
            w = solve(m, ic * sign, g, b, n, ridge)
        weights = dict(zip(names, map(float, w)))
        return weights, blend(z, weights)

    best = None
    for m in AUTO if method == "auto" else (method,):
        weights, composite = fitted(m)
        metrics = judged(composite)
        score = (metrics.get("validation") or {}).get("icir")
        score = -np.inf if score is None else score
        if best is None or score > best["_score"]:
            best = {"method": m, "weights": weights, "orientation": dict(zip(names, map(float, sign))), "composite": composite, "metrics": metrics, "_score": score}
    best.pop("_score")
    return best


__all__ = ["Splits", "blend", "combine", "gram", "methods", "nnls", "solve", "split_of", "standardize", "wide"]
