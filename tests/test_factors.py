"""Operators and scoring against plain loops on panels with holes."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.evaluation import metrics as M
from barloom.evaluation.combine import Splits, combine, nnls
from barloom.operators import registry
from barloom.plans.compiler import compile_factors, evaluate
from barloom.portfolio import accounting as A
from barloom.portfolio import construction as C
from barloom.portfolio.optimize import mean_variance, project, risk_parity, shrunk_covariance

T, N = 24, 6
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(T)]


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    x = 100 + rng.normal(size=(T, N)).cumsum(0)
    y = 100 + rng.normal(size=(T, N)).cumsum(0)
    x[rng.random((T, N)) < 0.08] = np.nan
    x[5] = np.nan
    x[8:14, 2] = 50.0
    x[3, 1:] = np.nan
    return x, y


@pytest.fixture(scope="module")
def panel(spark, world):
    x, y = world
    rows = [(d, f"S{j}", float(x[i, j]), float(y[i, j]), float(i * N + j)) for i, d in enumerate(DAYS) for j in range(N) if (i + j) % 11]
    return spark.createDataFrame(rows, "date date, symbol string, close double, volume double, extra double").withColumn("_d_unused", F.lit("x"))


def grid(world):
    x, y = (w.copy() for w in world)
    for i in range(T):
        for j in range(N):
            if not (i + j) % 11:
                x[i, j] = y[i, j] = np.nan
    return x, y


def matrix(df, col="factor"):
    p = df.toPandas()
    assert len(p) == T * N
    return p.pivot(index="date", columns="symbol", values=col).sort_index().to_numpy(float)


def strict(x, d, f):
    out = np.full_like(x, np.nan)
    for i in range(d - 1, T):
        for j in range(N):
            w = x[i - d + 1 : i + 1, j]
            if not np.isnan(w).any():
                out[i, j] = f(w)
    return out


def corr(x, y, d):
    out = np.full_like(x, np.nan)
    for i in range(d - 1, T):
        for j in range(N):
            a, b = x[i - d + 1 : i + 1, j], y[i - d + 1 : i + 1, j]
            if not np.isnan(a + b).any() and a.std() > 0 and b.std() > 0:
                out[i, j] = np.corrcoef(a, b)[0, 1]
    return out


def rank01(row):
    out, ok = np.full(len(row), np.nan), ~np.isnan(row)
    v = row[ok]
    r = np.array([((v < a).sum() + ((v == a).sum() - 1) / 2) for a in v])
    out[ok] = 0.5 if len(v) == 1 else r / max(len(v) - 1, 1)
    return out


def ema(x, d):
    a, out = 2 / (d + 1), np.full_like(x, np.nan)
    for j in range(N):
        e = np.nan
        for i in range(T):
            if not np.isnan(x[i, j]):
                e = x[i, j] if np.isnan(e) else a * x[i, j] + (1 - a) * e
            out[i, j] = e
    return out


CASES = {
    "ts_mean(close, 4)": lambda x, y: strict(x, 4, np.mean), "ts_std(close, 4)": lambda x, y: strict(x, 4, lambda w: w.std(ddof=1)), "ts_argmax(close, 4)": lambda x, y: strict(x, 4, lambda w: 3 - w.argmax()), "ts_rank(close, 4)": lambda x, y: strict(x, 4, lambda w: ((w <= w[-1]).sum() - 1) / 3),
    "decay_linear(close, 4)": lambda x, y: strict(x, 4, lambda w: (w * [1, 2, 3, 4]).sum() / 10), "Mad($close, 4)": lambda x, y: strict(x, 4, lambda w: np.abs(w - w.mean()).mean()), "Quantile($close, 5, 0.3)": lambda x, y: strict(x, 5, lambda w: np.quantile(w, 0.3)),
    "Slope($close, 5)": lambda x, y: strict(x, 5, lambda w: np.polyfit(range(5), w, 1)[0]), "Resi($close, 5)": lambda x, y: strict(x, 5, lambda w: w[-1] - np.polyval(np.polyfit(range(5), w, 1), 4)), "ts_product(close / 100, 3)": lambda x, y: strict(x / 100, 3, np.prod),
    "correlation(close, volume, 5)": lambda x, y: corr(x, y, 5), "EMA($close, 3)": lambda x, y: ema(x, 3), "EMA($close, 1)": lambda x, y: ema(x, 1), "DEMA($close, 3)": lambda x, y: 2 * ema(x, 3) - ema(ema(x, 3), 3), "rank(close)": lambda x, y: np.array([rank01(r) for r in x]),
    "rank(delta(close, 1))": lambda x, y: np.array([rank01(r) for r in np.vstack([np.full(N, np.nan), np.diff(x, axis=0)])]), "ts_mean(rank(close), 3)": lambda x, y: strict(np.array([rank01(r) for r in x]), 3, np.mean), "fillna(close, ffill)": lambda x, y: pd.DataFrame(x).ffill().to_numpy(),
    "close > volume ? 1 : -1": lambda x, y: np.where(np.isnan(x + y), np.nan, np.where(x > y, 1.0, -1.0)), "clip(close, 99, 101)": lambda x, y: np.clip(x, 99, 101), "safe_div(close, volume - volume, 7)": lambda x, y: np.where(np.isnan(y), np.nan, 7.0),
}


def test_operators_against_loops(panel, world):
    x, y = grid(world)
    plan = compile_factors(panel, {f"c{i}": e for i, e in enumerate(CASES)})
    assert plan.switches <= 4
    got = plan.frame.toPandas()
    with np.errstate(all="ignore"):
        for i, (e, f) in enumerate(CASES.items()):
            m = got.pivot(index="date", columns="symbol", values=f"c{i}").sort_index().to_numpy(float)
            want = f(x, y)
            np.testing.assert_allclose(m, want, rtol=1e-9, atol=1e-9, err_msg=e)


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(DAYS[0], "A", 1.0, 0.0), (DAYS[1], "A", -1.0, 0.0), (DAYS[2], "A", 0.0, 0.0), (DAYS[3], "A", None, 2.0)], "date date, symbol string, a double, b double")
    got = [r.factor for r in evaluate(df, "a / b").orderBy("date").collect()]
    assert got == [math.inf, -math.inf, None, None]


def test_repeated_and_bad_rows(spark):
    rows = [(DAYS[0], "A", 1.0, 1), (DAYS[0], "A", 9.0, 0), (DAYS[1], "A", float("nan"), 0), (DAYS[1], "B", 2.0, 0), (None, "C", 1.0, 0), (DAYS[0], None, 1.0, 0)]
    df = spark.createDataFrame(rows, "date date, symbol string, close double, seq int")
    got = {(r.symbol, r.date): r.factor for r in evaluate(df, "close + 0", order="seq").collect()}
    assert got == {("A", DAYS[0]): 1.0, ("A", DAYS[1]): None, ("B", DAYS[0]): None, ("B", DAYS[1]): 2.0}
    assert evaluate(df.limit(0), "ts_mean(close, 3)").count() == 0
    with pytest.raises(KeyError):
        evaluate(df, "rank(nope)")
    with pytest.raises(ValueError):
        evaluate(df, "ts_std(close, 1)").count()


def test_groups_must_be_complete(spark, panel):
    labels = spark.createDataFrame([(f"S{j}", "g") for j in range(N - 1)], "symbol string, sector string")
    with pytest.raises(ValueError):
        evaluate(panel, "indneutralize(close, sector)", labels)
    with pytest.raises(KeyError):
        evaluate(panel, "indneutralize(close, sector)")


def test_custom_operator_runs(panel, world):
    registry.register("twice", lambda ctx, x: x * 2)
    try:
        np.testing.assert_allclose(matrix(evaluate(panel, "twice(close)")), grid(world)[0] * 2)
    finally:
        registry.unregister("twice")


def test_perfect_and_inverse_coefficient(spark):
    rows = [(d, f"S{j}", float(j), float(j), float(-j)) for d in DAYS[:3] for j in range(5)]
    df = spark.createDataFrame(rows, "date date, symbol string, factor double, fwd double, neg double")
    assert [round(r.ic, 12) for r in M.ic_series(df).collect()] == [1.0] * 3
    assert [round(r.rank_ic, 12) for r in M.rank_ic_series(df, y="neg").collect()] == [-1.0] * 3
    flat = df.withColumn("fwd", F.lit(1.0))
    assert [r.ic for r in M.ic_series(flat).collect()] == [None] * 3
    assert M.turnover(df).first().turnover == pytest.approx(0.0)


def test_forward_returns_and_decay(spark):
    df = spark.createDataFrame([(d, "A", float(2**i), float(10 + i)) for i, d in enumerate(DAYS[:5])], "date date, symbol string, close double, open double")
    assert [r.fwd_1 for r in M.forward_returns(df, [1], "next_close").orderBy("date").collect()] == [1.0, 1.0, 1.0, 1.0, None]
    assert M.forward_returns(df, [1]).orderBy("date").first().fwd_1 == pytest.approx(12 / 11 - 1)
    with pytest.raises(ValueError):
        M.forward_returns(df, [0])
    by_h = spark.createDataFrame([(h, 0.1 * 0.5 ** (h / 4)) for h in (1, 5, 10)], "horizon int, rank_ic double")
    assert M.decay_halflife(by_h).first().half_life == pytest.approx(4.0)


def test_output_rules(spark):
    rows = [(d, f"S{j}", None if i < 3 else (float("inf") if j == 0 else 5.0)) for i, d in enumerate(DAYS[:4]) for j in range(4)]
    df = spark.createDataFrame(rows, "date date, symbol string, factor double")
    assert M.output_diagnostics(df).first().codes == ["O002", "O003", "O004", "O006"]
    empty = df.withColumn("factor", F.lit(None).cast("double"))
    assert M.output_diagnostics(empty).first().codes[0] == "O001"


def test_combination_finds_the_strong_factor(spark):
    rng = np.random.default_rng(0)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    fwd = rng.normal(0, 0.02, (90, 20))
    makes = {"strong": fwd + 0.5 * rng.normal(0, 0.02, fwd.shape), "weak": fwd + 4 * rng.normal(0, 0.02, fwd.shape), "flipped": -fwd + rng.normal(0, 0.02, fwd.shape)}
    rows = [(k, f"S{j}", d, float(m[i, j])) for k, m in makes.items() for i, d in enumerate(days) for j in range(20)]
    long = spark.createDataFrame(rows, "factor_id string, symbol string, date date, value double")
    returns = spark.createDataFrame([(f"S{j}", d, float(fwd[i, j])) for i, d in enumerate(days) for j in range(20)], "symbol string, date date, fwd double")
    s = Splits((days[0], days[44]), (days[45], days[64]), (days[65], days[89]), 2)
    for method in ("ic_weight", "nnls", "ridge"):
        got = combine(long, returns, s, method)
        assert got["orientation"] == {"strong": 1.0, "weak": 1.0, "flipped": -1.0}
        assert sum(map(abs, got["weights"].values())) == pytest.approx(1)
        assert max(got["weights"], key=got["weights"].get) == "strong" and got["metrics"]["test"]["ic"] > 0.7
    with pytest.raises(ValueError):
        combine(long, returns, s, "xgboost")


def test_nnls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    y = x @ [1.0, 0, 2.0, 0] - x[:, 1] * 0.5
    w = nnls(x.T @ x, x.T @ y)
    g = x.T @ y - x.T @ x @ w
    assert (w >= 0).all() and (g[w == 0] <= 1e-8).all() and np.abs(g[w > 0]).max() < 1e-8


def test_accountant_agrees_with_the_walk(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.02, (T, 4))
    r[4, 1] = np.nan
    plan = {3: [0.5, 0.5, 0, 0], 9: [0.2, 0.0, 0.6, 0.2], 16: [-0.5, 0.5, 0.5, 0.5]}
    returns = spark.createDataFrame([(f"S{j}", d, float(r[i, j])) for i, d in enumerate(DAYS) for j in range(4)], "symbol string, date date, ret double")
    targets = spark.createDataFrame([(run, DAYS[t], f"S{j}", float(w)) for run in ("a", "b") for t, ws in plan.items() for j, w in enumerate(ws)], "run_id string, date date, symbol string, weight double")
    want = A.walk(r, {t: np.array(w, float) for t, w in plan.items()}, commission=0.001, stamp=0.002)
    nav, trades = A.account(returns, targets, commission=0.001, stamp=0.002)
    for run in ("a", "b"):
        got = nav.where(F.col("run_id") == run).orderBy("date").toPandas()
        np.testing.assert_allclose(got.nav, want.nav, rtol=1e-12)
        np.testing.assert_allclose(got.gross_nav, want.gross_nav, rtol=1e-12)
    got = trades.where("run_id = 'a'").orderBy("date").toPandas()
    np.testing.assert_allclose(got.turnover, want.turnover[sorted(plan)], rtol=1e-12)
    np.testing.assert_allclose(got.cost, want.cost[sorted(plan)], rtol=1e-12)
    walked = A.account_by_walk(returns, targets, commission=0.001, stamp=0.002).where("run_id = 'b'").orderBy("date").toPandas()
    np.testing.assert_allclose(walked.nav, want.nav, rtol=1e-12)


def test_walk_limits():
    r = np.zeros((3, 2))
    out = A.walk(r, {0: np.array([1.0, 0.0]), 1: np.array([0.0, 1.0])}, max_turnover=0.25, commission=0.0)
    assert out.turnover.tolist() == pytest.approx([0.25, 0.25, 0.0])
    out = A.walk(r, {0: np.array([0.5, 0.5])}, tradable=np.array([[True, False]] * 3), commission=0.0)
    assert out.turnover[0] == 0.25


def fill_by_clipping(m, cap, target):
    m = np.minimum(m, cap)
    for _ in range(len(m) + 1):
        free = (m > 0) & (m < cap - 1e-15)
        gap = target - m.sum()
        if gap <= 1e-15 or not free.any():
            break
        m[free] = np.minimum(m[free] * (1 + gap / m[free].sum()), cap)
    return m


def test_water_fill_equals_repeated_clipping(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i in range(20):
        w = rng.random(7) ** 4
        w[rng.random(7) < 0.2] = 0
        w = w / w.sum() if w.sum() else w
        cap = 0.25
        want[DAYS[i]] = fill_by_clipping(w.copy(), cap, 1.0)
        rows += [(DAYS[i], f"S{j}", float(x)) for j, x in enumerate(w)]
    t = spark.createDataFrame(rows, "date date, symbol string, weight double")
    got = C.water_fill(t, 0.25, 1.0, 1.0, False).toPandas().pivot(index="date", columns="symbol", values="weight").sort_index()
    np.testing.assert_allclose(got.to_numpy(), np.array([want[d] for d in DAYS[:20]]), atol=1e-12)


def test_constraints_hold(spark):
    rng = np.random.default_rng(4)
    rows = [(d, f"S{j:02d}", float(x)) for d in DAYS[:5] for j, x in enumerate(rng.normal(size=30))]
    s = spark.createDataFrame(rows, "date date, symbol string, signal double")
    w = C.apply_constraints(C.weights(s, "signal_prop", long_short=True, gross=1.0, net=0.0), cap=0.08, most=24, gross=1.0, net=0.0, long_short=True).toPandas()
    for _, g in w.groupby("date"):
        assert abs(g.weight.abs().sum() - 1) < 1e-9 and abs(g.weight.sum()) < 1e-9 and g.weight.abs().max() <= 0.08 + 1e-12 and (g.weight != 0).sum() <= 24


def test_schedule():
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(70)) if d.weekday() < 5]
    assert C.calendar_schedule(days, "monthly") == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), days[-1]]
    assert C.calendar_schedule(days, "weekly", "Wed")[0] == dt.date(2024, 1, 3)
    assert len(C.calendar_schedule(days, "daily", min_gap=5)) == len(days) // 5
    assert C.shift_schedule(days, [days[0], days[-1]], 1) == {days[0]: days[1]}
    with pytest.raises(ValueError):
        C.shift_schedule(days, days, 0)


def test_optimizers():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (40, 5)) * [1, 2, 3, 1, 2]
    s = np.cov(x.T, bias=True)
    c = shrunk_covariance(x)
    z = x - x.mean(0)
    noise = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 40**2
    target = np.trace(s) / 5 * np.eye(5)
    share = min(noise / ((s - target) ** 2).sum(), 1)
    np.testing.assert_allclose(c, share * target + (1 - share) * s)
    w = risk_parity(c)
    part = w * (c @ w)
    np.testing.assert_allclose(part, part.mean(), rtol=1e-6)
    v = mean_variance(np.array([0.1, 0.2, 0.05, np.nan, 0.1]), c, high=0.5)
    assert v[3] == 0 and abs(v.sum() - 1) < 1e-9 and v.max() <= 0.5 + 1e-9
    u = np.where(np.isnan([0.1, 0.2, 0.05, np.nan, 0.1]), 0, [0.1, 0.2, 0.05, 0, 0.1])
    best = u @ v - 0.5 * v @ c @ v
    for _ in range(300):
        q = project(v[[0, 1, 2, 4]] + rng.normal(0, 0.1, 4), 0.0, 0.5, 1.0)
        p = np.array([q[0], q[1], q[2], 0, q[3]])
        assert u @ p - 0.5 * p @ c @ p <= best + 1e-9
