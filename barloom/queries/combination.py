"""Queries that combine factors, with SQL twins for what is relational."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import functions as F

from barloom.evaluation import combine as C
from barloom.evaluation.metrics import by_horizon, forward_returns
from barloom.plans.compiler import compile_factors
from barloom.queries.library import _FOUR_SQL, FOUR
from barloom.queries.panels import nation_weeks
from barloom.runtime import stage

D = dt.date
SPLITS = C.Splits((D(1995, 1, 1), D(1998, 12, 31)), (D(1999, 1, 1), D(2000, 6, 30)), (D(2000, 7, 1), D(2002, 12, 31)), embargo=2)


def _inputs(spark, d):
    plan = compile_factors(nation_weeks(spark, d), FOUR, keep=("open",))
    frame = stage(forward_returns(plan.frame, (1,), dense=True, carry=list(FOUR)), "combine")
    long = frame.select("symbol", "date", F.explode(F.create_map(*[x for k in FOUR for x in (F.lit(k), F.col(k))])).alias("factor_id", "value"))
    return long, by_horizon(frame, (1,), ["symbol", "date"]).select("symbol", "date", "fwd")


def combine_zscore(spark, d):
    return C.standardize(_inputs(spark, d)[0], "zscore").select("factor_id", "symbol", "date", F.round("value", 6).alias("value"))


def combine_rank(spark, d):
    return C.standardize(_inputs(spark, d)[0], "rank").select("factor_id", "symbol", "date", F.round("value", 6).alias("value"))


def combine_splits(spark, d):
    return C.split_of(_inputs(spark, d)[1], SPLITS)


def combine_blend(spark, d):
    z = C.standardize(_inputs(spark, d)[0], "zscore")
    return C.blend(z, {"level": 0.5, "move": -0.25, "size": 0.25}).select("symbol", "date", F.round("factor", 6).alias("factor"))


def _run(method):
    def run(spark, d):
        long, returns = _inputs(spark, d)
        got = C.combine(long, returns, SPLITS, method)
        rows = [(got["method"], k, float(w), got["orientation"][k]) for k, w in got["weights"].items()]
        return spark.createDataFrame(rows, "method string, factor_id string, weight double, orientation double").select("method", "factor_id", F.round("weight", 6).alias("weight"), "orientation")

    return run


METHODS = ("equal", "ic_weight", "icir_weight", "ols", "ridge", "nnls", "max_icir", "linear", "lasso", "elastic_net", "random_forest", "gbrt", "auto")
_STD = _FOUR_SQL + ", z as (select f as factor_id, symbol, date, case when x is not null then case when stddev_pop(x) over q > 0 then (x - avg(x) over q) / stddev_pop(x) over q else 0 end end as v from l window q as (partition by f, date))"
_TRAIN = _STD + f""", days as (select date, row_number() over (order by date desc) as k from (select distinct date from w where date between date '1995-01-01' and date '1998-12-31')),
tr as (select z.factor_id, z.date, z.symbol, z.v, w.fwd from z join w using (symbol, date) join days using (date) where k > 2 and z.v is not null and w.fwd is not null),
dic as (select factor_id, date, case when stddev_pop(v) > 0 and stddev_pop(fwd) > 0 then covar_pop(v, fwd) / (stddev_pop(v) * stddev_pop(fwd)) end as ic from tr group by all),
m as (select factor_id, avg(ic) as m, stddev_samp(ic) as s from dic group by all),
o as (select factor_id, case when m < 0 then -1.0 else 1.0 end as o, abs(m) as m, s from m)
"""
_NAMES = sorted(FOUR)
_K = range(len(_NAMES))


def _det(a) -> str:
    """The determinant of a square of SQL terms, by its permutations."""
    terms = []
    for perm in itertools.permutations(range(len(a))):
        odd = sum(perm[i] > perm[j] for i in range(len(perm)) for j in range(i + 1, len(perm))) % 2
        terms.append(("-" if odd else "+") + "*".join(a[i][j] for i, j in enumerate(perm)))
    return "(" + "".join(terms) + ")"


def _cramer(a, b) -> list[str]:
    """The solution of a small linear system in SQL, by Cramer's rule."""
    whole = _det(a)
    return [f"({_det([[b[i] if j == k else a[i][j] for j in range(len(b))] for i in range(len(b))])} / {whole})" for k in range(len(b))]


_GRAM = _TRAIN + f""", wd as (select date, symbol, any_value(fwd) as y, {", ".join(f"max(case when factor_id = '{n}' then v * o end) as x{i}" for i, n in enumerate(_NAMES))} from tr join o using (factor_id) group by all),
gm as (select {", ".join(f"sum(x{i} * x{j}) as g{i}{j}" for i in _K for j in _K)}, {", ".join(f"sum(x{i} * y) as b{i}" for i in _K)} from wd where {" and ".join(f"x{i} is not null" for i in _K)})"""
_MOMENTS = _TRAIN + f""", di as (select date, {", ".join(f"max(case when factor_id = '{n}' then ic * o end) as x{i}" for i, n in enumerate(_NAMES))} from dic join o using (factor_id) group by date),
gm as (select {", ".join(f"covar_samp(x{i}, x{j}) as g{i}{j}" for i in _K for j in _K)}, {", ".join(f"avg(x{i}) as b{i}" for i in _K)} from di where {" and ".join(f"x{i} is not null" for i in _K)})"""
_G, _B = [[f"g{i}{j}" for j in _K] for i in _K], [f"b{i}" for i in _K]
_TRACE = "(" + "+".join(f"g{i}{i}" for i in _K) + f") / {len(_NAMES)}"


def _plus(ridge: str):
    return [[f"(g{i}{j} + {ridge})" if i == j else f"g{i}{j}" for j in _K] for i in _K]


def _weights_sql(method: str, source: str, solution: list[str]) -> str:
    picked = " union all ".join(f"select '{n}' as factor_id, w{i} as w from sol" for i, n in enumerate(_NAMES))
    return f"{source}, sol as (select {', '.join(f'{w} as w{i}' for i, w in enumerate(solution))} from gm), pk as ({picked}) select '{method}' as method, factor_id, round(w / sum(abs(w)) over (), 6) + 0.0 as weight, o::double as orientation from pk join o using (factor_id)"


def _nnls_sql() -> str:
    """Of the solutions on all subsets of the factors, the best one without a negative weight."""
    parts = []
    for n in range(1, len(_NAMES) + 1):
        for some in itertools.combinations(_K, n):
            w = dict(zip(some, _cramer([[f"g{i}{j}" for j in some] for i in some], [f"b{i}" for i in some])))
            parts.append("select " + ", ".join(f"{w.get(i, '0.0')} as w{i}" for i in _K) + " from gm")
    sets = " union all ".join(parts)
    best = f"select * from ({sets}) cross join (select {', '.join(_B)} from gm) where {' and '.join(f'w{i} >= 0' for i in _K)} order by {' + '.join(f'w{i} * b{i}' for i in _K)} desc limit 1"
    picked = " union all ".join(f"select '{n}' as factor_id, w{i} as w from sol" for i, n in enumerate(_NAMES))
    return f"{_GRAM}, sol as ({best}), pk as ({picked}) select 'nnls' as method, factor_id, round(w / sum(abs(w)) over (), 6) + 0.0 as weight, o::double as orientation from pk join o using (factor_id)"


def combine_split_metrics(spark, d):
    """What the equal combination of the four factors is worth in each window."""
    long, returns = _inputs(spark, d)
    got = C.combine(long, returns, SPLITS, "equal")
    rows = [(split, m["ic"], m["rank_ic"], m["n_dates"]) for split, m in got["metrics"].items()]
    return spark.createDataFrame(rows, "split string, ic double, rank_ic double, n_dates long").select("split", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"), "n_dates")


_SPLIT_METRICS = _TRAIN + """, sp as (select date, split from (select *, row_number() over (partition by split order by date desc) as k from (select distinct date, case when date <= date '1998-12-31' then 'train' when date <= date '2000-06-30' then 'validation' else 'test' end as split from w)) where split = 'test' or k > 2),
cm as (select symbol, date, sum(v * o.o) / 4 as c from z join o using (factor_id) where v is not null group by all),
jn as (select split, date, c, w.fwd as y from cm join w using (symbol, date) join sp using (date) where w.fwd is not null),
rk2 as (select *, rank() over (partition by date order by c) + (count(*) over (partition by date, c) - 1) / 2.0 as rc, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from jn),
dd as (select split, date, case when stddev_pop(c) > 0 and stddev_pop(y) > 0 then covar_pop(c, y) / (stddev_pop(c) * stddev_pop(y)) end as ic, case when stddev_pop(rc) > 0 and stddev_pop(ry) > 0 then covar_pop(rc, ry) / (stddev_pop(rc) * stddev_pop(ry)) end as ric from rk2 group by all)
select split, round(avg(ic), 6) as ic, round(avg(ric), 6) as rank_ic, count(ic) as n_dates from dd group by split"""
ORACLES = {
    "combine_split_metrics": _SPLIT_METRICS,
    "combine_ols": _weights_sql("ols", _GRAM, _cramer(_G, _B)),
    "combine_ridge": _weights_sql("ridge", _GRAM, _cramer(_plus(f"0.01 * ({_TRACE})"), _B)),
    "combine_nnls": _nnls_sql(),
    "combine_max_icir": _weights_sql("max_icir", _MOMENTS, _cramer(_plus(f"0.000001 * greatest({_TRACE}, 1e-12)"), _B)),
    "combine_zscore": _STD + "select factor_id, symbol, date, round(v, 6) + 0.0 as value from z",
    "combine_rank": _FOUR_SQL + "select f as factor_id, symbol, date, round(case when x is not null then case when n = 1 then 0 else 2 * (rk - 1 + (tie - 1) / 2.0) / (n - 1) - 1 end end, 6) + 0.0 as value from (select *, rank() over (partition by f, date order by x nulls last) as rk, count(*) over (partition by f, date, x) as tie, count(x) over (partition by f, date) as n from l)",
    "combine_splits": _FOUR_SQL + "select date, split from (select *, row_number() over (partition by split order by date desc) as k from (select distinct date, case when date <= date '1998-12-31' then 'train' when date <= date '2000-06-30' then 'validation' else 'test' end as split from w)) where split = 'test' or k > 2",
    "combine_blend": _STD + "select symbol, date, round(sum(v * case factor_id when 'level' then 0.5 when 'move' then -0.25 else 0.25 end), 6) + 0.0 as factor from z where factor_id <> 'tilt' group by all",
    "combine_equal": _TRAIN + "select 'equal' as method, factor_id, round(1.0::double / count(*) over (), 6) as weight, o::double as orientation from o",
    "combine_ic_weight": _TRAIN + "select 'ic_weight' as method, factor_id, round(m / sum(m) over (), 6) as weight, o::double as orientation from o",
    "combine_icir_weight": _TRAIN + "select 'icir_weight' as method, factor_id, round((m / s) / sum(m / s) over (), 6) as weight, o::double as orientation from o",
}
QUERIES = {n: globals()[n] for n in ("combine_zscore", "combine_rank", "combine_splits", "combine_blend", "combine_split_metrics")} | {f"combine_{m}": _run(m) for m in METHODS}
