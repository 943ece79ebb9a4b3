"""Queries that score factors over the nation-week panel, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.evaluation import metrics as M
from barloom.plans.compiler import compile_factors
from barloom.queries.operators import rank as sql_rank
from barloom.queries.panels import PANEL_SQL, nation_groups, nation_weeks

FACTOR = "rank(close / delay(close, 1)) - rank(volume)"
HORIZONS = (1, 5, 10)


def scored(spark, d):
    """(symbol, date, factor, fwd_1, fwd_5, fwd_10) on the dense grid; factor and returns come from one plan."""
    plan = compile_factors(nation_weeks(spark, d), {"factor": FACTOR}, keep=("open",))
    return M.forward_returns(plan.frame, HORIZONS, dense=True, carry=["factor"])


def _long(spark, d):
    return M.by_horizon(scored(spark, d), HORIZONS, ["symbol", "date", "factor"])


def r(c, n=8):
    return F.round(c, n).alias(c)


def eval_forward_returns(spark, d):
    return scored(spark, d).select("symbol", "date", *[r(f"fwd_{h}") for h in HORIZONS])


def eval_forward_returns_close(spark, d):
    return M.forward_returns(nation_weeks(spark, d), (1, 2), "next_close").select("symbol", "date", r("fwd_1"), r("fwd_2"))


def eval_ic_series(spark, d):
    return M.ic_series(_long(spark, d), by=["horizon"]).select("horizon", "date", "n", r("ic"))


def eval_rank_ic_series(spark, d):
    return M.rank_ic_series(_long(spark, d), by=["horizon"]).select("horizon", "date", "n", r("rank_ic"))


def eval_ic_summary(spark, d):
    return M.evaluate_ic(_long(spark, d)).select("horizon", r("ic"), r("icir"), r("rank_ic"), r("rank_icir"), "n_dates")


def eval_decay_halflife(spark, d):
    """Of the absolute coefficients, so that the fit has points to go by."""
    table = M.evaluate_ic(_long(spark, d)).withColumn("rank_ic", F.abs("rank_ic"))
    return M.decay_halflife(table).select(r("half_life", 5))


def eval_group_returns(spark, d):
    return M.group_returns(_long(spark, d), 5, by=["horizon"]).select("horizon", "bucket", r("mean_return"), "n_dates")


def eval_long_short(spark, d):
    return M.long_short(M.group_returns(_long(spark, d), 5, by=["horizon"]), ["horizon"]).select("horizon", r("long_short"), "monotonic")


def eval_rank_autocorrelation(spark, d):
    return M.rank_autocorrelation(scored(spark, d).select("symbol", "date", "factor")).select("date", "n", r("autocorr"))


def eval_turnover(spark, d):
    return M.turnover(scored(spark, d).select("symbol", "date", "factor")).select(r("turnover"))


def eval_neutralized(spark, d):
    return M.neutralize(scored(spark, d).select("symbol", "date", "factor"), nation_groups(spark, d), "sector").select("symbol", "date", r("factor"))


def eval_output_diagnostics(spark, d):
    return M.output_diagnostics(scored(spark, d).select("symbol", "date", "factor")).select("n_cells", r("coverage"), "n_infinite", "first_valid", F.concat_ws(",", "codes").alias("codes"))


_ORDER = "over (partition by symbol order by date)"
_SQL = f"""with {PANEL_SQL},
f0 as (select *, close / lag(close) {_ORDER} as x from p),
f as (select symbol, date, sector, {sql_rank("x")} - ({sql_rank("volume")}) as factor,
  lead(open, 1) {_ORDER} as entry, {", ".join(f"lead(open, {h + 1}) {_ORDER} as o{h}" for h in HORIZONS)} from f0),
s as (select symbol, date, sector, factor, {", ".join(f"case when entry > 0 then o{h} / entry - 1 end as fwd_{h}" for h in HORIZONS)} from f),
l as ({" union all ".join(f"select symbol, date, factor, {h} as horizon, fwd_{h} as fwd from s" for h in HORIZONS)}),
j as (select * from l where factor is not null and fwd is not null),
k as (select *, rank() over (partition by horizon, date order by factor) + (count(*) over (partition by horizon, date, factor) - 1) / 2.0 as rx,
  rank() over (partition by horizon, date order by fwd) + (count(*) over (partition by horizon, date, fwd) - 1) / 2.0 as ry from j),
day as (select horizon, date, count(*) as n, case when stddev_pop(factor) > 0 and stddev_pop(fwd) > 0 then covar_pop(factor, fwd) / (stddev_pop(factor) * stddev_pop(fwd)) end as ic,
  case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) end as rank_ic from k group by all),
ics as (select horizon, avg(ic) as ic, avg(ic) / stddev_samp(ic) as icir, avg(rank_ic) as rank_ic, avg(rank_ic) / stddev_samp(rank_ic) as rank_icir, count(rank_ic) as n_dates from day group by all),
pos as (select *, row_number() over (partition by horizon, date order by factor, symbol) - 1 as pos, count(*) over (partition by horizon, date) as m from j),
bkt as (select horizon, date, floor(pos * 5 / m)::int as bucket, avg(fwd) as r from pos where m >= 5 group by all),
grp as (select horizon, bucket, avg(r) as mean_return, count(*) as n_dates from bkt group by all),
ac as (select *, rank() over (partition by date order by b) + (count(*) over (partition by date, b) - 1) / 2.0 as rx, rank() over (partition by date order by factor) + (count(*) over (partition by date, factor) - 1) / 2.0 as ry
  from (select symbol, date, factor, lag(factor) {_ORDER} as b from s) where factor is not null and b is not null),
acd as (select date, count(*) as n, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) as autocorr from ac group by all)
"""
ORACLES = {
    "eval_forward_returns": _SQL + "select symbol, date, " + ", ".join(f"round(fwd_{h}, 8) as fwd_{h}" for h in HORIZONS) + " from s",
    "eval_forward_returns_close": f"with {PANEL_SQL} select symbol, date, " + ", ".join(f"round(lead(close, {h}) {_ORDER} / close - 1, 8) as fwd_{h}" for h in (1, 2)) + " from p",
    "eval_ic_series": _SQL + "select horizon, date, n, round(ic, 8) as ic from day",
    "eval_rank_ic_series": _SQL + "select horizon, date, n, round(rank_ic, 8) as rank_ic from day",
    "eval_ic_summary": _SQL + "select horizon, round(ic, 8) as ic, round(icir, 8) as icir, round(rank_ic, 8) as rank_ic, round(rank_icir, 8) as rank_icir, n_dates from ics",
    "eval_decay_halflife": _SQL + "select case when regr_slope(ln(abs(rank_ic)), horizon) < 0 then round(-ln(2) / regr_slope(ln(abs(rank_ic)), horizon), 5) end as half_life from ics",
    "eval_group_returns": _SQL + "select horizon, bucket, round(mean_return, 8) as mean_return, n_dates from grp",
    "eval_long_short": _SQL + """select horizon, round(max(case when bucket = 4 then mean_return end) - max(case when bucket = 0 then mean_return end), 8) as long_short, bool_and(coalesce(up, true)) or bool_and(coalesce(down, true)) as monotonic
from (select *, mean_return > lag(mean_return) over q as up, mean_return < lag(mean_return) over q as down from grp window q as (partition by horizon order by bucket)) group by all""",
    "eval_rank_autocorrelation": _SQL + "select date, n, round(autocorr, 8) as autocorr from acd",
    "eval_turnover": _SQL + "select round(1 - avg(autocorr), 8) as turnover from acd",
    "eval_neutralized": _SQL + "select symbol, date, round(factor - avg(factor) over (partition by date, sector), 8) + 0.0 as factor from s",
    "eval_output_diagnostics": _SQL + """select count(*) as n_cells, round(count(factor) / count(*), 8) as coverage, 0::bigint as n_infinite, min(case when factor is not null then t end)::int as first_valid, '' as codes
from (select *, dense_rank() over (order by date) - 1 as t from s)""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
