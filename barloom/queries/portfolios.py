"""Portfolio queries over the nation-week panel, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.evaluation.metrics import rank_autocorrelation
from barloom.plans.compiler import compile_factors
from barloom.plans.panel import panel_dates
from barloom.portfolio import accounting as A
from barloom.portfolio import construction as C
from barloom.portfolio import execution as X
from barloom.portfolio import metrics as M
from barloom.portfolio.optimize import covariances, optimized_weights
from barloom.queries.operators import rank as sql_rank
from barloom.queries.panels import PANEL_SQL, nation_groups, nation_weeks
from barloom.runtime import stage
from barloom.sources.files import trade_status


def _frame(spark, d):
    plan = compile_factors(nation_weeks(spark, d), {"signal": "-1 * (close / delay(close, 1))"}, keep=("close", "vwap"))
    return stage(plan.frame, "portfolio")


def _signal(spark, d, transform="rank"):
    return C.process_signal(_frame(spark, d).select("date", "symbol", "signal"), transform)


def _r(c, n=7):
    return F.round(c, n).alias(c)


def portfolio_signal(spark, d):
    return _signal(spark, d).select("date", "symbol", _r("signal"))


def portfolio_signal_neutral(spark, d):
    s = _frame(spark, d).select("date", "symbol", "signal").join(F.broadcast(nation_groups(spark, d).select("symbol", "sector")), "symbol")
    return C.process_signal(s, "zscore", group="sector").select("date", "symbol", _r("signal"))


def _weights(method, **kw):
    def run(spark, d):
        return C.weights(_signal(spark, d), method, **kw).select("date", "symbol", _r("weight"))

    return run


LS = {"long_short": True, "gross": 1.0, "net": 0.0}
weights_equal, weights_signal, weights_quintile = _weights("equal"), _weights("signal_prop"), _weights("quintile")
weights_signal_long_short, weights_decile_long_short = _weights("signal_prop", **LS), _weights("decile", **LS)


def weights_constrained(spark, d):
    w = C.weights(_signal(spark, d), "signal_prop")
    return C.apply_constraints(w, cap=0.07, most=20).select("date", "symbol", _r("weight"))


def _targets(spark, d, frame=None):
    frame = _frame(spark, d) if frame is None else frame
    days = panel_dates(frame)
    plan = C.shift_schedule(days, C.calendar_schedule(days, "monthly", "last"), 1)
    w = C.apply_constraints(C.weights(C.process_signal(frame.select("date", "symbol", "signal")), "quintile"), cap=0.25)
    when = F.broadcast(spark.createDataFrame(sorted(plan.items()), "date date, _exec date"))
    return frame, w.join(when, "date").where("weight <> 0").select(F.lit("base").alias("run_id"), F.col("_exec").alias("date"), "symbol", "weight")


def _accounts(spark, d):
    frame, targets = _targets(spark, d)
    return A.account(A.daily_returns(frame, "vwap"), targets, commission=0.0005, stamp=0.001)


def portfolio_nav(spark, d):
    return _accounts(spark, d)[0].select("run_id", "date", _r("nav", 6), _r("gross_nav", 6))


def portfolio_rebalances(spark, d):
    return _accounts(spark, d)[1].select("run_id", "date", _r("turnover"), _r("cost", 9), "n_trades")


def portfolio_walk(spark, d):
    """The day-by-day walk with a limit on turnover."""
    frame, targets = _targets(spark, d)
    return A.account_by_walk(A.daily_returns(frame, "vwap"), targets, max_turnover=0.3).select("run_id", "date", _r("nav", 6), _r("turnover"))


def portfolio_metrics(spark, d):
    frame, targets = _targets(spark, d)
    returns = A.daily_returns(frame, "vwap")
    nav, _ = A.account(returns, targets, commission=0.0005, stamp=0.001)
    m = M.compute_metrics(nav.join(A.benchmark_nav(returns), "date"))
    return m.select("run_id", *[_r(c, 5) for c in m.columns if c not in ("run_id", "drawdown_days")], "drawdown_days")


def portfolio_monthly(spark, d):
    return M.monthly_returns(_accounts(spark, d)[0]).select("run_id", "month", _r("ret", 6))


def portfolio_trading(spark, d):
    t = M.trading_metrics(_accounts(spark, d)[1])
    return t.select("run_id", "n_rebalances", *[_r(c, 5) for c in ("mean_turnover", "annual_turnover", "holding_days", "total_cost")])


def _optimized(method, **kw):
    def run(spark, d):
        frame = _frame(spark, d)
        days = panel_dates(frame)
        picks = C.calendar_schedule(days, "quarterly")
        signal = C.process_signal(frame.select("date", "symbol", "signal")).where(F.col("date").isin(picks))
        return optimized_weights(signal, A.daily_returns(frame, "vwap"), method, window=26, **kw).select("date", "symbol", _r("weight", 6))

    return run


weights_risk_parity, weights_mean_variance = _optimized("risk_parity"), _optimized("mean_variance", high=0.2)

def _market(frame):
    """Status made from the panel itself: a price limit of 4 % around the last price, and room for trades by volume."""
    last = F.lag("vwap").over(Window.partitionBy("symbol").orderBy("date"))
    bars = frame.select("date", "symbol", F.col("vwap").alias("close"))
    limits = frame.select("date", "symbol", (last * 1.04).alias("up_limit"), (last * 0.96).alias("down_limit"))
    status = trade_status(bars, limits)
    rebased = X.rebased_limits(status, frame, "vwap")
    room = F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))
    return rebased.join(frame.select("date", "symbol", room.alias("volume_room")), ["date", "symbol"])


def _frame_with_volume(spark, d):
    plan = compile_factors(nation_weeks(spark, d), {"signal": "-1 * (close / delay(close, 1))"}, keep=("close", "vwap", "volume"))
    return stage(plan.frame, "portfolio")


def portfolio_trade_log(spark, d):
    """Every wanted trade, what of it is done, and why not all."""
    frame, targets = _targets(spark, d, _frame_with_volume(spark, d))
    log = X.trade_log(A.daily_returns(frame, "vwap"), targets, _market(frame), max_share=2.0)
    return log.select("run_id", "date", "symbol", "side", _r("wanted", 6), _r("filled", 6), _r("deferred", 6), "reason")


def portfolio_positions(spark, d):
    frame, targets = _targets(spark, d)
    return X.position_log(A.daily_returns(frame, "vwap"), targets).select("run_id", "date", "symbol", _r("weight"))


def portfolio_weekly_sample(spark, d):
    return A.sample_series(_accounts(spark, d)[0], "monthly").select("run_id", "date", _r("nav", 6))


def trade_status_limits(spark, d):
    """Limits and locks of every bar of the panel, rebased to a price twice the raw one."""
    frame = _frame_with_volume(spark, d)
    last = F.lag("vwap").over(Window.partitionBy("symbol").orderBy("date"))
    status = trade_status(frame.select("date", "symbol", F.col("vwap").alias("close")), frame.select("date", "symbol", (last * 1.04).alias("up_limit"), (last * 0.96).alias("down_limit")))
    twice = X.rebased_limits(status, frame.withColumn("vwap", F.col("vwap") * 2), "vwap")
    return status.select("date", "symbol", "limit_up_locked", "limit_down_locked").join(twice, ["date", "symbol"]).select("date", "symbol", "limit_up_locked", "limit_down_locked", _r("up_limit", 6), _r("down_limit", 6))


def trade_costs(spark, d):
    """The cost of each trade of the portfolio by the laws of impact, and with a least commission."""
    frame, targets = _targets(spark, d, _frame_with_volume(spark, d))
    share = F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))
    moves = A.books(A.daily_returns(frame, "vwap"), targets)["moves"].join(frame.select("date", "symbol", share.alias("_v")), ["date", "symbol"])
    part, sell, size = F.abs("move") / F.when(F.col("_v") > 0, F.col("_v")), F.col("move") < 0, F.abs("move") * 1e6
    rates = {"commission": 0.0003, "stamp": 0.0005, "transfer": 0.00002, "impact": 0.002}
    laws = [F.round(A.cost_rate(sell, part, law=law, **rates), 9).alias(law) for law in ("sqrt", "almgren_chriss", "linear", "zero")]
    return moves.select("run_id", "date", "symbol", *laws, F.round(A.cost_rate(sell, part, law="zero", least=5.0, notional=size, **rates), 9).alias("least"), F.lit(round(A.round_trip(0.0003, 0.0005, 0.00002), 9)).alias("round_trip"))


def rebalance_triggers(spark, d):
    """Symbols whose decile shifts by more than three, or whose weight drifts by more than 0.02, from one month's target to the next one's."""
    frame, targets = _targets(spark, d)
    made = targets.select("run_id", "date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy("run_id").orderBy("date")))
    dec = X.deciles(frame.select("date", "symbol", "signal")).select("date", "symbol", "decile")
    all_w = made.join(dec, "date").join(targets, ["run_id", "date", "symbol"], "left").fillna(0.0, ["weight"])
    old = all_w.where("next is not null").select("run_id", F.col("next").alias("date"), "symbol", "weight", "decile")
    return X.threshold_triggers(old, all_w, rank_shift=3, drift=0.02).select("run_id", "date", "symbol", F.col("rank_shift").cast("double").alias("rank_shift"), _r("drift", 6))


def rebalance_churn(spark, d):
    """Dates at which ranks have churned, at least four sessions apart."""
    frame = _frame(spark, d)
    days = panel_dates(frame)
    auto = rank_autocorrelation(frame.select("symbol", "date", F.col("signal").alias("factor")))
    picks = C.churn_schedule(auto, days, floor=-0.3, min_gap=4)
    return spark.createDataFrame([(p,) for p in picks], "date date")


def weights_sector_neutral(spark, d):
    w = C.weights(_signal(spark, d), "signal_prop").join(F.broadcast(nation_groups(spark, d).select("symbol", "sector")), "symbol")
    return C.sector_neutral(w, "sector").select("date", "symbol", _r("weight"))


def weights_limited(spark, d):
    """No dust, the twelve largest of each date, scaled to a gross weight of 0.9."""
    w = C.cap_count(C.drop_dust(C.weights(_signal(spark, d), "signal_prop"), 0.01, False), 12)
    return w.withColumn("weight", C.scale_legs(F.col("weight"), Window.partitionBy("date"), False, 0.9, 0.9)).select("date", "symbol", _r("weight"))


def _cov(kind):
    def run(spark, d):
        frame = _frame(spark, d)
        days = panel_dates(frame)
        got = covariances(A.daily_returns(frame, "vwap"), [q for q in C.calendar_schedule(days, "quarterly") if days.index(q) >= 26], window=26, covariance=kind)
        return got.select("date", "a", "b", F.round(F.col("cov") * 1e4, 5).alias("cov"))

    return run


cov_sample, cov_ledoit_wolf = _cov("sample"), _cov("ledoit_wolf")


_SIG = f"""with {PANEL_SQL},
f as (select date, symbol, sector, vwap, -1 * (close / lag(close) over (partition by symbol order by date)) as x from p),
wz as (select *, case when x is not null then greatest(least(x, quantile_cont(x, 0.99) over (partition by date)), quantile_cont(x, 0.01) over (partition by date)) end as z from f),
s as (select date, symbol, sector, vwap, {sql_rank('z')} as s from wz),
q as (select *, count(s) over d as n, min(s) over d as lo, max(s) over d as hi, avg(s) over d as m, row_number() over (partition by date order by s nulls last, symbol) - 1 as k from s window d as (partition by date))
"""
_EQ = "case when s is not null then 1.0 else 0.0 end"
_EQ_LS = "case when s is null then 0.0 when s >= case when quantile_cont(s, 0.5) over (partition by date) > lo then quantile_cont(s, 0.5) over (partition by date) else m end then 1.0 else -1.0 end"


def _scaled(raw: str, ls: bool = False) -> str:
    if not ls:
        return f"select date, symbol, round(coalesce(greatest(a, 0) / nullif(sum(greatest(a, 0)) over (partition by date), 0), 0), 7) + 0.0 as weight from (select date, symbol, {raw} as a from q)"
    return f"select date, symbol, round(coalesce(greatest(a, 0) * 0.5 / nullif(sum(greatest(a, 0)) over (partition by date), 0), 0) - coalesce(greatest(-a, 0) * 0.5 / nullif(sum(greatest(-a, 0)) over (partition by date), 0), 0), 7) + 0.0 as weight from (select date, symbol, {raw} as a from q)"


_QUINT = f"case when n < 5 then {_EQ} when s is not null and floor(k * 5 / n) >= 4 then 1.0 else 0.0 end"
_DECILE_LS = f"case when n < 10 then {_EQ_LS} when s is null then 0.0 when floor(k * 10 / n) >= 9 then 1.0 when floor(k * 10 / n) < 1 then -1.0 else 0.0 end"
# With at most 25 names a quintile holds at least 4 of them: a cap of 0.25 never binds on equal weights, but it does on 3.
_NAV = _SIG + f""",
w as (select date, symbol, a / sum(a) over (partition by date) as w0 from (select date, symbol, {_QUINT} as a from q) where a > 0),
w1 as (select date, symbol, least(w0, 0.25) as w from w),
days as (select date, lead(date) over (order by date) as nxt, last_value(date) over (partition by date_trunc('month', date) order by date rows between unbounded preceding and unbounded following) as month_end from (select distinct date from p)),
t as (select d.nxt as date, w1.symbol, w1.w from w1 join days d on d.date = w1.date where d.date = d.month_end and d.nxt is not null),
ex as (select distinct date as seg from t),
ret as (select symbol, date, case when lag(vwap) over (partition by symbol order by date) > 0 then vwap / lag(vwap) over (partition by symbol order by date) - 1 end as r from f),
mk as (select d.date, max(e.seg) as seg from days d join ex e on e.seg < d.date group by d.date),
h as (select t.date as seg, t.symbol, t.w, mk.date, product(1 + coalesce(ret.r, 0)) over (partition by t.date, t.symbol order by mk.date) as g
  from t join mk on mk.seg = t.date left join ret on ret.symbol = t.symbol and ret.date = mk.date),
v as (select seg, date, 1 + sum(w * (g - 1)) as f from h group by all),
bk as (select h.date, h.symbol, h.w * h.g / v.f as held from h join v using (seg, date) join ex on ex.seg = h.date),
mv as (select coalesce(t.date, bk.date) as date, coalesce(t.w, 0) - coalesce(bk.held, 0) as m from t full join bk on bk.date = t.date and bk.symbol = t.symbol),
tr as (select date, sum(abs(m)) / 2 as turnover, sum(abs(m) * (0.0005 + case when m < 0 then 0.001 else 0 end)) as cost, count(*) as n_trades from mv where abs(m) > 1e-12 group by all),
ln as (select d.date, coalesce(v.f, 1) as f, tr.cost from days d left join v on v.date = d.date left join tr on tr.date = d.date),
nav as (select 'base' as run_id, date, gross_nav, gross_nav * paid as nav from (
  select date, coalesce(product(case when cost is not null then f else 1 end) over (order by date rows between unbounded preceding and 1 preceding), 1) * f as gross_nav, product(1 - coalesce(cost, 0)) over (order by date rows unbounded preceding) as paid from ln))
"""
_METRICS = _NAV + """,
bn as (select date, product(1 + m) over (order by date rows unbounded preceding) as bench from (select date, coalesce(avg(r), 0) as m from ret group by date)),
x as (select *, nav / lag(nav) over o - 1 as r, bench / lag(bench) over o - 1 as b, max(nav) over (order by date rows unbounded preceding) as pk, row_number() over o as t from nav join bn using (date) window o as (order by date)),
y as (select *, sum(case when nav < pk then 0 else 1 end) over (order by date rows unbounded preceding) as isl from x),
z as (select *, sum(case when nav < pk then 1 else 0 end) over (partition by isl) as depth from y),
a as (select arg_max(nav, date) / arg_min(nav, date) - 1 as tot, arg_max(bench, date) / arg_min(bench, date) - 1 as btot, arg_max(gross_nav, date) / arg_min(gross_nav, date) - 1 as gtot, max(t) - min(t) as span, sum(ln(1 + r)) as lr, avg(r) as mr, stddev_samp(r) as sd,
  sqrt(avg(pow(least(r, 0), 2))) as down, max(1 - nav / pk) as mdd, max(depth) as dd, avg(r - b) as ac, stddev_samp(r - b) as te, covar_samp(r, b) as cv, var_samp(b) as vb, avg(b) as mb from z)
select 'base' as run_id, round(tot, 5) as total_return, round(pow(greatest(1 + tot, 0), 252.0 / span) - 1, 5) as annual_return, round(lr, 5) as log_return, round(tot - btot, 5) as excess_return, round(mr / sd * sqrt(252), 5) as sharpe, round(mr / down * sqrt(252), 5) as sortino,
  round(mdd, 5) as max_drawdown, round((pow(greatest(1 + tot, 0), 252.0 / span) - 1) / mdd, 5) as calmar, round(ac / te * sqrt(252), 5) as information_ratio, round(te * sqrt(252), 5) as tracking_error, round(cv / vb, 5) as beta, round((mr - cv / vb * mb) * 252, 5) as alpha, round(gtot - tot, 5) as cost_drag, dd::bigint as drawdown_days from a"""
_LOG = _NAV.replace("f as (select date, symbol, sector, vwap,", "f as (select date, symbol, sector, vwap, volume,").replace("mv as (select ", "mv as (select coalesce(t.symbol, bk.symbol) as symbol, ")
_MARKET = """,
mk2 as (select date, symbol, vwap, volume / sum(volume) over (partition by date) as room, lag(vwap) over (partition by symbol order by date) as last from f)"""
_COVS = _NAV + """,
qd as (select max(date) as date from days group by date_trunc('quarter', date)),
dn as (select date, row_number() over (order by date) as k from days),
wn as (select q.date, r.symbol, r.r, n.k from qd q join dn m on m.date = q.date join dn n on n.k between m.k - 25 and m.k join ret r on r.date = n.date),
ok as (select date, symbol from wn group by all having count(r) = count(*)),
tt as (select date, count(distinct k) as t from wn group by date),
cz as (select w.date, w.symbol, w.k, w.r - avg(w.r) over (partition by w.date, w.symbol) as z from wn w join ok using (date, symbol)),
sc as (select a.date, a.symbol as a, b.symbol as b, sum(a.z * b.z) as s, any_value(t) as t from cz a join cz b on a.date = b.date and a.k = b.k and a.symbol <= b.symbol join tt on tt.date = a.date group by all)"""
_LW = _COVS + """,
tr2 as (select date, avg(s / t) as mu, any_value(t) as t from sc where a = b group by date),
far as (select sc.date, sum(case when a = b then 1 else 2 end * pow(s / sc.t - case when a = b then mu else 0 end, 2)) as far, sum(case when a = b then 1 else 2 end * pow(s / sc.t, 2)) as s2 from sc join tr2 using (date) group by sc.date),
noise as (select date, sum(pow(q, 2)) as n4 from (select date, k, sum(z * z) as q from cz group by all) group by date),
sh as (select tr2.date, mu, case when far > 0 then least(greatest((n4 - tr2.t * s2) / pow(tr2.t, 2) / far, 0), 1) else 0 end as sh from tr2 join far using (date) join noise using (date))"""
_DEC = "select *, case when s0 is not null then least(floor(k0 * 10.0 / n0), 9)::int end as decile from (select date, symbol, x as s0, row_number() over (partition by date order by x nulls last, symbol) - 1 as k0, count(x) over (partition by date) as n0 from f)"
ORACLES = {
    "portfolio_trade_log": _LOG + _MARKET + """,
j as (select mv.date, mv.symbol, m, vwap, last * 1.04 as up, last * 0.96 as dn, room * 2.0 as room from mv left join mk2 using (date, symbol) where abs(m) > 1e-12),
rs as (select *, case when vwap is null or vwap <= 0 then 'suspended' when m > 0 and vwap >= up * (1 - 1e-9) then 'limit_up' when m < 0 and vwap <= dn * (1 + 1e-9) then 'limit_down' when abs(m) > room then 'volume' end as reason from j),
fl as (select *, case when reason is null then m when reason = 'volume' then sign(m) * room else 0 end as filled from rs)
select 'base' as run_id, date, symbol, case when m > 0 then 'buy' else 'sell' end as side, round(m, 6) as wanted, round(filled, 6) + 0.0 as filled, round(m - filled, 6) + 0.0 as deferred, reason from fl""",
    "portfolio_positions": _NAV + "select 'base' as run_id, h.date, h.symbol, round(h.w * h.g / v.f, 7) as weight from h join v using (seg, date)",
    "portfolio_weekly_sample": _NAV + "select run_id, max(date) as date, round(arg_max(nav, date), 6) as nav from nav group by run_id, date_trunc('month', date)",
    "trade_status_limits": _LOG + _MARKET + " select date, symbol, coalesce(last * 1.04 > 0 and vwap >= last * 1.04 * 0.999, false) as limit_up_locked, coalesce(last * 0.96 > 0 and vwap * 0.999 <= last * 0.96, false) as limit_down_locked, case when vwap > 0 then round(last * 1.04 * 2, 6) end as up_limit, case when vwap > 0 then round(last * 0.96 * 2, 6) end as down_limit from mk2",
    "trade_costs": _LOG + _MARKET + """, c as (select date, symbol, m, case when abs(m) / nullif(room, 0) > 0 then abs(m) / nullif(room, 0) else 0 end as p, 0.00032 + case when m < 0 then 0.0005 else 0 end as r from mv join mk2 using (date, symbol) where abs(m) > 1e-12)
select 'base' as run_id, date, symbol, round(r + 0.002 * sqrt(p), 9) as sqrt, round(r + 0.002 * sqrt(p), 9) as almgren_chriss, round(r + 0.002 * p, 9) as linear, round(r, 9) as zero, round(r - 0.0003 + greatest(0.0003, 5.0 / (abs(m) * 1000000)), 9) as least, 0.00114::double as round_trip from c""",
    "rebalance_triggers": _NAV + f""", dc as ({_DEC}), md as (select seg as date, lead(seg) over (order by seg) as nxt from ex),
aw as (select md.date, md.nxt, dc.symbol, dc.decile, coalesce(t.w, 0) as w from md join dc using (date) left join t on t.date = md.date and t.symbol = dc.symbol)
select 'base' as run_id, b.date, b.symbol, abs(b.decile - a.decile)::double as rank_shift, round(abs(b.w - a.w), 6) as drift from aw a join aw b on b.date = a.nxt and b.symbol = a.symbol where abs(b.decile - a.decile) > 3 or abs(b.w - a.w) > 0.02""",
    "weights_sector_neutral": _SIG + """, w as (select date, symbol, sector, coalesce(greatest(a, 0) / nullif(sum(greatest(a, 0)) over (partition by date), 0), 0) as w from (select date, symbol, sector, case when lo = hi then case when s is not null then 1.0 else 0.0 end when s is null then 0.0 else s - lo end as a from q)),
sn as (select *, sum(abs(w)) over (partition by date) / (select count(distinct sector) from grps) as share, sum(w) over (partition by date, sector) as tot from w)
select date, symbol, round(case when tot <> 0 then w * share / tot else 0 end, 7) + 0.0 as weight from sn""",
    "weights_limited": _SIG + """, w as (select date, symbol, coalesce(greatest(a, 0) / nullif(sum(greatest(a, 0)) over (partition by date), 0), 0) as w from (select date, symbol, case when lo = hi then case when s is not null then 1.0 else 0.0 end when s is null then 0.0 else s - lo end as a from q)),
u as (select date, symbol, case when w < 0.01 then 0 else w end as w from w), c as (select *, row_number() over (partition by date order by abs(w) desc, symbol) as k from u), e as (select date, symbol, case when k <= 12 then w else 0 end as w from c)
select date, symbol, round(coalesce(w * 0.9 / nullif(sum(w) over (partition by date), 0), 0), 7) + 0.0 as weight from e""",
    "cov_sample": _COVS + " select date, a, b, round(s / (t - 1) * 10000, 5) as cov from sc join dn using (date) where dn.k > 26",
    "cov_ledoit_wolf": _LW + " select sc.date, a, b, round(((1 - sh) * s / t + case when a = b then sh * mu else 0 end) * 10000, 5) as cov from sc join sh using (date) join dn using (date) where dn.k > 26",
    "portfolio_signal": _SIG + "select date, symbol, round(s, 7) as signal from s",
    "portfolio_signal_neutral": _SIG + ", g as (select date, symbol, z - avg(z) over (partition by date, sector) as g from wz) select date, symbol, round((g - avg(g) over (partition by date)) / nullif(stddev_samp(g) over (partition by date), 0), 7) + 0.0 as signal from g",
    "weights_equal": _SIG + _scaled(_EQ),
    "weights_signal": _SIG + _scaled(f"case when lo = hi then {_EQ} when s is null then 0.0 else s - lo end"),
    "weights_quintile": _SIG + _scaled(_QUINT),
    "weights_signal_long_short": _SIG + _scaled(f"case when lo = hi then {_EQ_LS} when s is null then 0.0 else s - m end", True),
    "weights_decile_long_short": _SIG + _scaled(_DECILE_LS, True),
    "portfolio_nav": _NAV + "select run_id, date, round(nav, 6) as nav, round(gross_nav, 6) as gross_nav from nav",
    "portfolio_rebalances": _NAV + "select 'base' as run_id, date, round(turnover, 7) as turnover, round(cost, 9) as cost, n_trades from tr",
    "portfolio_monthly": _NAV + "select run_id, month, round(c / coalesce(lag(c) over (order by month), o) - 1, 6) + 0.0 as ret from (select run_id, strftime(date, '%Y-%m') as month, arg_max(nav, date) as c, arg_min(nav, date) as o from nav group by all)",
    "portfolio_trading": _NAV + "select 'base' as run_id, count(*) as n_rebalances, round(avg(turnover), 5) as mean_turnover, round(avg(turnover) * count(*) / ((max(date) - min(date)) / 365.25), 5) as annual_turnover, round(252 / (avg(turnover) * count(*) / ((max(date) - min(date)) / 365.25)), 5) as holding_days, round(sum(cost), 5) as total_cost from tr",
    "portfolio_metrics": _METRICS,
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "rebalance_churn", "weights_constrained", "portfolio_walk", "weights_risk_parity", "weights_mean_variance")}
